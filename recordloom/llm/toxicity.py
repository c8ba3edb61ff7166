"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over all letter triples that both have in order, the decay to the power of the stretches that the
triples take up; a gap or an inserted character lengthens a stretch and so lowers the kernel a little, it does not break it.
Landmarks are words of labelled sentences; the kernel to them, whitened by the kernel among them, gives each word a short
vector. A sentence counts by its worst word, a text by its worst words, and the machine is fitted so: labelled texts say
only that some sentence is toxic, so each round takes the sentences of toxic texts that seem toxic, the worst one where none
does, and the worst and usual words of clean sentences, and fits again. As the kernel is a sum over triples, the fitted sum over landmarks folds into one weight per
triple, and scoring a word costs one look-up per triple.

Results for odd input: null and empty texts have no word and get the score of a text that is as clean as can be; labels with a
null in them are left out and repeated ones count again; without labels of both classes every score is 0; repeated rows get
equal scores; other columns are not read; an empty table gives an empty result. Texts of any length are scored whole.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import hashed_sample, small_batches, stored

DECAY, SPAN = 0.6, 6
#: Letters other than a-z share the codes behind them.
ALPHABET = 40
#: Labelled texts, and sentences of each class, in the fit at most; chosen by hashes. Longer sentences are cut into pieces.
FIT_TOXIC, FIT_CLEAN, FIT_SENTENCES, SENTENCE_WORDS = 2500, 7500, 40_000, 30
LANDMARKS, USUAL_WORDS, ROUNDS, RIDGE = 128, 4000, 5, 3e-5
CHUNK, KERNEL_CHUNK = 20_000, 1000
#: How much oftener than by chance a word must stand in toxic texts to be held toxic at the start.
STRONG = 4.0
#: Distinct words of a text, the worst ones, that its probability depends on.
WORST = 2
SPACED = re.compile(r"(?<!\w)\w(?:[\W_]{1,2}\w(?!\w)){2,}")


def units(text: str | None) -> list[str]:
    """The words of a text, and letters that stand singly in a row as one word with gaps."""
    low = (text or "").lower()
    return low.split() + [m[0] for m in SPACED.finditer(low)]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight), each pair of word and triple once; only letters form triples, all characters take up places."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    word, place = np.repeat(np.arange(len(words)), length), np.arange(length.sum())
    letter = ((chars >= 97) & (chars <= 122)) | (chars >= 0xC0)
    word, place, chars = word[letter], place[letter], chars[letter]
    code = np.where(chars < 128, chars - 97, 26 + chars % (ALPHABET - 26))
    keys, weights = [], []
    for b in range(2, SPAN):
        stretch = place[b:] - place[:-b]
        good = np.flatnonzero((word[b:] == word[:-b]) & (stretch < SPAN))
        for a in range(1, b):
            triple = (code[good] * ALPHABET + code[good + a]) * ALPHABET + code[good + b]
            keys.append(word[good] * ALPHABET**3 + triple)
            weights.append(DECAY ** (stretch[good] + 1.0))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key // ALPHABET**3, key % ALPHABET**3, np.bincount(at, np.concatenate(weights), len(key))


def word_margins(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of ``weights`` over each word's triples, the word scaled to length 1."""
    out = [np.empty(0)]
    for low in range(0, len(words), CHUNK):
        part = words[low : low + CHUNK]
        word, triple, value = triples(part)
        norm = np.sqrt(np.bincount(word, value * value, len(part)))
        out.append(np.bincount(word, value * weights[triple], len(part)) / np.maximum(norm, 1e-12))
    return np.concatenate(out)


def kernel_rows(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel of each word to each landmark, whose triples are the columns of ``landmarks``."""
    out = np.zeros((len(words), landmarks.shape[1]))
    for low in range(0, len(words), KERNEL_CHUNK):
        part = words[low : low + KERNEL_CHUNK]
        word, triple, value = triples(part)
        if len(word):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            norm = np.sqrt(np.add.reduceat(value * value, first))
            out[low + word[first]] = np.add.reduceat(landmarks[triple] * value[:, None], first) / norm[:, None]
    return out


@dataclass
class Machine:
    """One weight per triple, the offset, and the slopes and shift that turn a text's worst margins into a probability."""

    weights: np.ndarray
    offset: float
    slopes: tuple[float, ...] = (1.0,) + (0.0,) * (WORST - 1)
    shift: float = 0.0
    fitted: bool = True


def solve(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton's method; the last column of ``z`` is 1."""
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(z.shape[1] - 1, RIDGE), 1e-9] * cost.sum()
    for _ in range(25):
        held = y * (z @ w) < 1
        zh, ch = z[held], cost[held]
        step = np.linalg.solve((zh * ch[:, None]).T @ zh + np.diag(keep), (zh * (ch * y[held])[:, None]).sum(axis=0)) - w
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def spellings(word: str) -> list[str]:
    """A word with a gap behind each letter, with one gap, and with a letter doubled."""
    half = len(word) // 2
    return [".".join(word), word[:half] + "*" + word[half:], word[:half] + word[half : half + 1] + word[half:]]


def fit_machine(sentences: list[tuple[int, int, list[str]]]) -> Machine | None:
    """``sentences``: (text, label of the text, words). None without both classes."""
    number: dict[str, int] = {}
    bags = [(doc, label, [number.setdefault(w, len(number)) for w in set(words)]) for doc, label, words in sentences]
    bags = [(doc, label, ws) for doc, label, ws in bags if ws]
    if len({label for _, label, _ in bags}) < 2:
        return None
    words = list(number)
    toxic, clean = Counter(), Counter()
    for _, label, ws in bags:
        (toxic if label else clean).update(ws)
    texts = Counter(n for _, n in {(doc, n) for doc, label, ws in bags if label for n in ws})
    total = [sum(label == side for _, label, _ in bags) for side in (0, 1)]
    odds = np.array([np.log((toxic[n] + 0.5) / (total[1] + 1)) - np.log((clean[n] + 0.5) / (total[0] + 1)) for n in range(len(words))])
    heard = np.array([texts[n] for n in range(len(words))])
    strength = np.where(heard >= 2, np.maximum(odds - 1, 0) * np.sqrt(heard), 0.0)
    worst = np.argsort(-strength, kind="stable")[: LANDMARKS * 2 // 3]
    usual = Counter(dict(clean.most_common(USUAL_WORDS)))
    chosen = [words[n] for n in dict.fromkeys([*worst.tolist(), *[n for n, _ in usual.most_common(LANDMARKS // 3)]])]
    columns = np.zeros((ALPHABET**3, len(chosen)), np.float32)
    word, triple, value = triples(chosen)
    norm = np.sqrt(np.bincount(word, value * value, len(chosen)))
    columns[triple, word] = value / norm[word]
    columns = columns[:, norm > 0]
    among = columns.T @ columns
    size, axes = np.linalg.eigh(among.astype(float))
    whiten = (axes / np.sqrt(np.maximum(size, 1e-6))) @ axes.T
    margin, seen = strength - STRONG, {}

    def vectors(names: list[int]) -> np.ndarray:
        new = [n for n in dict.fromkeys(names) if n not in seen]
        for n, row in zip(new, kernel_rows([words[n] for n in new], columns) @ whiten, strict=True):
            seen[n] = row
        return np.stack([seen[n] for n in names])

    machine = None
    for _ in range(ROUNDS):
        best: dict[int, tuple[float, int]] = {}
        hard, positive, sure = Counter(), Counter(), set()
        for doc, label, ws in bags:
            top = max(ws, key=margin.__getitem__)
            if not label:
                hard[top] += 1
            elif margin[top] > 0 and strength[top] > STRONG:
                positive[top] += 1
                sure.add(doc)
            else:
                best[doc] = max(best.get(doc, (-np.inf, -1)), (margin[top], top))
        # A word counts for either side as often as it stands there, so a common word that tops a toxic text stays clean.
        positive.update(n for doc, (_, n) in best.items() if doc not in sure)
        negative = usual | hard
        # Each toxic word counts once more with gaps and with inserted letters.
        spelled = [(v, k / 3) for n, k in positive.items() for v in spellings(words[n])]
        names = [*positive, *negative]
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative)), np.ones(len(spelled))]
        cost = np.array([*positive.values(), *negative.values(), *[k for _, k in spelled]], float)
        cost[y > 0] *= cost[y < 0].sum() / cost[y > 0].sum() / 3
        z = np.vstack([vectors(names), kernel_rows([v for v, _ in spelled], columns) @ whiten])
        w = solve(np.hstack([z, np.ones((len(z), 1))]), y, cost)
        machine = Machine((columns @ (whiten @ w[:-1])).astype(np.float32), float(w[-1]))
        margin = word_margins(words, machine.weights) + machine.offset
    return machine


def training_labels(labels: DataFrame) -> DataFrame:
    """At most ``FIT_TOXIC`` + ``FIT_CLEAN`` labelled ids of the part that is not held out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    toxic, clean = own.where("toxic = 1"), own.where("toxic = 0")
    return hashed_sample(toxic, FIT_TOXIC, "doc_id", "toxic").union(hashed_sample(clean, FIT_CLEAN, "doc_id", "toxic"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sentences(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, toxic, words) of each sentence of the chosen texts, at most ``FIT_SENTENCES`` per class."""
    pieces = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[.!?\n]+")
    # The labelled ids are bounded by FIT_TOXIC and FIT_CLEAN.
    split = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.explode(pieces).alias("s"))
    words = split.select("doc_id", "toxic", F.filter(F.split("s", r"\s+"), lambda w: F.length(w).between(3, 60)).alias("w")).where("size(w) > 0")
    cut = words.select("doc_id", "toxic", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / SENTENCE_WORDS).cast("int")), lambda i: F.slice("w", i * SENTENCE_WORDS + 1, SENTENCE_WORDS))).alias("words"))
    rows = stored(cut.where("toxic IN (0, 1)"), "sentences")
    return hashed_sample(rows.where("toxic = 1"), FIT_SENTENCES, "words", "doc_id").union(hashed_sample(rows.where("toxic = 0"), FIT_SENTENCES, "words", "doc_id"))


def margin_column(docs: DataFrame, machine: Machine):
    """A column function: the margins of the worst distinct words of a text, the worst first. The machine is broadcast; its size is fixed by the alphabet."""
    # Broadcasts are pickled by name, so only plain arrays and numbers go into them: workers may lack this package.
    shared = docs.sparkSession.sparkContext.broadcast((machine.weights, machine.offset))
    small_batches(docs.sparkSession, "4m")

    def margins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, offset = shared.value
        for batch in batches:
            seen: set[str] = set()
            for text in batch:
                seen.update(units(text.as_py()))
            words = [w for w in seen if len(w) >= 3]
            known = dict(zip(words, (word_margins(words, weights) + offset).tolist(), strict=True))
            lowest = -1.0 + min(offset, 0.0)
            none = [lowest] * WORST
            tops = [heapq.nlargest(WORST, none + [known.get(w, lowest) for w in set(units(text.as_py()))]) for text in batch]
            yield pa.array(tops, pa.list_(pa.float64()))

    margins.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(margins, "array<double>")


def calibrated(machine: Machine, margins: np.ndarray, y: np.ndarray) -> Machine:
    """Slopes and shift of the logistic curve over the margins of labelled texts."""
    x = np.hstack([np.clip(margins, -1.0, 1.0), np.ones((len(margins), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([1.0] * WORST + [1e-6])
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (t - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Machine(machine.weights, machine.offset, tuple(map(float, w[:-1])), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """The fitted and calibrated machine; labelled sentences and the margins of labelled texts, both bounded, come to the driver."""
    chosen = training_labels(labels)
    rows = labelled_sentences(docs, chosen).toArrow()
    machine = fit_machine(list(zip(rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(), rows["words"].to_pylist(), strict=True)))
    if machine is None:
        return Machine(np.zeros(ALPHABET**3, np.float32), 0.0, fitted=False)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", margin_column(docs, machine)("text").alias("margins")).toArrow()
    return calibrated(machine, np.array(known["margins"].to_pylist()), known["toxic"].to_numpy())


def toxicity(docs: DataFrame, machine: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    if not machine.fitted:
        return docs.withColumn(into, F.lit(0.0))
    margins = margin_column(docs, machine)(F.col(text).cast("string"))
    terms = F.zip_with(margins, F.lit(list(machine.slopes)), lambda m, slope: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m)) * slope)
    total = F.aggregate(terms, F.lit(machine.shift), lambda a, b: a + b)
    return docs.withColumn(into, 1 / (1 + F.exp(-total)))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
