"""Spelling variants by an index of variable-length grams.

The words of a corpus and how often they occur are counted first. A dictionary of grams is then grown over the distinct words:
grams of two letters always count, and a longer one enters if its prefix is frequent (lists of the prefix would be long) and
it is not too rare itself. A word, between two marks, is decomposed by the longest gram at each place, less those inside one before.

For every word the most grams that one edit can take away are found (``affected``): those that hold the edited letter, those that a
longer gram might replace, and those that a new gram might cover. Of n grams, n - affected stay in every near word, so two
near words share one of their affected + 1 rarest grams; only those are put on lists, by gram, length and place, and lists are merged
word by word. A word that may lose all its grams also lists its halves, one of which every edit leaves alone. Merged pairs are
verified by their edit distance.

The dictionary is bounded by its shares (``FREQUENT`` and ``LEAST`` parts of all places, so at most ``LEAST`` grams of each length),
and only it is sent to all executors. Distances count code points.

Results for odd input: a null or empty text has no words; a null doc_id counts as an empty one where words are damaged; repeated
rows count as often as they stand there; ties of forms go to the smallest word in code-point order; other columns are not read;
an empty table gives an empty result; texts and words of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 5, 3
#: Longest gram; a gram is extended if it stands at more than one in FREQUENT places, by grams that stand at one in LEAST or more.
LONGEST, FREQUENT, LEAST = 6, 4096, 65536
OPEN, CLOSE = "\x02", "\x03"

Dictionary = tuple[dict[str, int], set[str], set[str]]  # grams with the rank of their lists, proper prefixes, inner parts


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, run): every run of letters, A-Z lower-cased."""
    run = F.explode(F.split(F.col(text).cast("string"), f"[^{LETTERS}]+"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", upper, upper.lower()))
    return docs.select(F.col(key).alias("key"), run.alias("run")).where("run <> ''").select("key", low.alias("run"))


def misspelt(key: Column, run: Column, share: int = 97) -> Column:
    """``run`` without one of its letters, where a checksum of both says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(h % share == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words in column ``word`` that are long and frequent enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def gram_dictionary(vocab: DataFrame, longest: int = LONGEST) -> Dictionary:
    """Grow the dictionary over the distinct words. The driver gets no more than LEAST grams of each length."""
    marked = F.concat(F.lit(OPEN), F.col("word"), F.lit(CLOSE))
    size = F.length("marked")
    at_place = lambda q: F.transform(F.sequence(F.lit(1), size - (q - 1)), lambda p: F.substring(F.col("marked"), p, F.lit(q)))
    lists = [F.when(size >= q, at_place(q)).otherwise(F.array().cast("array<string>")) for q in range(2, longest + 1)]
    grams = vocab.select(marked.alias("marked")).select(F.explode(F.flatten(F.array(*lists))).alias("gram"))
    places = vocab.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    counts = {r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= places / LEAST).collect()}
    return pruned(counts, places / FREQUENT)


def pruned(counts: dict[str, int], frequent: float) -> Dictionary:
    """Grams of three letters and more whose prefix is frequent, and what is left on each list once longer grams took their words."""
    kept = {g for g in counts if len(g) > 2 and counts.get(g[:-1], 0) > frequent}
    left = {g: n for g, n in counts.items() if len(g) == 2 or g in kept}
    for g in kept:
        if g[:-1] in left:
            left[g[:-1]] -= counts[g]
    prefixes = {g[:q] for g in kept for q in range(2, len(g))}
    inner = {g[a:b] for g in kept for a in range(1, len(g) - 1) for b in range(a + 2, len(g) + 1)}
    return left, prefixes, inner


def decompose(marked: str, known: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of the variable grams: the longest known one at each place, unless one before reaches as far."""
    grams, reached, size = [], 0, len(marked)
    for a in range(size - 1):
        b = a + 2
        while b < size and marked[a : b + 1] in known:  # every prefix of a known gram is known
            b += 1
        if b > reached:
            grams.append((a, b))
            reached = b
    return grams


def affected(marked: str, grams: list[tuple[int, int]], prefixes: set[str], inner: set[str]) -> int:
    """The most grams that one edit can take away.

    An edit at place i deletes or replaces the letter there or puts one before it. It takes away grams that hold the place, a gram
    ending there that some longer gram begins with, and later grams that a new gram over the place might cover.
    """
    change = [0] * (len(marked) + 1)
    for a, b in grams:
        low, high = a, b if marked[a:b] in prefixes else b - 1
        while low > 1 and marked[low:b] in inner:
            low -= 1
        change[max(low, 1)] += 1
        change[min(high, len(marked) - 1) + 1] -= 1
    most = now = 0
    for step in change:
        now += step
        most = max(most, now)
    return most


def postings(word: str, dictionary: Dictionary) -> tuple[list[int], list[int], int]:
    """Hashed keys of the lists where a word is at home, of those of words one letter shorter that it visits, and a mask of its letters."""
    import xxhash

    known, prefixes, inner = dictionary
    marked, size = OPEN + word + CLOSE, len(word)
    grams = decompose(marked, known)
    lost = affected(marked, grams, prefixes, inner)
    if lost < len(grams):
        ranked = sorted((known.get(marked[a:b], 0), marked[a:b], a) for a, b in grams)
        grams = [(a, a + len(g)) for _, g, a in ranked[: lost + 1]]
        halves = []
    else:
        halves = [(size, word), (size - 1, word)]
    home = [f"{marked[a:b]}|{size}|{a}" for a, b in grams]
    visit = [f"{marked[a:b]}|{size - 1}|{p}" for a, b in grams for p in (a, a - 1) if p >= 0]
    for n, w in halves:
        (home if n == size else visit).extend((f"<{w[: n // 2]}|{n}", f">{w[len(w) - (n - n // 2) :]}|{n}"))
    mask = 0
    for c in word:
        mask |= 1 << (ord(c) & 63)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(xxhash.xxh64_intdigest(k)) for k in home], [signed(xxhash.xxh64_intdigest(k)) for k in visit], signed(mask)


def listed(vocab: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(word, n, mask, home, visit): each word with the lists that it stands on."""
    shared = vocab.sparkSession.sparkContext.broadcast(dictionary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            homes, visits, masks = [], [], []
            for word in batch["word"].to_pylist():
                home, visit, mask = postings(word, known)
                homes.append(home)
                visits.append(visit)
                masks.append(mask)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (homes, visits)]
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(masks, pa.int64()), *lists], ["word", "n", "mask", "home", "visit"])

    return vocab.select("word", "n").mapInArrow(index, "word string, n long, mask long, home array<long>, visit array<long>")


def near_words(vocab: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words that differ by one inserted, deleted or replaced code point, once each."""
    indexed = stored(listed(vocab, gram_dictionary(vocab)), "grams")
    home = indexed.select(F.explode("home").alias("list"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("mask").alias("mask_a"))
    either = F.explode(F.concat(F.transform("home", lambda k: F.struct(k.alias("list"), F.lit(False).alias("longer"))), F.transform("visit", lambda k: F.struct(k.alias("list"), F.lit(True).alias("longer")))))
    other = indexed.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("mask_b"), either.alias("at")).select("at.list", "at.longer", "b", "n_b", "mask_b")
    merged = home.join(other, "list").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2) & (F.levenshtein("a", "b", 1) == 1))
    return merged.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where following forms ends, by pointer jumping; rounds are the logarithm of the longest chain."""
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        jumped = stored(state.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        state = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return state


def variants(vocab: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n): a word's form is its most frequent near word, if at least twice as frequent."""
    vocab = stored(vocab.select("word", "n"), "vocabulary")
    pairs = near_words(vocab)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("n_near")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("n_near")))
    both = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = F.min(F.struct((-F.col("n_near")).alias("rank"), F.col("near").alias("form")))
    near = stored(both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    judged = vocab.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.rank") >= 2 * F.col("n"), -F.col("best.rank")))
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "form_n")
    judged = stored(judged, "forms")
    found = judged.join(roots(judged.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_report(docs: DataFrame) -> DataFrame:
    """The variants among the words of the contract, some of which lost a letter."""
    words = runs(docs).select(misspelt(F.col("key"), F.col("run")).alias("word"))
    return variants(vocabulary(words)).select("word", "form", "root", "n", "n_near", "form_n")
