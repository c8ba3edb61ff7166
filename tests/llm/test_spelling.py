import random
import re
import zlib
from collections import Counter, defaultdict

from recordloom.llm import spelling as S

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def low(run):
    return re.sub("[A-Z]", lambda m: m[0].lower(), run)


def counted_words(texts):
    counts = Counter()
    for i, t in texts:
        for run in map(low, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    """All words with one letter left out, or marked as any letter, name the words near each other."""
    shapes = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            shapes[w[:k] + "*" + w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in counts:
                shapes[w, k] = {w, w[:k] + w[k + 1 :]}
    near = defaultdict(set)
    for group in shapes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n, len(near[w]), counts.get(form[w])


def test_report_equals_brute_force(docs, texts, none, same):
    same(S.spelling_report(docs.withColumn("word", docs["doc_id"])), COLUMNS, brute(counted_words(texts)))
    assert S.spelling_report(none).count() == 0


def test_report_on_the_next_table(spark, same):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    same(S.spelling_report(table), COLUMNS, brute(counted_words(texts)))


def test_chains_ties_long_words_and_marks(spark, same):
    counts = {"étésx": 3, "étésxy": 6, "étésxyz": 12, "étésxyza": 24, "aaaaa": 5, "aaaab": 10, "aaaac": 10, "aaaaaa": 11, "a" * 9000: 3, "a" * 9001: 9, "×÷abc": 4, "×÷×abc": 8}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    same(S.variants(frame), COLUMNS, brute(counts))


def edited(rng, word, letters):
    k = rng.randrange(len(word) + 1)
    return rng.choice([word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1 :], word[:k] + word[k + 1 :]])


def test_no_edit_takes_more_grams_than_the_bound_and_near_words_meet():
    rng = random.Random(7)
    for letters, parts in (("ab", 3), ("abc", 3), ("abcdefgh", 40)):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 14))) for _ in range(parts * 40)}
        counts = Counter(m[a : a + q] for w in words for m in [S.OPEN + w + S.CLOSE] for q in range(2, 7) for a in range(len(m) - q + 1))
        for frequent in (1, 5, 30, 200):
            known, prefixes, inner = dictionary = S.pruned({g: n for g, n in counts.items() if n > frequent / 16}, frequent)
            for w in list(words)[:150]:
                other = edited(rng, w, letters)
                if len(other) < 5 or other == w:
                    continue
                marks = [S.OPEN + x + S.CLOSE for x in (w, other)]
                grams = [S.decompose(m, known) for m in marks]
                told = [Counter(m[a:b] for a, b in g) for m, g in zip(marks, grams, strict=True)]
                shared = (told[0] & told[1]).total()
                for m, g in zip(marks, grams, strict=True):
                    assert shared >= len(g) - S.affected(m, g, prefixes, inner)
                a, b = sorted((w, other), key=len)
                home, (home_b, visit_b, _) = S.postings(a, dictionary)[0], S.postings(b, dictionary)
                assert set(home) & set(home_b if len(a) == len(b) else visit_b)
