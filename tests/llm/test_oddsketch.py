import random
import re
from collections import defaultdict

import numpy as np
import pytest

from recordloom.llm import oddsketch as O


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(texts):
    """Rows of the report, by comparing each set with all that share a shingle with it."""
    sets = [plain_set(t) for _, t in texts]
    holders = defaultdict(set)
    for s in set(sets):
        for x in s:
            holders[x].add(s)
    root = {s: s for s in set(sets)}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for s in root:
        for o in set().union(*[holders[x] for x in s]) if s else ():
            if 100 * len(s & o) >= 80 * len(s | o):
                root[find(s)] = find(o)
    least = {}
    for (i, _), s in zip(texts, sets, strict=True):
        if i is not None and s:
            least[find(s)] = min(i, least.get(find(s), i))
    for (i, _), s in zip(texts, sets, strict=True):
        top = least.get(find(s)) if s else i
        yield i, len(s), top, i == top


COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def test_report_equals_brute_force(docs, texts, none, same):
    same(O.duplicates_report(docs.withColumn("size", docs["n_chars"])), COLUMNS, brute(texts))
    assert O.duplicates_report(none).count() == 0


def near_copies(rng, copies, length, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"v{rng.randrange(5000)}"
        yield " ".join(words)


@pytest.mark.parametrize("cell", [2000, 9])
def test_groups_around_the_threshold_lose_no_link(spark, same, monkeypatch, cell):
    """Short and long sets whose likeness lies on both sides of the threshold; with small cells bands are cut."""
    rng = random.Random(8)
    rows = [t for length, copies, edits in ((5, 30, 1), (12, 40, 2), (60, 60, 4), (150, 150, 8), (400, 40, 14)) for t in near_copies(rng, copies, length, edits)]
    rng.shuffle(rows)
    rows = [(n, t) for n, t in enumerate(rows)]
    monkeypatch.setattr(O, "CELL_ROWS", cell)
    monkeypatch.setattr(O, "HUBS", 1 if cell == 9 else O.HUBS)
    same(O.duplicates_report(spark.createDataFrame(rows, "doc_id long, text string")), COLUMNS, brute(rows))


def test_sketches_never_rule_a_link_out_and_tell_unlike_sets():
    rng = np.random.Generator(np.random.PCG64(1))
    for shared, a, b in ((450, 50, 50), (16, 2, 2), (900, 5, 5), (800, 200, 0), (1600, 200, 200), (8000, 1000, 1000), (8000, 2000, 0)):
        for _ in range(40):
            common, x, y = (rng.integers(0, 1 << 63, n, np.uint64) for n in (shared, a, b))
            sketches = [O.odd_sketch(np.unique(np.r_[common, own])).view(np.uint64) for own in (x, y)]
            assert np.bitwise_count(sketches[0] ^ sketches[1]).sum() <= O.most_bits(shared + a, shared + b)
    for shared, own in ((150, 50), (400, 110), (900, 400)):
        for _ in range(40):
            common, x, y = (rng.integers(0, 1 << 63, n, np.uint64) for n in (shared, own, own))
            sketches = [O.odd_sketch(np.unique(np.r_[common, z])).view(np.uint64) for z in (x, y)]
            assert np.bitwise_count(sketches[0] ^ sketches[1]).sum() > O.most_bits(shared + own, shared + own)


def test_bands_meet_as_often_as_theory_says():
    rng = np.random.Generator(np.random.PCG64(2))
    met = 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (16, 2, 2))
        keys = [O.band_keys(O.samples(np.r_[common, x])) for x in (a, b)]
        met += bool((keys[0] == keys[1]).any())
    assert met == 300
