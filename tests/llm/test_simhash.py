import random
import re

import numpy as np
import xxhash

from recordloom.llm import graphs, simhash as S


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, bits=4):
    prints, root = list(prints), {}
    for p in prints:
        root[p] = p

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_report_equals_brute_force(docs, texts, none, same):
    prints = [(i, plain_print(t)) for i, t in texts]
    roots = plain_roots({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    same(S.duplicates_report(docs), ["doc_id", "fingerprint", "component_id"], [(i, f"{p:016x}", least.get(roots[p])) for i, p in prints])
    assert S.duplicates_report(none).count() == 0


def near_prints(rng, groups, size):
    out = set()
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            p = centre
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            out.add(p)
    return sorted(out)


def test_links_keep_every_component_and_crowded_anchors_are_cut(spark, monkeypatch):
    rng = random.Random(5)
    prints = near_prints(rng, 25, 12) + near_prints(rng, 1, 300)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    expected = plain_roots(signed)
    for limit in (2000, 7):
        monkeypatch.setattr(S, "CELL_ROWS", limit)
        links = S.near_links(frame)
        assert links.where("bit_count(a ^ b) = 0").count() == 0
        found = {r.node: r.root for r in graphs.components(links).collect()}
        assert {p: found.get(p, p) for p in signed} == expected


def test_every_pair_within_four_bits_meets_at_a_home():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        who, keys = S.anchors(np.array([a, b], np.uint64).view(np.int64))
        homes = {k >> 1 for w, k in zip(who.tolist(), keys.tolist(), strict=True) if w == 0 and not k & 1}
        assert homes & {k >> 1 for w, k in zip(who.tolist(), keys.tolist(), strict=True) if w == 1}


def test_chains_reach_their_smallest_node(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in graphs.components(chain).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert graphs.components(chain.where("false")).count() == 0
