import hashlib
import random

import numpy as np

from recordloom.llm import substrings as B


def brute(texts):
    last = B.LAST
    least = {}
    for i, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(last if i is None else i, least.get(w, last))
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < (last if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def test_report_equals_brute_force(docs, texts, none, same):
    same(B.repeats_report(docs.repartition(3)), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute(texts))
    assert B.repeats_report(none).count() == 0


def test_windows_are_sorted_at_every_depth():
    rng = random.Random(2)
    base = bytes(rng.choice(b"ab") for _ in range(80))
    data = b"".join(base[: rng.randint(20, 80)] + bytes(rng.choice(b"abc") for _ in range(30)) for _ in range(120))
    text = np.frombuffer(data, np.uint8)
    starts = np.array(rng.sample(range(len(data) - 50), 2000))
    plain = sorted(data[s : s + 50] for s in starts.tolist())
    for shallow in (0, 8, 32, 64):
        order, same = B.sorted_windows(text, starts, shallow=shallow)
        found = [data[s : s + 50] for s in starts[order].tolist()]
        assert found == plain
        assert same.tolist() == [k > 0 and found[k] == found[k - 1] for k in range(len(found))]


def test_markers_are_the_least_hash_of_each_window():
    text = np.frombuffer(random.Random(4).randbytes(400), np.uint8)
    whole = B.markers(text)
    assert len(whole) == 351
    assert all(B.markers(text[p : p + 50])[0] == whole[p] for p in range(0, 351, 7))
