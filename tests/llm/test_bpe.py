import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from recordloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_report_equals_the_library(docs, texts, none, same):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    expected = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    same(bpe.token_report(docs), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], expected)
    assert bpe.token_report(none).count() == 0


def test_odd_strings_equal_the_library():
    library, own = Tokenizer.from_file(PATH), bpe.Encoder(bpe.read_vocabulary(PATH))
    rng = random.Random(3)
    alphabet = "aabbee' \t\n\x1c\x85\xa0's't'reıİΣσςßéÉ́ñÑ中ǅﬁ①²٣🙂…!!?? 　"
    strings = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    strings += ["a" * k for k in range(60)] + ["ab" * k for k in range(30)] + ["x<|endoftext|>y <|startoftext|>", "<|notspecial|>", "they'LL it's"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(strings)] == [e.ids for e in library.encode_batch(strings, add_special_tokens=False)]


def test_ids_come_back_as_tokens(spark, odd):
    rows = bpe.decode(bpe.encode(odd.where("doc_id in (1, 2, 13)"))).select("doc_id", "ids", "decoded").collect()
    assert {r.doc_id: (len(r.ids), r.decoded) for r in rows} == {1: (0, ""), 2: (0, ""), 13: (4, "word</w>")}


def test_one_worker_codes_both_ways(odd):
    rows = odd.select("doc_id", "text")
    both = bpe.encode_decode(rows)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    for plan in (both, bpe.token_report(rows)):
        assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [code(") == 1
        assert "ArrowEvalPython [encode(" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, both.collect())) == sorted(map(str, bpe.decode(bpe.encode(rows)).collect()))
