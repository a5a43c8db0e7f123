"""Fixed cases of the word encoder against the library, and the plan's slots when runs are dealt out in parts."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postloom.llm import packing

MODEL = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("text", [
    "<|ENDOFTEXT|> and <|endoftext|>", "a <|EndOfText|>, b", "<| <|X|>", "Word WORD word, word?! | ... Kelvin İstanbul", "x" * 500,
    "straße, STRASSE; café! CAFÉ é 中文，", "don't it's 12.5% $3|a a|b", ""])
def test_fixed_words(text):
    encoder = packing.WordEncoder(open(MODEL, encoding="utf-8").read())
    want = Tokenizer.from_file(MODEL).encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def test_plan_in_parts(spark, monkeypatch):
    """Slots are whole and gapless when every run of the plan is cut into parts of a few slots."""
    monkeypatch.setattr(packing, "PART", 7)
    rows = [(i, 0, [3, 500, 700, 1024, 2048][i % 5] + i % 2) for i in range(400)]
    pieces = spark.createDataFrame([(i, p, min(n, 2048), i) for i, p, n in rows], "doc_id long, piece int, length long, ids_crc32 long")
    out = packing.best_fit_pack(pieces).collect()
    assert sorted(r.doc_id for r in out) == list(range(400))
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_kept_encoders_are_released():
    """A worker process keeps one encoder, and none once a map that needs memory of its own begins: before, its memos stayed as long as the worker."""
    import gc
    import weakref

    import pyarrow as pa
    from postloom.llm import common

    first = weakref.ref(common.kept("a", lambda: packing.WordEncoder(open(MODEL, encoding="utf-8").read())))
    first().encode("some words")
    assert common.kept("a", lambda: None) is first()
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(common.lean(lambda batches: batches)(iter([batch]))) == [batch]
    assert first() is None and common.kept("b", lambda: 2) == 2 and common.kept("c", lambda: 3) == 3 and list(common._KEPT) == ["c"]
    gc.collect()
    common.release()
