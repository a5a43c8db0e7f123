"""Token files against the library, and the files themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postloom.llm import queries, token_files
from postloom.llm.token_files import Part, StretchEncoder, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return StretchEncoder(f.read(), 2)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aB1'!.,-_ \n\t\r\x0b\x0c\x1c\x85\xa0  　é漢\0\x01<|>")), max_size=30), max_size=5))
def test_stretches(encoder, library, texts):
    texts.append("a <|endoftext|> b")
    got = encoder.encode_all(pa.array(["skipped", *texts], pa.string())[1:])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def table(rows, library, end):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, at, ids))
        at += len(ids)
    return out


def test_files(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "LEAST_BYTES", 2000)
    rng = random.Random(5)
    rows = [(i, " ".join(f"word{rng.randrange(900)}" for _ in range(rng.randrange(200)))) for i in rng.sample(range(-50, 5000), 60)]
    rows += [(7000, ""), (7001, None), (None, "no id"), (7002, "long " * 70_000), (7003, "Ünï\n\n  ß 漢字")]
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, ids binary, part int").repartition(4)
    folder = str(tmp_path / "tokens")
    write_token_files(docs, folder, PATH, end_id=2)
    got = [(r.doc_id, r.start, r.ids) for r in read_token_files(spark, folder).orderBy("start").collect()]
    assert got == table(rows, library, 2)
    parts = spark.read.parquet(f"{folder}/parts.parquet").orderBy("part").collect()
    assert len(parts) > 1 and [p.first_id for p in parts] == np.cumsum([0] + [p.ids for p in parts[:-1]]).tolist()
    assert sum((tmp_path / "tokens" / f"{p.part:05d}.bin").stat().st_size for p in parts) == 2 * sum(p.ids for p in parts)
    last = Part(folder, parts[-1].part, 2)
    assert last[len(last) - 1].tolist() == got[-1][2] and len(last) == parts[-1].documents
    assert not [f for f in (tmp_path / "tokens").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_repeated_rows_and_text_ids(spark, library, tmp_path):
    rows = [("b", "two words"), ("a", "one"), ("b", "two words"), ("b", "another text"), ("c", None)]
    folder = f"file://{tmp_path}/tokens"
    write_token_files(spark.createDataFrame(rows, "doc_id string, text string"), folder, PATH, end_id=70_000)  # four bytes an id
    got = read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == ["a", "b", "b", "b", "c"]
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((i, (*library.encode(t or "").ids, 70_000)) for i, t in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, PATH, end_id=2)
    assert read_token_files(spark, folder).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op12_token_files(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, ids in table(rows, library, 2)]
