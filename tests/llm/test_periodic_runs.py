"""Runs against the definition: every stretch, its smallest period, no longer neighbour."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postloom.llm import periodic_runs as pr
from postloom.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_definition(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            smallest = next(p for p in range(1, q + 1) if all(words[k] == words[k + p] for k in range(start, start + length - p)))
            if smallest == q and length >= max(6, 4 * q):
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=4), st.integers(1, 9)), max_size=8))
def test_find(blocks):
    words = [w for unit, times in blocks for w in unit * times]
    assert pr.find_runs(np.array(words, np.int64)) == by_definition(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=8, max_size=120), st.sampled_from([0, 1, 4, 10**9]), st.sampled_from([1, 50, 1 << 20]))
def test_counts(words, heavy, held):
    """Heavy and light words give the same counts, wherever the border lies."""
    was, pr.HEAVY, pr.HELD = (pr.HEAVY, pr.HELD), heavy, held
    try:
        most = len(words) // 4
        got = pr.lag_counts(np.array(words, np.int64), most)
    finally:
        pr.HEAVY, pr.HELD = was
    assert got.tolist() == [0] + [sum(a == b for a, b in zip(words, words[q:], strict=False)) for q in range(1, most + 1)]


def test_long_texts():
    rng = np.random.default_rng(1)
    codes = rng.zipf(1.3, 200_000) % 5000
    codes[70_000:90_000] = np.tile(codes[70_000:70_500], 40)
    assert [s <= 70_000 and s + n >= 90_000 for s, n, q in pr.find_runs(codes) if q == 500] == [True]
    assert pr.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert pr.find_runs(np.tile(np.arange(7), 40_000)) == [(0, 280_000, 7)]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_short(n):
    assert pr.find_runs(np.zeros(n, np.int64)) == []


def rows():
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["a", "b", "a b", "c d a"]) + " " + rng.choice(["a b ", "c ", "d e f "]) * rng.randrange(9) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["go " * 50, "x y z\n" * 30 + "end", None, "", "  \n", "one", "ä ö " * 9, "long tail " * 20_000]
    return [*enumerate(texts), (3, texts[4]), (3, texts[4]), (None, "a b " * 10)]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_definition(words) if n < 3000 else [(0, n, 2)]
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    text = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), n)


def test_query(spark, tmp_path):
    spark.createDataFrame([(*r, 1, "x") for r in rows()], "doc_id long, text string, runs int, words string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()))
    want = collections.Counter(expected(*r) for r in rows())
    assert got == want
    assert any(r[1] > 1 for r in want)


def test_operator(spark):
    docs = spark.createDataFrame([("k", "x y " * 6 + "z"), ("e", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in pr.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got["k"].runs] == [(0, 12, 2)] and got["k"].collapsed == "x y z" and got["e"].runs == [] and got["e"].collapsed == ""
    assert pr.periodic_runs(docs.where("false")).count() == 0
