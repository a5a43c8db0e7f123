"""Mined negatives against all pairs in Python's own integers."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from postloom.llm import hard_negatives as hn
from postloom.llm import queries

SCHEMA = "vec_id long, label int, embedding array<double>, norm string, row int"


def brute(rows, is_anchor, k=5):
    """Rows as (vec_id, label, vector); gives a count of the result's rows."""
    whole = []
    for vec_id, label, x in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        x = [256 * v for v in x]
        if all(map(math.isfinite, x)):
            whole.append((vec_id, label, [math.floor(v) for v in x]))
    out = collections.Counter()
    for a, (anchor_id, label, u) in enumerate(whole):
        if anchor_id is None or not is_anchor(anchor_id):
            continue
        scored = sorted((-max(-hn.LIMIT, min(hn.LIMIT, sum(p * q for p, q in zip(u, v)))), math.inf if i is None else i, lab) for b, (i, lab, v) in enumerate(whole) if b != a)  # noqa: B905
        for minus, positive, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:k]
            for rank, (score, i, _) in enumerate(fits, 1):
                out[anchor_id, None if positive == math.inf else positive, rank, None if i == math.inf else i, -minus, -score] += 1
    return out


def mined(spark, rows, anchor):
    df = spark.createDataFrame([(*r, "norm", 3) for r in rows], SCHEMA).repartition(3)
    return collections.Counter(map(tuple, hn.hard_negatives(df, anchor).collect()))


def some_rows(rng, n, scale=1.0):
    return [(i, rng.randrange(3), [scale * rng.uniform(0.1, 1) for _ in range(6)]) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e6, 2e7])  # float32, float64, int64, Python's own (partly beyond 2**60)
def test_scores(spark, scale):
    rows = some_rows(random.Random(1), 120, scale)
    want = brute(rows, lambda i: i % 5 == 0)
    assert want and mined(spark, rows, F.col("vec_id") % 5 == 0) == want


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(hn, "BUCKET_BYTES", 120)
    monkeypatch.setattr(hn, "BLOCK", 7)
    rng = random.Random(2)
    rows = some_rows(rng, 80)
    rows += [rows[10], rows[10], (None, 1, rows[3][2]), (None, 2, rows[3][2]), (200, None, rows[0][2]), (205, 1, None), (210, 1, [1.0, None]),
             (215, 1, [math.nan] * 6), (220, 2, [math.inf] + [1.0] * 5), (225, 2, [1e307] * 6), (230, 1, []), (235, 0, [0.0] * 6), (240, 1, [-0.5] * 6), (245, 2, [0.7, 0.9]), (-5, 2, [0.8] * 9)]
    rows += [(300 + i, i % 3, [0.75] * 6) for i in range(60)]  # ties
    want = brute(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows, F.col("vec_id") % 5 == 0) == want
    assert any(k[1] is None or k[3] is None for k in want)


def test_norms_prune(spark, monkeypatch):
    """Buckets of small norms are left out, and the result is whole all the same."""
    monkeypatch.setattr(hn, "BUCKET_BYTES", 200)
    rng = random.Random(3)
    rows = [(i, rng.randrange(2), [rng.uniform(0.2, 1) / (1 + i % 40) ** 2 * 20 for _ in range(5)]) for i in range(400)]
    met = []
    monkeypatch.setattr(hn._Search, "_merge", (lambda f: lambda self, *a: (met.append(1), f(self, *a))[1])(hn._Search._merge))
    want = brute(rows, lambda i: i % 20 == 0)
    assert want and mined(spark, rows, F.col("vec_id") % 20 == 0) == want
    search = hn._Search([{"row": 0, "label": 1, "top": 10.0, "width": 1, "code": 2, "cells": b"\x0a\0", "lo": [1000], "hi": [2000]}], 2, False)
    search.meet({"top": 5.0, "cells": None, "width": 1, "code": 2, "rows": 1, "numbers": None})  # below the limit: never opened


def test_empty_and_query(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(df, F.col("vec_id") % 5 == 0).count() == 0
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = collections.Counter(map(tuple, queries.op11_hard_negatives(spark, sf).collect()))
    assert got == brute(rows, lambda i: i % 100 == 0) and got
