"""Thresholds of op8 come from every labelled candidate, however many patterns more frequent kinds have."""

import collections
import random

from pyspark.sql import functions as F

from postloom.llm import pii


def test_rare_kinds_keep_their_thresholds(spark, monkeypatch):
    monkeypatch.setattr(pii, "FIT_PATTERNS", 40)
    rng = random.Random(5)
    rows = [f"{'a' * (1 + i % 20)}{'1' * (i // 20)}@ex.org" for i in range(60) for _ in range(3)]
    keys = []
    for i in range(60):  # seen once each: letters and digits vary
        x = "".join(rng.choice("abcdef") for _ in range(14 + i % 15)) + "7" * (11 + i // 15)
        keys.append(f"secret token {x}")
    bad = [f"some words and then {'q' * (21 + i)}123" for i in range(15)]  # too few digits
    docs = spark.createDataFrame(list(enumerate(rows + keys + bad)), "doc_id long, text string")
    found = pii.candidates(docs)
    trees, least = pii.fit(found)
    number = pii.KINDS.index("key")
    scores = collections.defaultdict(lambda: [0, 0])
    for r in found.select(F.explode("found").alias("c")).where("c.label is not null").select("c.*").collect():
        if r.kind == number:
            s = scores[round(sum(pii.tree_value(t, tuple(r[f] for f in pii.FEATURES)) for t in trees), 9)]
            s[0] += r.label
            s[1] += 1
    right, total, want = 0, 0, None
    for s in sorted(scores, reverse=True):
        right, total = right + scores[s][0], total + scores[s][1]
        if right >= pii.PRECISION * total:
            want = s
    assert total == 75 and want is not None
    assert least[number] is not None and abs(least[number] - want) < 1e-8
    spans = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    picked = sum("key:" in spans[len(rows) + i] for i in range(60))
    assert picked == 60
