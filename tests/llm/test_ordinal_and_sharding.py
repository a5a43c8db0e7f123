"""The ordinal loss against a numeric gradient and a plain optimiser; the sharding table recomputed slot by slot."""

import numpy as np
import xxhash

from postloom.llm import sharding, toxicity


def loss(w, theta, x, y, weight, l2):
    s = x @ w
    up_to = 1 / (1 + np.exp(np.subtract.outer(s, theta)))
    up_to = np.hstack([np.zeros((len(y), 1)), up_to, np.ones((len(y), 1))])
    chance = up_to[np.arange(len(y)), y + 1] - up_to[np.arange(len(y)), y]
    return -(weight / weight.sum() * np.log(chance)).sum() + l2 / 2 * (w @ w)


def test_fit_is_a_minimum():
    rng = np.random.default_rng(4)
    x = (rng.random((400, 6)) < 0.4).astype(float)
    y = np.digitize(x @ np.array([2.0, -1, 0.5, 0, 1, -2]) + rng.logistic(size=400), [0.0, 1.5])
    weight = rng.random(400) + 0.5
    row, col = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(row, col, 6, y, weight, 3, l2=1e-2, steps=2000)
    theta = np.array(theta)
    assert theta[0] < theta[1]
    p, step = np.concatenate([w, theta]), 1e-5
    at = lambda q: loss(q[:6], q[6:], x, y, weight, 1e-2)
    slope = [(at(p + step * e) - at(p - step * e)) / (2 * step) for e in np.eye(8)]
    assert np.abs(slope).max() < 1e-3
    # plain descent from elsewhere ends at the same loss
    q = np.array([0.0] * 6 + [-1.0, 1.0])
    for _ in range(3000):
        q -= 0.5 * np.array([(at(q + step * e) - at(q - step * e)) / (2 * step) for e in np.eye(8)])
    assert abs(at(q) - at(p)) < 1e-4


def test_severity_is_the_expected_grade():
    model = toxicity.OrdinalModel({1: 2.0}, [0.5, 1.5])
    chances = model.grade_chances(2.0)
    up_to = [1 / (1 + np.exp(2.0 - t)) for t in (0.5, 1.5)]
    assert np.allclose(chances, [up_to[0], up_to[1] - up_to[0], 1 - up_to[1]])


def test_table_slot_by_slot():
    """Turns, preference orders and weights by their definition: a list of all preferred slots a shard, claimed in turns."""
    import hashlib

    shards, slots = {"b": 1, "a": 2, "c": 1}, 101
    prefer = {}
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        start, stride = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        prefer[name] = [(start + k * stride) % slots for k in range(slots)]
        assert len(set(prefer[name])) == slots
    owner = {}
    while len(owner) < slots:
        for name in ["a", "a", "b", "c"]:
            if len(owner) < slots:
                owner[next(x for x in prefer[name] if x not in owner)] = name
    assert [sorted(shards)[k] for k in sharding.fill_table(shards, slots)] == [owner[i] for i in range(slots)]


def test_slots_of_rows(spark):
    """Spark's XXH64 with seed 42 over the eight bytes of a long and over a text's UTF-8."""
    df = spark.createDataFrame([(1, "a"), (-5, "b"), (None, "ünï"), (None, None)], "doc_id long, text string")
    got = sharding.assign_shards(df, "doc_id", {"a": 1, "b": 1}, 101, fallback="text").collect()
    signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    for r in got:
        raw = r.doc_id.to_bytes(8, "little", signed=True) if r.doc_id is not None else (r.text or "").encode()
        want = 42 if r.doc_id is None and r.text is None else signed(xxhash.xxh64_intdigest(raw, 42))
        assert r.slot == want % 101
    assert sharding.assign_shards(df.where("false"), "doc_id", {"a": 1}, 101).count() == 0
