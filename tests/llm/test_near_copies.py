"""The pipeline's near-copy stage against brute force over planted edited copies."""

import random

import corpus_pipeline
from postloom.llm.simhash import fingerprint, shingle_hashes


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_planted_edited_copies(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(words) for _ in range(40)]  # a common passage alone makes no copy
    texts = []
    for n in [200] * 12 + [1000] * 4 + [60] * 6:
        base = [rng.choice(words) for _ in range(n)] + passage
        texts.append(base)
        for edits in (1, 2, max(1, n // 100), max(1, n // 50)):
            copy = list(base)
            for at in rng.sample(range(n), edits):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
        chain = texts[-1]
        for _ in range(3):  # each step is a near copy of the one before only
            chain = chain[max(1, n // 14) :] + [f"y{rng.randrange(10**6)}" for _ in range(n // 14)]
            texts.append(chain)
    texts = [" ".join(t) for t in texts] + ["", None, " \n", "a b", "A  b", "a c"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, texts[0])]
    least, sets = list(range(len(rows))), [shingles(t) for _, t in rows]

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                least[find(i)] = find(j)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        first.setdefault(find(i), []).append((doc_id is None, doc_id))
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(min(g, key=lambda x: (x[0], x[1] or 0))[1] for g in first.values())
    # what two bits of the op7 fingerprint link would have left most of them
    fps = [fingerprint(shingle_hashes((t or "").encode())) for _, t in rows]
    far = sum(all((fps[i] ^ fps[j]).bit_count() > 2 for j in range(len(rows)) if j != i) for i in range(len(rows)))
    assert far > 2 * len(got)


def test_op7_links_at_one_and_two_bits(spark, monkeypatch):
    """Planted fingerprints at one to three bits through the whole operator, in chains and beside unlinked ones."""
    from pyspark.sql import functions as F

    from postloom.llm import common, simhash

    rng = random.Random(6)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.append(x)
        for bits in (1, 2, 3):
            y = x
            for at in rng.sample(range(64), bits):
                y ^= 1 << at
            fps += [y, y] if bits == 1 else [y]
    monkeypatch.setattr(common, "FREQUENT", 2)  # keys of two rows count as frequent
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size: docs.select("doc_id", F.col("fp")))
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(rows).collect()}
    least = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    assert got == dict(enumerate(least)) and len(set(least)) > 60
