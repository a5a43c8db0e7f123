"""Each operator against a brute-force version on small tables with nulls, empties, ties, repeated rows and clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postloom.llm import bpe, exact_dedup, line_dedup, packing, pii, quality, sharding, simhash, substring_dedup, toxicity
from postloom.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    texts += [texts[0], texts[0].replace(" ", "  ", 3), texts[1] + " " + passage, passage + " " + texts[2], passage, "a " * 200, "", None, " \n ", "Ünï ß"]
    texts.append(" ".join(rng.choice(words) for _ in range(20_000)))
    rows = [(i, t, "kept", 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id here", "x", 2), (None, "no id here", "x", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame(corpus(), "doc_id long, text string, kept string, key int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_substring(docs, empty):
    words = [WORD.findall(t or "") for _, t, *_ in corpus()]
    n = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = collections.Counter()
    for (doc_id, *_), w in zip(corpus(), words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if n[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = substring_dedup.remove_repeated_windows(docs).drop("intervals").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert substring_dedup.remove_repeated_windows(empty).count() == 0


def test_intervals():
    assert substring_dedup.removal_intervals(np.array([0, 1, 35, 36, 80]), 35) == [(0, 71), (80, 115)]


def test_exact(docs, empty):
    norm = {}
    for i, (doc_id, t, *_) in enumerate(corpus()):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((doc_id is None, doc_id or 0, i))
    got = exact_dedup.exact_dedup(*exact_dedup.split_by_id(docs)).collect()
    want = collections.Counter()
    for t, g in norm.items():
        least = min(g)
        for no_id, doc_id, _ in g:
            want[None if no_id else doc_id, None if least[0] else least[1], len(g), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(norm)
    assert exact_dedup.exact_dedup(*exact_dedup.split_by_id(empty)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 20_000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = exact_dedup.FuseFilter.build(keys)
    assert f.contains(keys).all()
    others = np.random.default_rng(n + 1).integers(0, 2**63, 20_000).astype(np.uint64)
    assert f.contains(others).mean() < 0.02


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.clean_lines(docs).collect()}
    for doc_id, t, *_ in corpus():
        if doc_id is None:
            continue
        w, t = WORD.findall(t or ""), t or ""
        n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(twice)), doc_id
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
    assert quality.clean_lines(empty).count() == 0


def test_lines(spark, empty):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(20)]
    near = [b[:40] + "X" + b[41:] for b in base[:10]]
    hot = ["the very same opening line of every page in this set, number " + str(i % 60) for i in range(150)]
    rows = [(i, "\n".join(x)) for i, x in enumerate([base, near, base[:3], hot, ["", " "], ["abc"], ["abc"]])] + [(9, None), (0, "\n".join(base))]
    got = line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lines = {(i, k): re.sub(r"\s+", " ", x.lower()) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()}
    sets = {x: {x[a : a + 5] for a in range(len(x) - 4)} or {x} for x in set(lines.values())}
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    want = collections.defaultdict(set)
    have = collections.defaultdict(set)
    for at, x in lines.items():
        want[find(x)].add(at)
    for r in got:
        have[r.class_id].add((r.doc_id, r.line_no))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))
    assert collections.Counter(r.class_id for r in got if r.kept) == collections.Counter(have.keys())
    assert line_dedup.fuzzy_lines(empty).count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, capacity=256).collect()
    library = Tokenizer.from_file(path)
    want = collections.Counter()
    for doc_id, t, *_ in corpus():
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        for k in range(0, n, 256):
            want[doc_id, k // 256, k, min(256, n - k)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan(histogram):
    bins = collections.Counter()
    slots = collections.Counter()
    for length, rank, n, each, first, offset in packing.plan_best_fit(histogram, 64):
        assert rank == slots[length]
        slots[length] += n
        for i in range(n):
            bins[first + i // each] += length
            assert offset + (i % each + 1) * length <= 64
    assert slots == histogram and all(v <= 64 for v in bins.values())
    one_by_one = []  # best fit decreasing, an item at a time
    for length in sorted(slots.elements(), reverse=True):
        fits = [i for i, v in enumerate(one_by_one) if v + length <= 64]
        if fits:
            one_by_one[max(fits, key=one_by_one.__getitem__)] += length
        else:
            one_by_one.append(length)
    assert sorted(bins.values()) == sorted(one_by_one)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab É中 İ!'sΣ\n\x1c\x85 1²<|endoftext|>K", max_size=30))
def test_word_encoder(text):
    want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")) if not hasattr(test_word_encoder, "t") else test_word_encoder.t
    if not hasattr(test_word_encoder, "t"):
        test_word_encoder.t = want
        test_word_encoder.e = packing.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert np.frombuffer(test_word_encoder.e.encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


def test_simhash(docs, empty):
    def fp(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.simhash_components(docs).collect()
    want = {i: fp(t) for i, t, *_ in corpus() if i is not None}
    assert {r.doc_id: r.fingerprint for r in got if r.doc_id is not None} == {i: f"{x:016x}" for i, x in want.items()}
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == min(i for i, x in want.items() if x == want[r.doc_id])
    assert simhash.simhash_components(empty).count() == 0


def test_golay_keys_meet():
    rng = random.Random(5)
    golay = simhash.Golay()
    a = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    b = np.array([int(x) ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 2))}) for x in a], np.uint64)
    keys = []
    for fps in (a, b):
        rows, own = simhash.golay_keys(fps.view(np.int64), golay)
        own_of = collections.defaultdict(set)
        for r, k in zip(rows.tolist(), own.tolist(), strict=True):
            own_of[r].add(k)
        assert max(map(len, own_of.values())) <= 18
        keys.append(own_of)
    assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


def test_links_of_a_full_bucket(spark):
    """Fingerprints that differ only in the bits of one segment share keys; more than PAIRS_UP_TO of them, in chains
    of small steps and apart, end in the components that all pairs would give."""
    rng = random.Random(11)
    ring = sorted({sum(1 << 43 + k for k in rng.sample(range(20), rng.randint(0, 4))) for _ in range(160)})
    assert len(ring) > 2 * simhash.PAIRS_UP_TO
    distinct = spark.createDataFrame([(x,) for x in ring], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.close_links(distinct)).collect()}
    root = {x: x for x in ring}
    changed = True
    while changed:
        changed = False
        for x in ring:
            for y in ring:
                if (x ^ y).bit_count() <= 2 and root[y] < root[x]:
                    root[x], changed = root[y], True
    assert {x: roots.get(x, x) for x in ring} == root


def test_pii(spark, empty):
    texts = ["a@b.c_d@e.f", "x@@y.z", "1.2.3.4.5 300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-1234)", "+1234", None, "",
             "é😀 mail me@x.org", "1 " * 3000, "a@b.co " * 300, "1." * 500, "12  4111111111111111"]
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for i, t in enumerate(texts):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert set(spans) <= set(got[i].spans.split(","))
    assert pii.find_spans(empty).count() == 0
    kept = pii.redact(spark.createDataFrame([(1, "é to me@x.org, bye", 7), (2, None, 0)], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in kept] == [(1, "é to [EMAIL], bye", 17), (2, None, None)]


def test_toxicity(spark, empty):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lan", "mir", "tos", "ven")]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        t = [rng.choice(words) for _ in range(60)] + ([rng.choice(["vile", "scum", "foul"]) + rng.choice(["", "ly", "er"]) for _ in range(rng.randint(1, 6))] if toxic else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        if i < 400:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (7000, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held_out = [got[i].toxic == (i % 5 == 0) for i in range(400, 600)]
    assert sum(held_out) >= 198 and not got[7000].toxic and not got[None].toxic
    assert all(0 <= r.expected_severity <= 2 for r in got.values())
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).where("toxic").count() == 0
    assert toxicity.keep_clean(docs, model).columns == ["doc_id", "text"]


def test_sharding(spark, docs):
    names = sharding.shard_names(20)
    table = sharding.fill_table(names)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    more = sharding.fill_table(sharding.shard_names(21))
    assert (np.array(sorted(names))[table] != np.array(sorted(sharding.shard_names(21)))[more]).mean() < 0.12
    got = sharding.assign_shards(docs, "doc_id", names, fallback="text").collect()
    assert len(got) == len(corpus()) and all(r.shard == sorted(names)[table[r.slot]] for r in got)
    with pytest.raises(ValueError, match="prime"):
        sharding.fill_table(names, 100)


@pytest.fixture(scope="module")
def encoders():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Encoder(bpe.build_tables(ranks, public_tokenizers.PATTERN)), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="ab the\n é中😀'1", max_size=60))
def test_bpe(encoders, text):
    mine, library = encoders
    pieces = mine.encode_text(text)
    assert [int(i) for p in pieces for i in p.split(",")] == library.encode_ordinary(text)
    assert mine.decode(pieces) == text.encode()


def test_bpe_query(docs, empty, encoders):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = collections.Counter((r.doc_id, r.ids) for r in bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN).collect())
    assert got == collections.Counter((i, ",".join(map(str, encoders[1].encode_ordinary(t or "")))) for i, t, *_ in corpus())
    assert bpe.encode_and_decode(empty, path, public_tokenizers.PATTERN).count() == 0
