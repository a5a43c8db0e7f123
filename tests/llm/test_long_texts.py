"""Very long texts and lists, dotted names and text ids."""

import collections
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postloom.llm import exact_dedup, pii, quality


def brute_repeats(words):
    n = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    return len({k for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)})


def test_repeats_between_like_hashes(spark):
    """Windows A, B, A whose hashes share 40 bits, in texts of over 65,535 words: A is found, whatever lies between."""
    a, b = ([f"{c}{i}" for c in "abc"] for i in (284680, 375028))
    filler = [f"w{i}" for i in range(40_000)]
    texts = [a + filler + b + [f"v{i}" for i in range(40_000)] + a, b + filler + a + [f"v{i}" for i in range(40_000)] + b, a + filler + [f"v{i}" for i in range(40_000)] + a,
             a + ["x"] + b + ["y"] + a, ["go"] * 70_000]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id int, text string")
    got = [r.n_repeat_words for r in quality.clean_lines(df).orderBy("doc_id").collect()]
    assert got == [6, 6, 6, 6, 70_000] == list(map(brute_repeats, texts))


def test_exact_path(spark):
    """The path by whole hashes gives what the packed one does."""
    words = [["a", "b", "c", "a", "b", "c", "d", "a", "b", "c"], ["a"] * 9, [], ["a", "b"], ["a", "b", "c", "d"]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")
    assert [r.n for r in df.select("i", quality.repeat_words(F.col("w")).alias("n")).orderBy("i").collect()] == list(map(brute_repeats, words))


def test_cleaned_lines(spark):
    """Lines that fail go, the others stay in their order, blank ones among them."""
    text = "A plain sentence stands here, whole.\n\nHome | About | News | Help | Contact\nno marks at all in this one\nAnother sentence ends it."
    r = quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r.clean_text == "A plain sentence stands here, whole.\n\nAnother sentence ends it." and (r.n_lines, r.n_bad_lines) == (4, 2)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 1000])
def test_many_spans(spark, n):
    """Places and redactions of a text do not depend on the blocks that they are folded in."""
    text = "".join(f"é{i} me{i}@x.org, " for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = df.select(pii.places(F.col("text"), *pii.GENERATORS["email"]).alias("p")).first().p
    assert [text[s.start : s.end] for s in found] == [f"me{i}@x.org" for i in range(n)] and [s.span for s in found] == [f"me{i}@x.org" for i in range(n)]
    assert pii.redact(df).first().text == "".join(f"é{i} [EMAIL], " for i in range(n))


def test_spans_in_time(spark):
    def seconds(n):
        began = time.perf_counter()
        df = spark.createDataFrame([(1, " ".join(f"me{i}@x.org" for i in range(n)))], "doc_id int, text string")
        assert df.select(F.size(pii.places(F.col("text"), *pii.GENERATORS["email"]))).first()[0] == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(64_000) < 30


def test_overlapping_spans(spark):
    """A span that reaches over many blocks hides those inside it."""
    spans = [(0, 5000, 0)] + [(i, i + 1, 1) for i in range(10, 4000, 10)] + [(6000, 6001, 2)]
    df = spark.createDataFrame([("x" * 7000, spans)], "text string, spans array<struct<start:bigint,end:bigint,kind:int>>")
    assert df.select(pii.redacted(F.col("text"), F.col("spans"))).first()[0] == "[EMAIL]" + "x" * 1000 + "[CARD]" + "x" * 999


def test_long_keys_and_numbers(spark):
    key, number = "sk_" + "a1" * 150, "9" * 60
    df = spark.createDataFrame([(1, f"secret key {key} and account {number}.")], "doc_id int, text string")
    for kind, want in (("key", key), ("number", number)):
        assert [s.span for s in df.select(pii.places(F.col("text"), *pii.GENERATORS[kind]).alias("p")).first().p if s.span == want] == [want]


def test_dotted_names_and_text_ids(spark):
    docs = spark.createDataFrame([("k1", "one text here", 1), ("k0", "one  text here", 2), (None, "mail me@x.org", 3)], ["doc_id", "text", "a.b`c"])
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(*exact_dedup.split_by_id(docs)).collect()} == {("k0", "k0", True), ("k1", "k0", False), (None, None, True)}
    kept = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r[2] for r in kept.collect()) == [2, 3]
    assert {r[2]: r.text for r in pii.redact(docs).collect()}[3] == "mail [EMAIL]"
    model = __import__("postloom.llm.toxicity", fromlist=["fit"])
    labels = spark.createDataFrame([("k1", 0), ("k0", 1)], "doc_id string, toxic int")
    assert model.keep_clean(docs, model.fit(docs, labels), 1.1).columns == docs.columns
