"""The pipeline's rows against a step-by-step version in plain Python over the same trained models."""

import collections
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from postloom.llm import pii, toxicity
from postloom.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))

    def clean(t):
        words = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        hits = {f for w in words for f in toxicity.word_features(w) if f in model.weights}
        return model.grade_chances(sum(model.weights[f] for f in sorted(hits)))[0] > 0.5

    rows = {i: t for i, t in rows.items() if clean(t)}
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    rows = {i: rows[i] for i in first.values()}
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in rows.items()}
    least = {i: i for i in rows}
    links = [(i, j) for i in rows for j in rows if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                changed = True
    rows = {i: t for i, t in rows.items() if least[i] == i}
    redacted = pii.redact(docs.where(docs.doc_id.isin(list(rows))))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in redacted.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
        for k in range(0, n, 2048):
            want[r.doc_id, k // 2048, k, min(2048, n - k)] += 1
    got = corpus_pipeline.run(spark, DIR).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_registry():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


STRANGE = "doc_id long, text string, id int, selected string, kept boolean, h string, row int, n_chars int, found int, stays int"


def strange(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", False, "h", 2, len(t or ""), 3, 4) for i, t in rows], STRANGE)


def test_repeated_and_null_ids_in_the_near_stage(spark):
    a = " ".join(f"w{i}" for i in range(300))
    near = [a.replace("w150", x) for x in ("x", "y")]
    rows = [(3, a), (5, near[0]), (5, "another text that is not like it"), (None, near[1]), (None, "and one more text here")]
    got = corpus_pipeline.drop_near_copies(spark, strange(spark, rows), "").collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted([(3, a), (5, rows[2][1]), (-1, rows[4][1])])


def test_cases_of_every_stage(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(f"v{i * 7919 % 100003}" for i in range(30_000))
    rows = [(1, "One text, write to ann@example.com"), (1, "One text, write to ann@example.com"), (2, "One  text, write to ann@example.com"), (3, None), (4, ""),
            (5, " \n"), (None, "no id"), (None, "no id"), (6, long)]
    docs = strange(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        if name == "best-fit packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in rows}
            continue
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = sorted((r.doc_id or -1, r.text) for r in out.where("text is not null").collect())
        nulls = out.where("text is null").count()
        if name == "toxicity":
            assert len(got) == 8 and nulls == 1
        elif name == "personal data":
            assert nulls == 1 and [t for i, t in got if i == 1] == ["One text, write to [EMAIL]"] * 2
        elif name == "exact dedup":
            assert nulls == 1 and [i for i, _ in got] == [-1, 1, 5, 6]  # 3 and 4 are empty, 5 is one space
        else:
            assert nulls == 1 and [i for i, _ in got] == [-1, 1, 6]  # texts without words are copies, 2 has the words of 1


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
