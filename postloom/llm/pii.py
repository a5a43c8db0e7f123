"""Personal data by candidate spans and gradient boosting, in DataFrame functions only.

Generators propose spans of high recall, which may overlap: the four base kinds by their fixed patterns, valid or not,
and further kinds (phones without a plus sign, social-security-like numbers, IBANs, key-like strings, long numbers).
Each candidate has small whole-number features of its format and of the 24 characters before it. Boosted trees score
them; a threshold for each kind, calibrated to PRECISION on all candidates with a weak label, selects redactions.
Base spans that pass their check always stay.

Fitting reads every candidate: they are counted by feature pattern in Spark, and at most FIT_PATTERNS patterns of each
kind (but e-mails, whose label is constant) go to the driver, where small trees are grown in plain Python: the most
frequent half, and of the others a sample by hash, weighted for those left out. The model comes back as nested CASE
expressions, which score every labelled candidate; thresholds come from these scores, counted in Spark. Candidates are found in one pass over whole texts and kept, without texts, in the checkpoint
folder. Texts are never shuffled; a row's work depends on that row alone, so hot groups don't matter.

A match's place is the sum of what split() and regexp_extract_all() return before it. The patterns are the fixed ones
with possessive loops, which match the same and need no stack or second look, however long a text is.

Cases: a null text counts as empty; rows that repeat a doc_id are treated each; spans that tie in kind and start are ordered by
their end; texts and spans may have any length; an empty table gives no rows, and without candidates the model selects nothing. Other columns are ignored by find_spans; redact keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, let, text_or_empty, whole_row

BASE_KINDS = ("email", "ip", "card", "phone")
#: kind: (characters that a text must have, pattern)
GENERATORS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    # only runs of 16 to 19 digits can pass, and a run is as long as it goes
    "card": (r"[0-9][0-9\x20-]{14}", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "local_phone": (r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "id_number": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    "key": (r"[A-Za-z0-9_]{24}", r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{24,}+"),
    "number": (r"[0-9]{9}", r"(?<![0-9])[0-9]{9,}+"),
}
KINDS = tuple(GENERATORS)
GOOD_CONTEXT = r"tel|phone|call|fax|mobil|mail|contact|card|visa|account|iban|konto|host|server|addr|token|key|secret|passw|ssn|login|user"
BAD_CONTEXT = r"version|isbn|issn|order|article|section|chapter|doi|page|figure|total|price|http"
FEATURES = ("kind", "digits", "letters", "marks", "luhn", "octets", "good", "bad", "follows")
FIT_PATTERNS = 5000  # bound of what the fit gathers of each kind
ROUNDS = 20
PRECISION = 0.95
_SPAN = "array<struct<start:bigint,end:bigint,span:string>>"


#: Matches of a text that one fold goes over: folds carry growing arrays, so long lists are folded in blocks.
BLOCK = 128


def _blocks(items: Column) -> Column:
    """items, not empty, in blocks of BLOCK."""
    last = ((F.size(items) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))


def _before(values: Column, begin: Column, join) -> Column:
    """For each of the blocks' values what join makes of those before it."""
    start = F.struct(begin.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def places(text: Column, needs: str, pattern: str) -> Column:
    """Leftmost matches that don't overlap, as array<struct<start, end, span>> in code points."""
    zero = F.lit(0).cast("long")

    def fold(steps: Column) -> Column:
        begin = F.struct(zero.alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(steps, begin, lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"),
                                                x["span"].alias("span")))).alias("out")))

    def of_blocks(blocks: Column) -> Column:
        bases = _before(F.transform(blocks, lambda b: b["at"]), zero, lambda a, x: a + x)
        moved = lambda b, base: F.transform(b["out"], lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end"), s["span"].alias("span")))
        return F.flatten(F.zip_with(blocks, bases, moved))

    def of_steps(steps: Column) -> Column:
        return F.when(F.size(steps) <= BLOCK, fold(steps)["out"]).otherwise(let(F.transform(_blocks(steps), fold), of_blocks))

    def walk(m: Column) -> Column:
        step = F.zip_with(F.slice(m["gaps"], 1, F.size(m["found"])), m["found"], lambda g, f: F.struct(
            F.length(g).cast("long").alias("gap"), F.length(f).cast("long").alias("size"), f.alias("span")))
        return let(step, of_steps)

    both = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))
    held = text.contains(needs) if len(needs) == 1 else text.rlike(needs)
    return F.when(held, let(both, walk)).otherwise(F.array().cast(_SPAN))


def _count(s: Column, of: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, of, ""))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _check(kind: str, span: Column, c: dict[str, Column]) -> Column:
    """Whether a candidate passes as its kind: the fixed checks, and weak labels (null: not known) for the others."""
    digits = F.regexp_replace(span, "[^0-9]", "")
    known = {
        "email": F.lit(True),
        "ip": c["octets"] == 1,
        "card": _luhn(digits),
        "phone": F.length(digits).between(8, 15),
        "local_phone": F.when(c["bad"] == 1, False).when((c["good"] == 1) | span.startswith("("), True),
        "id_number": F.when(span.rlike("^(000|666|9)|-00-|-0000$"), False).otherwise(True),
        "iban": F.when(c["digits"] < 12, False).when(c["good"] == 1, True),
        "key": F.when((c["digits"] < 4) | (c["letters"] < 4), False).when(c["good"] == 1, True),
        "number": F.when(c["good"] == 1, True).when(c["bad"] == 1, False),
    }
    return known[kind]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): every candidate of every text with features, label and whether it is a valid base span."""
    text = F.col("text")

    def enriched(number: int, kind: str) -> Column:
        def enrich(x: Column) -> Column:
            before = F.lower(F.substring(text, F.greatest(x["start"] - 23, F.lit(1)).cast("int"), F.least(x["start"], F.lit(24)).cast("int")))
            span = x["span"]
            c = {
                "kind": F.lit(number), "digits": F.least(_count(span, "[0-9]"), F.lit(40)),
                "letters": F.least(_count(span, "[A-Za-z]"), F.lit(40)), "marks": F.least(_count(span, "[^A-Za-z0-9]"), F.lit(12)),
                "luhn": F.coalesce(_luhn(F.regexp_replace(span, "[^0-9]", "")), F.lit(False)).cast("int"),
                "octets": span.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$").cast("int"),
                "good": before.rlike(GOOD_CONTEXT).cast("int"), "bad": before.rlike(BAD_CONTEXT).cast("int"),
                "follows": F.when(before.rlike(r"[\"'=:#/]\x20?$"), 2).when(before.rlike(r"\x20$"), 1).otherwise(0),
            }
            ok = _check(kind, span, c)
            base = F.coalesce(ok, F.lit(False)) if kind in BASE_KINDS else F.lit(False)
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), *(v.cast("int").alias(k) for k, v in c.items()),
                            ok.cast("int").alias("label"), base.alias("base"))

        return F.transform(places(text, *GENERATORS[kind]), enrich)

    found = F.concat(*(enriched(k, kind) for k, kind in enumerate(KINDS)))
    return docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", found.alias("found"))


def grow_trees(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = ROUNDS, rate: float = 0.4) -> list[tuple]:
    """Boosted trees of depth two for the logistic loss over (features, positives, count); a tree is
    (feature, cut, low, high) with subtrees or leaf values below: low where feature <= cut."""
    score = [0.0] * len(rows)
    trees = []

    def leaf(part: list[int], g: list[float], h: list[float]) -> float:
        return rate * sum(g[i] for i in part) / (sum(h[i] for i in part) + 1.0)

    def split(part: list[int], g: list[float], h: list[float], depth: int):
        best, total_g, total_h = (1e-6, None), sum(g[i] for i in part), sum(h[i] for i in part)
        for f in range(len(FEATURES)):
            sums: dict[int, list[float]] = {}
            for i in part:
                s = sums.setdefault(rows[i][0][f], [0.0, 0.0])
                s[0] += g[i]
                s[1] += h[i]
            low_g = low_h = 0.0
            for cut in sorted(sums)[:-1]:
                low_g, low_h = low_g + sums[cut][0], low_h + sums[cut][1]
                gain = (low_g**2 / (low_h + 1) + (total_g - low_g) ** 2 / (total_h - low_h + 1) - total_g**2 / (total_h + 1))
                best = max(best, (gain, (f, cut)), key=lambda x: x[0])
        if not depth or best[1] is None:
            return leaf(part, g, h)
        f, cut = best[1]
        return (f, cut, split([i for i in part if rows[i][0][f] <= cut], g, h, depth - 1),
                split([i for i in part if rows[i][0][f] > cut], g, h, depth - 1))

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [pos - n * q for (_, pos, n), q in zip(rows, p, strict=True)]
        h = [n * q * (1 - q) for (_, _, n), q in zip(rows, p, strict=True)]
        tree = split(list(range(len(rows))), g, h, 2)
        trees.append(tree)
        score = [s + tree_value(tree, x) for s, (x, _, _) in zip(score, rows, strict=True)]
    return trees


def tree_value(tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _tree_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(c[FEATURES[f]] <= cut, _tree_column(low, c)).otherwise(_tree_column(high, c))


def _total(trees: list[tuple], c: Column) -> Column:
    total = F.lit(0.0)
    for t in trees:
        total = total + _tree_column(t, c)
    return total


def _fit_rows(patterns: DataFrame) -> list[tuple[tuple[int, ...], float, float]]:
    """(features, positives, count) of at most FIT_PATTERNS patterns of each kind."""
    half = FIT_PATTERNS // 2
    ranked = patterns.where(F.col("kind") != KINDS.index("email")).withColumn(
        "top", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), *FEATURES)) <= half)
    own = Window.partitionBy("kind", "top")
    some = ranked.withColumn("place", F.row_number().over(own.orderBy(F.xxhash64(*FEATURES), *FEATURES))).withColumn(
        "weight", F.count("*").over(own) / F.least(F.count("*").over(own), F.lit(half))).where(F.col("place") <= half)
    return [(tuple(r[f] for f in FEATURES), r.weight * r.good_n, r.weight * r.n) for r in some.orderBy(*FEATURES).collect()]


def thresholds(patterns: DataFrame, trees: list[tuple]) -> list[float | None]:
    """By kind the least score at which those at or above it have PRECISION, over all patterns with their counts."""
    scored = patterns.select("kind", _total(trees, F.struct(*FEATURES)).alias("score"), "good_n", "n")
    counts = scored.groupBy("kind", "score").agg(F.sum("good_n").alias("good_n"), F.sum("n").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select("kind", "score", F.sum("good_n").over(above).alias("right"), F.sum("n").over(above).alias("total"))
    least = {r.kind: r.cut for r in sums.where(F.col("right") >= PRECISION * F.col("total")).groupBy("kind").agg(F.min("score").alias("cut")).collect()}
    return [least.get(kind) for kind in range(len(KINDS))]


def fit(found: DataFrame) -> tuple[list[tuple], list[float | None]]:
    """Trees, and by kind the least score to redact at (None: none reaches PRECISION)."""
    each = found.select(F.explode("found").alias("c")).where("c.label is not null").select("c.*")
    patterns = checkpoint(each.groupBy(*FEATURES).agg(F.sum("label").alias("good_n"), F.count("*").alias("n")))
    rows = _fit_rows(patterns)
    if not rows:
        return [], [None] * len(KINDS)
    trees = grow_trees(rows)
    return trees, thresholds(patterns, trees)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, selected) for every row of docs (doc_id, text).

    spans names base spans and selected candidates as kind:start:end; selected has them as structs.
    """
    return select_spans(*_found_and_model(docs))


def _found_and_model(docs: DataFrame):
    found = checkpoint(candidates(docs))
    return found, *fit(found)


def select_spans(found: DataFrame, trees: list[tuple], least: list[float | None]) -> DataFrame:
    def chosen(c: Column) -> Column:
        total = _total(trees, c)
        cut = F.lit(None).cast("double")
        for kind, value in enumerate(least):
            if value is not None:
                cut = F.when(c["kind"] == kind, F.lit(value - 1e-9)).otherwise(cut)
        return c["base"] | F.coalesce(total >= cut, F.lit(False))

    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))
    kept = F.array_sort(F.transform(F.filter("found", chosen), plain))
    name = F.array(*map(F.lit, KINDS))
    as_text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("selected", lambda s: s["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter("selected", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    return found.select("doc_id", kept.alias("selected")).select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)),
        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("selected")).alias("spans"), "selected")


def redacted(text: Column, selected: Column) -> Column:
    """text with each selected span, overlapping ones as one, replaced by the kind of the first in brackets."""
    by_start = F.array_sort(F.transform(selected, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(a: Column, s: Column) -> Column:
        piece = F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.get(name, s["kind"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= a["at"], F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    def fold(spans: Column, at: Column) -> Column:
        """Pieces of text and names for spans that follow place `at`."""
        return F.aggregate(spans, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda a: a["out"])

    ends = lambda spans: F.array_max(F.transform(spans, lambda s: s["end"]))
    zero = F.lit(0).cast("long")

    def of_blocks(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, _before(F.transform(blocks, ends), zero, F.greatest), fold))

    def of_spans(spans: Column) -> Column:
        pieces = F.when(F.size(spans) <= BLOCK, fold(spans, zero)).otherwise(let(_blocks(spans), of_blocks))
        return F.concat(F.array_join(pieces, ""), F.substring(text, (ends(spans) + 1).cast("int"), F.length(text)))

    return F.when(F.size(selected) == 0, text).otherwise(let(by_start, of_spans))


def redact(docs: DataFrame) -> DataFrame:
    """docs, text redacted and n_chars (where there is one) set to its new length; null texts stay null.

    Spans are found again beside the texts, so texts are not shuffled; the model is fitted on all of docs first.
    """
    _, trees, least = _found_and_model(docs)
    # find spans in the row that holds the text: candidates() and select_spans() only need one column to pass by
    found = candidates(docs.select(whole_row(docs).alias("doc_id"), "text"))
    name = "r" * (1 + max(map(len, docs.columns)))  # a name that docs lacks
    row = F.col(name)
    text = redacted(row["text"], F.col(f"{name}_"))
    of = {"text": text, "n_chars": F.length(text)}
    return select_spans(found, trees, least).select(F.col("doc_id").alias(name), F.col("selected").alias(f"{name}_")).select(
        *((of[c].cast(docs.schema[c].dataType) if c in of else row.getField(c)).alias(c) for c in docs.columns))
