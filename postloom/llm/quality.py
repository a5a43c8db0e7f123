"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own: punctuation (no sentence mark at all, or marks and symbols piled up), navigation (short
items between separators) and boilerplate (set phrases of licences, cookies and menus in a short line). Failing lines
are removed, and a document that loses more than LOST_SHARE of its word characters is rejected, as is one that fails
the base rules (too few words, too much repetition).

Everything is a projection over rows: no shuffle, no state, so hot sources and copies don't matter. Repeated three-word
windows are found inside a row by sorting hashes packed with positions; equal prefixes are confirmed on whole 64-bit
hashes, and where different hashes share a prefix (long texts) whole hashes are sorted instead, so results are exact
at any length and time is n log n in the words of a text.

Cases: a null text has no words and fails the base rules; an empty table gives no rows; rows that repeat a doc_id are
judged each. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LOST_SHARE = 0.5
#: Set phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "this work is licensed", "copyright", "cookie",
    "javascript", "privacy policy", "terms of use", "terms of service", "lorem ipsum", "subscribe", "newsletter",
    "click here", "sign in", "sign up", "log in", "read more", "share this",
)
BOILERPLATE_WORDS = 30


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def without(text: Column, pattern: str) -> Column:
    """Code points of text that don't match."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more, each position once."""
    def covered(at: Column) -> Column:
        each = F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long"))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

    def by_pairs(hashes: Column) -> Column:
        """Sorted whole hashes with their places: exact for any hashes, but slower."""
        def starts(s: Column) -> Column:
            same = lambda p, q: F.coalesce(p["h"] == q["h"], F.lit(False))
            twice = F.filter(s, lambda p, i: same(p, F.get(s, i - 1)) | same(p, F.get(s, i + 1)))
            return F.sort_array(F.transform(twice, lambda p: p["i"]))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        return let(let(pairs, starts), covered)

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        mask = F.when(n < 1 << 16, F.lit((1 << 16) - 1)).when(n < 1 << 24, F.lit((1 << 24) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long")

        def with_mask(mask: Column) -> Column:
            prefix, place = F.bitwise_not(mask), lambda x: F.get(hashes, x.bitwiseAND(mask).cast("int"))
            alike = lambda a, b: a.bitwiseXOR(b).bitwiseAND(prefix) == 0
            packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(prefix).bitwiseOR(i.cast("long"))))

            def starts(s: Column) -> Column:
                same = lambda a, b: F.coalesce(alike(a, b) & (place(a) == place(b)), F.lit(False))
                twice = F.filter(s, lambda p, i: same(p, F.get(s, i - 1)) | same(p, F.get(s, i + 1)))
                return F.sort_array(F.transform(twice, lambda p: p.bitwiseAND(mask)))

            def checked(s: Column) -> Column:
                # other hashes with the same prefix may lie between equal ones
                mixed = F.size(F.filter(s, lambda p, i: F.coalesce(alike(p, F.get(s, i - 1)) & (place(p) != place(F.get(s, i - 1))), F.lit(False)))) > 0
                return F.when(mixed, by_pairs(hashes)).otherwise(let(starts(s), covered))

            return let(packed, checked)

        return let(mask, with_mask)

    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, of)


def line_fails(line: Column) -> Column:
    """Whether a line fails: punctuation, then navigation, then boilerplate."""
    def of(low: Column) -> Column:
        n = F.greatest(F.size(words_of(low)), F.lit(1))
        chars = F.length(low)
        symbols = chars - F.length(F.regexp_replace(low, "[#*$%&|<>{}]", ""))
        shouts = chars - F.length(F.regexp_replace(low, "!!", ""))
        bars = chars - F.length(F.regexp_replace(low, r"[|>»›·•]", ""))
        punctuation = ~low.rlike(r"[.!?:;,…。！？\"”»)]([\x20\x09-\x0D]|$)") | (symbols * 10 > chars) | (shouts > n)
        navigation = (bars >= 3) & (n <= 5 * (bars + 1))
        phrase = F.lit(False)
        for p in BOILERPLATE:
            phrase = phrase | low.contains(p)
        return punctuation | navigation | ((n <= BOILERPLATE_WORDS) & phrase)

    return let(F.lower(line), of)


def clean_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_bad_lines,
    bad_chars, kept, clean_text) for every row of docs (doc_id, text)."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    bad = lambda xs: F.filter(xs, line_fails)
    of_lines = let(lines, lambda xs: F.struct(
        F.size(xs).cast("long").alias("n_lines"),
        (F.size(xs) - F.size(F.array_distinct(xs))).cast("long").alias("n_dup_lines"), bad(xs).alias("bad")))
    of_words = let(words_of(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"), repeat_words(ws).alias("n_repeat_words")))
    clean = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike("[^\\x20\\x09-\\x0D]") & line_fails(x))), "\n")
    base = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", of_words.alias("w"), of_lines.alias("l"))
    out = base.select(
        "doc_id", "w.n_words", without(text, SPACE + "+").alias("word_chars"),
        (F.length(text) - without(text, "[#*$%&|<>]")).alias("n_symbols"), "l.n_dup_lines", "w.n_repeat_words",
        ((F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("w.n_words"))).alias("base_failed"),
        "l.n_lines", F.size("l.bad").cast("long").alias("n_bad_lines"),
        without(F.array_join("l.bad", " "), SPACE + "+").alias("bad_chars"), clean.alias("clean_text"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("bad_chars") <= LOST_SHARE * F.col("word_chars")))
