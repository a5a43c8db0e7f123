"""JSON Lines and JSON documents as tables: one reader with three ways to treat bad lines, and the input formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAD_JSON, NOT_OBJECT = "bad_json", "not_object"


def jsonl(spark: SparkSession, path: str, on_error: str = "raise", missing_ok: bool = True) -> DataFrame:
    """(line, v, reject_reason) of a JSON Lines source; blank lines are left out.

    raise: the first bad line fails the query, whose message names its number, lines that are no object are left out; skip: bad
    lines are left out too; count: they stay, with a null v and their reason. A missing path is an empty table if missing_ok.
    """
    if on_error not in ("raise", "skip", "count"):
        raise ValueError("on_error must be raise, skip or count")
    if missing_ok and not _exists(spark, path):
        lines = spark.createDataFrame([], "line string")
    elif on_error == "raise":
        return parse_lines(numbered_lines(spark, path).select("line_number", "line"), on_error).drop("line_number")
    else:
        lines = spark.read.text(path).withColumnRenamed("value", "line")
    return parse_lines(lines, on_error)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parse_lines(lines: DataFrame, on_error: str) -> DataFrame:
    """parse_lines over any table with a column line; other columns are carried on."""
    d = lines.where(~F.col("line").rlike(r"^\s*$")).withColumn("v", F.try_parse_json("line"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    d = d.withColumn("reject_reason", F.when(F.col("v").isNull(), BAD_JSON).when(~is_object, NOT_OBJECT))
    if on_error == "count":
        return d.withColumn("v", F.when(F.col("reject_reason").isNull(), F.col("v")))
    if on_error == "raise":
        number = [F.lit("line "), F.col("line_number").cast("string"), F.lit(": ")] if "line_number" in lines.columns else []
        message = F.concat(*number, F.lit("invalid JSON line: "), F.left("line", F.lit(200)))
        d = d.withColumn("reject_reason", F.when(F.col("reject_reason") == BAD_JSON, F.raise_error(message).cast("string")).otherwise(F.col("reject_reason")))
    return d.where("reject_reason is null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line) of text files of any size: true numbers from 1 in each file, blank lines counted.

    Files are read in splits, as many tasks as their size gives. Lines are counted by split (a small aggregate), the splits'
    bases are prefix sums of the counts inside a file, and a line's number is its base and its place in the split. A line ends at a
    line feed, with or without a carriage return before it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "\r$", "").alias("line"))
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    place = F.col("at") - F.col("first")
    # both readings of the files must have cut them alike; if not, it fails rather than tell a wrong number
    number = F.when(place.between(0, F.col("lines") - 1), F.col("base") + place + 1).otherwise(F.raise_error(F.lit("the files were cut differently when read again")).cast("bigint"))
    return lines.join(splits, ["file", "split"]).select("file", number.alias("line_number"), "line")


def jsonl_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, line, v): true numbers from 1, blank lines counted but left out."""
    return parse_lines(numbered_lines(spark, path).select("line_number", "line"), "raise").drop("reject_reason")


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """(v) of a file that holds one JSON object; a byte-order mark is allowed."""
    d = spark.read.text(path, wholetext=True).select(F.parse_json(F.regexp_replace("value", "^﻿", "")).alias("v"))
    wrong = ~F.schema_of_variant("v").startswith("OBJECT")
    return d.select(F.when(wrong, F.raise_error(F.lit("expected a JSON object")).cast("variant")).otherwise(F.col("v")).alias("v"))


def _elements(documents: DataFrame) -> DataFrame:
    """(pos, item) of a list, or of the list under posts or urls of an object."""
    v = F.col("v")
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.posts", "array<variant>"),
                       F.try_variant_get(v, "$.urls", "array<variant>"))
    items = F.coalesce(items, F.raise_error(F.lit("expected a list, or an object with posts or urls")).cast("array<variant>"))
    return documents.select(F.posexplode(items).alias("pos", "item"))


def batch_input(spark: SparkSession, path: str) -> DataFrame:
    """(pos, url, metadata) of batch input: texts, or objects whose URL is under url, canonical_url or original_url."""
    from postloom.plans.normalize import text_of

    d = _elements(spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v")))
    i = F.col("item")
    url = F.coalesce(text_of(i, "$"), text_of(i, "$.url"), text_of(i, "$.canonical_url"), text_of(i, "$.original_url"))
    meta = F.map_filter(F.try_variant_get(i, "$", "map<string,variant>"), lambda k, _: ~k.isin("url", "canonical_url", "original_url"))
    usable = F.when(F.trim(url) != "", F.trim(url)).otherwise(F.raise_error(F.lit("an item has no usable URL")).cast("string"))
    return d.select("pos", usable.alias("url"), F.to_json(F.coalesce(meta, F.create_map().cast("map<string,variant>"))).alias("metadata"))


def keyword_file(spark: SparkSession, path: str) -> DataFrame:
    """(keywords): the distinct stripped texts of a JSON list, in order; anything else fails."""
    from postloom.operators.relational import keywords_in_order
    from postloom.plans.normalize import text_of

    items = F.coalesce(F.try_variant_get(F.parse_json("value"), "$", "array<variant>"), F.raise_error(F.lit("expected a JSON list")).cast("array<variant>"))
    words = F.transform(items, lambda x: F.coalesce(text_of(x, "$"), F.raise_error(F.lit("keywords must be texts")).cast("string")))
    return spark.read.text(path, wholetext=True).select(keywords_in_order(words).alias("keywords"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pos, url, platform, post_id, canonical_url, error) of a manifest of schema version 1; error names a broken rule."""
    from postloom.functions.url import classify
    from postloom.plans.normalize import manifest_error, text_of, whole_of

    v = F.col("v")
    d = json_document(spark, path).select(F.when(whole_of(v, "$.schema_version") == 1, v).otherwise(
        F.raise_error(F.lit("unsupported manifest schema_version")).cast("variant")).alias("v"))
    items = d.select(F.posexplode(F.try_variant_get("v", "$.items", "array<variant>")).alias("pos", "i"))
    flat = items.select("pos", *(text_of(F.col("i"), f"$.{k}").alias(k) for k in ("url", "platform", "post_id", "canonical_url")),
                        F.try_variant_get("i", "$.search_contexts", "array<variant>").isNotNull().alias("_contexts"))
    checked = classify(flat.withColumnsRenamed({"platform": "item_platform", "post_id": "item_id", "canonical_url": "item_url"}), "item_url")
    return checked.select("pos", "url", F.col("item_platform").alias("platform"), F.col("item_id").alias("post_id"), F.col("item_url").alias("canonical_url"),
                          manifest_error(F.col("item_platform"), F.col("_contexts"), F.col("platform")).alias("error"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """(platform, post_id, v): the last line of each identity; a line without one fails."""
    from postloom.plans.normalize import text_of

    d = jsonl_numbered(spark, path).select("line_number", "v", *(
        F.coalesce(text_of(F.col("v"), f"$.{k}"), F.raise_error(F.lit("history line without identity")).cast("string")).alias(k)
        for k in ("platform", "post_id")))
    last = d.groupBy("platform", "post_id").agg(F.max("line_number").alias("line_number"))
    return d.join(last, ["platform", "post_id", "line_number"], "left_semi").drop("line_number")
