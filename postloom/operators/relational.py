"""Order-aware relational operators: DataFrame in, DataFrame out. Input order is always an explicit column.

No operator gathers rows on the driver, and none needs a window without a partition: ranks and running counts over
the whole input go through with_global_rank, which ranks within ordered blocks and adds the blocks' counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task ranks, about, and the most blocks that a rank is dealt into.
ROWS_A_BLOCK = 200_000
MOST_BLOCKS = 4096
#: Keys looked at for each block, to place the bounds.
KEYS_A_BLOCK = 16


def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row in order of each key. An aggregate with map-side combine, so that a key with most rows is no
    task of its own; ties in order go to the least row."""
    first = F.min(F.struct(F.col(order).alias("_at"), F.struct(*(F.col(c) for c in df.columns if c not in keys)).alias("_row")))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first._row.*").select(*df.columns)


def _block(df: DataFrame, order: list[str], rows: int) -> Column:
    """The number of a row's block: blocks are ascending ranges of order with about `rows` rows each.

    Bounds are sampled once and become literals, so every use of the column, and every retried task, deals rows alike;
    the sample decides how even blocks are, never where a rank comes out. Equal keys share a block.
    """
    n = df.count()
    blocks = min(MOST_BLOCKS, n // rows + 1)
    if blocks == 1:
        return F.lit(0)
    share = min(1.0, KEYS_A_BLOCK * blocks / n)
    keys = df.select(*order).where(F.rand(1) < share).orderBy(*order).collect()  # 65,536 or so at most
    bounds = [keys[len(keys) * k // blocks] for k in range(1, blocks)] if keys else []
    kinds = dict(df.dtypes)
    literal = lambda r: F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, r, strict=True)))
    key = F.struct(*order)
    # plain sums of comparisons in two levels, so that a row meets about two square roots of all bounds
    below = lambda xs: reduce(Column.__add__, (F.coalesce((x < key).cast("int"), F.lit(0)) for x in xs))
    step = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not parts:
        return F.lit(0)
    part = below([literal(p[-1]) for p in parts])
    own = F.get(F.array(*(F.array(*map(literal, p)) for p in parts)), part)
    return part * step + below([F.get(own, j) for j in range(step)])


def with_global_rank(df: DataFrame, order: list[str], name: str = "rank", rows: int = ROWS_A_BLOCK) -> DataFrame:
    """Adds the 1-based position in order over all rows: range blocks are ranked each, then shifted by what is before."""
    parts = df.withColumn("_block", _block(df, order, rows))
    inside = parts.withColumn(name, F.row_number().over(Window.partitionBy("_block").orderBy(*order)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.groupBy("_block").agg(F.count("*").alias("n")).select("_block", before.alias("_base"))  # MOST_BLOCKS rows at most
    return inside.join(F.broadcast(base), "_block").withColumn(name, F.col(name) + F.col("_base")).drop("_block", "_base")


def rank_per_key(df: DataFrame, keys: list[str], order: str, name: str = "rank", rows: int = ROWS_A_BLOCK) -> DataFrame:
    """Adds the 1-based position in order within each key. Blocks are ranges of (keys, order), so a key with most rows is
    ranked in many tasks; of each block only its first and its last key can reach over its ends, hence at most two rows
    a block are broadcast."""
    parts = df.withColumn("_block", _block(df, [*keys, order], rows))
    inside = parts.withColumn(name, F.row_number().over(Window.partitionBy("_block", *keys).orderBy(order)))
    own = parts.groupBy(*keys, "_block").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    before = F.sum("n").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    base = own.withColumns({"_base": before, "_first": F.min("_block").over(w)}).where("_block > _first")
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    base = base.select(*keys, "_block", "_base")
    out = inside.alias("i").join(F.broadcast(base.alias("b")), [F.col("i._block") == F.col("b._block"), *same], "left")
    return out.select(*(F.col(f"i.{c}") for c in df.columns if c != name),
                      (F.col(f"i.{name}") + F.coalesce("b._base", F.lit(0))).alias(name))


def page_of_rank(rank: Column, size: int = 10) -> Column:
    return (F.floor((rank - 1) / size) + 1).cast("bigint")


def reject_reason(first_pos: Column, pos: Column, url: Column, platform: Column) -> Column:
    """Why a search result isn't taken; null where it is. first_pos: of its identity."""
    return (
        F.when(url.isNull() | (F.trim(url) == ""), "missing_url").when(platform.isNull(), "unsupported_url")
        .when(platform != "facebook", "non_facebook_post").when(pos > first_pos, "duplicate_facebook_post")
    )


def with_first_position(df: DataFrame, keys: list[str], order: str, name: str = "first_pos") -> DataFrame:
    """Adds the first position of a row's key; rows with a null key keep null."""
    first = df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.min(order).alias(name))
    return df.join(first, keys, "left")


def anti_processed(df: DataFrame, processed: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows none of whose identities was processed; keys maps a column to the column of processed it is compared with.

    One shuffle on (field, value) for any number of identities; rows are told apart by pos.
    """
    def long(d: DataFrame, columns: dict[str, str], *more: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(field).alias("field"), F.col(c).alias("value")) for field, c in columns.items()))
        return d.select(*more, F.explode(pairs).alias("k")).select(*more, "k.*").where("value is not null")

    seen = long(processed, {k: v for k, v in keys.items()}).distinct()
    hit = long(df, {k: k for k in keys}, "pos").join(seen, ["field", "value"], "left_semi").select("pos").distinct()
    return df.join(hit, "pos", "left_anti")


def merge_contexts(posts: DataFrame, distinct: bool) -> DataFrame:
    """One row a post of (platform, post_id, canonical_url, keyword, rank, url, pos): the first keyword, rank and URL,
    and all contexts in order of pos, each (keyword, rank, url) once if distinct."""
    context = ["keyword", "rank", "url"]
    each = posts.groupBy("platform", "post_id", *context).agg(F.min("pos").alias("pos"), F.min("canonical_url").alias("canonical_url")) if distinct else posts
    row = F.struct("pos", *context)
    out = each.groupBy("platform", "post_id").agg(
        F.min(F.struct("pos", "canonical_url", *context)).alias("f"), F.array_sort(F.collect_list(row)).alias("search_contexts"))
    return out.select("platform", "post_id", "f.canonical_url", F.col("f.keyword").alias("search_keyword"),
                      F.col("f.rank").alias("search_rank"), F.col("f.url").alias("search_result_url"), "search_contexts")


def running_limit(df: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows over all groups in order: what one group leaves is the next one's."""
    return with_global_rank(df, [group, *order], "_n").where(F.col("_n") <= limit).drop("_n")


def mark_batch(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Batch items with skip_reason: unsupported and repeated posts stay as skipped rows. With a limit, all from the
    first new supported post beyond it on goes."""
    d = with_first_position(df, ["platform", "post_id"], "pos")
    fb = F.coalesce(F.col("platform") == "facebook", F.lit(False))
    d = d.withColumn("skip_reason", F.when(~fb, "unsupported_facebook_url").when(F.col("pos") > F.col("first_pos"), "duplicate_facebook_post")).drop("first_pos")
    if limit is None:
        return d
    stop = d.where("skip_reason is null").orderBy("pos").limit(limit + 1).agg(F.when(F.count("*") > limit, F.max("pos")).alias("_stop"))
    return d.join(F.broadcast(stop)).where("_stop is null or pos < _stop").drop("_stop")  # one row


def login_breaker(df: DataFrame, run: str, order: str, failed_login: Column, threshold: int = 2, processed: Column | None = None) -> DataFrame:
    """Adds stopped: true after `threshold` login failures in a row within a run. Only processed items count: skipped ones
    neither fail nor end a row of failures."""
    d = df.withColumn("_done", F.lit(True) if processed is None else F.coalesce(processed, F.lit(False)))
    w = Window.partitionBy(run).orderBy(order)
    streak = F.lit(True)
    for k in range(threshold):
        streak = streak & F.coalesce(F.lag(failed_login, k).over(w) if k else failed_login, F.lit(False))
    tripped = d.where("_done").withColumn("_streak", streak).where("_streak").groupBy(run).agg(F.min(order).alias("_trip"))
    return d.join(tripped, run, "left").withColumn("stopped", F.coalesce(F.col(order) > F.col("_trip"), F.lit(False))).drop("_done", "_trip")


def page_plan(targets: DataFrame, size: int = 10, cap: int = 100) -> DataFrame:
    """(keyword, page_number, start, num): pages of at most `size` until target or cap is reached."""
    t = F.least(F.col("target"), F.lit(cap))
    pages = F.when(t > 0, F.sequence(F.lit(1), F.ceil(t / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = targets.select("keyword", t.alias("_t"), F.explode(pages).alias("page_number"))
    start = (F.col("page_number") - 1) * size + 1
    return out.select("keyword", F.col("page_number").cast("bigint"), start.cast("bigint").alias("start"),
                      F.least(F.lit(size), F.col("_t") - start + 1).cast("bigint").alias("num"))


def stop_paging(pages: DataFrame) -> DataFrame:
    """Pages (keyword, page_number, requested, received) up to and with the first short or empty one. Columns has_next
    and failed are minded where they are: no page follows one without a next, and a page that failed isn't taken."""
    w = Window.partitionBy("keyword").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("received") < F.col("requested")
    if "has_next" in pages.columns:
        last = last | ~F.coalesce("has_next", F.lit(True))
    failed = F.coalesce("failed", F.lit(False)) if "failed" in pages.columns else F.lit(False)
    before = F.max((last | failed).cast("int")).over(w)
    return pages.withColumn("_s", F.coalesce(before, F.lit(0))).where((F.col("_s") == 0) & ~failed).drop("_s")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old with new's last row of each key in place of its own, all columns at once (nulls too), and action:
    'kept', 'updated' or 'inserted'. Both have the same columns; order tells new's rows apart."""
    values = [c for c in old.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_at"), F.struct(*values).alias("_new"))).alias("_l"))
    last = last.select(*keys, F.col("_l._new").alias("_new"))
    both = old.select(*keys, F.struct(*values).alias("_old")).join(last, keys, "full")
    return both.select(*keys, F.coalesce("_new", "_old").alias("_v"),
                       F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").otherwise("updated").alias("action")).select(*keys, "_v.*", "action")


def history_decision(items: DataFrame, history: DataFrame, skip: tuple[str, ...] = ("success",), retry_failed: bool = False) -> DataFrame:
    """items with reason: why the history skips them; null where they are collected."""
    h = history.select("platform", "post_id", F.col("status").alias("_status"))
    reason = F.when(F.col("_status").isin(*skip), F.concat(F.lit("history_"), F.col("_status")))
    if not retry_failed:
        reason = reason.when(F.col("_status") == "failed", "history_failed_not_retryable")
    return items.join(h, ["platform", "post_id"], "left").withColumn("reason", reason).drop("_status")


def history_upsert(history: DataFrame, items: DataFrame, run: str) -> DataFrame:
    """History (platform, post_id, canonical_url, first_run, last_run, status) after a run over items (…, pos)."""
    last = items.groupBy("platform", "post_id").agg(
        F.max_by("canonical_url", F.when(F.col("canonical_url").isNotNull(), F.col("pos"))).alias("_url"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("pos"))).alias("_status"), F.lit(run).alias("_run"))
    both = history.join(last, ["platform", "post_id"], "full")
    return both.select(
        "platform", "post_id", F.coalesce("_url", "canonical_url").alias("canonical_url"), F.coalesce("first_run", "_run").alias("first_run"),
        F.coalesce("_run", "last_run").alias("last_run"),
        F.coalesce("_status", "status", F.lit("seen")).alias("status"))


FEW_KEYWORDS = 10_000


def post_keywords(posts: DataFrame, keywords: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Every post with every keyword of its run, blank ones apart, that isn't linked yet. Keywords are counted before
    they are broadcast; beyond FEW_KEYWORDS the join is left to the planner."""
    words = keywords.select(F.trim("keyword").alias("keyword")).where("keyword <> ''").distinct()
    few = words.count() <= FEW_KEYWORDS
    out = posts.select("platform", "post_id").distinct().crossJoin(F.broadcast(words) if few else words)
    return out if existing is None else out.join(existing, ["platform", "post_id", "keyword"], "left_anti")


def keywords_in_order(words: Column) -> Column:
    """Stripped, blank ones dropped, each once, in order."""
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.trim(w)), lambda k: k != ""))


def dedupe_up_to(df: DataFrame, keys: list[str], order: str, limit: int | None) -> DataFrame:
    """The first row of each key, and of these the first `limit` in order."""
    first = dedupe_first(df, keys, order)
    return first if limit is None else with_global_rank(first, [order], "_n").where(F.col("_n") <= limit).drop("_n")


def first_per_flag(df: DataFrame, flag: str, order: str, most: dict[bool, int]) -> DataFrame:
    """The first rows of each value of a flag in order, as many as most says."""
    ranked = rank_per_key(df, [flag], order, "_n")
    cap = F.create_map(*(F.lit(x) for pair in most.items() for x in pair))
    return ranked.where(F.col("_n") <= F.coalesce(F.element_at(cap, F.col(flag)), F.lit(0))).drop("_n")


def attempts(log: DataFrame, item: str, order: str, retryable: Column, most: int) -> DataFrame:
    """The attempts that are made: each item's tries in order, numbered, up to the first that succeeded or can't be
    repeated (column failed, and retryable), and at most `most`."""
    w = Window.partitionBy(item).orderBy(order)
    goes_on = F.coalesce(F.col("failed") & retryable, F.lit(False))
    ended = F.max((~goes_on).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = log.withColumns({"attempt": F.row_number().over(w), "_ended": F.coalesce(ended, F.lit(0))})
    return d.where((F.col("_ended") == 0) & (F.col("attempt") <= most)).drop("_ended")


def with_ids(new: DataFrame, order: str, name: str, old: DataFrame | None = None) -> DataFrame:
    """new with ids that go on from the greatest of old, in order: the same input gives the same ids."""
    start = 0 if old is None else old.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    return with_global_rank(new, [order], "_n").withColumn(name, (F.col("_n") + F.lit(start)).cast("bigint")).drop("_n")


def platforms_in_order(words: Column, known: tuple[str, ...] = ("x", "facebook")) -> Column:
    """Platforms of a list in lower case, blank ones dropped, each once; null if one isn't known."""
    clean = F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(F.trim(w))), lambda k: k != ""))
    return F.when(~F.exists(clean, lambda k: ~k.isin(*known)), clean)


def ordered_platforms(wanted: Column, enabled: Column) -> Column:
    """Enabled platforms in the wanted order, then the others in their own."""
    return F.array_union(F.filter(wanted, lambda k: F.array_contains(enabled, k)), enabled)
