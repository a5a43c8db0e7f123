"""Helpers that several operators share: word rules, checkpoints, batches, connected components."""

from __future__ import annotations

import atexit
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here; a word is a maximal run of other characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Entries of one generation of a memo in a worker, and the length of a key that is still kept.
MEMO = 250_000
MEMO_KEY = 64


class Memo(dict):
    """A dictionary that makes what it lacks. A full one becomes the old generation, from which entries still in use
    come back, and keys of more than MEMO_KEY characters are made anew each time; so memory is bounded, frequent keys stay,
    and results don't depend on either."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(key) > MEMO_KEY:
            return self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


#: What an operator keeps in a worker process from task to task: one large object, such as an encoder with its memos.
_KEPT: dict[str, object] = {}


def kept(name: str, make):
    """The object of this name, made at its first use in a worker process; any other is let go."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Hand memory back that a worker process doesn't use: what other operators keep, and what Arrow's pool holds free."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # memos and their owners name each other
    pa.default_memory_pool().release_unused()


def lean(run):
    """The map of batches `run`, which keeps nothing in its worker process: memory is released before it and after."""
    @functools.wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return released


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, spark.checkpoint.dir. Only a session that runs in one process (tests, the
    benchmark) may do without: it gets a folder of its own, which goes when Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own_folder()
    return folder


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="postloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the cluster names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like checkpoint, but as compressed Parquet in that folder: for wide or many rows. The plan reads the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/postloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of texts holds in a Python worker (rows may be very long)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def short_methods(spark: SparkSession) -> None:
    """Have Spark split what would be a method of over 8,000 bytes: HotSpot doesn't compile those, and runs them some ten times as long."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > 8000:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df by key in the session's number of shuffle partitions, which small but laborious rows are otherwise merged into a few of."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, whatever their names."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def let(value: Column, body) -> Column:
    """Evaluate value once per row and hand it to body, however often body names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Rows of a key from which it counts as frequent: at least so many, and such a part of all rows.
FREQUENT = 1000
FREQUENT_PARTS = 50_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with table, one row a key that holds in `count` how many of rows have it.

    Keys of many rows, at most FREQUENT_PARTS of them since their rows add up to all rows at most, are broadcast, so
    their rows stay where they are; only the others are shuffled. No task then reads more than its share of a hot key.
    """
    table = stored(table)
    total = table.agg(F.sum(count)).first()[0] or 0
    least = max(FREQUENT, -(-total // FREQUENT_PARTS))
    often = table.where(F.col(count) >= least)
    if often.isEmpty():
        return rows.join(table, key)
    known = often.select(F.col(key).alias("_often"))
    rest = rows.join(F.broadcast(known), F.col(key) == F.col("_often"), "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(rest.join(table.where(F.col(count) < least), key))


#: Bits of a set of shingles, by which two sets are told apart without their texts.
SET_BITS = 1024


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """SET_BITS bits, as longs: those that the hashes of a set name."""
    flags = np.zeros(SET_BITS, np.uint8)
    flags[hashes & (SET_BITS - 1)] = 1
    return np.packbits(flags).view("<i8")


def may_be_similar(size_a: Column, size_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """False only if sets of these sizes and set_bits are certainly below a Jaccard similarity of 0.8.

    Similar sets share 4/9 of the sum of their sizes at least; a bit that one set lacks is an element of the other's that it lacks.
    """
    def missing(x: Column, y: Column) -> Column:
        return reduce(lambda m, n: m + n, (F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(k))))) for k in range(SET_BITS // 64)))

    most = lambda n: 9 * n - 4 * (size_a + size_b)
    return (most(size_a) >= 0) & (most(size_b) >= 0) & (9 * missing(bits_a, bits_b) <= most(size_a)) & (9 * missing(bits_b, bits_a) <= most(size_b))


def ones(bits: str) -> Column:
    """How many bits of set_bits are set."""
    return F.aggregate(bits, F.lit(0), lambda n, x: n + F.bit_count(x))


def bit_columns(bits: str, name: str) -> list[Column]:
    """set_bits of column `bits` as columns that are never null, for may_be_similar_columns."""
    return [F.coalesce(F.get(bits, F.lit(k)), F.lit(0).cast("bigint")).alias(f"bits{k}{name}") for k in range(SET_BITS // 64)]


def may_be_similar_columns(a: str, b: str) -> Column:
    """may_be_similar of columns size, ones and bit_columns of names a and b. A join that tests millions of pairs needs it in few
    instructions: of arrays, the code that Spark makes was over the 8,000 bytes up to which the JVM compiles a method."""
    c = lambda kind, x: F.col(f"{kind}{x}")
    most = lambda x: 9 * c("size", x) - 4 * (c("size", a) + c("size", b))
    both = reduce(lambda m, n: m + n, (F.bit_count(c(f"bits{k}", a).bitwiseAND(c(f"bits{k}", b))) for k in range(SET_BITS // 64)))
    return (most(a) >= 0) & (most(b) >= 0) & (9 * both >= F.greatest(9 * c("ones", a) - most(a), 9 * c("ones", b) - most(b)))


#: Longs of a bitmap that tells which rows are wanted.
MAP_WORDS = 1 << 17
_WORD, _BIT = f"cast(shiftrightunsigned({{0}}, 6) % {MAP_WORDS} as int)", "shiftleft(1L, cast({0} & 63 as int))"


def bitmap_words(wanted: DataFrame, name: str) -> np.ndarray:
    """MAP_WORDS longs with a bit set for every hash in column name of wanted."""
    set_bits = wanted.groupBy(F.expr(_WORD.format(name)).alias("word")).agg(F.expr(f"bit_or({_BIT.format(name)})").alias("bits")).toArrow()
    words = np.zeros(MAP_WORDS, np.int64)
    words[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy()
    return words


def bitmap(wanted: DataFrame, name: str) -> DataFrame:
    """bitmap_words as one row, words."""
    one = pa.table({"words": pa.array([bitmap_words(wanted, name)], pa.list_(pa.int64()))})
    return wanted.sparkSession.createDataFrame(one)


def _hit(name: str) -> Column:
    return F.expr(f"get(words, {_WORD.format(name)}) & {_BIT.format(name)} <> 0")


def in_bitmap(rows: DataFrame, name: str, words: DataFrame) -> DataFrame:
    """All rows whose hash is wanted, and few others."""
    return rows.join(F.broadcast(words), _hit(name)).drop("words")


def out_of_bitmap(rows: DataFrame, name: str, words: DataFrame) -> DataFrame:
    """The rows that in_bitmap leaves out."""
    return rows.join(F.broadcast(words), ~_hit(name)).drop("words")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) of any orderable type -> (node, root), root the least node that can be reached.

    Alternates large-star and small-star steps; minima are combined map-side and joined back by node: the links
    of a star's centre are read by one task, but never held by it. Lineage is cut each round in the shared checkpoint folder.
    Self links are ignored; nodes without links don't appear.
    """
    e = checkpoint(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        e = checkpoint(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        e.groupBy("v").agg(F.min("v").alias("root")).select(F.col("v").alias("node"), "root")
    ).groupBy("node").agg(F.min("root").alias("root"))
