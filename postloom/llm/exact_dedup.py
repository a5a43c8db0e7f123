"""Exact dedup of an incoming batch against an immutable snapshot, screened by static binary-fuse filters.

The snapshot's digests are dealt into buckets; each bucket gets one binary-fuse filter (8-bit fingerprints, three
slots a key), built once, since a snapshot never changes. An incoming batch is first grouped by digest on its own,
then each of its digests is probed in its bucket's filter. Digests that the filter rejects are new for certain. The
others join the exact bucket, and the texts of the two representatives are compared as bytes, so neither a filter's
false positive nor a digest collision merges different texts.

Sizes: digests, not texts, are shuffled and grouped, with map-side combine, so a group of copies with a third of all
rows is a few partial rows, and its rows meet their group by broadcast. Of texts only the representatives that the byte
check needs move; a bitmap of fixed size keeps the others in place. Filters take about nine bits a snapshot digest and
stay with their buckets; they are never broadcast.

Cases: null text counts as empty; texts are compared after each run of ASCII white space becomes one space; of equal
texts the least doc_id stays, a null doc_id only if there is no other; of rows that repeat both doc_id and text one
stays. Texts of any length are compared whole. Either side may be empty. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, checkpoint, in_bitmap, join_counted, text_or_empty

KEYS_PER_BUCKET = 500_000
MIN_BUCKETS = 256


def normalised(text: str = "text") -> Column:
    """Each run of white space becomes one space; runs that are one space already are not matched."""
    return F.regexp_replace(text_or_empty(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


class FuseFilter:
    """Static binary-fuse filter over distinct 64-bit keys: built by peeling whole rounds of single-key slots."""

    def __init__(self, seed: int, segment: int, count: int, prints: np.ndarray):
        self.seed, self.segment, self.count, self.prints = seed, segment, count, prints

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))

    @staticmethod
    def _slots(h: np.ndarray, segment: int, count: int) -> np.ndarray:
        """Three slots in three segments that follow each other."""
        first = ((h >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) >> np.uint64(7)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = min(262_144, 1 << int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        count = max(1, math.ceil(n * factor / segment) - 2 + (n < 64))
        seed = 1
        while True:
            h = cls._mix(keys, seed)
            slots = cls._slots(h, segment, count)
            if (rounds := cls._peel(slots, (count + 2) * segment)) is not None:
                break
            seed += 1
            count += seed > 8  # more room after several bad seeds
        prints = np.zeros((count + 2) * segment, np.uint8)
        want = cls._print(h)
        for who, where in reversed(rounds):
            s = slots[:, who]
            # the own slot is still 0, so the xor over all three is the xor over the other two
            prints[where] = want[who] ^ prints[s[0]] ^ prints[s[1]] ^ prints[s[2]]
        return cls(seed, segment, count, prints)

    @staticmethod
    def _peel(slots: np.ndarray, size: int):
        n = slots.shape[1]
        load = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        index = np.arange(n)
        for s in slots:
            np.bitwise_xor.at(owner, s, index)
        rounds, left = [], n
        ready = np.flatnonzero(load == 1)
        while left:
            ready = ready[load[ready] == 1]
            if not len(ready):
                return None
            who, at = np.unique(owner[ready], return_index=True)
            where = ready[at]
            rounds.append((who, where))
            left -= len(who)
            for s in slots[:, who]:
                np.subtract.at(load, s, 1)
                np.bitwise_xor.at(owner, s, who)
            ready = np.unique(slots[:, who])
        return rounds

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        h = self._mix(keys, self.seed)
        a, b, c = self._slots(h, self.segment, self.count)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == self._print(h)


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, sha, key): one row a document; the text itself stays behind."""
    sha = docs.select("doc_id", F.sha2(normalised(), 256).alias("sha"))
    return sha.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sha", F.xxhash64("sha").alias("key"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row a digest: its size and the row that would stay."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return rows.groupBy("sha", "key").agg(first.alias("first"), F.count("*").alias("n"))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """The snapshot's filters, one row a bucket; keep them with the snapshot, as it never changes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame([(pdf["bucket"].iat[0], f.seed, f.segment, f.count, f.prints.tobytes())],
                            columns=["bucket", "seed", "segment", "count", "prints"])

    keyed = groups.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key")
    return keyed.groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, count int, prints binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Adds maybe: false where the snapshot certainly lacks the digest."""

    def probe(inc: pd.DataFrame, flt: pd.DataFrame) -> pd.DataFrame:
        out = inc[["sha", "key"]].copy()
        out["maybe"] = False
        if len(inc) and len(flt):
            r = flt.iloc[0]
            f = FuseFilter(int(r["seed"]), int(r["segment"]), int(r["count"]), np.frombuffer(r["prints"], np.uint8))
            out["maybe"] = f.contains(inc["key"].to_numpy().view(np.uint64))
        return out

    keyed = groups.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "sha", "key")
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(
        probe, "sha string, key bigint, maybe boolean")


def exact_dedup(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, part, screened) for every row of both.

    part is 'snapshot' or 'batch'; screened tells for a batch row whether its digest passed the filter.
    """
    texts = snapshot.select("doc_id", "text", F.lit("snapshot").alias("part")).unionByName(
        batch.select("doc_id", "text", F.lit("batch").alias("part")))
    rows = texts.select("doc_id", "part", F.sha2(normalised(), 256).alias("sha"))
    rows = checkpoint(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", "sha",
                                  F.xxhash64("sha").alias("key")))
    old = checkpoint(grouped(rows.where("part = 'snapshot'")))
    new = grouped(rows.where("part = 'batch'"))
    buckets = max(MIN_BUCKETS, math.ceil(old.count() / KEYS_PER_BUCKET))
    screened = checkpoint(new.join(screen(new, snapshot_filters(old, buckets), buckets), ["sha", "key"]))

    # positives meet their exact bucket entry; the byte check compares the two representatives' texts
    pairs = checkpoint(screened.where("maybe").select("sha", "key", F.col("first").alias("new_first")).join(
        old.select("sha", "key", F.col("first").alias("old_first")), ["sha", "key"]))
    texts_of = {}
    for side, docs in (("new", batch), ("old", snapshot)):
        wanted = pairs.select("sha", F.col(f"{side}_first.doc_id").alias("id"))
        norm = docs.select("doc_id", normalised().alias("norm")).withColumn("sha", F.sha2("norm", 256)).withColumn("h", F.xxhash64("sha"))
        # most texts are no representatives and stay where they are
        norm = in_bitmap(norm, "h", bitmap(wanted.select(F.xxhash64("sha").alias("h")), "h"))
        texts_of[side] = norm.join(
            wanted.withColumnRenamed("sha", "wanted"),
            (F.col("sha") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("id")),  # no semi-join: it would be moved before the bitmap
        ).select("sha", F.col("norm").alias(f"{side}_norm"))
    same = texts_of["new"].join(texts_of["old"], "sha").where("new_norm = old_norm").select("sha").distinct()

    joined = screened.join(same.withColumn("same", F.lit(True)), "sha", "left").select(
        "sha", "maybe", F.coalesce("same", F.lit(False)).alias("same"), F.col("first").alias("new_first"),
        F.col("n").alias("new_n"))
    groups = old.select("sha", F.col("first").alias("old_first"), F.col("n").alias("old_n")).join(joined, "sha", "full")
    both = F.when(F.col("same") | F.col("old_n").isNull() | F.col("new_n").isNull(),
                  F.struct(F.least("old_first", "new_first").alias("first"),
                           (F.coalesce("old_n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n")))
    groups = groups.select(
        "sha", (F.coalesce("old_n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("rows"), F.coalesce("maybe", F.lit(False)).alias("maybe"),
        F.coalesce(both, F.struct(F.col("old_first").alias("first"), F.col("old_n").alias("n"))).alias("of_old"),
        F.coalesce(both, F.struct(F.col("new_first").alias("first"), F.col("new_n").alias("n"))).alias("of_new"))
    mine = F.when(F.col("part") == "snapshot", F.col("of_old")).otherwise(F.col("of_new"))
    return join_counted(rows, groups, "sha", "rows").select(
        "doc_id", mine["first"]["doc_id"].alias("keep_id"), mine["n"].alias("group_size"),
        (mine["first"]["row"] == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"), "part",
        F.when(F.col("part") == "batch", F.col("maybe")).alias("screened"))


def split_by_id(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The older half of the id range as the stored snapshot, the rest (and null ids) as the incoming batch; ids that are no
    whole numbers are parted by hash."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        old = F.coalesce(F.xxhash64("doc_id") % 2 == 0, F.lit(False)) & F.col("doc_id").isNotNull()
        return docs.where(old), docs.where(~old)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return docs.where(old), docs.where(~old)
