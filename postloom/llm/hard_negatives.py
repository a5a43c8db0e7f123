"""Hard negatives by norm-bucketed search: exact best inner products inside a window of scores.

1. Vectors become whole numbers (floor of 256 times a component) with their norms and are stored. Sorted by norm, the
   longest first, they are cut into buckets of some KB; sorting goes by norm and row, so equal norms are split too.
2. Anchors, in blocks, meet the buckets: a task has one block of anchors and one lane of buckets (every so-manieth of
   the order), which come in descending norm. Scores of an anchor with a bucket are at most its norm times the bucket's
   largest norm (Cauchy-Schwarz); where that is below what every window of the anchor still needs (its lower limit, or
   the kth score found so far), the anchor is done with all further buckets.
3. The first search finds an anchor's positives (same label, no limits). Each gives a window for the second
   search (other labels), before which buckets below all windows are not even dealt out.
4. Best ones of all lanes are merged by a window over (anchor, positive), at most k rows a lane.

Scores are exact: matrix products run in the narrowest of float32, float64 and int64 that the norms show to be safe, else
in Python's integers. Anchors against all rows, in blocks, is the job itself; no key has its own task, so a label or a vector that
a third of the rows share changes nothing. Memory is one block, one batch of buckets and a matrix of both.

Cases: rows with a null label, a null vector, or a null or non-finite component (256-fold too) take no part; where vectors differ in
length, missing components count as zero; rows that repeat a vec_id are rows of their own, as anchors, positives and
negatives; a null vec_id is no anchor, comes last among ties and is returned as null (as are the two largest longs); scores beyond 2**60 count as
2**60; a negative positive score has no window; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Anchors of one block, about; bytes of the vectors of one bucket; rows of one lane and fewest lanes; most tasks.
BLOCK = 512
BUCKET_BYTES = 1 << 17
LANE_ROWS = 1 << 21
LANES = 8
TASKS = 20_000
#: Rows that one task cuts into buckets, about, and the fewest such tasks.
CUT_ROWS = 1 << 17
CUTS = 8
#: Scores are within +-LIMIT. EMPTY stands for no candidate, NO_ID for one without vec_id.
LIMIT = 1 << 60
EMPTY, NO_ID = (1 << 63) - 1, (1 << 63) - 2

_CELLS = {2: "<i2", 4: "<i4", 8: "<f8"}


def _packed(cells: np.ndarray) -> tuple[int, bytes]:
    """The narrowest form of whole numbers held as doubles, and its bytes."""
    most = np.abs(cells).max(initial=0)
    code = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return code, cells.astype(_CELLS[code]).tobytes()


def whole_vectors(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, embedding) that take part, as (vec_id, label, norm, width, code, cells, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, norms, widths, codes, cells = [], [], [], [], [], []
            for vec_id, label, vector in zip(*(batch.column(k) for k in ("vec_id", "label", "embedding")), strict=True):
                x = vector.values
                if x.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(256 * x.cast(pa.float64()).to_numpy(zero_copy_only=False))
                    if not np.isfinite(x).all():
                        continue
                    norm = float(np.linalg.norm(x)) * (1 + 1e-12)
                code, packed = _packed(x)
                ids.append(vec_id.as_py())
                labels.append(label.as_py())
                norms.append(norm)
                widths.append(len(x))
                codes.append(code)
                cells.append(packed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(norms, pa.float64()), pa.array(widths, pa.int32()),
                 pa.array(codes, pa.int32()), pa.array(cells, pa.binary())], ["vec_id", "label", "norm", "width", "code", "cells"])

    whole = rows.where("label is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return whole.mapInArrow(run, "vec_id long, label long, norm double, width int, code int, cells binary").withColumn("row", F.monotonically_increasing_id())


def _matrix(rows: list[tuple[int, int, bytes]]) -> np.ndarray:
    """(width, code, cells) rows as one matrix of doubles; short rows are filled up with zeros."""
    widths = {w for w, _, _ in rows}
    if len(widths) == 1 and len({c for _, c, _ in rows}) == 1:
        w, code, _ = rows[0]
        return np.frombuffer(b"".join(c for _, _, c in rows), _CELLS[code]).reshape(len(rows), w).astype(np.float64)
    out = np.zeros((len(rows), max(widths, default=0)))
    for k, (w, code, cells) in enumerate(rows):
        out[k, :w] = np.frombuffer(cells, _CELLS[code])
    return out


def norm_buckets(vectors: DataFrame, lanes: int, cuts: int) -> DataFrame:
    """Buckets of stored whole_vectors: (lane, top, rows, width, code, cells, numbers), numbers being rows, ids and labels.

    Every bucket holds rows of neighbouring norms, of which top is the largest; lanes take buckets in turn.
    """
    number = np.dtype("<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        turn, size = None, 0

        def flush():
            m = _matrix([(r["width"], r["code"], r["cells"]) for r in held])
            code, cells = _packed(m)
            numbers = np.array([[r["row"] for r in held], [NO_ID if r["vec_id"] is None else min(r["vec_id"], NO_ID) for r in held], [r["label"] for r in held]], number)
            return pa.RecordBatch.from_pydict({
                "lane": pa.array([turn % lanes], pa.int32()), "top": [max(r["norm"] for r in held)], "rows": pa.array([len(held)], pa.int32()),
                "width": pa.array([m.shape[1]], pa.int32()), "code": pa.array([code], pa.int32()), "cells": pa.array([cells], pa.binary()),
                "numbers": pa.array([numbers.tobytes()], pa.binary())})

        for batch in batches:
            for r in batch.to_pylist():
                turn = r["cut"] if turn is None else turn
                if held and size + len(r["cells"]) > BUCKET_BYTES:
                    yield flush()
                    held, size, turn = [], 0, turn + 1
                held.append(r)
                size += len(r["cells"])
        if held:
            yield flush()

    dealt = vectors.repartitionByRange(cuts, F.desc("norm"), F.asc("row")).sortWithinPartitions(F.desc("norm"), F.asc("row"))
    return dealt.withColumn("cut", F.spark_partition_id()).mapInArrow(
        run, "lane int, top double, rows int, width int, code int, cells binary, numbers binary")


class _Search:
    """The search of one task: a block of anchors, each with windows (lo, hi), against buckets in descending norm."""

    def __init__(self, anchors: list[dict], k: int, same: bool):
        self.k, self.same = k, same
        self.rows = np.array([a["row"] for a in anchors], np.int64)
        self.labels = np.array([a["label"] for a in anchors], np.int64)
        self.norms = np.array([a["top"] for a in anchors])
        self.cells = _matrix([(a["width"], a["code"], a["cells"]) for a in anchors])
        windows = max(len(a["lo"]) for a in anchors)
        self.lo = np.full((len(anchors), windows), LIMIT + 1, np.int64)  # no score reaches it
        self.hi = np.full((len(anchors), windows), LIMIT, np.int64)
        for i, a in enumerate(anchors):
            self.lo[i, : len(a["lo"])] = a["lo"]
            self.hi[i, : len(a["hi"])] = a["hi"]
        self.score = np.repeat(self.lo[:, :, None], k, 2)
        self.id = np.full(self.score.shape, EMPTY, np.int64)

    def _scores(self, some: np.ndarray, cells: np.ndarray, top: float) -> np.ndarray:
        a = self.cells[some]
        w = min(a.shape[1], cells.shape[1])
        a, b = a[:, :w], cells[:, :w].T
        most = max(1.0, float(self.norms[some].max())) * max(1.0, top)
        if most < 1 << 24:
            return a.astype(np.float32) @ b.astype(np.float32)
        if most < 1 << 53:
            return a @ b
        if most < 1 << 62:
            return np.clip(a.astype(np.int64) @ b.astype(np.int64), -LIMIT, LIMIT)
        exact = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b.T] for u in a]
        return np.array([[max(-LIMIT, min(LIMIT, x)) for x in r] for r in exact], np.int64).reshape(len(a), b.shape[1])

    def meet(self, bucket: dict) -> None:
        # the least that a further candidate of any window must reach
        need = np.maximum(self.score[:, :, -1], self.lo).min(1)
        some = np.flatnonzero(self.norms * bucket["top"] * (1 + 1e-9) >= need)
        if not len(some):
            return
        cells = np.frombuffer(bucket["cells"], _CELLS[bucket["code"]]).reshape(bucket["rows"], bucket["width"]).astype(np.float64)
        rows, ids, labels = np.frombuffer(bucket["numbers"], "<i8").reshape(3, bucket["rows"])
        scores = self._scores(some, cells, bucket["top"])
        fits = (self.labels[some, None] == labels) == self.same
        if self.same:
            fits &= self.rows[some, None] != rows
        for w in range(self.lo.shape[1]):
            last = self.score[some, w, -1]
            u, v = np.nonzero(fits & (scores >= last[:, None].astype(scores.dtype)))
            s, i, a = scores[u, v].astype(np.int64), ids[v], some[u]
            # exactly now: a candidate beats the kth by its score, or by its id if the scores are equal
            good = (s <= self.hi[a, w]) & ((s > self.score[a, w, -1]) | ((s == self.score[a, w, -1]) & (i < self.id[a, w, -1])))
            if good.any():
                self._merge(w, a[good], s[good], i[good])

    def _merge(self, w: int, a: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        touched = np.unique(a)
        a = np.concatenate((a, np.repeat(touched, self.k)))
        s = np.concatenate((s, self.score[touched, w].ravel()))
        i = np.concatenate((i, self.id[touched, w].ravel()))
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        first = place < self.k
        self.score[a[first], w, place[first]] = s[first]
        self.id[a[first], w, place[first]] = i[first]

    def found(self) -> pa.RecordBatch:
        a, w, k = np.nonzero(self.id != EMPTY)
        return pa.RecordBatch.from_pydict({"row": self.rows[a], "slot": w.astype(np.int32), "id": self.id[a, w, k], "score": self.score[a, w, k]})


def best_in_windows(anchors: DataFrame, buckets: DataFrame, k: int, same: bool, blocks: int, lanes: int) -> DataFrame:
    """(row, slot, rank, id, score): for each anchor (row, label, norm, width, code, cells, lo, hi) and each of its windows the
    k best candidates of its label (same) or of other labels, higher scores first, ties by id."""
    long = "array<bigint>"
    a = anchors.select(
        F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"),
        F.col("norm").alias("top"), "width", "code", "cells", "row", "label", "lo", "hi", F.lit(1).alias("rows"), F.lit(None).cast("binary").alias("numbers"))
    b = buckets.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "lane", F.lit(1).alias("kind"), "top", "width", "code", "cells",
        F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("label"), F.lit(None).cast(long).alias("lo"), F.lit(None).cast(long).alias("hi"),
        "rows", "numbers")
    tasks = min(blocks * lanes, TASKS)
    both = a.unionByName(b).withColumn("task", F.col("block") * lanes + F.col("lane")).drop("block", "lane")
    dealt = both.repartitionById(tasks, (F.col("task") % tasks).cast("int")).sortWithinPartitions("task", "kind", F.desc("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, search = None, [], None
        for row in (row for batch in batches for row in batch.to_pylist()):
            if row["task"] != task:
                if search is not None:
                    yield search.found()
                task, block, search = row["task"], [], None
            if row["kind"] == 0:
                block.append(row)
            elif block:  # a block may lack anchors
                if search is None:
                    search = _Search(block, k, same)
                search.meet(row)
        if search is not None:
            yield search.found()

    found = dealt.mapInArrow(run, "row bigint, slot int, id bigint, score bigint")
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _id(name: str) -> Column:
    return F.when(F.col(name) < NO_ID, F.col(name))


def hard_negatives(rows: DataFrame, anchor: Column, k_positive: int = 5, k_negative: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    anchor says which rows are anchors (a condition on vec_id). A negative's score lies between its positive's
    and least[0]/least[1] of it.
    """
    spark = rows.sparkSession
    small_batches(spark)
    vectors = stored(whole_vectors(rows))
    is_anchor = anchor & F.col("vec_id").isNotNull()
    n, n_anchors = vectors.agg(F.count("*"), F.count_if(is_anchor)).first()
    blocks, lanes = max(1, -(-n_anchors // BLOCK)), max(LANES, -(-n // LANE_ROWS))
    buckets = stored(norm_buckets(vectors, lanes, max(CUTS, -(-n // CUT_ROWS))))
    anchors = vectors.where(is_anchor)

    open_ = anchors.withColumns({"lo": F.array(F.lit(-LIMIT)), "hi": F.array(F.lit(LIMIT))})
    positives = stored(best_in_windows(open_, buckets, k_positive, True, blocks, lanes).where("score >= 0"))
    part, whole = least
    windows = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("ranked")).select(
        "row", F.expr(f"transform(ranked, r -> (r.score div {whole}) * {part} + ((r.score % {whole}) * {part} + {whole - 1}) div {whole})").alias("lo"),
        F.col("ranked.score").alias("hi"))
    second = stored(anchors.join(windows, "row"))
    # no anchor needs a bucket whose norms are below the least quotient of lower limit and norm
    floor = second.agg(F.min(F.when(F.col("norm") > 0, F.array_min("lo") / F.col("norm")).otherwise(0.0))).first()[0] or 0.0
    found = best_in_windows(second, buckets.where(F.col("top") >= floor * (1 - 1e-9)), k_negative, False, blocks, lanes)
    of = positives.select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    return found.join(of, ["row", "slot"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", _id("positive").alias("positive_id"), "rank", _id("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
