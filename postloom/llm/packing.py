"""Best-fit packing planned on the length histogram: lengths are packed, then documents take the planned slots.

1. Each document is encoded and cut into pieces of at most the capacity (one map over rows, checkpointed).
2. The counts by length, at most `capacity` of them, go to the driver, where best-fit decreasing runs over counts:
   bins with equal room are one entry, so a step places thousands of pieces and the plan stays small however many
   documents there are.
3. The plan is expanded to one row a slot on the executors; a piece takes the slot with its length and its rank
   among the pieces of that length. Ranks come from counts by (length, salt) and a window inside each, so no length,
   however common, is ranked in one task.

Cases: a null or empty text is one piece that holds only the end id; only pieces longer than the capacity are cut;
rows that repeat a doc_id are documents of their own; texts are encoded whole, however long; pieces of one length take their
slots by salt, doc_id, piece and crc, and those alike in all may swap; an empty table gives no rows. Other columns are passed by.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Memo, checkpoint, kept, small_batches

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that one task ranks, about.
RANKED = 200_000
#: Slots of one part of the plan, about.
PART = 50_000

#: Marks that may close a word; the tokenizer always encodes letters and the marks after them apart.
_MARKS = ".,!?:;%&$#*|"
_PARTS = re.compile(r"([^\W\d_]+)([.,!?:;%&$#*|]+)")


#: Letters that the tokenizer's normaliser leaves as they are; a word of these is one input of its merges.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def byte_characters() -> str:
    """The public byte-level alphabet: bytes that print stand for themselves, the others follow from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    return "".join(chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256))


class WordEncoder:
    """Ids of a text by its words. The tokenizer never joins across white space, so each distinct word is encoded
    once by the library and then taken from a bounded memo. Only ASCII white space cuts words here. Words of plain letters go to the library's merges at
    once, other words through its normaliser and splitter too; texts with its own special tokens are encoded whole."""

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Memo(self._word, 300_000)
        self.parts = Memo(self._part, 300_000)
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = dict(enumerate(byte_characters()))
        self.codes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, text: str) -> bytes:
        """Ids of lower-case ASCII letters, which stand for themselves in the byte-level alphabet."""
        codes = self.codes
        return b"".join([codes[x.id] for x in self.merge(text)])

    def _part(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():
            return self._letters(text)
        if not _PLAIN.fullmatch(text):
            return self._library(text)
        codes = self.codes
        return b"".join([codes[x.id] for x in self.merge(text.encode().decode("latin-1").translate(self.alphabet))])

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if "<" in low and any(x in low for x in self.special):
            return self._library(word)  # in other letter case it isn't special to the library
        # lower case first where that is safe, so that fewer words are distinct
        if low.isascii():
            if low.isalpha():
                return self.parts[low]
            letters = low.rstrip(_MARKS)
            if letters.isalpha():
                return self.parts[letters] + self.parts[low[len(letters) :]]
            return self.parts[low]
        m = _PARTS.fullmatch(word)
        parts = m.groups() if m and m[1].lower().isalpha() else (word,)
        return b"".join([self.parts[low if (low := x.lower()).isascii() or _PLAIN.fullmatch(low) and len(low) == len(x) else x]
                         for x in parts])

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Each distinct word of the array is looked up once."""
        whole = reduce(pc.or_, (pc.match_substring(texts, x) for x in self.special), pa.repeat(False, len(texts)))
        lists = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        words = lists.flatten().dictionary_encode()
        of_word = pa.array([self.words[x] for x in words.dictionary.to_numpy(zero_copy_only=False).tolist()], pa.large_binary())
        ids = of_word.take(words.indices)
        _, starts, data = ids.buffers()
        starts = np.frombuffer(starts, "<i8")[ids.offset :] if len(ids) else np.zeros(1, np.int64)
        ends = starts[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        data = memoryview(data or b"")
        return [self._library(texts[i].as_py()) if whole[i].as_py() else bytes(data[a:b])
                for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as f:
        model = f.read()
    name = hashlib.sha256(model.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(model)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(name, lambda: WordEncoder(shared.value))
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder.encode_all(batch.column("text"))):
                ids = memoryview(ids + end)
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
            pa.default_memory_pool().release_unused()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, slots, slots a bin, first bin, offset in the bin).

    Slot r of a row, from 0, lies in bin `first bin + r // slots a bin`. Bins are kept as runs with equal room; a
    run is split only where a length's count ends inside it, so rows are about as many as lengths, not pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def add(left: int, first: int, bins: int) -> None:
        if left and bins:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, bins))

    plan, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                first, bins = room[left].pop()
                if not room[left]:
                    del room[left], rooms[k]
            else:
                left, first = capacity, opened
                bins = -(-todo // (capacity // length))
                opened += bins
            each = left // length
            full = min(bins, todo // each)
            if full:
                plan.append((length, rank, full * each, each, first, capacity - left))
                add(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            rest = bins - full
            if todo and rest:  # the last of this length: part of one bin
                plan.append((length, rank, todo, todo, first + full, capacity - left))
                add(left - todo * length, first + full, 1)
                full, rest, todo = full + 1, rest - 1, 0
            add(left, first + full, rest)
    return plan


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...); pieces must be materialised."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_best_fit(histogram, capacity)
    # long runs of slots are dealt out in parts of whole bins, on the executors, so that no task has to expand a large one
    rows = spark.createDataFrame(plan, "length long, rank0 long, slots long, each long, bin long, at long")
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(PART) / F.col("each"))) * F.col("each")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.col("step"))))
    slots = rows.withColumn("step", step).withColumn("part", number).select(
        "length", (F.col("rank0") + F.col("part") * F.col("step")).alias("rank0"),
        F.least("step", F.col("slots") - F.col("part") * F.col("step")).alias("slots"), "each",
        (F.col("bin") + F.floor(F.col("part") * F.col("step") / F.col("each"))).cast("long").alias("bin"), "at")
    slots = slots.repartition(max(1, min(50_000, (len(plan) + sum(histogram.values()) // PART) // 20)))
    slots = slots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("i")).select(
        "length", (F.col("rank0") + F.col("i")).alias("rank"),
        (F.col("bin") + F.floor(F.col("i") / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.col("i") % F.col("each") * F.col("length")).alias("offset"))

    salts = max(64, -(-max(histogram.values(), default=1) // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    before = F.coalesce(
        F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("length", "salt", before.alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("inside", inside).join(base, ["length", "salt"]).withColumn(
        "rank", F.col("base") + F.col("inside") - 1)
    # both sides grow with the documents: neither may be broadcast, whatever their estimates say
    return ranked.join(slots.hint("merge"), ["length", "rank"]).drop("salt", "inside", "base", "rank")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    packed = best_fit_pack(checkpoint(cut_pieces(docs, path, capacity, end_id)), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
