"""Token ids as flat files: little-endian unsigned integers, 64-bit offsets of documents, read by memory mapping.

A folder holds, for each part NNNNN:

    NNNNN.bin    the ids of its documents one after another, in as few bytes each (2 or 4) as the vocabulary needs
    NNNNN.idx    64-bit offsets into the part, in ids: one a document and the end
    NNNNN.ids    the documents' ids, an Arrow file

and `parts.parquet`, written last: of each part its counts of documents and ids and the sums of those before it, the
part's bases. A document's place in the whole is its part's base and its own offset. A folder without it isn't complete.

1. Texts are dealt by ranges of doc_id, further told apart by hash and place, so that even one id of all rows is split.
2. Each task encodes its texts and writes its part in one pass, under a name of its own, and moves it into place; a
   repeated task writes the same bytes.
3. Counts of parts come back, a few numbers each, and their prefix sums are the bases.

The tokenizer is the library's. Pre-tokens never reach over the last of a run of white space, so texts are cut there,
and each distinct stretch of a batch is encoded once and then taken from a bounded memo.

Cases: a null or empty text is one end id; rows that repeat a doc_id are documents of their own, next to each other; a null doc_id
comes last; texts of any length are encoded whole; an empty table gives no parts; other columns are passed by.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches, stored

#: Bytes of text of one part, about, at scale; small inputs have smaller parts, as many as the session shuffles to.
PART_BYTES = 1 << 28
LEAST_BYTES = 1 << 20
#: Stretches that the memo holds in each of its two generations, and the bytes of one that is still kept.
MEMO = 400_000
MEMO_KEY = 64
#: Bytes of text that are looked at for cuts at once.
BLOCK = 1 << 15
#: Documents of one batch that a reader gives, and the most tasks that read.
READ = 512
READERS = 20_000

_PARTS = pa.schema([("part", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64()), ("first_document", pa.int64()), ("first_id", pa.int64()),
                    ("width", pa.int32())])

# Kinds of bytes: ASCII white space; other than a space; not white space, nor what may begin any further one in UTF-8; ASCII letters;
# marks that pre-tokens of letters leave out (an apostrophe may begin one)
_SPACE, _LINE, _DARK, _LETTER, _MARK = 1, 2, 4, 8, 16
_KINDS = np.full(256, _DARK, np.uint8)
for _kind, _bytes in ((0, b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3"), (_SPACE, b" "), (_SPACE | _LINE, b"\t\n\x0b\x0c\r"), (_DARK | _MARK, b".,;:!?()[]{}*#$%&|<>\"-_/"),
                      (_DARK | _LETTER, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")):
    _KINDS[list(_bytes)] = _kind
_TABLE = _KINDS.tobytes()


class StretchEncoder:
    """Ids of texts as bytes of unsigned integers, by stretches that the tokenizer encodes apart."""

    def __init__(self, model: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(model)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = f"<u{width}"
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _library(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def _stretches(self, stretches: list[bytes]) -> list[bytes]:
        known, old = self.known, self.old
        out = list(map(known.get, stretches))
        fresh = [i for i, ids in enumerate(out) if ids is None]
        missing = [stretches[i] for i in fresh if stretches[i] not in old]
        made = dict(zip(missing, self._library(missing), strict=True))
        if len(known) > MEMO:  # what is still in use comes back from the old generation
            self.old, self.known, fresh = known, {}, range(len(out))
        for i in fresh:
            x = stretches[i]
            if out[i] is None:
                out[i] = made[x] if x in made else old[x]
            if len(x) <= MEMO_KEY:
                self.known[x] = out[i]
        return out

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        texts = texts.cast(pa.large_binary())
        _, starts, data = texts.buffers()
        if not len(texts) or data is None:
            return [b""] * len(texts)
        starts = np.frombuffer(starts, "<i8")[texts.offset : texts.offset + len(texts) + 1]
        codes = np.frombuffer(data, np.uint8)[: starts[-1]]
        whole = reduce(pc.or_, (pc.match_substring(texts, x) for x in self.special), pa.repeat(False, len(texts))).to_pylist()
        # cut[i]: a stretch starts at byte i. The last of a run of white space starts one, what follows a line end too, and a mark after a letter
        cut = np.zeros(len(codes) + 1, bool)
        if len(codes) > 1:
            for a in range(0, len(codes) - 1, BLOCK):  # arrays that stay in the cache
                kinds = np.frombuffer(codes[a : a + BLOCK + 1].tobytes().translate(_TABLE), np.uint8)
                now, dark, n = kinds[:-1], kinds[1:] & _DARK != 0, a + len(kinds) - 1
                cut[a:n] |= (now & _SPACE != 0) & dark
                cut[a + 1 : n + 1] |= ((now & _LINE != 0) & dark) | ((now & _LETTER != 0) & (kinds[1:] & _MARK != 0))
        cut[starts[1:] - 1] = False  # what follows is another text's
        cut[: starts[0]] = False
        cut[starts] = True
        ends = np.flatnonzero(cut)
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i8")), data])
        words = stretches.dictionary_encode()
        ids = pa.array(self._stretches(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        _, at, got = ids.buffers()
        at = np.frombuffer(at, "<i8")[ids.offset :] if len(ids) else np.zeros(1, np.int64)
        at = at[np.searchsorted(ends, starts)].tolist()
        got = memoryview(got or b"")
        return [self._library([texts[i].as_py()])[0] if whole[i] else bytes(got[a:b]) for i, (a, b) in enumerate(zip(at, at[1:], strict=False))]


#: The last encoder of this worker process, by the model's digest.
_ENCODERS: dict[tuple[str, int], StretchEncoder] = {}


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that may be a URI."""
    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Write docs' ids, with end_id after each document, to a new folder, in ascending order of doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as f:
        model = f.read()
    width = 2 if max(Tokenizer.from_str(model).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    name = hashlib.sha256(model.encode()).hexdigest(), width
    shared = spark.sparkContext.broadcast(model)
    end = end_id.to_bytes(width, "little")

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_BYTES)))
    order = F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("at")
    dealt = texts.withColumns({"hash": F.xxhash64("text"), "at": F.monotonically_increasing_id()}).repartitionByRange(
        parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    system, root = _place(folder)
    system.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = StretchEncoder(shared.value, width)
        system, root = _place(folder)
        part, own = TaskContext.get().partitionId(), f"{root}/.{uuid.uuid4().hex}"
        batch = next(batches, None)
        if batch is None:
            return
        lengths = [np.zeros(1, np.int64)]
        with system.open_output_stream(f"{own}.bin") as bin_, system.open_output_stream(f"{own}.ids") as ids_:
            with pa.ipc.new_file(ids_, pa.schema([batch.schema.field("doc_id")])) as keys:
                while batch is not None:
                    keys.write_batch(batch.select(["doc_id"]))
                    ids = [x + end for x in _ENCODERS[name].encode_all(batch.column("text"))]
                    bin_.write(b"".join(ids))
                    lengths.append(np.array([len(x) // width for x in ids], np.int64))
                    batch = next(batches, None)
        offsets = np.cumsum(np.concatenate(lengths)).astype("<i8")
        with system.open_output_stream(f"{own}.idx") as idx:
            idx.write(offsets.tobytes())
        for kind in ("bin", "ids", "idx"):
            system.move(f"{own}.{kind}", f"{root}/{part:05d}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "documents": [len(offsets) - 1], "ids": [int(offsets[-1])]})

    written = stored(dealt.mapInArrow(write, "part bigint, documents bigint, ids bigint")).orderBy("part").toArrow()
    documents, ids = (written.column(k).to_numpy() for k in ("documents", "ids"))
    table = pa.Table.from_arrays(
        [written.column("part"), pa.array(documents), pa.array(ids), pa.array(np.cumsum(documents) - documents), pa.array(np.cumsum(ids) - ids),
         pa.array(np.full(len(ids), width, np.int32))], schema=_PARTS)
    with system.open_output_stream(f"{root}/.parts") as out:
        pq.write_table(table, out)
    system.move(f"{root}/.parts", f"{root}/parts.parquet")


def _mapped(system: fs.FileSystem, path: str) -> pa.Buffer:
    """A file's bytes: mapped where it is local, read where it isn't."""
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with system.open_input_file(path) as f:
        return f.read_buffer()


class Part:
    """One part, mapped: doc_ids, offsets, and the ids of a document by its number."""

    def __init__(self, folder: str, part: int, width: int):
        system, root = _place(folder)
        at = f"{root}/{part:05d}"
        self.doc_ids = pa.ipc.open_file(_mapped(system, f"{at}.ids")).read_all().column("doc_id")
        self.offsets = np.frombuffer(_mapped(system, f"{at}.idx"), "<i8")
        self.all_ids = np.frombuffer(_mapped(system, f"{at}.bin"), f"<u{width}")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.all_ids[self.offsets[i] : self.offsets[i + 1]]


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of a folder: start counts the ids of all documents before it;
    with_ids=False leaves the ids in the workers."""
    parts = spark.read.parquet(f"{folder}/parts.parquet")
    first, last = parts.agg(F.min("part"), F.max("part")).first()
    if first is None:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
    probe = Part(folder, first, 2).doc_ids.type
    kind = "string" if pa.types.is_string(probe) or pa.types.is_large_string(probe) else "bigint" if pa.types.is_int64(probe) else "int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            part = Part(folder, row["part"], row["width"])
            for a in range(0, len(part), READ):
                b = min(a + READ, len(part))
                offsets = part.offsets[a : b + 1]
                ids = [part[i].astype("<u4") for i in range(a, b)]
                columns = {"doc_id": part.doc_ids[a:b].combine_chunks(), "start": pa.array(row["first_id"] + offsets[:-1]), "n_tokens": pa.array(np.diff(offsets)),
                           "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    tasks = min(last + 1, READERS)
    return parts.repartitionById(tasks, (F.col("part") % tasks).cast("int")).mapInArrow(
        read, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
