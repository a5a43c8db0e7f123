"""SimHash near-dedup: fingerprints linked at few differing bits, found by Golay-code fuzzy hashing.

Fingerprints have 64 bits in three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits
agree on one segment at least (pigeonhole), and differ in at most two bits in any other. The next segment is read as
a word of the perfect binary Golay code (23, 12), which corrects three errors: a word within two bits of a codeword
yields the index of that codeword, any other the indices of all codewords within four bits, which are six. Words
that differ in at most two bits always share an index. So a fingerprint has up to 18 keys (segment number, that
segment's bits, index of the next), and every linked pair meets under one of them, at 33 or more matching bits.

Copies share a fingerprint and are one row from the start. Buckets of up to PAIRS_UP_TO fingerprints are joined
with themselves and verified; in fuller ones every fingerprint is laid out with its 64 one-bit neighbours, and two
fingerprints are at most two bits apart exactly if these meet, so a star to the least one at each meeting point links
them without making pairs. Links go through connected components, which gathers no group in one place.

Cases: a null text has no words; a text without words has fingerprint zero, linked like any other; rows that repeat
a doc_id are documents of their own; a null doc_id is a component's id only if it has no other; texts are read whole, however long; a bit
that half the shingles have is 0; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, join_counted, small_batches, text_or_empty

SHINGLE = 3
MAX_BITS = 2
SEED = 42
PAIRS_UP_TO = 32
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of words, ASCII letters in lower case; a short text is one shingle."""
    words = _WORDS(text.lower())
    if len(words) < size:
        words = [b" ".join(words)] if words else []
        return np.array([xxhash.xxh64_intdigest(x, SEED) for x in words], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(shingle_hashes(x, size)) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


class Golay:
    """Tables of the (23, 12) Golay code, from its generator polynomial."""

    GENERATOR = 0b101011100011

    def __init__(self):
        def remainder(x: int) -> int:
            for i in range(22, 10, -1):
                if x >> i & 1:
                    x ^= self.GENERATOR << (i - 11)
            return x

        self.parts = [
            np.array([remainder((b << s) & (1 << 23) - 1) for b in range(256)], np.int64) for s in (0, 8, 16)]
        #: by syndrome: the error patterns to undo, at most six; unused places repeat the first
        self.patterns = np.zeros((2048, 6), np.int64)
        unit = [remainder(1 << i) for i in range(23)]
        found: dict[int, list[int]] = {}
        for weight in range(5):
            for bits in combinations(range(23), weight):
                s = 0
                for b in bits:
                    s ^= unit[b]
                own = found.setdefault(s, [])
                # within two bits of a codeword: that one alone; else the one at three bits and those at four
                if not own or (own[0].bit_count() == 3 and weight == 4):
                    own.append(sum(1 << b for b in bits))
        for s, own in found.items():
            self.patterns[s] = own + own[:1] * (6 - len(own))

    def indices(self, words: np.ndarray) -> np.ndarray:
        """For each 23-bit word the indices of its codewords: an array with six columns."""
        s = self.parts[0][words & 255] ^ self.parts[1][words >> 8 & 255] ^ self.parts[2][words >> 16 & 255]
        return (words[:, None] ^ self.patterns[s]) >> 11


def golay_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, key) for every distinct key of every fingerprint."""
    x = fps.view(np.uint64)
    parts = [(x >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 22), (22, 21), (43, 21))]
    rows, keys = [], []
    for k in range(3):
        near = golay.indices(parts[(k + 1) % 3])
        key = (np.int64(k) << 34 | parts[k] << 12)[:, None] | near
        new = np.ones(key.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :1]  # places that repeat the first
        rows.append(np.repeat(np.arange(len(x)), new.sum(axis=1)))
        keys.append(key[new])
    return np.concatenate(rows), np.concatenate(keys)


def _with_keys(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            rows, keys = golay_keys(fps, golay)
            yield pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(keys)], ["fp", "key"])

    return distinct.select("fp").mapInArrow(run, "fp bigint, key bigint")


def close_links(distinct: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints (fp), enough to connect all that differ in at most two bits."""
    keys = _with_keys(distinct)
    # most keys have one fingerprint; only shared ones go on
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpoint(keys.join(shared, "key"))
    few = met.where(F.col("n") <= PAIRS_UP_TO)
    pairs = few.select("key", F.col("fp").alias("u")).join(few.select("key", F.col("fp").alias("v")), "key").where(
        (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)).select("u", "v")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    many = met.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct().select("fp", F.explode(flips).alias("flip"))
    near = many.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot"))
    first = near.groupBy("spot").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("spot", "u")
    stars = near.join(first, "spot").where("u <> fp").select("u", F.col("fp").alias("v"))
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    rows = checkpoint(fingerprints(docs, size))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    roots = connected_components(close_links(distinct)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "rows", "component_id")
    return join_counted(rows, of_fp, "fp", "rows").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
