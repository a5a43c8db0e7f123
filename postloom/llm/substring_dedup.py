"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of words, counted over the whole corpus.

1. A map over rows hashes every window of every whole text and sorts a chunk's hashes (some MB of text) into buckets
   by a second, independent Rabin-Karp hash. A chunk's equal windows are counted there and then, so each chunk sends
   a hash at most once, packed with the place where it was seen: eight bytes and a short gap for the place. A window
   that every document shares arrives once a chunk, not once a document, so there are no hot buckets.
2. Each bucket, sized by the words of the corpus, counts its hashes and answers each chunk with the places whose hash
   another chunk has too. Two windows agree on 64 hash bits and the bucket of the second hash.
3. Answers go back to their chunk, are handed to its documents as window starts, and join the documents, where
   starts merge into maximal removal intervals in one pass.

Texts move once, in the last join; no pairs of documents are ever made.

Cases: a null text has no words; texts shorter than a window lose nothing; rows that repeat a doc_id are documents
of their own, told apart by their texts; rows that repeat both count as two occurrences and lose the same words.
The input must give the same rows when read again, as a retried task must. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, small_batches, text_or_empty

WINDOW = 35
#: Words of one chunk, about, and windows of one bucket: what one task holds at once.
CHUNK_WORDS = 500_000
BUCKET_WINDOWS = 4_000_000
MIN_BUCKETS = 256

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that they can be inverted modulo 2**64
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
#: Hashes of words in this worker.
_CODES = Memo(lambda word: xxhash.xxh64_intdigest(word, 7))


def _powers(base: int, n: int, _known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and its inverse modulo 2**64 for i < n; grows by doubling, kept in the worker."""
    if base not in _known or len(_known[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.ones((2, size), np.uint64)
        steps[0, 1:], steps[1, 1:] = base, pow(base, -1, 1 << 64)
        _known[base] = tuple(np.cumprod(steps, axis=1, dtype=np.uint64))
    return tuple(x[:n] for x in _known[base])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def window_hashes(codes: np.ndarray, base: int, window: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of codes[i:i + window] for every i, by prefix sums."""
    power, inverse = _powers(base, len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[:-1], out=prefix[1:])
    return _mix((prefix[window:] - prefix[:-window]) * inverse[: len(codes) - window + 1])


def _gaps(places: np.ndarray) -> bytes:
    """Ascending places as gaps, in as few bytes each as the largest gap needs; the first byte tells how many."""
    gaps = np.diff(places, prepend=0)
    size = next(k for k in (1, 2, 4) if not len(gaps) or gaps.max() < 1 << 8 * k)
    return bytes([size]) + gaps.astype(f"<u{size}").tobytes()


def _places(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, f"<u{blob[0]}", offset=1), dtype=np.int64)


# kinds of rows: hashes with places (to be counted), places known to repeat, and a chunk's documents
_HASHES, _REPEATS, _DOCS = 0, 1, 2
_ROW = "bucket int, chunk bigint, kind int, hashes binary, places binary"


def _hash_chunks(window: int, buckets: int):
    def chunk_rows(chunk: int, codes: list[np.ndarray], keys: bytes) -> Iterator[tuple]:
        counts = np.array([max(0, len(x) - window + 1) for x in codes], np.int64)
        if not counts.sum():
            return
        long = [x for x in codes if len(x) >= window]
        h = np.concatenate([window_hashes(x, _BASES[0], window) for x in long])
        bucket = np.concatenate([window_hashes(x, _BASES[1], window) for x in long])
        bucket = ((bucket >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((h, bucket))
        same = (h[order][1:] == h[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
        if same.any():  # counted here: all places repeat, one still goes out for the other chunks
            repeats = np.zeros(len(h), bool)
            repeats[order[1:][same]] = True
            repeats[order[:-1][same]] = True
            yield chunk % buckets, chunk, _REPEATS, None, _gaps(np.flatnonzero(repeats))
        first = np.ones(len(h), bool)
        first[order[1:][same]] = False
        at = np.flatnonzero(first)
        at = at[np.argsort(bucket[at], kind="stable")]  # by bucket, places ascending
        ends = np.searchsorted(bucket[at], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(ends)):
            own = at[ends[b] : ends[b + 1]]
            yield int(b), chunk, _HASHES, h[own].tobytes(), _gaps(own)
        yield chunk % buckets, chunk, _DOCS, keys, counts.astype("<i8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        codes, keys, words = [], [], 0

        def flush():
            nonlocal codes, keys, words, number
            rows = list(chunk_rows(part + number, codes, np.array(keys, "<i8").tobytes()))
            codes, keys, words, number = [], [], 0, number + 1
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 ["bucket", "chunk", "kind", "hashes", "places"])

        for batch in batches:
            for key, text in zip(zip(batch.column("key").to_pylist(), batch.column("key2").to_pylist(), strict=True),
                                 batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = _WORDS(text)
                codes.append(np.fromiter(map(_CODES.__getitem__, found), np.uint64, len(found)))
                keys.append(key)
                words += len(found)
                if words >= CHUNK_WORDS:
                    yield from flush()
        yield from flush()

    return run


def _count_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places whose hash is in several chunks, by chunk; what needs no counting is handed on."""
    own = pdf[pdf["kind"] == _HASHES]
    out = pdf[pdf["kind"] != _HASHES][["chunk", "kind", "hashes", "places"]]
    if len(own):
        hashes = [np.frombuffer(x, "<u8") for x in own["hashes"]]
        whose = np.repeat(np.arange(len(own)), [len(x) for x in hashes])
        h = np.concatenate(hashes)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        repeats = np.zeros(len(h), bool)
        repeats[order[1:][same]] = True
        repeats[order[:-1][same]] = True
        places = np.concatenate([_places(x) for x in own["places"]])[repeats]
        ends = np.searchsorted(whose[repeats], np.arange(len(own) + 1))
        rows = [(chunk, _REPEATS, None, _gaps(places[ends[i] : ends[i + 1]]))
                for i, chunk in enumerate(own["chunk"]) if ends[i] < ends[i + 1]]
        out = pd.concat([out, pd.DataFrame(rows, columns=out.columns)]) if rows else out
    return out


def _to_documents(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk's repeated places as window starts of its documents."""
    docs = pdf[pdf["kind"] == _DOCS].iloc[0]
    keys, counts = np.frombuffer(docs["hashes"], "<i8").reshape(-1, 2), np.frombuffer(docs["places"], "<i8")
    marks = pdf[pdf["kind"] == _REPEATS]["places"]
    if not len(marks):
        return pd.DataFrame({"key": [], "key2": [], "starts": []})
    places = np.unique(np.concatenate([_places(x) for x in marks]))
    begins = np.concatenate([[0], np.cumsum(counts)])
    ends = np.searchsorted(places, begins)
    rows = [(*keys[i], _gaps(places[ends[i] : ends[i + 1]] - begins[i])) for i in np.flatnonzero(np.diff(ends))]
    return pd.DataFrame(rows, columns=["key", "key2", "starts"])


def removal_intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of words that the windows at these ascending starts cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate([[0], cuts + 1])].tolist(),
                    (starts[np.concatenate([cuts, [len(starts) - 1]])] + window).tolist(), strict=True))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, intervals = [], [], [], []
            for text, blob in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = _WORDS(text)
                found = removal_intervals(_places(blob), window) if blob else []
                kept, at = [], 0
                for a, b in found:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                intervals.append([{"first": a, "end": b} for a, b in found])
            spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(intervals, spans)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals"])

    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, intervals) for every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, size // 6 // BUCKET_WINDOWS)  # six bytes a word, about
    # what tells rows apart: the same doc_id and text give the same result, so such rows may share keys
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumns(
        {"key": F.xxhash64("doc_id", "text"), "key2": F.xxhash64("text", "doc_id")})
    chunks = keyed.select("key", "key2", "text").mapInArrow(_hash_chunks(window, buckets), _ROW)
    answers = chunks.groupBy("bucket").applyInPandas(_count_bucket, "chunk bigint, kind int, hashes binary, places binary")
    starts = answers.groupBy("chunk").applyInPandas(_to_documents, "key bigint, key2 bigint, starts binary").groupBy("key", "key2").agg(
        F.max("starts").alias("starts"))  # rows with the same keys have the same text, hence the same starts
    kind = dict(docs.dtypes)["doc_id"]
    return keyed.join(starts, ["key", "key2"], "left").select("doc_id", "text", "starts").mapInArrow(
        _cut(window), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string,"
        " intervals array<struct<first: bigint, end: bigint>>")
