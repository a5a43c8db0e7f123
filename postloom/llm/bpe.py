"""Byte-level BPE by backtracking over longest matches, exact and linear in the length of a piece.

A text is cut by the vocabulary's pattern; each piece is encoded on its own. Bytes are mapped to Latin-1 so that
pyahocorasick can hold the vocabulary: an automaton over the reversed tokens, run over the reversed piece, gives the
longest token that starts at every place. The encoder takes the longest token, checks that it may follow the one
before (whether merging would ever have joined across their border, found by undoing both tokens' merges), falls back
to the longest token that is a prefix of it, and steps back where none fits. A place that was left is never tried
again, so the work is linear. Border checks are memoised, and so are whole pieces, as words repeat.

The tables are derived from the rank file on the driver and broadcast: their size is that of the vocabulary. Work is
a map over rows; nothing is shuffled, so neither hot keys nor copies matter, and a lost executor repeats its tasks.

Cases: a null text is the empty text: no ids, the digests of nothing; texts are encoded whole, however long; rows that
repeat a doc_id are encoded each; an empty table gives no rows. Other columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, small_batches

@dataclass
class Tables:
    """tokens by id; the two ids that a token was merged from (itself, for a byte); its longest token prefix or -1."""

    tokens: list[bytes]
    left: list[int]
    right: list[int]
    prefix: list[int]
    pattern: str


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The last merge that makes token: merge its bytes in order of rank until two parts are left."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            raise ValueError(f"the vocabulary can't make {token!r} by merging")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def build_tables(ranks: dict[bytes, int], pattern: str) -> Tables:
    size = max(ranks.values()) + 1
    tokens, left, right, prefix = [b""] * size, list(range(size)), list(range(size)), [-1] * size
    for token, rank in ranks.items():
        tokens[rank] = token
        if len(token) > 1:
            a, b = _halves(token, ranks)
            left[rank], right[rank] = ranks[a], ranks[b]
            prefix[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
    return Tables(tokens, left, right, prefix, pattern)


class Encoder:
    def __init__(self, tables: Tables):
        self.t = tables
        self.ids = {token: i for i, token in enumerate(tables.tokens) if token}
        self.merged = {(tables.left[i], tables.right[i]): i for i, x in enumerate(tables.tokens) if len(x) > 1}
        self.backwards = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.backwards.add_word(token[::-1].decode("latin-1"), i)
        self.backwards.make_automaton()
        self.find = regex.compile(tables.pattern).findall
        self.border = Memo(self._may_follow)
        self.piece = Memo(lambda text: ",".join(map(str, self.encode_piece(text.encode()))))
        self.undo = Memo(lambda text: b"".join(self.t.tokens[int(i)] for i in text.split(",")))

    def _may_follow(self, pair: tuple[int, int]) -> bool:
        """Undo the later of the two tokens' merges again and again: no earlier merge may cross the border."""
        a, b = pair
        left, right, limit = self.t.left, self.t.right, 1 << 60
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                a = right[a]
                if a == limit:
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    limit = a
                    a = right[a]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ids.get(piece)) is not None:
            return [whole]
        n, tokens, prefix, border = len(piece), self.t.tokens, self.t.prefix, self.border
        longest = [-1] * (n + 1)
        for end, token in self.backwards.iter(piece[::-1].decode("latin-1")):
            if longest[n - 1 - end] < 0:  # the longest match at a place comes first
                longest[n - 1 - end] = token
        out: list[int] = []
        open_ = bytearray(b"\1" * (n + 1))
        at, token = 0, longest[0]
        while at < n:
            end = at + len(tokens[token])
            if open_[end] and (not out or border[out[-1], token]):
                out.append(token)
                at, token = end, longest[end]
            elif prefix[token] >= 0:
                token = prefix[token]
            else:  # nothing can stand here after the token before: that one must be shorter
                open_[at] = 0
                token = out.pop()
                at -= len(tokens[token])
        return out

    def encode_text(self, text: str) -> list[str]:
        """For each piece its ids in decimal, joined by commas."""
        return list(map(self.piece.__getitem__, self.find(text)))

    def decode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.undo.__getitem__, pieces))


#: The last encoder of this worker process, by the vocabulary's digest.
_ENCODERS: dict[str, Encoder] = {}


def encode_and_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256): ids in decimal joined by commas.

    with_ids=False leaves the ids in the workers and returns only the digests.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    tables = spark.sparkContext.broadcast(build_tables(ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(tables.value)
        encoder = _ENCODERS[name]
        for batch in batches:
            ids, counts, shas, undone = [], [], [], []
            for text in batch.column("text").to_pylist():
                pieces = encoder.encode_text(text)
                joined = ",".join(pieces)
                if with_ids:
                    ids.append(joined)
                counts.append(joined.count(",") + 1 if joined else 0)
                shas.append(hashlib.sha256(joined.encode()).hexdigest())
                undone.append(hashlib.sha256(encoder.decode(pieces)).hexdigest())
            out = {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.string()), "n_tokens": pa.array(counts, pa.int64()),
                   "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(undone, pa.string())}
            yield pa.RecordBatch.from_pydict({k: v for k, v in out.items() if with_ids or k != "ids"})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, " + "ids string, " * with_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
