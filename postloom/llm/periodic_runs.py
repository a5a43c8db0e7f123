"""Periodic runs of words: stretches that repeat a unit of q words four times or more.

A lag is worth a scan only if enough words equal the word so many places on. How many do is counted for all lags at
once, heavy and light words apart: a word that is frequent in its text adds the power spectrum of its places, whose one
inverse FFT is the autocorrelation (whole numbers, so rounding makes it exact); a rare word adds the differences of its
places. Only a lag with matches enough for a run is scanned for islands of matches, and an island that a shorter
unit explains is left to that unit. The matches that a run gives to the multiples of its period are taken off
before those are judged, so that a text of one word over and over is scanned once.

Work is a map over rows: nothing is shuffled, and a lost executor repeats its tasks. Texts are read whole, however long:
memory is a few numbers a word of one text.

Cases: a null or empty text has no words and no runs; rows that repeat a doc_id are documents of their own; of runs
with one start the shorter period comes first; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A run has at least so many words, and so many times its period.
LEAST_WORDS = 6
LEAST_TIMES = 4
#: A word is heavy if its occurrences, squared, are more than so many times the FFT's length.
HEAVY = 4
#: Differences that are held before they are counted.
HELD = 1 << 20

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _fft_size(least: int) -> int:
    """The least length from `least` on that is a power of two, or three or five times one."""
    return min(f << max(0, (-(-least // f) - 1).bit_length()) for f in (1, 3, 5))


def lag_counts(codes: np.ndarray, most: int) -> np.ndarray:
    """For every lag up to `most`, how many i have codes[i] == codes[i + lag] (lag 0: not counted)."""
    total = np.zeros(most + 1, np.int64)
    times = np.bincount(codes)
    size = _fft_size(len(codes) + most)
    heavy = times * times > HEAVY * size
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        for word in np.flatnonzero(heavy):
            spectrum = np.fft.rfft(codes == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        total += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    # places of light words, the most frequent words first, so that those with a k-th next place are a prefix
    at = np.flatnonzero((~heavy & (times > 1))[codes])
    at = at[np.lexsort((at, codes[at], -times[codes[at]]))]
    word = codes[at]
    ends = np.searchsorted(-times[word], -np.arange(1, times[word[0]] if len(at) else 1), "left")
    held, n = [], 0
    for k, end in enumerate(ends.tolist(), 1):
        lag = (at[k:end] - at[: end - k])[word[k:end] == word[: end - k]]
        held.append(lag[lag <= most])
        n += len(held[-1])
        if n > HELD:
            total += np.bincount(np.concatenate(held), minlength=most + 1)
            held, n = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=most + 1)
    total[0] = 0
    return total


def _repeats_shorter(unit: np.ndarray) -> bool:
    """Whether a unit is itself a whole number of copies of a shorter one."""
    q, rest, p = len(unit), len(unit), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if np.array_equal(unit[q // p :], unit[: q - q // p]):
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def find_runs(codes: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. codes are small whole numbers, one a word."""
    n = len(codes)
    most = n // least_times
    if n < least_words or not most:
        return []
    count = lag_counts(codes, most)
    lags = np.arange(most + 1)
    need = np.maximum(least_words - lags, (least_times - 1) * lags)
    runs = []
    for q in np.flatnonzero(count >= need).tolist():  # lag 0 has no counts
        if count[q] < need[q]:  # what was enough has been explained by shorter periods
            continue
        breaks = np.flatnonzero(codes[q:] != codes[:-q])
        starts = np.concatenate(([0], breaks + 1))
        matches = np.concatenate((breaks, [n - q])) - starts
        for i in np.flatnonzero(matches >= need[q]):
            start, length = int(starts[i]), int(matches[i]) + q
            if _repeats_shorter(codes[start : start + q]):
                continue
            runs.append((start, length, q))
            multiples = np.arange(2 * q, min(length, most + 1), q)
            count[multiples] -= length - multiples
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_places(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first unit."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def periodic_runs(docs: DataFrame, rewrite: Callable[[Any, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every text, and its words without the repeats, joined by spaces.

    rewrite may change a document's words before they are read: it gets the doc_id and the words in UTF-8.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = _WORDS(text)
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                known: dict[bytes, int] = {}
                codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
                runs = find_runs(codes)
                if runs:
                    words = [words[i] for i in np.flatnonzero(kept_places(len(words), runs)).tolist()]
                counts.append(len(codes))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
