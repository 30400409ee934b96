"""Helpers that the operators share: folds, words, hashes, Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09-\x0D.
WORD_SEPARATORS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % modulus


def text_bytes(df: DataFrame, text: str = "text") -> Column:
    """The text as UTF-8 bytes, empty where null."""
    return F.coalesce(df[text], F.lit("")).cast("binary")


def chunks(items, size_of, limit: int):
    """Consecutive runs of ``items`` whose sizes add up to about ``limit``."""
    run, total = [], 0
    for x in items:
        run.append(x)
        total += size_of(x)
        if total >= limit:
            yield run
            run, total = [], 0
    if run:
        yield run


class WordHasher:
    """64-bit hashes of the words of a UTF-8 buffer, in whole-array operations.

    A word's hash sums a random 64-bit value per byte times an odd power for
    its place in the word, and is mixed at the end. The tables come from a fixed
    seed, so every task of every run gives the same hashes.
    """

    PLACES = 4096
    SLICE = 1 << 20  # bytes hashed at a time: several 64-bit values are held for each

    def __init__(self, seed: int = 20240611):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = rng.integers(1, 2**62, 1, dtype=np.uint64)[0] * np.uint64(4) + np.uint64(3)
        powers = np.empty(self.PLACES, dtype=np.uint64)
        powers[0] = 1
        with np.errstate(over="ignore"):
            for i in range(1, self.PLACES):
                powers[i] = powers[i - 1] * base
        self.powers = powers
        self.gap = np.zeros(256, dtype=bool)
        self.gap[list(WORD_SEPARATORS)] = True

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, byte offset at which it starts)."""
        if len(data) <= self.SLICE:
            return self._hashes(data)
        found, at = [], 0
        while at < len(data):
            end = min(len(data), at + self.SLICE)
            while end < len(data) and data[end] not in WORD_SEPARATORS:
                end += 1  # slices end between words
            words, starts = self._hashes(data[at:end])
            found.append((words, starts + at))
            at = end
        return np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])

    def _hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        buf = np.frombuffer(data, dtype=np.uint8)
        if not len(buf):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        gap = self.gap[buf]
        first = ~gap
        first[1:] &= gap[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.empty(0, np.uint64), starts
        ends = np.append(starts[1:], len(buf))
        lead = starts[0]
        place = np.arange(lead, len(buf)) - np.repeat(starts, ends - starts)
        with np.errstate(over="ignore"):
            part = self.values[buf[lead:]] * self.powers[place % self.PLACES]
            # longer words than the table: the round goes into the value as well
            if len(place) and place.max() >= self.PLACES:
                part += (place // self.PLACES).astype(np.uint64) * self.powers[7]
            part[gap[lead:]] = 0
            return mix(np.add.reduceat(part, starts - lead)), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a word-hash
    sequence; with fewer words the whole sequence is one shingle; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(width, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - size + 1, np.uint64(size), dtype=np.uint64)
        for j in range(size):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[j:n - size + 1 + j])
    return np.unique(acc)
