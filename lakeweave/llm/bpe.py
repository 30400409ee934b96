"""Operator 6: byte-level BPE encoding and decoding with a rank queue.

Pre-tokens are laid end to end in one array of symbols that are linked to their
neighbours inside a pre-token. Every adjacent pair whose join is in the
vocabulary lies in the bucket of its rank; a hierarchical bitmap tells which
buckets hold something, and find-first-set gives the lowest. All places of that
bucket are merged at once (entries whose symbols have changed since are stale
and skipped, overlapping ones are taken from the left), and the new pairs go to
their buckets. The work is in proportion to the merges done, whatever the length
of a pre-token, so a pre-token of a megabyte costs what as many short ones do.

Taking a bucket at once equals taking one pair at a time unless a merge makes a
pair of a lower rank than its own. Pre-tokens in which that happens are encoded
again one pair at a time with the same queue.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.text import chunks, table


class RankBitmap:
    """A set of small integers as 64-bit words in levels; a set bit says that the
    word below it is not zero, so the least member is one find-first-set per level."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * max(size, 1))
            if size <= 1:
                break

    def add(self, x: int) -> None:
        for level in self.levels:
            word, bit = x >> 6, 1 << (x & 63)
            if level[word] & bit:
                return
            level[word] |= bit
            x = word

    def discard(self, x: int) -> None:
        for level in self.levels:
            word = x >> 6
            level[word] &= ~(1 << (x & 63))
            if level[word]:
                return
            x = word

    def first(self) -> int:
        """The least member, -1 if empty."""
        if not self.levels[-1][0]:
            return -1
        x = 0
        for level in reversed(self.levels):
            word = level[x]
            x = (x << 6) | ((word & -word).bit_length() - 1)
        return x


class ByteBPE:
    """Encoder and decoder for a rank file (lines of base64 token and rank).

    ``pattern`` splits a text into pre-tokens, which are encoded separately; a
    pre-token that is itself in the vocabulary is one id."""

    #: Latin-1 letters and numbers, for a faster form of the pattern on such texts.
    LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
    LATIN_N = "0-9²³¹¼-¾"

    def __init__(self, rank_file: bytes, pattern: str, cache_size: int = 300_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.tokens[r] = token
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size
        self.pattern = pattern
        self.split_any = regex.compile(pattern).findall
        self.split_latin = self._latin_split(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self._pairs()

    def _latin_split(self, pattern: str):
        """The same pattern over Latin-1 text with plain character ranges (the
        standard re module has no property classes, and is faster). The contractions
        may be tried after the letters, which cannot start with an apostrophe."""
        contractions, _, rest = pattern.partition(r"| ?\p{L}+|")
        if rest and re.fullmatch(r"'[a-z]+(\|'[a-z]+)*", contractions):
            pattern = rf" ?\p{{L}}+|{contractions}|{rest}"
        fast = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\t-\r \x85\xa0{self.LATIN}{self.LATIN_N}]")
        fast = fast.replace(r"\p{L}", f"[{self.LATIN}]").replace(r"\p{N}", f"[{self.LATIN_N}]")
        fast = fast.replace(r"\s", r"[\t-\r \x85\xa0]").replace(r"\S", r"[^\t-\r \x85\xa0]")
        if r"\p" in fast:
            return self.split_any
        return re.compile(fast).findall

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def _pairs(self) -> None:
        """An open-addressed table (left id, right id) -> rank of the joined token,
        over all ways of cutting each token in two tokens."""
        found = {}
        get = self.ranks.get
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None:
                    b = get(token[i:])
                    if b is not None:
                        found[a << 32 | b] = r
        keys = np.fromiter(found.keys(), np.int64, len(found))
        vals = np.fromiter(found.values(), np.int64, len(found))
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, -1, np.int64)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            at = slot[left]
            free = self.keys[at] < 0
            _, firsts = np.unique(at[free], return_index=True)
            won = left[free][firsts]
            self.keys[slot[won]], self.vals[slot[won]] = keys[won], vals[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
        h >>= np.uint64(64 - self.bits)
        return h.view(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, -1 where the join is not in the vocabulary."""
        keys = left << 32 | right
        slot = self._slot(keys)
        there = self.keys[slot]
        same = there == keys
        out = np.where(same, self.vals[slot], -1)
        open_ = np.flatnonzero(~same & (there >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at = slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.vals[at[hit]]
            open_ = open_[~hit & (self.keys[at] >= 0)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each non-empty piece, as little-endian 32-bit integers."""
        starts = np.cumsum([0, *map(len, pieces)])
        sym = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[starts[1:] - 1] = -1
        prv[starts[:-1]] = -1
        rank = np.full(n, -1, np.int64)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        alive = np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        queue = RankBitmap(len(self.tokens))
        again: list[np.ndarray] = []

        def push(at: np.ndarray) -> None:
            at = at[rank[at] >= 0]
            if not len(at):
                return
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            begin = 0
            for end in [*cuts.tolist(), len(r)]:
                k = int(r[begin])
                if k in buckets:
                    buckets[k].append(at[begin:end])
                else:
                    buckets[k] = [at[begin:end]]
                    queue.add(k)
                begin = end

        push(inner)
        while (r := queue.first()) >= 0:
            queue.discard(r)
            held = buckets.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[alive[at] & (rank[at] == r)]  # the rest is stale
            if len(at) > 1:
                touching = np.flatnonzero(nxt[at[:-1]] == at[1:])
                if len(touching):  # of a run of overlapping pairs, every other one from the left
                    head = np.ones(len(at), bool)
                    head[touching + 1] = False
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
            if not len(at):
                continue
            right = nxt[at]
            after = nxt[right]
            sym[at], nxt[at] = r, after
            alive[right] = False
            prv[after[after >= 0]] = at[after >= 0]
            rank[at] = -1
            more = at[after >= 0]
            rank[more] = self.pair_ranks(sym[more], sym[nxt[more]])
            before = prv[at]
            before = before[before >= 0]
            rank[before] = self.pair_ranks(sym[before], sym[nxt[before]])
            made = np.concatenate([more, before])
            if len(lower := made[(rank[made] >= 0) & (rank[made] < r)]):
                again.append(lower)
            push(made)
        ids = sym[alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive)[starts[1:] - 1] * 4).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        if again:
            for i in np.unique(np.searchsorted(starts, np.concatenate(again), "right") - 1).tolist():
                out[i] = self.encode_one(pieces[i])
        return out

    def encode_one(self, piece: bytes) -> bytes:
        """One pre-token, one pair at a time: lowest rank first, then leftmost."""
        import heapq

        sym = [int(x) for x in self.byte_ids[np.frombuffer(piece, np.uint8)]]
        n = len(sym)
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        queue, tokens, get, state = RankBitmap(len(self.tokens)), self.tokens, self.ranks.get, [-1] * n

        def look(i: int) -> None:
            r = get(tokens[sym[i]] + tokens[sym[nxt[i]]]) if nxt[i] >= 0 else None
            state[i] = -1 if r is None else r
            if r is not None:
                heapq.heappush(buckets.setdefault(r, []), i)
                queue.add(r)

        for i in range(n):
            look(i)
        while (r := queue.first()) >= 0:
            i = heapq.heappop(buckets[r])
            if not buckets[r]:
                del buckets[r]
                queue.discard(r)
            if state[i] != r:
                continue
            j = nxt[i]
            sym[i], nxt[i], state[j] = r, nxt[j], -2
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            look(i)
            if prv[i] >= 0:
                look(prv[i])
        return np.array([s for s, x in zip(sym, state) if x != -2], "<u4").tobytes()

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        cache = self.cache
        if len(cache) > self.cache_size:
            cache.clear()
        split = [self.split(t) for t in texts]
        new = {piece for pieces in split for piece in pieces if piece not in cache}
        merge = []
        for piece in new:
            raw = piece.encode("utf-8")
            if raw in self.ranks:
                cache[piece] = self.ranks[raw].to_bytes(4, "little")
            else:
                merge.append((piece, raw))
        for run in chunks(merge, lambda x: len(x[1]), 1 << 23):
            cache.update(zip([x[0] for x in run], self.encode_pieces([x[1] for x in run])))
        get = cache.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text",
                  keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns of each row with ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` (and ``ids``, if asked for, as little-endian 32-bit integers).

    One pass, no shuffle: each task cuts its rows into runs of about 8 MB of
    text, encodes the distinct pre-tokens of a run that it has not met yet, and
    strings texts together from them. A null text counts as empty (no ids)."""
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, about 1 MB
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches):
        bpe = ByteBPE(ranks.value, pattern)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            n, a, b, ids = [], [], [], []
            for part in chunks(texts, len, 1 << 23):
                for x in bpe.encode_texts(part):
                    n.append(len(x) // 4)
                    a.append(hashlib.sha256(x).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(x)).hexdigest())
                    if with_ids:
                        ids.append(x)
            cols = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=schema.names)

    return docs.select(*keep, F.coalesce(docs[text], F.lit(""))).mapInArrow(run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"),
                         public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
