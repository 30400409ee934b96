"""Operator 10: language-model scoring with an Elias-Fano n-gram trie.

The model is a bigram model with Bayesian smoothing towards the unigrams:

    p(w)     = (c(w) + 1/2) / (N + (V + 1) / 2)
    p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU)

for every word v of the training texts; after an unknown one, c(v) = 0, that is
``p(w)``. A text's first word follows an end.

A trie has the predicted word on its first level and the words before it on the
second. It is cut by a hash of the first level in shards of bounded size, and
each occurrence in a text travels once, to the shard that holds its n-gram;
there the training texts' occurrences make the counts and everybody's are
scored. Words of the head (the ``HEAD`` most frequent ones), which may be any share
of all tokens, are dealt by the n-gram instead; their counts are in a table of
bounded size that every task has. After any other word v, whose count lies in the
shard of v, the n-gram's shard divides by ``rest + MU`` in place of ``c(v) + MU``,
where no word outside the head occurs more than ``rest`` times. Within a text every
token, its end too, is the word before exactly once, so the shard of v adds
``log10((rest + MU) / (c(v) + MU))`` for each of the text's v. The head thus decides
only where rows go, never what is counted. A shard writes its trie in levels to a file that it maps into memory: words
and pointers as Elias-Fano sequences, the second level as one too (each entry is
offset by its parent's place, so that it is monotone and a successor search
finds it), and the log-probabilities in 16-bit steps. Sums by document come back
in one row per run of documents and shard.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm.text import WordHasher, chunks, mix, remainder, table
from lakeweave.session import materialize

HEAD = 1 << 16
MU = 200.0
SHARD_TOKENS = 2_500_000  # training tokens for each shard
RUN_BYTES = 8 << 20
BLOCK = 1 << 18  # entries built or looked up at a time: several 64-bit values are held for each
END = np.uint64(0x5DEECE66D1CE4E5B)  # stands for the end of a text among the words' hashes
QUANTUM = 16.0 / 65535  # step of log10 probabilities, which reach from 0 to -16


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with a directory of
    zeros per word, so that a successor search costs no scan."""

    def __init__(self, values: np.ndarray | None = None, arrays=None):
        if arrays is not None:
            self.n, self.low_bits, self.low, self.high, self.zeros = arrays
            return
        v = values.astype(np.uint64)
        self.n = len(v)
        top = int(v[-1]) + 1 if self.n else 1
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        b = np.uint64(self.low_bits)
        self.low = np.zeros(int(self.n * self.low_bits) // 64 + 2, np.uint64)
        size = int(v[-1] >> b) + self.n + 1 if self.n else 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        for i in range(0, self.n, BLOCK):
            part = v[i:i + BLOCK]
            place = np.arange(i, i + len(part))
            low = part & ((np.uint64(1) << b) - np.uint64(1))
            at = place.astype(np.uint64) * b
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(self.low, word, low << shift)
            over = (shift + b > np.uint64(64)) & (b > 0)
            np.bitwise_or.at(self.low, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
            bits[(part >> b).astype(np.int64) + place] = 1
        bits[size:] = 1  # past the end there is nothing to find
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        self.zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(self.high).astype(np.int64))])

    def parts(self) -> list:
        return [self.n, self.low_bits, self.low, self.high, self.zeros]

    def _low(self, i: np.ndarray) -> np.ndarray:
        b = np.uint64(self.low_bits)
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * b
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        over = shift + b > np.uint64(64)
        x[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return x & ((np.uint64(1) << b) - np.uint64(1))

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many elements have high bits below ``h``: the place of zero number
        h - 1, less the zeros before it."""
        out = np.zeros(len(h), np.int64)
        out[h > self.zeros[-1]] = self.n
        some = np.flatnonzero((h > 0) & (h <= self.zeros[-1]))
        for part in np.array_split(some, max(1, len(some) >> 16)):
            want = h[part] - 1
            word = np.searchsorted(self.zeros, want, "right") - 1
            rest = (want - self.zeros[word] + 1).astype(np.uint8)
            bits = np.unpackbits(np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            place = (np.cumsum(1 - bits, axis=1, dtype=np.uint8) >= rest[:, None]).argmax(axis=1)
            out[part] = word * 64 + place - want
        return np.minimum(out, self.n)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of the first element not less than each ``x`` that equals it, else -1."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & ((np.uint64(1) << np.uint64(self.low_bits)) - np.uint64(1))
        at, end = self._before(high), self._before(high + 1)
        moving = np.flatnonzero(at < end)
        while len(moving):
            moving = moving[self._low(at[moving]) < low[moving]]
            at[moving] += 1
            moving = moving[at[moving] < end[moving]]
        out = np.full(len(x), -1, np.int64)
        inside = np.flatnonzero(at < end)
        hit = inside[self._low(at[inside]) == low[inside]]
        out[hit] = at[hit]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at places ``i`` (by decoding the high bits, once)."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[:self.n]
        return ((ones[i] - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)


class NgramTrie:
    """Two levels of n-grams, the last word first, in one memory-mapped file."""

    def __init__(self, words: np.ndarray, children: np.ndarray, contexts: np.ndarray, heads: int, others: np.ndarray, log10: np.ndarray):
        """``words`` ascending; ``children`` of each; ``contexts`` ascending under each
        word; ``log10`` probability of each context's entry. Contexts are numbers in
        the head up to ``heads``, then places among the words ``others`` (ascending)."""
        self.heads, self.n_contexts = heads, heads + 1 + len(others)
        place = np.repeat(np.arange(len(words)), children).astype(np.uint64)
        self.file = tempfile.TemporaryFile()
        self.sequences, spots = [], []
        step = np.clip(np.round(-log10 / QUANTUM), 0, 65535).astype(np.uint16)
        for seq in (EliasFano(words), EliasFano(np.concatenate([[0], np.cumsum(children)])),
                    EliasFano(place * np.uint64(self.n_contexts) + contexts.astype(np.uint64)), EliasFano(others)):
            n, low_bits, *arrays = seq.parts()
            spots.append((n, low_bits, [self._write(a) for a in arrays]))
        log_spot = self._write(step)
        self.file.flush()
        for n, low_bits, arrays in spots:
            self.sequences.append(EliasFano(arrays=(n, low_bits, *[self._map(s) for s in arrays])))
        self.words, self.pointers, self.entries, self.others = self.sequences
        self.steps = self._map(log_spot)

    def _write(self, a: np.ndarray):
        a = np.ascontiguousarray(a)
        self.file.seek(0, 2)
        self.file.write(b"\0" * (-self.file.tell() % 8))
        at = self.file.tell()
        self.file.write(a.tobytes())
        return at, a.dtype, len(a)

    def _map(self, spot) -> np.ndarray:
        at, dtype, n = spot
        return np.memmap(self.file, dtype=dtype, mode="r", offset=at, shape=(n,)) if n else np.empty(0, dtype)

    def numbers(self, others: np.ndarray) -> np.ndarray:
        """Numbers of contexts outside the head, 0 for those without an entry."""
        at = self.others.find(others)
        return np.where(at >= 0, self.heads + 1 + at, 0)

    def lookup(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """log10 probability of each (word, context) that is an entry, else NaN."""
        out = np.full(len(words), np.nan)
        for i in range(0, len(words), BLOCK):
            parent, context = self.words.find(words[i:i + BLOCK]), contexts[i:i + BLOCK]
            some = np.flatnonzero((parent >= 0) & (context > 0))
            at = self.entries.find(parent[some].astype(np.uint64) * np.uint64(self.n_contexts) + context[some].astype(np.uint64))
            out[i + some[at >= 0]] = -QUANTUM * self.steps[at[at >= 0]].astype(float)
        return out

    def close(self) -> None:
        del self.words, self.pointers, self.entries, self.others, self.sequences, self.steps
        self.file.close()


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays in their smallest unsigned types, then compressed."""
    head, body = [], []
    for a in arrays:
        if a.dtype.kind != "f":
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        head.append(f"{a.dtype.str}:{len(a)}")
        body.append(a.tobytes())
    return zstandard.compress(";".join(head).encode() + b"\n" + b"".join(body), 1)


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    at = raw.index(b"\n") + 1
    out = []
    for spec in raw[:at - 1].decode().split(";"):
        kind, n = spec.rsplit(":", 1)
        a = np.frombuffer(raw, kind, int(n), at)
        out.append(a)
        at += a.nbytes
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each element among them): ``np.unique`` in
    less memory."""
    order = np.argsort(x)
    x = x[order]
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return x[first], place


def tokens_of(texts: list[bytes], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of each text and an end after each, tokens of each text)."""
    joined = b"\n".join(texts).lower()  # bytes: A-Z only
    words, starts = hasher(joined)
    ends = np.cumsum([len(t) + 1 for t in texts])  # a text's bytes end before its separator
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends, "left")]))
    return np.insert(words, np.cumsum(counts), END), counts + 1


def word_counts(texts: DataFrame) -> DataFrame:
    """(``code``, ``n``) of all tokens of a frame's only column, summed up."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in chunks(batch.column(0).to_pylist(), lambda x: len(x) + 1, RUN_BYTES):
                code, n = np.unique(tokens_of(part, hasher)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Model:
    """What every task knows: totals and the head's counts."""

    def __init__(self, total: int, distinct: int, head: np.ndarray, counts: np.ndarray, shards: int):
        self.total, self.distinct, self.shards = total, distinct, shards
        order = np.argsort(head)
        self.head, self.counts = head[order], counts[order]
        self.rest = int(counts.min()) if distinct > len(head) else 0  # no other word occurs more often

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Number of each word in the head from 1, 0 for the others."""
        if not len(self.head):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.head, codes), len(self.head) - 1)
        return np.where(self.head[at] == codes, at + 1, 0)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))


def occurrences(part_docs: list[bytes], train: np.ndarray, model: Model, hasher: WordHasher):
    """(shard, payload) rows for a run of documents."""
    codes, sizes = tokens_of(part_docs, hasher)
    words, w = distinct(codes)
    del codes
    place = model.place(words)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[0] = np.searchsorted(words, END)  # elsewhere a text's first word does follow an end
    pairs, pair = distinct(w.astype(np.int64) * len(words) + before)
    del w, before
    key, n = np.unique(pair.astype(np.int64) * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    pair, doc, n = (key // len(sizes)).astype(np.int32), (key % len(sizes)).astype(np.int32), n.astype(np.int32)
    pw, pv = (pairs // len(words)).astype(np.int32), (pairs % len(words)).astype(np.int32)
    del key, pairs
    with np.errstate(over="ignore"):
        spread = words[pw] + np.where(place[pw] > 0, words[pv], 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shard = ((mix(spread) >> np.uint64(33)) % np.uint64(model.shards)).astype(np.int32)[pair]
    w, v = pw[pair], pv[pair]
    before = place[v]
    del pair, spread
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(1, model.shards + 1))
    begin = 0
    for s, end in enumerate(ends.tolist()):
        at = order[begin:end]
        begin = end
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate([[True], w[at][1:] != w[at][:-1]]))
        others = words[v[at][before[at] == 0]]  # contexts outside the head go by their hashes
        yield s, _pack([words[w[at][first]], np.diff(np.append(first, len(at))), before[at], others, doc[at], n[at], np.packbits(train), np.array([len(sizes)])])


def score_shard(runs: list[bytes], model: Model):
    """For each run of documents: (base, score, tokens, known) sums by document."""
    words, per_word, before, others, doc, n, train = [], [], [], [], [], [], []
    sizes = []
    for raw in runs:
        w, k, b, o, d, m, bits, size = _unpack(raw)
        words.append(w.astype(np.uint64))
        per_word.append(k.astype(np.int64))
        before.append(b.astype(np.int32))
        others.append(o.astype(np.uint64))
        doc.append(d.astype(np.int32))
        n.append(m.astype(np.int32))
        sizes.append(int(size[0]))
        train.append(np.unpackbits(bits)[:sizes[-1]].astype(bool)[d])
    lengths = [len(d) for d in doc]
    uniq, inv = distinct(np.concatenate(words))
    w = np.repeat(inv, np.concatenate(per_word))
    del words, per_word, inv
    before, doc, n, train = (np.concatenate(x) for x in (before, doc, n, train))
    heads = len(model.head)
    others, number = distinct(np.concatenate(others))
    before[before == 0] = heads + 1 + number
    width = heads + 1 + len(others)
    pairs, pair = distinct(w.astype(np.int64) * width + before)
    del before, number
    seen = np.bincount(pair, weights=n * train, minlength=len(pairs))
    pw, pv = (pairs // width).astype(np.int32), (pairs % width).astype(np.int32)
    del pairs
    place = model.place(uniq)
    count = np.bincount(pw, weights=seen, minlength=len(uniq))  # all of a tail word's occurrences are here
    if heads:
        count = np.where(place > 0, model.counts[np.maximum(place, 1) - 1], count)
    p1 = model.unigram(count)
    context = np.concatenate([[0], model.counts, np.full(len(others), model.rest)])[pv]  # c(v), for tail words its limit
    smooth = MU * p1[pw] / (context + MU)
    entry = seen > 0
    known = count > 0
    level = np.flatnonzero(known)
    children = np.bincount(pw[entry], minlength=len(uniq))[level]
    held = pv[entry]
    far = np.unique(held[held > heads])
    held = np.where(held > heads, heads + 1 + np.searchsorted(far, held), held)
    trie = NgramTrie(uniq[level], children, held, heads, others[far - heads - 1], np.log10(seen[entry] / (context[entry] + MU) + smooth[entry]))
    del held, context
    log10 = trie.lookup(uniq[pw], np.concatenate([np.arange(heads + 1), trie.numbers(others)])[pv])
    trie.close()
    log10 = np.where(np.isnan(log10), np.log10(smooth), log10)
    as_context = np.where(place > 0, 0.0, np.log10((model.rest + MU) / (count + MU)))
    base = np.log10(p1)
    at = 0
    for size, length in zip(sizes, lengths):
        i = slice(at, at + length)
        at += length
        add = lambda x: np.bincount(doc[i], weights=n[i] * x, minlength=size)  # noqa: B023, E731
        yield add(base[w[i]]), add(log10[pair[i]] + as_context[w[i]]), add(np.ones(length)), add(known[w[i]])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score`` (log10) of every row, learning from the rows outside the held fold.

    A null or empty text is its end alone. Repeated rows are texts of their own.
    Without training rows every word is unknown. Words are told apart by 64-bit
    hashes."""
    spark = docs.sparkSession
    train = remainder(F.col(f"`{id_col}`"), folds) != held_fold
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    counts = materialize(word_counts(docs.filter(train).select(raw)), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "code").limit(HEAD).collect()  # the head has a fixed size; it only deals
    model = Model(total, distinct, np.array([r["code"] for r in top], np.int64).view(np.uint64),
                  np.array([r["n"] for r in top], np.int64), max(1, -(-total // SHARD_TOKENS)))
    sent = spark.sparkContext.broadcast(model)
    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType

    def deal(batches):
        hasher, part, number = WordHasher(), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, flags = batch.column(2).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            at = 0
            for run in chunks(texts, lambda x: len(x) + 1, RUN_BYTES):
                who = (part << 32) + number
                number += 1
                ids = pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), batch.column(1).slice(at, len(run))], names=["id", "train"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as writer:
                    writer.write_batch(ids)
                rows = list(occurrences(run, flags[at:at + len(run)].astype(bool), sent.value, hasher))
                at += len(run)
                names = [sink.getvalue().to_pybytes(), *[None] * (len(rows) - 1)]  # the documents go with the first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in rows], pa.int32()), pa.array([who] * len(rows), pa.int64()),
                     pa.array([x for _, x in rows], pa.binary()), pa.array(names, pa.binary())], names=["shard", "run", "payload", "ids"])

    def at_shard(group: pa.Table) -> pa.Table:
        group = group.sort_by("run")
        sums = [_pack(list(x)) for x in score_shard(group.column("payload").to_pylist(), sent.value)]
        return pa.table({"shard": group.column("shard"), "run": group.column("run"), "sums": pa.array(sums, pa.binary()), "ids": group.column("ids")})

    names = ("n_tokens", "n_known", "base_score", "score")
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def at_run(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        base = score = n = known = 0.0
        for raw in group.column("sums").to_pylist():
            a, b, c, d = _unpack(raw)
            base, score, n, known = base + a, score + b, n + c, known + d
        raw = next(x for x in group.column("ids").to_pylist() if x is not None)
        ids = pa.ipc.open_stream(raw).read_all()
        held = pa.compute.invert(ids.column("train"))
        cols = [ids.column("id"), held, *(pa.array(x.astype(np.int64)) for x in (n, known)), pa.array(base), pa.array(score)]
        return pa.table(dict(zip([id_col, "held_out", *names], cols)))

    out = (docs.select(F.col(f"`{id_col}`"), train.alias("train"), raw).mapInArrow(deal, "shard int, run long, payload binary, ids binary")
           .groupBy("shard").applyInArrow(at_shard, "shard int, run long, sums binary, ids binary")
           .groupBy("run").applyInArrow(at_run, schema))
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def op10_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
