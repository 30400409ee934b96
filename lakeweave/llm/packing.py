"""Operator 7: packing windows to a token mixture by deficit round-robin.

Each source is a queue: the token stream of its documents. Windows of a fixed
length are filled from all queues in proportion to target weights (by default a
source's share of all tokens, so that all queues run dry together). What a queue
is owed or has been given ahead after a window is its deficit, carried on to the
next; it always stays near one token, so every window has the target mixture.

The deficits after any number of windows follow from the totals alone: serving
the queue with the greatest deficit, token by token, is the order of
(y + 1/2) / weight over all tokens y of all queues, and how many tokens each
queue has given among the first h of that order is found directly. So a task that
holds any stretch of a queue knows the deficits that the windows before its first
one have left, and fills its windows without waiting for other partitions.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakeweave.llm.text import chunks, table
from lakeweave.session import materialize


class Tokenizer:
    """Ids of texts by a byte-level BPE file of the tokenizers library, special
    tokens' strings being ordinary text. Texts in Latin-1 go through the same
    vocabulary as ranks in tiktoken, which gives equal ids in a fifth of the time."""

    def __init__(self, tokenizer_json: str, rank_file: bytes, pattern: str):
        import base64

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        import tokenizers

        self.exact = tokenizers.Tokenizer.from_str(tokenizer_json)
        self.exact.encode_special_tokens = True
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


class Mixture:
    """Which tokens of which queue the windows hold.

    ``totals``: tokens of each queue; ``weights``: its target share (any scale).
    A queue that runs dry leaves its share to the others."""

    def __init__(self, totals, weights=None, window: int = 1024):
        self.totals = np.asarray(totals, np.int64)
        self.weights = np.asarray(totals if weights is None else weights, np.float64)
        self.window = window
        self.total = int(self.totals.sum())
        self.n_windows = -(-self.total // window)
        ends = np.unique(np.concatenate([[0.0], self.totals / self.weights]))
        self.times = ends
        self.given = np.minimum(self.totals, self.weights * ends[:, None]).sum(axis=1)

    def taken(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has given before each of ``windows`` (rows)."""
        h = np.minimum(windows.astype(np.int64) * self.window, self.total)
        at = np.interp(h, self.given, self.times)
        a = np.clip(np.floor(at[:, None] * self.weights + 0.5).astype(np.int64), 0, self.totals)
        rows, last = np.arange(len(h)), len(self.totals) - 1

        def next_in(r):  # the queue whose next token comes first
            key = np.where(a[r] < self.totals, (a[r] + 0.5) / self.weights, np.inf)
            k = key.argmin(axis=1)
            return k, key[np.arange(len(r)), k]

        def last_out(r):  # the queue whose last token comes last
            key = np.where(a[r] > 0, (a[r] - 0.5) / self.weights, -np.inf)
            k = last - key[:, ::-1].argmax(axis=1)
            return k, key[np.arange(len(r)), k]

        while len(r := rows[(short := h - a.sum(axis=1)) > 0]):
            k, _ = next_in(r)
            a[r, k] += 1
        while len(r := rows[(h - a.sum(axis=1)) < 0]):
            k, _ = last_out(r)
            a[r, k] -= 1
        r = rows
        while len(r):  # rounding may have left the wrong token at the border
            (i, first), (o, final) = next_in(r), last_out(r)
            wrong = (first < final) | ((first == final) & (i < o))
            r, i, o = r[wrong], i[wrong], o[wrong]
            a[r, i] += 1
            a[r, o] -= 1
        return a

    def stretch(self, queue: int, begin: int, end: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(first window, tokens of ``queue`` given before each window from it on,
        offset of the queue's run in each of these) for windows that cover its
        tokens ``begin`` to ``end``."""
        times = np.array([begin, end]) / self.weights[queue]
        low, high = (np.interp(times, self.times, self.given) / self.window).astype(np.int64)
        margin = 2 + len(self.totals) // self.window
        while True:
            w0, w1 = max(0, int(low) - margin), min(self.n_windows, int(high) + 1 + margin)
            a = self.taken(np.arange(w0, w1 + 1))
            if (a[0, queue] <= begin or not w0) and (a[-1, queue] >= end or w1 == self.n_windows):
                return w0, a[:, queue], np.diff(a[:, :queue], axis=0).sum(axis=1)
            margin *= 4


def tokenized(docs: DataFrame, keep: list[str], source: str, text: str, tokenizer_path: str, rank_path: str,
              pattern: str, end_id: int = 0) -> DataFrame:
    """``keep`` and ``source`` columns with ``_ids`` (little-endian 32-bit or, where the
    vocabulary allows, 16-bit), ``_n``, ``_part`` and ``_at``: tokens of the same
    source ahead of the document within its partition."""
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f, open(rank_path, "rb") as g:
        files = sc.broadcast((f.read(), g.read()))  # the vocabulary files
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("_source", T.StringType()),
                           T.StructField("_ids", T.BinaryType()), T.StructField("_n", T.LongType()),
                           T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])

    def run(batches):
        tokenizer, part, ahead = Tokenizer(*files.value, pattern), TaskContext.get().partitionId(), {}
        small = tokenizer.exact.get_vocab_size() <= 1 << 16
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                piece = batch.slice(k, 2000)
                ids, n, at = [], [], []
                for t, s in zip(piece.column(len(keep) + 1).to_pylist(), piece.column(len(keep)).to_pylist()):
                    x = np.concatenate([tokenizer.encode(t), end])
                    ids.append(x.astype("<u2" if small else "<u4").tobytes())
                    n.append(len(x))
                    at.append(ahead.get(s, 0))
                    ahead[s] = at[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:-1], pa.array(ids, pa.binary()), pa.array(n, pa.int64()),
                     pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64())], names=schema.names)

    return docs.select(*keep, F.col(f"`{source}`").cast("string").alias("_source"), F.coalesce(docs[text], F.lit(""))).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, rank_path: str, pattern: str, window: int = 1024, source: str = "source",
         text: str = "text", keep: tuple[str, ...] = ("doc_id",), weights: dict | None = None,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: ``keep`` columns, ``start`` (ids of the document before it),
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``source_tokens``
    (ids of its source ahead of it); ``ids`` if asked for.

    Every document is its ids and id 0, cut freely; all sequences are full but
    the last. ``weights`` maps a source to its target share (default: its share of
    all tokens). A null text is one id; null sources form a queue; repeated rows
    are packed each; an empty table gives no pieces. Only the totals by source (the
    parts of the mixture) go through the driver."""
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, list(keep), source, text, tokenizer_path, rank_path, pattern), "tokens")
    held = tokens.groupBy("_part", "_source").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("_part").alias("_p"), F.col("_source").alias("_s"),
                       F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    totals = sorted(((r[0], r[1]) for r in tokens.groupBy("_source").agg(F.sum("_n")).collect()),
                    key=lambda x: (x[0] is not None, x[0] or ""))
    queue = {s: i for i, (s, _) in enumerate(totals)}
    given = None if weights is None else [weights[s] for s, _ in totals]
    mixture = Mixture([n for _, n in totals], given, window) if totals else None
    schema = T.StructType([*docs.select(*keep).schema.fields] + [T.StructField(c, T.LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_tokens")])
    if with_ids:
        schema = schema.add("ids", "binary")
    k = len(keep)

    def pieces(batch):
        source_of = np.array([queue[s] for s in batch.column(k).to_pylist()])
        ids, n = batch.column(k + 1).to_pylist(), batch.column(k + 2).to_numpy()
        begin = batch.column(k + 3).to_numpy()
        for s in np.unique(source_of):
            rows = np.flatnonzero(source_of == s)
            rows = rows[np.argsort(begin[rows], kind="stable")]
            gaps = np.flatnonzero(begin[rows[1:]] != begin[rows[:-1]] + n[rows[:-1]]) + 1
            for run in np.split(rows, gaps):
                x0, x1 = begin[run[0]], begin[run[-1]] + n[run[-1]]
                w0, given_before, offset = mixture.stretch(int(s), int(x0), int(x1))
                cuts = np.union1d(begin[run], given_before[(given_before > x0) & (given_before < x1)])
                row = run[np.searchsorted(begin[run], cuts, "right") - 1]
                w = np.searchsorted(given_before, cuts, "right") - 1
                length = np.diff(np.append(cuts, x1))
                start = cuts - begin[row]
                size, crcs, raws, last, wide = 0, [], [], -1, b""
                for r, a, m in zip(row.tolist(), start.tolist(), length.tolist()):
                    if r != last:
                        size = len(ids[r]) // int(n[r])
                        wide = memoryview(np.frombuffer(ids[r], f"<u{size}").astype("<u4").tobytes())
                        last = r
                    crcs.append(zlib.crc32(wide[4 * a:4 * (a + m)]))
                    if with_ids:
                        raws.append(bytes(wide[4 * a:4 * (a + m)]))
                cols = [start, length, np.array(crcs, np.int64), n[row], w0 + w, offset[w] + cuts - given_before[w], cuts]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(row)) for i in range(k)), *(pa.array(c, pa.int64()) for c in cols)]
                    + [pa.array(raws, pa.binary())] * with_ids, names=schema.names)

    def run(batches):
        for batch in batches:
            yield from pieces(batch)

    joined = tokens.join(held, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
    return joined.select(*keep, "_source", "_ids", "_n", F.col("_ahead") + F.col("_at")).mapInArrow(run, schema)


def op7_mixture_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers as public

    return pack(table(spark, sf_dir, "documents") if docs is None else docs, public.path("byte_bpe_50k.json"),
                public.path("byte_bpe_50k.tiktoken"), public.PATTERN).drop("source_tokens")
