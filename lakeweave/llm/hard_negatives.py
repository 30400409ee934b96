"""Operator 11: hard negatives by threshold joins over an inverted index.

An anchor's positives are its nearest rows of the same label; a positive's negatives are
the best rows of other labels whose score lies in a window below the positive's. Both are
threshold joins: all rows of at least a given score, for every anchor its own threshold.
Thresholds start where a normal tail of the anchor's scores would leave a few rows, and are
lowered, for the windows that are not full, until they fill or end. Each round returns only
the band between the old threshold and the new one.

A task takes its rows in blocks and builds an inverted index over the dimensions, those of
least energy first. A row's first dimensions are left out of the index as long as their
norm, times an anchor's, stays below its threshold: rows that meet in them alone cannot
reach it. Rows stand in the order of the dimension at which they enter the index, so the
posting list of a dimension is a prefix of the block. Scores are accumulated over the posting
lists from the last dimension down; a pair is given up once its partial score plus the
product of the remaining norms is below the threshold, and what is left is completed
from the dimensions that the index omits.

Scores are integer inner products, exact.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeweave.llm.text import table
from lakeweave.session import materialize, shared_dir

ANCHORS = 1 << 15  # anchors whose vectors are sent to all tasks at once
SAMPLE = 2048  # rows, those of the least hash, whose scores place the first thresholds
BLOCK = 8192  # rows of an index
TILE = 256  # anchors whose scores are accumulated together
CHUNK = 8  # dimensions between two looks at the bounds
LOWER = 8  # times as many rows are expected after each lowering
EXACT = 2.0 ** 53  # sums of integers below this are exact in double precision
FAR = 1 << 62


def matrix(column, dims: int) -> np.ndarray:
    """A column of lists of integers as a matrix; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    flat = column.flatten().to_numpy().astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def prefix_norms(x: np.ndarray) -> np.ndarray:
    """The norm of the first 0, 1, 2 ... chunks of dimensions of each row, rounded up."""
    dims = x.shape[1]
    ends = np.minimum(np.arange(0, dims + CHUNK, CHUNK), dims)
    sums = np.zeros((len(x), dims + 1))
    np.cumsum(x.astype(np.float64) ** 2, axis=1, out=sums[:, 1:])
    return np.sqrt(sums[:, ends]) * (1 + 1e-12)


class SuffixIndex:
    """The inverted index of a block of rows for scores per anchor norm of at least ``tau``."""

    def __init__(self, rows: np.ndarray, tau: float):
        norms = prefix_norms(rows)
        chunks = norms.shape[1] - 1
        start = np.maximum((norms < tau).sum(axis=1) - 1, 0)  # chunks that are left out
        order = np.argsort(start, kind="stable")
        self.row = order[start[order] < chunks] if tau > 0 else order
        self.start, self.norms = start[self.row], norms[self.row]
        self.values = rows[self.row].astype(np.float64)
        self.chunks = chunks
        lists = [np.searchsorted(self.start, c, "right") for c in range(chunks)]
        self.postings = [np.ascontiguousarray(self.values[:n, c * CHUNK:(c + 1) * CHUNK].T) for c, n in enumerate(lists)]

    def search(self, x: np.ndarray, t: np.ndarray):
        """(anchor, row, score) of all pairs of anchors ``x`` and rows with a score of at least ``t`` of the anchor."""
        x = x.astype(np.float64)
        norms = prefix_norms(x)
        cols, acc, found = np.arange(len(self.row)), np.zeros((len(x), len(self.row))), []
        slack = 1e-9 * norms[:, -1].max(initial=0) * self.norms[:, -1].max(initial=0) + 1e-9
        least = t[:, None] - slack

        def finish(part, cols, c):
            """Pairs of ``cols``, whose scores lack the first ``c`` chunks."""
            if not len(cols):
                return
            alive = part + norms[:, c, None] * self.norms[cols, c] >= least
            some = int(alive.sum())
            if c and some * 16 > alive.size:
                part = part + x[:, :c * CHUNK] @ self.values[cols, :c * CHUNK].T
                alive, c = part >= least, 0
            i, j = np.nonzero(alive)
            for a in range(0, len(i), 1 << 16):
                ii, jj = i[a:a + (1 << 16)], j[a:a + (1 << 16)]
                s = part[ii, jj]
                if c:
                    s = s + np.einsum("pd,pd->p", x[ii, :c * CHUNK], self.values[cols[jj], :c * CHUNK])
                fine = s >= t[ii] - slack
                found.append((ii[fine], cols[jj[fine]], s[fine]))

        for c in range(self.chunks - 1, -1, -1):
            n = int(np.searchsorted(self.start[cols], c, "right"))  # the others' remaining dimensions are not in the index
            finish(acc[:, n:], cols[n:], c + 1)
            cols, acc = cols[:n], acc[:, :n]
            if not n:
                break
            acc = acc + x[:, c * CHUNK:(c + 1) * CHUNK] @ self.postings[c][:, cols]
            if c and c in (self.chunks // 2, self.chunks // 4):
                alive = acc + norms[:, c, None] * self.norms[cols, c] >= least
                if int(alive.sum()) * 32 < alive.size:
                    finish(acc, cols, c)
                    cols = cols[:0]
                    break
                stays = alive.any(axis=0)
                if stays.mean() < 0.75:
                    cols, acc = cols[stays], acc[:, stays]
        if len(cols):
            finish(acc, cols, 0)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        i, j, s = (np.concatenate(z) for z in zip(*found))
        return i, self.row[j], s


class Windows:
    """Windows of scores to fill for a block of anchors: window w belongs to anchor
    ``of[w]`` and takes the ``need`` best rows with ``floor[w]`` <= score <= ``high[w]``, of the anchor's
    own label or of any other one. ``low`` and ``top`` are the band of the present round."""

    def __init__(self, ids, labels, x, of, high, floor, need: int, same: bool):
        self.ids, self.labels, self.x, self.need, self.same = ids, labels, x, need, same
        self.of, self.high, self.floor = (np.asarray(z, np.int64) for z in (of, high, floor))
        self.low, self.top = self.high + 1, self.high
        self.got, self.open = np.zeros(len(self.of), np.int64), np.ones(len(self.of), bool)

    def place(self, rows: float, mean: np.ndarray, deviation: np.ndarray, share: np.ndarray, times: float) -> None:
        """Lowers the thresholds of the open windows to where about ``times`` * ``need`` more rows are expected."""
        z = np.linspace(-9, 9, 3601)
        tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        of = self.of
        n = np.maximum(rows * (share[of] if self.same else 1 - share[of]), 1.0)
        above = np.interp((self.high - mean[of]) / np.maximum(deviation[of], 1e-9), z, tail)
        wanted = above + times * self.need / n
        depth = np.interp(-wanted, -tail, z)  # tail falls as z grows
        at = np.ceil(np.clip(mean[of] + depth * deviation[of], -FAR, FAR)).astype(np.int64)
        at = np.where(wanted >= 0.5, self.floor, np.maximum(at, self.floor))
        self.top = self.low - 1
        self.low = np.maximum(np.minimum(at, self.top), self.floor)

    def close(self) -> None:
        self.open &= (self.got < self.need) & (self.low > self.floor)


def threshold_join(vectors: DataFrame, w: Windows, order: np.ndarray, dims: int) -> DataFrame:
    """(``w``, ``vec_id``, ``score``): rows in the bands of the open windows. A block of rows gives
    no more than the ``need`` best of each window, since the others cannot be among them."""
    take = np.flatnonzero(w.open)
    anchors, place = np.unique(w.of[take], return_inverse=True)
    least = np.full(len(anchors), FAR)
    np.minimum.at(least, place, w.low[take])
    x = w.x[anchors][:, order]
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    by = np.argsort(least / np.maximum(size, 1e-30), kind="stable")  # like thresholds share a tile
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    of = rank[place]
    nth = np.argsort(of, kind="stable")
    slots = int(np.bincount(of).max())
    column = np.arange(len(nth)) - np.searchsorted(of[nth], of[nth])
    number, low, top = (np.full((len(by), slots), v, np.int64) for v in (-1, FAR, -FAR))
    number[of[nth], column], low[of[nth], column], top[of[nth], column] = take[nth], w.low[take][nth], w.top[take][nth]
    sent = vectors.sparkSession.sparkContext.broadcast(
        (x[by].astype(np.int32), w.ids[anchors][by], w.labels[anchors][by], number, low, top, order))
    need, same = w.need, w.same

    def block(ids, labels, rows, state):
        x, own, label, number, low, top, norm = state
        t = low.min(axis=1).astype(np.float64)
        tau = float((t / np.maximum(norm, 1e-30)).min())
        index = SuffixIndex(rows, tau)
        exact = norm.max() * index.norms[:, -1].max(initial=0) < EXACT
        for a in range(0, len(x), TILE):
            i, j, s = index.search(x[a:a + TILE], t[a:a + TILE])
            i = i + a
            fits = (label[i] == labels[j]) & (own[i] != ids[j]) if same else label[i] != labels[j]
            i, j, s = i[fits], j[fits], s[fits]
            if exact:
                s = np.rint(s).astype(np.int64)
            else:  # the partial sums only chose the pairs
                s = np.array([x[p] @ rows[q] for p, q in zip(i.tolist(), j.tolist())], np.int64)
            for k in range(number.shape[1]):
                inside = np.flatnonzero((s >= low[i, k]) & (s <= top[i, k]))
                if not len(inside):
                    continue
                ii, jj, ss = i[inside], j[inside], s[inside]
                best = np.lexsort((ids[jj], -ss, ii))
                ii, jj, ss = ii[best], jj[best], ss[best]
                place = np.arange(len(ii)) - np.searchsorted(ii, ii)
                last = place == need - 1  # a full window's threshold rises for the task's next blocks
                low[ii[last], k] = np.maximum(low[ii[last], k], ss[last])
                got = place < need
                yield number[ii[got], k], ids[jj[got]], ss[got]

    def run(batches):
        x, own, label, number, low, top, order = sent.value
        x = x.astype(np.int64)
        state = x, own, label, number, low.copy(), top, np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        held, n = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            parts = list(block(rows.column(0).to_numpy(), rows.column(1).to_numpy(), matrix(rows.column(2), dims)[:, order], state))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*parts)], names=["w", "vec_id", "score"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(a, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return vectors.select("vec_id", "label", "q").mapInArrow(run, "w long, vec_id long, score long")


class Rows:
    """The table to search, and what places first thresholds in it."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors
        n, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
        self.n, self.dims = n, dims or 0
        some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        self.sample, self.sample_labels = matrix(some.column("q"), self.dims).astype(np.float64), some.column("label").to_numpy()
        self.order = np.argsort((self.sample ** 2).sum(axis=0), kind="stable")

    def fill(self, w: Windows) -> DataFrame | None:
        """(``w``, ``vec_id``, ``score``, ``rank``): the rows that fill the windows, best first."""
        mean, deviation = np.zeros(len(w.x)), np.zeros(len(w.x))
        for a in range(0, len(w.x), 1024):
            s = w.x[a:a + 1024].astype(np.float64) @ self.sample.T
            mean[a:a + 1024], deviation[a:a + 1024] = s.mean(axis=1), s.std(axis=1)
        labels, counts = np.unique(self.sample_labels, return_counts=True)
        at = np.minimum(np.searchsorted(labels, w.labels), len(labels) - 1)
        share = np.where(labels[at] == w.labels, counts[at], 0.5) / len(self.sample_labels)
        rounds, times = [], 4.0
        while w.open.any():
            w.place(self.n, mean, deviation, share, times)
            found = materialize(threshold_join(self.vectors, w, self.order, self.dims), "band")
            rounds.append(found)
            for k, n in found.groupBy("w").agg(F.count(F.lit(1))).collect():  # at most a row a window of the block
                w.got[k] += n
            w.close()
            times *= LOWER
        if not rounds:
            return None
        all_rounds = rounds[0]
        for x in rounds[1:]:
            all_rounds = all_rounds.unionByName(x)
        best = Window.partitionBy("w").orderBy(F.col("score").desc(), "vec_id")
        return all_rounds.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= w.need)


def integer_rows(df: DataFrame, id_col: str, label: Column, vector: str, scale: int = 256) -> DataFrame:
    """(``vec_id``, ``label``, ``q``) of the rows that take part: components times ``scale``, rounded down.

    Rows with a null id, label or vector, or with a null or non-finite component, take no
    part, nor do vectors whose scores may not fit a long (a squared norm of 2^62 or
    more after scaling). Of rows with one id the least by label and vector counts, so
    repeated rows count once. Vectors of unequal lengths are as if they ended in zeros."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                     F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull())
    rows = rows.filter(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("_v", F.transform("_v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    rows = rows.filter(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x) < F.lit(2.0 ** 62))
    one = F.min(F.struct("label", F.col("_v").cast("array<int>").alias("q"))).alias("_r")
    return rows.groupBy("vec_id").agg(one).select("vec_id", "_r.label", "_r.q")


def _share(p: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of whole numbers, rounded, without leaving 64 bits."""
    rest = p % 100 * percent
    return p // 100 * percent + (-(-rest // 100) if up else rest // 100)


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``: for each of the rows
    ``anchors`` and its nearest ``positives`` of the same label the first ``negatives`` rows of other
    labels that score from ``low`` to ``high`` percent of the positive's score.

    ``rows`` as of :func:`integer_rows`. Higher scores come first, ties by smaller id. A positive
    with a negative score has no window and no rows; so have anchors without positives. An
    empty table gives no rows. The driver holds one block of ``ANCHORS`` anchors at a time, with
    their positives' scores; results of a block are written before the next begins."""
    spark = rows.sparkSession
    vectors = materialize(rows, "vectors")
    chosen = vectors.filter(anchors)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    blocks, path = -(-chosen.count() // ANCHORS), f"{shared_dir(spark)}/lakeweave/mined-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    table_of = Rows(vectors) if blocks else None
    for b in range(blocks):
        got = chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if not got.num_rows:
            continue
        ids, labels, x = got.column("vec_id").to_numpy(), got.column("label").to_numpy(), matrix(got.column("q"), table_of.dims)
        m = len(ids)
        near = table_of.fill(Windows(ids, labels, x, np.arange(m), np.full(m, FAR), np.zeros(m), positives, True)).toArrow()
        of, best, score = (near.column(c).to_numpy() for c in ("w", "vec_id", "score"))
        windows, number = np.unique(np.stack([of, score]), axis=1, return_inverse=True)
        top, floor = _share(windows[1], high, False), _share(windows[1], low, True)
        w = Windows(ids, labels, x, windows[0], top, floor, negatives, False)
        w.open &= floor <= top
        filled = table_of.fill(w)
        if filled is None:
            continue
        pairs = spark.createDataFrame(pa.table({"w": number.reshape(-1).astype(np.int64), "anchor_id": ids[of], "positive_id": best, "positive_score": score}))
        (filled.join(pairs, "w").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                                        F.col("score").alias("negative_score")).write.mode("append").parquet(path))
    return spark.read.schema(schema).parquet(path)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id))::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""


def op11_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(integer_rows(rows, "vec_id", label, "embedding"), F.col("vec_id") % 50 == 0)
