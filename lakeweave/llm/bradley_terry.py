"""Operator 1: a quality classifier by Bradley-Terry pairwise ranking.

A document's strength is w.x over surface features of its text. Each labelled
good document is preferred to labelled bad ones, and the weights minimise the
logistic loss of the feature differences of such pairs (Newton steps with a ridge
term). Only differences enter, so strengths have no zero of their own: the
threshold is a quantile of the strengths of the labelled rows, chosen where the
two classes part best.

All labelled rows take part. Pairs are formed inside hash buckets of bounded
size, each row of the larger class meeting ``rounds`` rows of the smaller one, so
the number of pairs is linear in the labels; a Newton step sends one gradient
and Hessian (of the number of features) to the driver, summed on the way.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm.text import remainder, table
from lakeweave.session import materialize

CUT = 0.3  # the score of a document that stands at the threshold
BUCKET_ROWS = 2000
QUANTILES = 400

FEATURES = ("log_words", "word_length", "symbols", "upper", "marks", "digits", "pipes", "distinct_words", "top_word",
            "dup_lines", "repeats", "short_lines", "line_words", "loud_words")


def features(raw: bytes) -> list[float]:
    """Surface features of a UTF-8 text; all zero without words."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw) - int(hist[[9, 10, 11, 12, 13, 32]].sum())
    share = lambda chars: float(hist[list(chars)].sum()) / size
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [math.log1p(n), math.log(size / n), math.sqrt(share(b"#*$%&<>@^~=+_\\{}[]")), math.sqrt(share(range(65, 91))),
            math.sqrt(share(b"!?")), math.sqrt(share(range(48, 58))), math.sqrt(share(b"|")),
            math.log(len(tally) / n), math.sqrt(max(tally.values()) / n), 1 - len(set(lines)) / max(len(lines), 1),
            math.sqrt(same / n), sum(len(x) < 12 for x in lines) / max(len(lines), 1), math.log(n / max(len(lines), 1)),
            sum(w.endswith(b"!!") or w[-1:] in b"*$%&#" for w in words) / n]


def text_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("_x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                x = [features(t) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    return docs.select(*keep, F.coalesce(docs[text], F.lit("")).cast("binary")).mapInArrow(run, schema)


def fit(training: DataFrame, rounds: int = 4, steps: int = 12, ridge: float = 1e-3) -> np.ndarray:
    """Weights from rows (``_id``, ``_y`` 0 or 1, ``_x``): all zero if a class is missing."""
    d = len(FEATURES)
    n = training.count()
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    dealt = training.withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(buckets)))
    weights = np.zeros(d)
    out = "n long, " + ", ".join(f"g{i} double" for i in range(d + d * d))

    for _ in range(steps):
        w = weights.copy()

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_id", kind="stable")
            x, y = np.array(pdf["_x"].tolist()).reshape(len(pdf), d), pdf["_y"].to_numpy()
            good, bad = x[y == 1], x[y == 0]
            if not len(good) or not len(bad):
                return pd.DataFrame([[0] + [0.0] * (d + d * d)], columns=["n", *(f"g{i}" for i in range(d + d * d))])
            m = max(len(good), len(bad))
            at = np.arange(m * rounds)
            turn = at // m  # each round pairs with the next row of the other class
            diff = good[(at + turn * (len(good) < m)) % len(good)] - bad[(at + turn * (len(bad) <= m)) % len(bad)]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # of the wrong order
            g, h = diff.T @ p, (diff * (p * (1 - p))[:, None]).T @ diff
            return pd.DataFrame([[len(diff), *g, *h.ravel()]], columns=["n", *(f"g{i}" for i in range(d + d * d))])

        got = dealt.groupBy("_bucket").applyInPandas(step, out).agg(F.sum("n"), *[F.sum(f"g{i}") for i in range(d + d * d)]).first()
        if not got[0]:
            return weights
        g = np.array(got[1:d + 1]) / got[0] - ridge * weights
        h = np.array(got[d + 1:]).reshape(d, d) / got[0] + ridge * np.eye(d)
        move = np.linalg.solve(h, g)
        move *= min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
        weights = weights + move
        if np.abs(move).max() < 1e-4:
            break
    return weights


def quantile_cut(strengths: DataFrame) -> tuple[float, float]:
    """(cut, the quantile of all labelled strengths at which it lies) from rows
    (``_s``, ``_y``): where the share of bad rows below less the share of good
    rows below is largest, in the middle of the gap there."""
    grid = [i / QUANTILES for i in range(QUANTILES + 1)]
    rows = {r["_y"]: (r["q"], r["n"]) for r in strengths.groupBy("_y").agg(
        F.percentile_approx("_s", grid, 100_000).alias("q"), F.count(F.lit(1)).alias("n")).collect()}
    if len(rows) < 2:
        return (0.0, 0.0)
    (bad, n0), (good, n1) = ((np.array(rows[y][0]), rows[y][1]) for y in (0, 1))
    cuts = np.unique(np.concatenate([bad, good]))
    cuts = np.concatenate([cuts, (cuts[1:] + cuts[:-1]) / 2])
    below = lambda q: np.searchsorted(q, cuts, "left") / len(q)
    gain = below(bad) - below(good)
    best = cuts[gain >= gain.max() - 1e-9]
    cut = float((best.min() + best.max()) / 2)
    share = float((np.searchsorted(bad, cut) / len(bad) * n0 + np.searchsorted(good, cut) / len(good) * n1) / (n0 + n1))
    return cut, share


def score(x: Column, mean: np.ndarray, std: np.ndarray, weights: np.ndarray, cut: float) -> Column:
    w = weights / std
    s = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    shift = math.log(CUT / (1 - CUT)) - cut - float(mean @ w)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(s + F.lit(shift))))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                   folds: int = 5, held_fold: int = 0, text: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every row.

    Labels are taken from rows outside the held fold only. Null labels or ids do
    not train; of several labels for an id the smallest counts. Null or empty
    texts have all features zero. Repeated rows get equal scores. Without labels
    of both kinds every score is that of the threshold."""
    x = materialize(text_features(docs, [id_col], text), "features")
    stats = x.select(*[F.col("_x")[i].alias(f"c{i}") for i in range(len(FEATURES))]).agg(
        *[f(f"c{i}") for i in range(len(FEATURES)) for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([v or 0.0 for v in stats[0::2]])
    std = np.array([v if v and v > 1e-9 else 1.0 for v in stats[1::2]])
    marks = (labels.filter(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
             .filter(remainder(F.col(f"`{id_col}`"), folds) != held_fold)
             .groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min(f"`{label}`").cast("int").alias("_y")))
    standard = F.transform(
        F.zip_with("_x", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b), lambda v: v)
    standard = F.zip_with(standard, F.array(*[F.lit(float(v)) for v in std]), lambda a, b: a / b)
    training = materialize(x.select(F.col(f"`{id_col}`").alias("_id"), standard.alias("_x")).join(marks, "_id"), "training")
    weights = fit(training)
    strength = F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(v)) for v in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    cut, _ = quantile_cut(training.select("_y", strength.alias("_s")))
    out = x.select(F.col(f"`{id_col}`"), (remainder(F.col(f"`{id_col}`"), folds) == held_fold).alias("held_out"),
                   score(F.col("_x"), mean, std, weights, cut).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
