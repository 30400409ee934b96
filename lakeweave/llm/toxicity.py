"""Operator 4: toxicity by the nearest labelled examples.

Examples and documents are TF-IDF vectors over terms that tell the labels apart:
words, and beginnings of words (inflected and compounded forms share them). Each
document is held against an inverted index of the examples; postings are cut in
blocks of examples with the greatest weight of each term in each block, so that
blocks which cannot reach the k-th best cosine are passed over. The search is
exact. Neighbours vote with their cosine; votes are calibrated on the examples
themselves, each without its own vote. A document's evidence is its neighbours.

The classifier is fitted on a bounded sample of the labelled rows: at most
``max_examples`` distinct texts of either label, those with the least hash of the
id. So index, vocabulary and calibration have a size that does not grow with the
corpus and are broadcast. Document frequencies are counted over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm.text import remainder, table
from lakeweave.session import materialize

CUT = 0.7  # the score at which a document counts as toxic
MAX_EXAMPLES = 6000  # of either label
MAX_TERMS = 4096
NEIGHBOURS = 15
BLOCK = 32
PREFIXES = (4, 5, 6)
STRIP = re.compile(r"^[\W_]+|[\W_]+$").sub


def word_terms(word: str) -> tuple[str, ...]:
    """Terms of a raw word: the bare word, and its beginnings marked with a star."""
    bare = STRIP("", word.lower())
    return (bare, *(bare[:k] + "*" for k in PREFIXES if len(bare) > k)) if bare else ()


class TermCounter:
    """Counts of a text's terms that are in a vocabulary."""

    def __init__(self, vocabulary: dict[str, int] | None, limit: int = 300_000):
        self.vocabulary, self.memo, self.limit = vocabulary, {}, limit

    def __call__(self, text: str) -> Counter:
        words = Counter(text.split())
        out: Counter = Counter()
        memo, vocabulary = self.memo, self.vocabulary
        if len(memo) > self.limit:
            memo.clear()
        for w, n in words.items():
            terms = memo.get(w)
            if terms is None:
                terms = word_terms(w)
                if vocabulary is not None:
                    terms = memo[w] = tuple(vocabulary[t] for t in terms if t in vocabulary)
            for t in terms:
                out[t] += n
        return out


def vector(tf: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers ascending, weights of length one)."""
    terms = np.array(sorted(tf), np.int64)
    w = np.array([1 + math.log(tf[t]) for t in terms.tolist()]) * idf[terms]
    return terms, w / math.sqrt(float(w @ w)) if len(w) else w


class BlockMaxIndex:
    """Postings by term in ascending example number, with the greatest weight of
    each term in each block of ``BLOCK`` consecutive examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        # examples of like terms stand together, which makes the blocks' bounds tight
        self.order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")].tolist(), i))
        lists: list[list] = [[] for _ in range(n_terms)]
        for place, i in enumerate(self.order):
            for t, w in zip(vectors[i][0].tolist(), vectors[i][1].tolist()):
                lists[t].append((place, w))
        self.n_blocks = -(-len(vectors) // BLOCK)
        self.places = [np.array([p for p, _ in x], np.int64) for x in lists]
        self.weights = [np.array([w for _, w in x]) for x in lists]
        self.blocks, self.starts, self.tops = [], [], []
        for p, w in zip(self.places, self.weights):
            b, at = np.unique(p // BLOCK, return_index=True)
            self.blocks.append(b)
            self.starts.append(np.append(at, len(p)))
            self.tops.append(np.maximum.reduceat(w, at) if len(p) else w)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of greatest positive cosine, as (cosine, number), ties
        to the smaller number; ``without`` is left out."""
        bound = np.zeros(self.n_blocks)
        for t, q in zip(terms.tolist(), weights.tolist()):
            bound[self.blocks[t]] += q * self.tops[t]
        best: list[tuple[float, int]] = []
        least = 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) >= k and bound[b] < least - 1e-12):
                break
            sums = np.zeros(BLOCK)
            for t, q in zip(terms.tolist(), weights.tolist()):
                i = np.searchsorted(self.blocks[t], b)
                if i < len(self.blocks[t]) and self.blocks[t][i] == b:
                    at = slice(self.starts[t][i], self.starts[t][i + 1])
                    sums[self.places[t][at] - b * BLOCK] += q * self.weights[t][at]
            hit = np.flatnonzero(sums > 0)
            best += [(s, i) for s, j in zip(sums[hit].tolist(), hit.tolist()) if (i := self.order[b * BLOCK + j]) != without]
            if len(best) > k:
                best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            if len(best) >= k:
                least = min(best)[0]
        return sorted(best, key=lambda x: (-x[0], x[1]))


class NearestVotes:
    """Index, labels and calibration; small enough to be sent to every task."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, ids: list, labels: np.ndarray, vectors: list, class_weights):
        self.vocabulary, self.idf, self.ids, self.labels = vocabulary, idf, ids, labels
        self.index = BlockMaxIndex(vectors, len(vocabulary))
        self.class_weights = np.asarray(class_weights, float)
        self.prior = float((self.class_weights[1] * (labels == 1).sum()) / max(self.class_weights[labels].sum(), 1e-12)) if len(labels) else 0.0
        self.slope, self.cut = 8.0, 0.5

    def vote(self, terms, weights, without: int = -1) -> tuple[float, list[tuple[float, int]]]:
        """(share of the vote for label 1, neighbours). The prior has a small vote,
        which decides where there are no neighbours."""
        near = self.index.search(terms, weights, NEIGHBOURS, without) if len(terms) else []
        yes, everything = 0.25 * self.prior, 0.25
        for s, i in near:
            # every neighbour speaks for its class's rows in the whole training set
            w = s * self.class_weights[self.labels[i]]
            everything += w
            yes += w * self.labels[i]
        return yes / everything, near

    def calibrate(self, votes: np.ndarray) -> None:
        """Cut where the classes part best; slope by logistic loss around it."""
        w = self.class_weights[self.labels]
        one, nil = self.labels == 1, self.labels == 0
        if not one.any() or not nil.any():
            return
        values = np.unique(votes)
        cuts = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values
        gain = np.array([(votes[one] > c).mean() - 2 * np.average(votes[nil] > c, weights=w[nil]) for c in cuts])
        best = cuts[gain >= gain.max() - 1e-9]
        self.cut = float((best.min() + best.max()) / 2)
        shift = math.log(CUT / (1 - CUT))
        loss = lambda a: np.average(np.logaddexp(0, -(2 * self.labels - 1) * (a * (votes - self.cut) + shift)), weights=w)
        self.slope = min((4.0, 6.0, 8.0, 12.0, 16.0, 24.0), key=loss)

    def score(self, vote: float) -> float:
        return 1 / (1 + math.exp(-(self.slope * (vote - self.cut) + math.log(CUT / (1 - CUT)))))


def examples(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text: str, folds: int, held_fold: int) -> tuple[DataFrame, dict]:
    """At most ``MAX_EXAMPLES`` labelled texts of either label, and the rows of each label."""
    marks = (labels.filter(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
             .filter(remainder(F.col(f"`{id_col}`"), folds) != held_fold)
             .groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(f"`{label}`").cast("int").alias("_y")))
    counts = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        some = marks.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(MAX_EXAMPLES)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text")).filter(F.col("_text").isNotNull())
    # at most 2 * MAX_EXAMPLES ids and labels
    found = texts.join(F.broadcast(chosen), "_id")
    return materialize(found.groupBy(F.xxhash64("_text").alias("_h")).agg(
        F.min(F.struct("_id", "_y", "_text")).alias("x")).select("x.*"), "examples"), counts


def choose_terms(found: DataFrame, n_of: dict[int, int]) -> list[str]:
    """Terms of the examples that stand for label 1: enough distinct texts, mostly
    of that label, and the highest chi-square."""
    def split(batches):
        count = TermCounter(None)
        for batch in batches:
            rows = [(t, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in count(x)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], names=["term", "y"])

    n1, n0 = n_of.get(1, 0), n_of.get(0, 0)
    if not n1 or not n0:
        return []
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (F.lit(float(n1 * n0)) * (a + b) * (n1 + n0 - a - b))
    # the classes are sampled apart: their rates, not their numbers, are compared
    rows = (found.select("_text", "_y").mapInArrow(split, "term string, y int")
            .groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
            .filter((F.col("a") >= max(3, math.ceil(0.003 * n1))) & (a / n1 > 8 * b / n0) & (F.col("a") + F.col("b") < n1 + n0))
            .select("term", chi.alias("chi")).orderBy(F.desc("chi"), "term").limit(MAX_TERMS).collect())
    return sorted(r["term"] for r in rows)


def term_counts(docs: DataFrame, keep: list[str], text: str, vocabulary: dict[str, int]) -> DataFrame:
    """``keep`` columns and ``_terms``, ``_counts``: the terms of each text and how often it holds them."""
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("_terms", T.ArrayType(T.IntegerType())),
                           T.StructField("_counts", T.ArrayType(T.IntegerType()))])

    def run(batches):
        count = TermCounter(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = [sorted(count(t.as_py()).items()) for t in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([[t for t, _ in x] for x in found], pa.list_(pa.int32())),
                     pa.array([[c for _, c in x] for x in found], pa.list_(pa.int32()))], names=schema.names)

    return docs.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit(""))).mapInArrow(run, schema)


def document_frequencies(counted: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each of ``size`` terms, and all documents."""
    df = np.zeros(size)
    for t, n in counted.select(F.explode("_terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():  # a row a term
        df[t] = n
    return df, counted.count()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text",
        folds: int = 3, held_fold: int = 1) -> NearestVotes:
    return fit_and_count(docs, labels, [id_col], label, id_col, text, folds, held_fold)[0]


def fit_and_count(docs: DataFrame, labels: DataFrame, keep: list[str], label: str = "toxic", id_col: str = "doc_id", text: str = "text",
                  folds: int = 3, held_fold: int = 1) -> tuple[NearestVotes, DataFrame]:
    """The classifier, and the :func:`term_counts` of ``docs`` with the columns ``keep``, to be scored by it. They are written
    down for frequencies and scores, so texts are taken apart once; whole documents are better not among them."""
    found, counts = examples(docs, labels, label, id_col, text, folds, held_fold)
    n_of = {r["_y"]: r["count"] for r in found.groupBy("_y").count().collect()}
    vocabulary = {t: i for i, t in enumerate(choose_terms(found, n_of))}
    counted = materialize(term_counts(docs, keep, text, vocabulary), "terms")
    df, n = document_frequencies(counted, len(vocabulary))
    idf = np.log((n + 1) / (df + 1)) + 1

    def vectors(batches):
        count = TermCounter(vocabulary)
        for batch in batches:
            tf = [sorted(count(x).items()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[t for t, _ in x] for x in tf], pa.list_(pa.int32())),
                 pa.array([[c for _, c in x] for x in tf], pa.list_(pa.int32()))], names=["_id", "_y", "t", "c"])

    schema = T.StructType([*found.select("_id", "_y").schema.fields, T.StructField("t", T.ArrayType(T.IntegerType())), T.StructField("c", T.ArrayType(T.IntegerType()))])
    # at most 2 * MAX_EXAMPLES rows of a few chosen terms each
    rows = sorted(found.select("_id", "_y", "_text").mapInArrow(vectors, schema).collect(), key=lambda r: str(r["_id"]))
    vecs = [vector(Counter(dict(zip(r["t"], r["c"]))), idf) for r in rows]
    y = np.array([r["_y"] for r in rows], np.int64)
    weights = [counts.get(c, 0) / max(n_of.get(c, 0), 1) for c in (0, 1)]
    top = max(weights) or 1.0
    model = NearestVotes(vocabulary, idf, [str(r["_id"]) for r in rows], y, vecs, [w / top for w in weights])
    known: dict = {}

    def own(i: int) -> float:
        t, w = vecs[i]
        if not len(t):
            return known.setdefault("", model.vote(t, w)[0])
        return model.vote(t, w, without=i)[0]

    model.calibrate(np.array([own(i) for i in range(len(rows))]))
    return model, counted


def toxicity_scores(docs: DataFrame, model: NearestVotes, keep: list[str], text: str = "text") -> DataFrame:
    """:func:`scores` of documents that have not been counted yet."""
    return scores(term_counts(docs, keep, text, model.vocabulary), model)


def scores(counted: DataFrame, model: NearestVotes) -> DataFrame:
    """The rows of :func:`term_counts` with ``score``, ``predicted`` and ``evidence``: the
    nearest examples as (id, label, cosine).

    No shuffle. Null and empty texts have no terms and get the prior's score; repeated
    rows keep a row each; an empty table gives none. Kept columns may have any name but
    those of the results."""
    keep = [c for c in counted.columns if c not in ("_terms", "_counts")]
    sent = counted.sparkSession.sparkContext.broadcast(model)
    evidence = T.ArrayType(T.StructType([T.StructField("example_id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
    schema = T.StructType([*counted.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", evidence)])
    kind = pa.list_(pa.struct([("example_id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        m, known = sent.value, {}
        for batch in batches:
            found_scores, near = [], []
            for terms, counts in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                key = (*terms, *counts)
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    vote, found = m.vote(*vector(dict(zip(terms, counts)), m.idf))
                    known[key] = (m.score(vote), [{"example_id": m.ids[i], "label": int(m.labels[i]), "cosine": s} for s, i in found[:5]])
                s, e = known[key]
                found_scores.append(s)
                near.append(e)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(found_scores, pa.float64()), pa.array([int(s >= CUT) for s in found_scores], pa.int32()), pa.array(near, kind)], names=schema.names)

    return counted.select(*keep, "_terms", "_counts").mapInArrow(run, schema)


def op4_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counted = fit_and_count(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    held = (remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return scores(counted, model).select("doc_id", held, "score", "predicted", "evidence")
