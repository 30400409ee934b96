"""Operator 9: Jaccard join of word n-gram sets by grouped prefixes.

Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of
each under any common order. The order is rare first: shingles are sorted by how
many documents hold them (in powers of two), then by hash. Prefixes of unrelated
documents are shingles of their own and meet nobody.

1. One pass over the texts hashes the sets. A document's shingles with the least
   hashes (somewhat more than a prefix) stand for it when counting; they are
   written down per run of documents, counted by hash shard, and their classes
   are sent back to the runs, which choose the prefixes.
2. Documents with equal sets are one class; classes with equal prefix and size
   are one group. Groups meet over a shared prefix shingle if sizes and positions
   allow it. A shingle of many groups pairs each with one hub: the most typical
   group, of middling size and with few rarer shingles ahead, which among near
   copies is close to the text they were made from.
3. Group pairs are held against each other on their whole prefixes, which bounds
   the possible overlap; what passes is verified on the whole sets, a group by its
   first class, whose links with the group's other classes are verified too. The
   links give components.
4. Documents of shingles and groups that are not in one component yet go through
   the same steps once more, among themselves and with all their shingles in the
   order, which makes prefixes and bounds tight. What even then shares a prefix
   shingle across components meets in full. So components are exact, and a group
   of copies does not become all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.components import connected_components
from lakeweave.llm.text import WordHasher, chunks, shingle_hashes, table
from lakeweave.session import materialize

RUN_BYTES = 8 << 20
SHARD_BYTES = 24 << 20  # of text for each shard of the counts
FEW = 16  # groups of a shingle that meet without a hub
CLASS_BITS = np.uint64(59)


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def text_sets(texts: list[bytes], width: int, hasher: WordHasher):
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    words, starts = hasher(b"\n".join(texts).lower())
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]), "left")
    begin = 0
    for end in ends.tolist():
        yield shingle_hashes(words[begin:end], width)
        begin = end


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _ranges(counts: np.ndarray) -> list[slice]:
    ends = np.cumsum(counts).tolist()
    return [slice(a, b) for a, b in zip([0, *ends[:-1]], ends)]


def counted_share(percent: int) -> float:
    """Part of all hashes that stands for a document: a prefix and some more."""
    return 1.6 * (100 - percent) / 100


def hashed_runs(docs: DataFrame, id_col: str, text: str, width: int, percent: int, share: float) -> DataFrame:
    """One row per run of documents: ids and texts' hashes (as an Arrow table), sizes
    and hashes of the sets, and the shingles that stand for each document."""
    bound = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches):
        hasher, part, number = WordHasher(), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(2).to_pylist(), lambda x: len(x) + 1, RUN_BYTES):
                n, c, tokens = [], [], []
                for s in text_sets(texts, width, hasher):
                    n.append(len(s))
                    c.append(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)))
                    tokens.append(s[:max(prefix_length(len(s), percent), int(np.searchsorted(s, bound)))])
                ids = pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts))], names=["id", "t"])
                at += len(texts)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as writer:
                    writer.write_batch(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + number]), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                     pa.array([np.array(n, "<i4").tobytes()], pa.binary()), pa.array([np.array(c, "<u8").tobytes()], pa.binary()),
                     pa.array([np.array([len(x) for x in tokens], "<i4").tobytes()], pa.binary()),
                     pa.array([np.concatenate(tokens).astype("<u8").tobytes()], pa.binary())],
                    names=["run", "ids", "n", "c", "held", "tokens"])
                number += 1

    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return materialize(docs.select(F.col(f"`{id_col}`"), F.xxhash64(raw), raw.cast("binary")).mapInArrow(
        run, "run long, ids binary, n binary, c binary, held binary, tokens binary"), "runs")


def shingle_classes(runs: DataFrame, shards: int) -> DataFrame:
    """(``run``, ``shard``, ``classes``): for the sorted distinct shingles of a run in a
    hash shard, the power of two of the documents that hold each, one byte each."""

    def deal(batches):
        for batch in batches:
            for run, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, n = np.unique(np.frombuffer(raw, "<u8"), return_counts=True)
                shard = tokens % np.uint64(shards)
                for s in range(shards):
                    mine = shard == s
                    if mine.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([run]), pa.array([s], pa.int32()), pa.array([tokens[mine].tobytes()], pa.binary()),
                             pa.array([n[mine].astype("<u4").tobytes()], pa.binary())], names=["run", "shard", "tokens", "n"])

    def count(group: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, "<u8") for x in group.column("tokens").to_pylist()]
        n = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("n").to_pylist()])
        all_, inv = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(inv, weights=n)
        classes = np.minimum(np.log2(total), 14).astype(np.uint8)[inv]
        return pa.table({"run": group.column("run"), "shard": group.column("shard"),
                         "classes": pa.array([classes[i].tobytes() for i in _ranges(np.array([len(x) for x in tokens]))], pa.binary())})

    return (runs.select("run", "tokens").mapInArrow(deal, "run long, shard int, tokens binary, n binary")
            .groupBy("shard").applyInArrow(count, "run long, shard int, classes binary"))


def prefixes(docs: DataFrame, id_col: str, text: str, width: int, percent: int, share: float) -> DataFrame:
    """One row per document: ``id``, ``t`` (hash of the text), ``n``, ``c`` (class: hash of the set), and where
    a prefix shingle is not the document's own, ``g`` (group) and ``prefix``: its
    shingles as keys in the common order."""
    bound = np.uint64(min(int(share * 2**64), 2**64 - 1))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    runs = hashed_runs(docs, id_col, text, width, percent, share)
    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    out = "t long, n long, c long, g long, prefix array<long>"

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        row = {k: left.column(k)[0].as_py() for k in ("ids", "n", "c", "held", "tokens")}
        ids = pa.ipc.open_stream(row["ids"]).read_all()
        n, c, held = np.frombuffer(row["n"], "<i4"), np.frombuffer(row["c"], "<u8"), np.frombuffer(row["held"], "<i4")
        tokens = np.frombuffer(row["tokens"], "<u8")
        uniq = np.unique(tokens)
        classes, shard = np.zeros(len(uniq), np.uint64), uniq % np.uint64(shards)
        for s, raw in zip(right.column("shard").to_pylist(), right.column("classes").to_pylist()):
            classes[shard == s] = np.frombuffer(raw, np.uint8)
        # shingles beyond the bound are not counted everywhere: they come last, as one class
        top = np.where(uniq < bound, classes, np.uint64(15))
        keys = ((top << CLASS_BITS) | (uniq >> np.uint64(5)))[np.searchsorted(uniq, tokens)]
        groups, chosen = [], []
        for size, i in zip(n.tolist(), _ranges(held)):
            key = np.sort(keys[i])[:prefix_length(size, percent)] if size else keys[:0]
            if len(key) and key[-1] >> CLASS_BITS:
                groups.append(xxhash.xxh3_64_intdigest(key.tobytes(), seed=size) - (1 << 63))
                chosen.append(_signed(key))
            else:
                groups.append(None)
                chosen.append(None)
        known = pa.array(_signed(c), mask=n == 0)
        return pa.table([ids.column("id"), ids.column("t"), pa.array(n.astype(np.int64)), known,
                         pa.array(groups, pa.int64()), pa.array(chosen, pa.list_(pa.int64()))], names=["id", "t", "n", "c", "g", "prefix"])

    classes = shingle_classes(runs, shards)
    return materialize(runs.groupBy("run").cogroup(classes.groupBy("run")).applyInArrow(choose, f"id {id_type}, {out}"), "prefixes")


def sizes_fit(a, b, percent: int):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def positions_fit(na, ia, nb, ib, percent: int):
    """Whether a first common shingle at these positions leaves room for the overlap."""
    left = 1 + F.least(na - ia - 1, nb - ib - 1)
    return left * (100 + percent) >= percent * (na + nb)


def possible_pairs(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Of the group pairs (``a``, ``b``) those whose prefixes allow the overlap: up to
    the lesser of the two last keys all of both sets is known."""

    def keep(batches):
        for batch in batches:
            flags = []
            na, nb = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            pa_, pb = batch.column(3), batch.column(5)
            for i in range(batch.num_rows):
                x, y = (col[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for col in (pa_, pb))
                end = min(x[-1], y[-1])
                x, y = x[:np.searchsorted(x, end, "right")], y[:np.searchsorted(y, end, "right")]
                most = len(np.intersect1d(x, y, assume_unique=True)) + min(na[i] - len(x), nb[i] - len(y))
                flags.append(most * (100 + percent) >= percent * (na[i] + nb[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(flags, pa.bool_()))

    one = groups.select(F.col("g").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    two = groups.select(F.col("g").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "na", "pa", "nb", "pb").mapInArrow(keep, "a long, b long"))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """Of the class pairs (``u``, ``v``) those whose whole sets are similar enough. The
    texts of the classes concerned are hashed again."""
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(), "pairs")
    wanted = pairs.select(F.col("u").alias("c")).unionByName(pairs.select(F.col("v").alias("c"))).distinct()
    texts = sets.join(wanted, "c", "left_semi").groupBy("c").agg(F.min("t").alias("t")).select("t")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def whole(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in chunks(batch.column(0).to_pylist(), len, RUN_BYTES):
                found = list(text_sets(part, width, hasher))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) for s in found], np.uint64))),
                     pa.array([s.tobytes() for s in found], pa.binary())], names=["c", "set"])

    full = (docs.select(raw.alias("x"), F.xxhash64(raw).alias("t")).join(texts, "t", "left_semi").dropDuplicates(["t"])
            .select(F.col("x").cast("binary")).mapInArrow(whole, "c long, set binary"))

    def similar(batches):
        for batch in batches:
            flags = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                flags.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(flags, pa.bool_()))

    return (pairs.join(full.select(F.col("c").alias("u"), F.col("set").alias("x")), "u")
            .join(full.select(F.col("c").alias("v"), F.col("set").alias("y")), "v")
            .select("u", "v", "x", "y").mapInArrow(similar, "u long, v long"))


class Meeting:
    """Groups of a frame of prefixes and the pairs of them that may link. ``labels``
    (``node``, ``label``) tells which classes are in one component already."""

    def __init__(self, sets: DataFrame, percent: int, labels: DataFrame | None = None):
        self.percent = percent
        self.groups = materialize(sets.filter("g is not null").select("g", "n", "prefix").dropDuplicates(["g"]), "groups")
        self.members = materialize(sets.filter("g is not null").select("g", "c").distinct(), "members")
        self.heads = self.members.groupBy("g").agg(F.min("c").alias("head"))
        self.labels = labels
        posted = self.groups.select("g", "n", F.posexplode("prefix").alias("i", "key")).filter(F.shiftrightunsigned("key", 59) > 0)
        shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("f"), F.round(F.avg("n")).alias("middle")).filter("f > 1")
        self.posted = materialize(posted.join(shared, "key"), "postings")
        self.few, self.many = self.posted.filter(F.col("f") <= FEW), self.posted.filter(F.col("f") > FEW)

    def labelled(self, labels: DataFrame | None) -> DataFrame:
        """Members with the label of each class."""
        if labels is None:
            return self.members.withColumn("label", F.col("c"))
        return self.members.join(labels.withColumnRenamed("node", "c"), "c", "left").select("g", "c", F.coalesce("label", "c").alias("label"))

    def _possible(self, pairs: DataFrame) -> DataFrame:
        return materialize(possible_pairs(pairs.distinct(), self.groups, self.percent), "close")

    def _meet(self, posted: DataFrame, extra=None) -> DataFrame:
        x, y = posted.alias("x"), posted.alias("y")
        fits = (sizes_fit(F.col("x.n"), F.col("y.n"), self.percent)
                & positions_fit(F.col("x.n"), F.col("x.i"), F.col("y.n"), F.col("y.i"), self.percent))
        if extra is not None:
            fits = fits & extra
        return (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.g") < F.col("y.g")) & fits)
                .select(F.col("x.g").alias("a"), F.col("y.g").alias("b")).distinct())

    def typical_pairs(self) -> DataFrame:
        """Class pairs (``u``, ``v``): heads of groups that share a shingle of few groups,
        of each group and the hub of a shingle of many, and of a group and its others."""
        far = F.col("i") + F.abs(F.col("n") - F.col("middle"))
        hubs = (self.many.groupBy("key").agg(F.min(F.struct(far.alias("o"), F.col("g").alias("hub"), F.col("n").alias("m"))).alias("h"))
                .select("key", "h.hub", "h.m"))
        starred = (self.many.join(hubs, "key").filter((F.col("g") != F.col("hub")) & sizes_fit(F.col("n"), F.col("m"), self.percent))
                   .select(F.least("g", "hub").alias("a"), F.greatest("g", "hub").alias("b")).distinct())
        self.close = self._possible(self._meet(self.few).unionByName(starred))
        heads = self.heads
        pairs = (self.close.join(heads.select(F.col("g").alias("a"), F.col("head").alias("u")), "a")
                 .join(heads.select(F.col("g").alias("b"), F.col("head").alias("v")), "b").select("u", "v"))
        inside = self.members.join(heads, "g").filter("c <> head").select(F.col("head").alias("u"), F.col("c").alias("v"))
        pairs = pairs.unionByName(inside)
        if self.labels is None:
            return pairs
        known = self.labels.select(F.col("node"), "label")
        return (pairs.join(known.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u", "left")
                .join(known.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v", "left")
                .filter(~F.coalesce(F.col("lu") == F.col("lv"), F.lit(False))).select("u", "v"))

    def _spans(self, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        members = materialize(self.labelled(labels), "labelled")
        spans = members.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("k"))
        marked = self.many.join(spans, "g")
        open_keys = marked.groupBy("key").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("key")
        return members, spans, marked.join(open_keys, "key", "left_semi")

    def _beside(self, wide: DataFrame) -> DataFrame:
        """Close pairs of which one is a group of several classes."""
        return (self.close.join(wide.select(F.col("g").alias("a")), "a", "left_semi")
                .unionByName(self.close.join(wide.select(F.col("g").alias("b")), "b", "left_semi").select("a", "b")).distinct())

    def open_classes(self, labels: DataFrame) -> DataFrame:
        """Classes (``c``) that may have links across components."""
        members, spans, marked = self._spans(labels)
        wide = spans.filter("k > 1").select("g")
        beside = self._beside(wide)
        groups = (marked.select("g").unionByName(spans.filter("low <> high").select("g"))
                  .unionByName(beside.select(F.col("a").alias("g"))).unionByName(beside.select(F.col("b").alias("g"))).distinct())
        return members.join(groups, "g", "left_semi").select("c").distinct()

    def remaining_pairs(self, labels: DataFrame) -> DataFrame:
        """All class pairs across components that share a shingle of many groups, a
        group, or whose groups are close."""
        members, spans, marked = self._spans(labels)
        apart = (F.col("x.low") != F.col("y.low")) | (F.col("x.low") != F.col("x.high")) | (F.col("y.low") != F.col("y.high"))
        rest = self._possible(self._meet(marked, apart).join(self.close, ["a", "b"], "left_anti"))
        both = rest.unionByName(self._beside(spans.filter("k > 1").select("g"))).distinct()
        between = (both.join(members.select(F.col("g").alias("a"), F.col("c").alias("u"), F.col("label").alias("lu")), "a")
                   .join(members.select(F.col("g").alias("b"), F.col("c").alias("v"), F.col("label").alias("lv")), "b"))
        some = members.join(spans.filter("low <> high").select("g"), "g", "left_semi")
        within = (some.select("g", F.col("c").alias("u"), F.col("label").alias("lu"))
                  .join(some.select("g", F.col("c").alias("v"), F.col("label").alias("lv")), "g").filter("u < v"))
        return between.filter("lu <> lv").select("u", "v").unionByName(within.filter("lu <> lv").select("u", "v"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(``id``, ``t``, ``n_shingles``, ``component_id``) of every row: the hash of its text, the
    size of the set of ``width``-word shingles, and the least id that links lead to,
    its own included. Two rows link if their sets' Jaccard similarity is at least
    ``percent`` / 100.

    Null, empty and blank texts have no set and no links; their component is their own
    id. Repeated rows and exact copies link. A null id counts in a component only
    if no other row is in it. Sets are told apart by 64-bit hashes of shingles."""
    sets = prefixes(docs, id_col, text, width, percent, counted_share(percent))
    check = lambda pairs: materialize(verified(pairs, docs, sets, text, width, percent), "links")
    first = Meeting(sets, percent)
    links = check(first.typical_pairs())
    labels = connected_components(links)

    # what is not linked yet, with all shingles
    again = first.open_classes(labels)
    texts = sets.join(again, "c", "left_semi").groupBy("c").agg(F.min("t").alias("_t")).select("_t")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    some = materialize(docs.select(F.xxhash64(raw).alias("_t"), raw.alias("_x")).join(texts, "_t", "left_semi").dropDuplicates(["_t"]), "again")
    second = Meeting(prefixes(some, "_t", "_x", width, percent, 1.0), percent, labels)
    links = links.unionByName(check(second.typical_pairs()))
    links = links.unionByName(check(second.remaining_pairs(connected_components(links))))
    labels = connected_components(links).select(F.col("node").alias("c"), "label")

    of_class = sets.filter("c is not null").groupBy("c").agg(F.min("id").alias("low")).join(labels, "c", "left")
    of_class = of_class.withColumn("label", F.coalesce("label", "c"))
    least = of_class.groupBy("label").agg(F.min("low").alias("component_id"))
    found = of_class.join(least, "label").select("c", "component_id")
    return (sets.select("id", "t", F.col("n").alias("n_shingles"), "c").join(found, "c", "left")
            .select("id", "t", "n_shingles", F.coalesce("component_id", "id").alias("component_id")))


def op9_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the
    least id stays, once. Rows without words stay, one of equal rows' id and text."""
    stay = (similar_components(docs, id_col, text, width, percent).filter(F.col("id").eqNullSafe(F.col("component_id")))
            .select(F.col("id").alias("_id"), F.col("t").alias("_tt")).distinct())
    keyed = docs.withColumn("_t", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return (keyed.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tt")), "left_semi")
            .dropDuplicates([id_col, "_t"]).drop("_t"))


#: The same over the whole table, on the shingles themselves instead of hashes.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM (SELECT * FROM s SEMI JOIN shared USING (sh)) a
      JOIN (SELECT * FROM s SEMI JOIN shared USING (sh)) b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(low) AS low FROM r GROUP BY node) c ON c.node = d.doc_id
"""
