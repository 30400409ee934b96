"""Tamper-evident audit trail (G7, G8, W2): links, Merkle roots, heads, proofs.

Every event is stored as its canonical JSON document (fields in alphabetical order,
``previous_hash`` included) with ``this_hash`` = sha256(document). Links are sequential by
definition, so a source's chain is cut into segments of one hour (or fewer seconds), and
every segment is bound as a whole:

* the content hash of an event is sha256 of its document with a placeholder for the
  link: row-parallel, independent of the chain;
* the root of a segment is the Merkle tree hash over its events' content hashes, in
  the order of (time, event id), computed while rows stream by;
* the head after a segment is sha256(head before it | source | segment | number of events |
  root). It is the first link of the next segment.

So heads need one small row per segment, all segments are linked in parallel, and any
change, removal, addition or reordering of events changes the segment's root and the
first link that must follow. What lies at the end of a source has no next link: heads
(and, to find the place, the seals of all segments) are stored apart from the trail.

An event without a time goes to one of ``UNTIMED`` segments of its source by its id.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.columns import trunc_seconds, ts_lit
from lakeweave.session import materialize

PREV_PLACEHOLDER = "__PREVIOUS_HASH__"
GENESIS = "GENESIS"
UNKNOWN = "unknown"  # source of events whose type is null or not registered
NO_HOUR = "0001-01-01 00:00:00"  # first segment of events without a timestamp
UNTIMED = 4096
LATE = "#late"  # sources of events that came after their segment was sealed

CHAIN_SCHEMA = ("source_system string, seg_hour timestamp_ntz, ts timestamp_ntz, event_id string, "
                "query_id string, doc string, previous_hash string, this_hash string")
FIELDS = ["action", "actor", "event_id", "event_type", "outcome", "previous_hash", "resource", "risk",
          "schema_version", "source_host", "source_namespace", "source_system", "timestamp"]
SEGMENT = ["source_system", "seg_hour"]


def ship_by_value() -> None:
    """Functions of this module run in tasks: pickled by value, executors need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---------------------------------------------------------------------------
# Documents, segments, hashes
# ---------------------------------------------------------------------------

def template(event: Column) -> Column:
    """Canonical JSON of an event struct with the placeholder as its link."""
    return F.to_json(F.struct(*[(F.lit(PREV_PLACEHOLDER) if n == "previous_hash" else event[n]).alias(n) for n in FIELDS]))


def content_hash(doc: Column) -> Column:
    """Content hash of a stored document."""
    return F.sha2(F.regexp_replace(doc, r'"previous_hash":"[^"]*"', f'"previous_hash":"{PREV_PLACEHOLDER}"'), 256)


def genesis(source: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(GENESIS), source), 256)


def head_after(before: Column, source: Column, segment: Column, n: Column, root: Column) -> Column:
    return F.sha2(F.concat_ws("|", before, source, F.date_format(segment, "yyyy-MM-dd'T'HH:mm:ss"), n.cast("string"), root), 256)


def with_segment(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Adds ``seg_hour`` and fills ``source_system``; neither is ever null, so no join on them drops an event."""
    untimed = ts_lit(NO_HOUR) + F.make_interval(secs=F.crc32(F.coalesce("event_id", F.lit("")).cast("binary")) % UNTIMED)
    return (events.withColumn("source_system", F.coalesce("source_system", F.lit(UNKNOWN)))
                  .withColumn("seg_hour", F.coalesce(trunc_seconds("ts", seconds), untimed)))


# ---------------------------------------------------------------------------
# Merkle trees over streams of rows
# ---------------------------------------------------------------------------

class Merkle:
    """Tree hash of a stream of leaves. Subtrees of 2^k leaves are kept on a stack and
    joined when two are alike, so memory grows with the logarithm of the leaves; at the
    end the rest is joined from the right. ``watch`` follows a leaf's path to the root."""

    def __init__(self):
        self.stack: list[tuple[int, str, list[list]]] = []  # (leaves, hash, paths of watched leaves)
        self.n = 0

    def _join(self) -> None:
        (a, left, ours), (b, right, theirs) = self.stack[-2:]
        for path in ours:
            path.append((False, right))
        for path in theirs:
            path.append((True, left))
        node = hashlib.sha256(f"1|{left}|{right}".encode()).hexdigest()
        self.stack[-2:] = [(a + b, node, ours + theirs)]

    def add(self, leaf: str, watch: list | None = None) -> None:
        self.stack.append((1, leaf, [] if watch is None else [watch]))
        self.n += 1
        while len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            self._join()

    def root(self) -> str:
        while len(self.stack) > 1:
            self._join()
        return self.stack[0][1]


def _runs(batches, columns):
    """(segment, rows of ``columns`` as tuples) runs of rows that are clustered by segment, in order."""
    for b in batches:
        keys = zip(b.column("source_system").to_pylist(), b.column("seg_hour").cast(pa.int64()).to_pylist())
        yield from zip(keys, zip(*(b.column(c).to_pylist() for c in columns)))


def _segment_roots(batches):
    """One row per segment: its number of events, root, and the first event's link."""
    segment, tree, first, out = None, None, None, []

    def batch():
        source, hour, n, root, link = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(source), pa.array(hour, pa.int64()).cast(pa.timestamp("us")), pa.array(n, pa.int64()),
                                           pa.array(root), pa.array(link, pa.string())], names=["source_system", "seg_hour", "n_events", "root", "first_link"])

    for key, (leaf, link) in _runs(batches, ["leaf", "link"]):
        if key != segment:
            if tree:
                out.append((*segment, tree.n, tree.root(), first))
                if len(out) >= 10_000:
                    yield batch()
                    out = []
            segment, tree, first = key, Merkle(), link
        tree.add(leaf)
    if tree:
        out.append((*segment, tree.n, tree.root(), first))
        yield batch()


ROOTS = "source_system string, seg_hour timestamp_ntz, n_events long, root string, first_link string"


def segment_roots(rows: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """``ROOTS`` of rows (``source_system``, ``seg_hour``, ``ts``, ``event_id``, ``leaf``, ``link``). Columns in ``also`` are read
    as well, so that an exchange below is the same as another consumer's and runs once."""
    ship_by_value()
    order = rows.sortWithinPartitions(*SEGMENT, "ts", "event_id", "leaf")
    return order.select(*SEGMENT, "leaf", "link", *also).mapInArrow(_segment_roots, ROOTS)


def _fold(rows: pa.Table) -> pa.Table:
    """Heads before each segment of one source."""
    rows = rows.sort_by("seg_hour")
    hours = rows.column("hour_text").to_pylist()
    head, heads = rows.column("start")[0].as_py(), []
    for source, hour, n, root in zip(rows.column("source_system").to_pylist(), hours, rows.column("n_events").to_pylist(), rows.column("root").to_pylist()):
        heads.append(head)
        head = hashlib.sha256(f"{head}|{source}|{hour}|{n}|{root}".encode()).hexdigest()
    return pa.table({"source_system": rows.column("source_system"), "seg_hour": rows.column("seg_hour"), "anchor": pa.array(heads, pa.string())})


def running_heads(roots: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(``source_system``, ``seg_hour``, ``anchor``): the head before each segment. A fold over one row per
    segment of a source; ``heads`` (``source_system``, ``head``) continue earlier increments."""
    start = genesis(F.col("source_system"))
    r = roots
    if heads is not None:
        r = r.join(heads.select(F.col("source_system"), F.col("head")), "source_system", "left")
        start = F.coalesce("head", start)
    ship_by_value()
    return (r.select(*SEGMENT, "n_events", "root", start.alias("start"), F.date_format("seg_hour", "yyyy-MM-dd'T'HH:mm:ss").alias("hour_text"))
             .groupBy(F.col("source_system").alias("_source")).applyInArrow(_fold, "source_system string, seg_hour timestamp_ntz, anchor string"))


# ---------------------------------------------------------------------------
# Building (G7)
# ---------------------------------------------------------------------------

def _link_batches(batches):
    """The sequential part: rows clustered by segment and in order, each segment from its anchor."""
    token = f'"{PREV_PLACEHOLDER}"'
    segment, prev = None, None
    for b in batches:
        links, hashes, docs = [], [], []
        for key, (text, anchor) in _runs([b], ["template", "anchor"]):
            if key != segment:
                segment, prev = key, anchor
            doc = text.replace(token, f'"{prev}"', 1)
            links.append(prev)
            docs.append(doc)
            prev = hashlib.sha256(doc.encode("utf-8")).hexdigest()
            hashes.append(prev)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in (*SEGMENT, "ts", "event_id", "query_id")), pa.array(docs, pa.string()), pa.array(links, pa.string()),
             pa.array(hashes, pa.string())], names=[c.split()[0] for c in CHAIN_SCHEMA.split(", ")])


def chain_templates(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Links rows (``source_system``, ``seg_hour``, ``ts``, ``event_id``, ``query_id``, ``template``) of whole segments."""
    # One hash exchange by segment feeds the roots and the rows. Spark reuses it as both read all its columns and
    # the join's own conditions (a segment is never null) stand below it for both
    whole = F.col("source_system").isNotNull() & F.col("seg_hour").isNotNull()
    e = (rows.filter(whole).select(*SEGMENT, "ts", "event_id", "query_id", "template").repartition(*SEGMENT)
             .withColumn("leaf", F.sha2("template", 256)))
    anchors = running_heads(segment_roots(e.withColumn("link", F.lit(None).cast("string")), ["query_id"]), heads)
    work = (e.join(anchors, SEGMENT).select(*SEGMENT, "ts", "event_id", "query_id", "leaf", "template", "anchor")
             .sortWithinPartitions(*SEGMENT, "ts", "event_id", "leaf"))
    ship_by_value()
    return work.mapInArrow(_link_batches, CHAIN_SCHEMA)


def templates(events: DataFrame, segment_seconds: int = 3600) -> DataFrame:
    """What :func:`chain_templates` takes, from canonical events (output of ``normalize_events``)."""
    return with_segment(events, segment_seconds).select(*SEGMENT, "ts", "event_id", "query_id", template(F.col("event")).alias("template"))


def chain_events(events: DataFrame, heads: DataFrame | None = None, segment_seconds: int = 3600) -> DataFrame:
    """Hash-chain canonical events.

    ``heads`` (``source_system``, ``head``) continue the chains of earlier increments, which must hold only
    earlier segments; without it every source starts anew. All events of a segment are linked in
    one task; sources with very many events in an hour take a smaller ``segment_seconds``."""
    return chain_templates(templates(events, segment_seconds), heads)


# ---------------------------------------------------------------------------
# Seals and heads, kept apart
# ---------------------------------------------------------------------------

def _leaves(chained: DataFrame) -> DataFrame:
    """Hashes only: documents are not shuffled."""
    return (chained.withColumn("source_system", F.coalesce("source_system", F.lit(UNKNOWN)))
                   .select(*SEGMENT, "ts", "event_id", F.unhex(content_hash(F.col("doc"))).alias("leaf"), F.col("previous_hash").alias("link")))


def _by_segment(rows: DataFrame) -> DataFrame:
    """Rows with a binary ``leaf``, which takes half the room in the exchange, dealt by segment."""
    return rows.repartition(*SEGMENT).withColumn("leaf", F.lower(F.hex("leaf")))


def _sealed(roots: DataFrame) -> DataFrame:
    head = head_after(F.col("first_link"), F.col("source_system"), F.col("seg_hour"), F.col("n_events"), F.col("root"))
    return roots.withColumn("head", F.when(F.col("first_link").isNotNull(), head))


def seal_segments(chained: DataFrame) -> DataFrame:
    """(``source_system``, ``seg_hour``, ``n_events``, ``root``, ``first_link``, ``head``) of every stored segment: the record to keep apart."""
    return _sealed(segment_roots(_by_segment(_leaves(chained))))


def chain_heads(chained: DataFrame) -> DataFrame:
    """(``source_system``, ``head``): the head after the last segment of each source, to continue or to keep apart.
    A stored trail is read twice, but only the last segments are shuffled and sealed."""
    c = chained.withColumn("source_system", F.coalesce("source_system", F.lit(UNKNOWN)))
    last = c.groupBy(F.col("source_system").alias("_source")).agg(F.max("seg_hour").alias("_last"))  # one row per source
    ends = c.join(F.broadcast(last), (F.col("source_system") == F.col("_source")) & F.col("seg_hour").eqNullSafe(F.col("_last")), "left_semi")
    return last_heads(seal_segments(ends))


def last_heads(seals: DataFrame) -> DataFrame:
    return seals.groupBy("source_system").agg(F.max_by("head", "seg_hour").alias("head"))


# ---------------------------------------------------------------------------
# Verification
# ---------------------------------------------------------------------------

def verify_chain(chained: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Every stored event (without its document) with ``hash_ok`` and ``link_ok``.

    A segment's first link must be the head that follows from the previous stored segment (its own
    first link, number of events and root), a source's first one ``heads`` or the genesis; so a change
    shows where it was made and at the next segment, not at all later ones. Only hashes are shuffled."""
    inside = F.regexp_extract("doc", r'"previous_hash":"([^"]*)"', 1)
    c = (chained.withColumn("source_system", F.coalesce("source_system", F.lit(UNKNOWN)))
         .select(*SEGMENT, "ts", "event_id", "query_id", "previous_hash", "this_hash", F.unhex(content_hash(F.col("doc"))).alias("leaf"),
                 F.sha2("doc", 256).eqNullSafe(F.col("this_hash")).alias("hash_ok"),
                 inside.eqNullSafe(F.col("previous_hash")).alias("__inside"))
         .repartition(*SEGMENT))
    seals = seal_segments(chained)  # the same exchange as in verify_seals: Spark runs it once for both
    by_source = Window.partitionBy("source_system").orderBy("seg_hour")  # one row per segment
    a = seals.select(*SEGMENT, F.lag("head").over(by_source).alias("__head"), (F.row_number().over(by_source) == 1).alias("__first"))
    start = genesis(F.col("source_system"))
    if heads is not None:
        a = a.join(heads.select("source_system", F.col("head").alias("__start")), "source_system", "left")
        start = F.coalesce("__start", start)
    a = a.select(*SEGMENT, F.when(F.col("__first"), start).otherwise(F.col("__head")).alias("__anchor"))
    w = Window.partitionBy(*SEGMENT).orderBy("ts", "event_id", "leaf")
    v = c.join(a, SEGMENT).withColumn("__nth", F.row_number().over(w)).withColumn("__before", F.lag("this_hash").over(w))
    expected = F.when(F.col("__nth") == 1, F.col("__anchor")).otherwise(F.col("__before"))
    link = F.col("previous_hash").isNotNull() & F.col("previous_hash").eqNullSafe(expected) & F.col("__inside")
    return v.withColumn("link_ok", link).drop("__nth", "__before", "__anchor", "__inside", "leaf")


def broken_links(verified: DataFrame) -> DataFrame:
    return verified.filter(~F.col("hash_ok") | ~F.col("link_ok"))


def verify_heads(chained: DataFrame, apart: DataFrame) -> DataFrame:
    """(``source_system``, ``problem``) for every source whose last head is not the one kept apart: a cut or
    rewritten end, a lost source, or an unknown one. Sources in order have no row."""
    now = chain_heads(chained).select(F.col("source_system").alias("_s"), F.col("head").alias("_h"))
    kept = apart.select("source_system", "head")
    both = kept.join(now, F.col("source_system") == F.col("_s"), "full")
    problem = (F.when(F.col("_s").isNull(), "missing source").when(F.col("source_system").isNull(), "unexpected source")
               .when(~F.col("head").eqNullSafe(F.col("_h")), "end differs"))
    return both.select(F.coalesce("source_system", "_s").alias("source_system"), problem.alias("problem")).filter("problem IS NOT NULL")


def verify_seals(chained: DataFrame, seals: DataFrame) -> DataFrame:
    """(``source_system``, ``seg_hour``, ``problem``) for every segment that differs from its seal: missing or
    unexpected segments, events added or removed, contents altered (re-hashed or not), links moved."""
    now = seal_segments(chained).select(*[F.col(c).alias(f"_{c}") for c in (*SEGMENT, "n_events", "root", "head")])
    both = seals.join(now, (F.col("source_system") == F.col("_source_system")) & (F.col("seg_hour") == F.col("_seg_hour")), "full")
    problem = (F.when(F.col("_source_system").isNull(), "missing segment").when(F.col("source_system").isNull(), "unexpected segment")
               .when(F.col("n_events") != F.col("_n_events"), "events added or removed")
               .when(F.col("root") != F.col("_root"), "contents differ")
               .when(~F.col("head").eqNullSafe(F.col("_head")), "links differ"))
    return both.select(F.coalesce("source_system", "_source_system").alias("source_system"), F.coalesce("seg_hour", "_seg_hour").alias("seg_hour"),
                       problem.alias("problem")).filter("problem IS NOT NULL")


# ---------------------------------------------------------------------------
# Proofs that an event is part of a sealed segment
# ---------------------------------------------------------------------------

PROOF = ("event_id string, source_system string, seg_hour timestamp_ntz, position long, n_events long, leaf string, "
         "path array<struct<is_left:boolean,hash:string>>, root string")


def _proofs(batches):
    segment, tree, watched, out = None, None, [], []

    def ended():
        root = tree.root()
        return [(e, *segment, p, tree.n, leaf, path, root) for e, p, leaf, path in watched]

    def batch(rows):
        cols = list(zip(*rows))
        path = pa.array([[{"is_left": side, "hash": h} for side, h in p] for p in cols[6]], pa.list_(pa.struct([("is_left", pa.bool_()), ("hash", pa.string())])))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()).cast(pa.timestamp("us")), pa.array(cols[3], pa.int64()),
             pa.array(cols[4], pa.int64()), pa.array(cols[5]), path, pa.array(cols[7])], names=[x.split()[0] for x in (
                 "event_id", "source_system", "seg_hour", "position", "n_events", "leaf", "path", "root")])

    for key, (leaf, event, wanted) in _runs(batches, ["leaf", "event_id", "wanted"]):
        if key != segment:
            if watched:
                out += ended()
            segment, tree, watched = key, Merkle(), []
        path = [] if wanted else None
        if wanted:
            watched.append((event, tree.n, leaf, path))
        tree.add(leaf, path)
        if len(out) >= 1000:
            yield batch(out)
            out = []
    if watched:
        out += ended()
    if out:
        yield batch(out)


def inclusion_proofs(chained: DataFrame, wanted: DataFrame) -> DataFrame:
    """``PROOF`` of each stored event whose id is among ``wanted.event_id``: its place, its content hash and the
    hashes on its way to the segment's root, as many as the logarithm of the segment's events. The ids are written first:
    Spark knows their size then, and shuffles the trail by id only if they are too many to be sent to all tasks."""
    ids = materialize(wanted.select(F.col("event_id").alias("_id")).distinct(), "wanted")
    marked = _leaves(chained).join(ids, F.col("event_id") == F.col("_id"), "left").withColumn("wanted", F.col("_id").isNotNull())
    ship_by_value()
    return (_by_segment(marked.drop("link", "_id")).sortWithinPartitions(*SEGMENT, "ts", "event_id", "leaf")
                  .select(*SEGMENT, "leaf", "event_id", "wanted").mapInArrow(_proofs, PROOF))


def proof_holds(leaf: Column, path: Column, root: Column) -> Column:
    """Whether a path of hashes leads from a content hash to a root."""
    step = F.aggregate(path, leaf, lambda h, s: F.sha2(F.when(s["is_left"], F.concat_ws("|", F.lit("1"), s["hash"], h))
                                                       .otherwise(F.concat_ws("|", F.lit("1"), h, s["hash"])), 256))
    return step.eqNullSafe(root)
