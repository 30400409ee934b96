"""Operator 12: the prefix trie of conversations, by merging sorted neighbours.

Conversations are put in the order of their turns (range partitions, so copies and
common beginnings are spread by their ids). Two neighbours share as many turns as
their longest common prefix says, and the trie follows from these numbers alone: all
edges between neighbours are taken in descending depth, a union-find joins the
conversations on either side, and every merge creates the branching node at that
depth (or adds to the one that a side already is). Between branching nodes lie chains
of nodes with the same members.

A task does this for runs of bounded size. What lies between the first and the last
conversation of a run is finished; only the nodes along these two (the spines) may go
on in the neighbouring runs. So a forest contracts to its spines, spines that face each
other over a boundary meet by equal prefixes, and what is no longer on the outer border
is closed: first within a task, then for ``FAN`` partitions at a time up a tree.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.text import table
from lakeweave.session import materialize

RUN = 8192  # conversations, and
RUN_TURNS = 1 << 18  # turns, after which a run ends
FAN = 32  # forests that are merged in one task
WORDS = r"[^\x20\x09-\x0D]+"

NODE, CLOSED, OPEN, ENDS = range(4)
FOREST = ("kind int, part long, left boolean, right boolean, key binary, parent_key binary, conv_id long, depth long, "
          "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, "
          "ends_sha256 string, chunk_no long, chunk binary")
COLUMNS = [c.split()[0] for c in FOREST.split(", ")]
TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
ARROW = pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in FOREST.split(", ")])
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], ARROW.field(c).type) for c in COLUMNS], schema=ARROW)


def prefix_keys(turns: list[bytes]) -> list[bytes]:
    """A key of each prefix of a sequence of turn keys, from the empty one on."""
    h, out = hashlib.blake2b(digest_size=16), []
    out.append(h.digest())
    for t in turns:
        h.update(t)
        out.append(h.copy().digest())
    return out


def common(a: list, b: list) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class Trie:
    """The compressed trie of sorted sequences: nodes with ``depth``, members ``first``
    to ``last`` (places in the order) and ``kids``. The last node is the root."""

    def __init__(self, turns: list[list[bytes]]):
        n = len(turns)
        self.depth, self.first, self.last = [len(t) for t in turns], list(range(n)), list(range(n))
        self.kids: list[list[int]] = [[] for _ in range(n)]
        shared = [common(turns[i], turns[i + 1]) for i in range(n - 1)]
        up, top = list(range(n)), list(range(n))  # union-find, and the topmost node of each component
        gone = set()

        def find(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for i in sorted(range(n - 1), key=lambda i: -shared[i]):
            d, x, y = shared[i], find(i), find(i + 1)
            a, b = top[x], top[y]
            up[y] = x
            if self.depth[a] == d and self.depth[b] == d:
                self.kids[a] += self.kids[b]
                gone.add(b)
                node = a
            elif self.depth[a] == d:
                self.kids[a].append(b)
                node = a
            elif self.depth[b] == d:
                self.kids[b].insert(0, a)
                node = b
            else:
                node = self._new(d, [a, b])
            self.first[node], self.last[node] = self.first[a], self.last[b]
            top[x] = node
        whole = top[find(0)]
        if self.depth[whole]:
            whole = self._new(0, [whole])
            self.first[whole], self.last[whole] = 0, n - 1
        self.root, self.gone = whole, gone

    def _new(self, depth: int, kids: list[int]) -> int:
        self.depth.append(depth)
        self.kids.append(kids)
        self.first.append(0)
        self.last.append(0)
        return len(self.depth) - 1

    def upwards(self) -> list[int]:
        """All nodes, children before parents."""
        return sorted((v for v in range(len(self.depth)) if v not in self.gone), key=lambda v: -self.depth[v])


class Spines:
    """Nodes that may have members elsewhere: by key, what is known of them so far."""

    def __init__(self):
        self.held: dict[bytes, dict] = {}

    def add(self, e: dict) -> None:
        x = self.held.get(e["key"])
        if x is None:
            self.held[e["key"]] = dict(e)
            return
        x["conv_id"] = min(x["conv_id"], e["conv_id"])
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            x[c] += e[c]

    def close(self, border: set[bytes]) -> list[dict]:
        """Takes out all nodes off the border, deepest first, and adds them to their parents."""
        out = []
        for e in sorted((e for k, e in self.held.items() if k not in border), key=lambda e: -e["depth"]):
            del self.held[e["key"]]
            e["n_leaves"] = e["n_leaves"] if e["n_children"] else 1
            e["saved_tokens"] += (e["n_convs"] - 1) * e["words"]
            if e["depth"]:
                p = self.held.get(e["parent_key"])
                p["n_children"] += 1
                p["n_leaves"] += e["n_leaves"]
                p["saved_tokens"] += e["saved_tokens"]
            out.append(e | {"kind": CLOSED})
        return out


def _run_forest(ids: list[int], turns: list[list[bytes]], words: list[list[int]], part: int, run: int):
    """(finished nodes and chunks of ends, entries of the spines) of a run in order."""
    t, n = Trie(turns), len(ids)
    keys = {0: prefix_keys(turns[0]), n - 1: prefix_keys(turns[-1])}
    out, spine = [], []
    least, leaves, saved, parent, waiting = {}, {}, {}, {}, []
    order = t.upwards()
    for v in order:
        for c in t.kids[v]:
            parent[c] = v
    edge = {v: 0 if t.first[v] == 0 else n - 1 for v in order if t.first[v] == 0 or t.last[v] == n - 1}
    for v in order:
        a, d, members = t.first[v], t.depth[v], t.last[v] - t.first[v] + 1
        kids, low = t.kids[v], t.depth[parent[v]] if v in parent else -1
        own = a  # members that end here stand first
        while own <= t.last[v] and len(turns[own]) == d:
            own += 1
        least[v] = min([*ids[a:own], *(least[c] for c in kids)])
        if v in edge:
            done = [c for c in kids if c not in edge]
            chain = keys[edge[v]]
            for x in range(d, low, -1):
                at = x == d
                spine.append({"key": chain[x], "parent_key": chain[x - 1] if x else None, "depth": x, "part": part,
                              "words": words[a][x - 1] if x else 0, "conv_id": least[v], "n_convs": members,
                              "n_children": len(done) if at else 0, "n_leaves": sum(leaves[c] for c in done) if at else 0,
                              "saved_tokens": sum(saved[c] for c in done) if at else 0})
            if own > a:
                out.append({"kind": ENDS, "part": part, "key": chain[d], "chunk_no": run, "chunk": ",".join(map(str, ids[a:own])).encode()})
            continue
        leaves[v] = sum(leaves[c] for c in kids) or 1
        total, u = sum(saved[c] for c in kids), parent[v]
        for x in range(d, low, -1):
            total += (members - 1) * words[a][x - 1]
            row = {"kind": NODE, "part": part, "conv_id": least[v], "depth": x, "n_convs": members,
                   "n_children": len(kids) if x == d else 1, "n_leaves": leaves[v], "saved_tokens": total, "ends_sha256": NO_ENDS}
            if x == d and own > a:
                row["ends_sha256"] = hashlib.sha256(",".join(map(str, ids[a:own])).encode()).hexdigest()
            if x > low + 1:
                row["parent_conv_id"] = least[v]
            elif u in edge:
                row["parent_key"] = keys[edge[u]][low]
            else:
                waiting.append((row, u))
            out.append(row)
        saved[v] = total
    for row, u in waiting:
        row["parent_conv_id"] = least[u]
    return out, spine, keys


def _forests(batches):
    """Forests of a sorted partition: finished nodes, and its spines as open nodes."""
    part, spines, left, right, run = TaskContext.get().partitionId(), Spines(), None, None, 0

    def finish(ids, turns, words):
        nonlocal left, right, run
        out, spine, keys = _run_forest(ids, turns, words, part, run)
        run += 1
        left = left or set(keys[0])
        right = set(keys[len(ids) - 1])
        for e in spine:
            spines.add(e)
        return out + spines.close(left | right)

    ids, turns, words, size = [], [], [], 0
    for batch in batches:
        for i, t, w in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(i)
            turns.append(t)
            words.append(w)
            size += len(t)
            if len(ids) >= RUN or size >= RUN_TURNS:
                rows = finish(ids, turns, words)
                for a in range(0, len(rows), 10_000):
                    yield _rows(rows[a:a + 10_000])
                ids, turns, words, size = [], [], [], 0
    rows = finish(ids, turns, words) if ids else []
    rows += [e | {"kind": OPEN, "left": k in left, "right": k in right} for k, e in spines.held.items()]
    for a in range(0, len(rows), 10_000):
        yield _rows(rows[a:a + 10_000])


def _merge(last: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        first, final, spines = min(r["part"] for r in rows), max(r["part"] for r in rows), Spines()
        left = {r["key"] for r in rows if r["part"] == first and r["left"]}
        right = {r["key"] for r in rows if r["part"] == final and r["right"]}
        group = first // FAN
        for r in rows:
            spines.add(r | {"part": group})
        out = spines.close(set() if last else left | right)
        out += [e | {"kind": OPEN, "left": k in left, "right": k in right} for k, e in spines.held.items()]
        return pa.Table.from_batches([_rows(out)])

    return run


def _digests(batches):
    """SHA-256 of the chunks of each key, which come in order, joined by commas."""
    key, h = None, None
    for batch in batches:
        keys, out = [], []
        for k, c in zip(*(x.to_pylist() for x in batch.columns)):
            if k != key:
                if h:
                    keys.append(key)
                    out.append(h.hexdigest())
                key, h = k, hashlib.sha256(c)
            else:
                h.update(b",")
                h.update(c)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["end_key", "sha"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["end_key", "sha"])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of ``sequences`` (``conv_id`` long, unique; ``turns`` array of binary
    keys, ``words`` array of counts): ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    A sequence without turns is a member of the root alone; null ids take no part; an
    empty table has no node, not even the root. One conversation's turn keys must fit
    a row (24 bytes a turn); texts are not carried."""
    known = materialize(sequences.filter("conv_id IS NOT NULL"), "sequences")
    ordered = (known.select("conv_id", "turns", "words").repartitionByRange("turns", "conv_id")
               .sortWithinPartitions("turns", "conv_id"))
    forest = materialize(ordered.mapInArrow(_forests, FOREST), "forest")
    state, closed = forest.filter(F.col("kind") == OPEN), [forest.filter(F.col("kind") == CLOSED)]
    parts = (state.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN)
        level = materialize(state.groupBy(F.expr(f"part div {FAN}").alias("_group")).applyInArrow(_merge(parts == 1), FOREST), "forest")
        closed.append(level.filter(F.col("kind") == CLOSED))
        if parts == 1:
            break
        state = level.filter(F.col("kind") == OPEN)
    border = closed[0]
    for x in closed[1:]:
        border = border.unionByName(x)
    # the nodes of the spines: their digests come from chunks, their parents are among them
    chunks = (forest.filter(F.col("kind") == ENDS).select("key", "chunk", "part", "chunk_no").repartition("key")
              .sortWithinPartitions("key", "part", "chunk_no").select("key", "chunk").mapInArrow(_digests, "end_key binary, sha string"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    names = border.select(F.col("key").alias("p_key"), F.col("conv_id").alias("p_conv"))
    spine_nodes = (border.drop("parent_conv_id", "ends_sha256").join(names, F.col("parent_key") == F.col("p_key"), "left")
                   .join(chunks, F.col("key") == F.col("end_key"), "left")
                   .withColumn("parent_conv_id", F.col("p_conv")).withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))))
    # finished nodes below a spine find its members' least id among the spines of their own partition
    there = (forest.filter(F.col("kind").isin(OPEN, CLOSED)).select(F.col("part").alias("p_part"), "key").distinct()
             .join(names, F.col("key") == F.col("p_key")).select("p_part", "p_key", "p_conv"))
    nodes = forest.filter(F.col("kind") == NODE)
    below = (nodes.filter("parent_key IS NOT NULL")
             .join(there, (F.col("part") == F.col("p_part")) & (F.col("parent_key") == F.col("p_key")), "left")
             .withColumn("parent_conv_id", F.col("p_conv")))
    return (nodes.filter("parent_key IS NULL").select(*columns).unionByName(below.select(*columns))
            .unionByName(spine_nodes.select(*columns)))


def rebuilt(conversations: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """``conv_id``, ``turns``, ``words`` of every conversation c, rebuilt: the first h turns of conversation
    c - c % ``block``, then its own after its first h; h is crc32(c) modulo ``most``.

    Turns are ordered by turn (null first), equal ones by a hash of role and text. A null
    role or text is empty; repeated rows are turns of their own; rows with a null
    conv_id take no part; other columns are not read."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(conversations["turn"].alias("turn"),
                 F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
                 F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")).alias("t")).filter("conv_id IS NOT NULL")
    own = materialize(rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")), "conversations")
    heads = own.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), F.slice("t", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = own.withColumn("_h", h).join(heads, F.col("conv_id") - F.col("conv_id") % block == F.col("_base"), "left")
    head = F.when(F.col("_head").isNull(), F.slice("t", 1, 0)).otherwise(F.expr("slice(_head, 1, _h)"))
    whole = F.concat(head, F.expr("slice(t, _h + 1, size(t))"))
    return joined.select("conv_id", whole["key"].alias("turns"), whole["words"].alias("words"))


#: CRC-32 of the nibbles 0 to 15 (reflected polynomial 0xEDB88320), for the SQL below.
def _nibble(x: int) -> int:
    for _ in range(4):
        x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
    return x


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, md5(length(role) || ':' || role || text) AS k,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
nibbles AS (
  SELECT conv_id, flatten([[ord(s[i]) & 15, ord(s[i]) >> 4]
                           for i in range(1, length(s) + 1)]) AS nib
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, nib::BIGINT[]),
                         lambda a, b: xor({[_nibble(x) for x in range(16)]}[(xor(a, b) & 15) + 1]::BIGINT, a >> 4)), 4294967295) % 4 AS h
  FROM nibbles),
r AS (
  SELECT c.conv_id, s.p AS d, s.k, s.text FROM convs c JOIN t s ON s.conv_id = c.base AND s.p <= c.h
  UNION ALL
  SELECT c.conv_id, s.p - c.h + (SELECT count(*) FROM t b WHERE b.conv_id = c.base AND b.p <= c.h), s.k, s.text
  FROM convs c JOIN t s ON s.conv_id = c.conv_id AND s.p > c.h),
m AS (
  SELECT conv_id, 0 AS d, '' AS key, 0 AS words FROM convs
  UNION ALL
  SELECT conv_id, d, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)),
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM r),
ends AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha
  FROM (SELECT conv_id, key FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY key),
nodes AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM m GROUP BY key, d),
parents AS (SELECT n.key, p.key AS parent_key FROM nodes n JOIN m p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT parent_key AS key, count(*) AS n FROM parents GROUP BY 1),
sums AS (
  SELECT a.key, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((v.n - 1) * v.words) AS saved
  FROM nodes v LEFT JOIN kids k ON k.key = v.key JOIN m a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY a.key)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN kids k ON k.key = n.key LEFT JOIN ends e ON e.key = n.key
LEFT JOIN parents p ON p.key = n.key LEFT JOIN nodes up ON up.key = p.parent_key
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
