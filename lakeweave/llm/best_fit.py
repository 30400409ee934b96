"""Operator 13: best-fit packing by hierarchical merging of underfull sequences.

Documents become ids, cut only where they are longer than a sequence. Pieces as long
as a sequence are sequences of their own. The others are dealt evenly over partitions
and packed there: longest first, each into the fullest sequence that still takes it.
Sequences that are nearly full are done. The others are items themselves, of the size
of what they hold: the underfull sequences of ``FAN`` neighbouring partitions meet,
are packed by best fit again, and so on up a tree until one group is left.

Two sequences of one group never fit together, or best fit would have put them into
one. So a group holds at most one sequence that is at most half full, and of a given
fill no more than the number of the other groups can ever take a part from elsewhere;
a group passes on that many of each fill, and the rest are done. This changes no
result, and bounds what a task of the tree reads.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm.text import table
from lakeweave.session import materialize

ITEMS = 1 << 17  # pieces packed in a partition
FAN = 16  # groups that meet in a task of the tree
NEARLY = 64  # a sequence is done when less than a 64th of it is free


#: The pattern and suffix of the word-level vocabulary that ``WordRanks`` knows.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


class WordRanks:
    """Ids of a Latin-1 stretch without white space by a BPE vocabulary whose words end in
    ``WORD_END``, as ranks of byte strings: a word's end is byte 0xFF, which no UTF-8 text holds, and
    the pairs with it come first, as the vocabulary's ids do. An eighth of the time of the
    ``tokenizers`` library, tested equal."""

    def __init__(self, vocabulary: dict[str, int]):
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}
        ranks = {}
        for token, i in vocabulary.items():
            if not (token.startswith("<|") and token.endswith("|>")):
                ends = token.endswith(WORD_END) and token != WORD_END
                ranks[bytes(byte[c] for c in (token[:-len(WORD_END)] if ends else token)) + b"\xff" * ends] = i
        self.encode_piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        pattern = WORD_PATTERN.replace(r"[\p{L}]", f"[{kinds['L']}]").replace(r"[\p{N}]", f"[{kinds['N']}]")
        self.pieces = re.compile(pattern.replace(r"\p{L}\p{N}", kinds["L"] + kinds["N"])).findall

    @classmethod
    def of(cls, tokenizer_json: str) -> WordRanks | None:
        """For a tokenizer file of just this kind."""
        file = json.loads(tokenizer_json)
        model, split = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
        fits = (split[0].get("pattern") == {"Regex": WORD_PATTERN} and [x["type"] for x in split] == ["Split", "ByteLevel"]
                and steps == ["NFC", "Replace", "Lowercase"] and model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END)
        ordered = fits and all(model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) == 512 + k for k, m in enumerate(model["merges"]))
        return cls(model["vocab"]) if ordered else None

    def encode(self, stretch: str) -> list[int]:
        out = []
        for piece in self.pieces(stretch.lower()):
            out += self.encode_piece(piece.encode() + b"\xff")
        return out


class ChunkTokenizer:
    """Ids of texts by a tokenizer file whose pre-tokens never hold white space.

    Such a tokenizer works on every stretch between white space alone, so a stretch
    is encoded once and its ids are kept, up to ``kept`` stretches at a time."""

    #: Characters that Python takes for white space and the tokenizer's pattern does not.
    ODD = re.compile("[\x1c-\x1f]")
    WIDE = re.compile("[^\x00-\xff]")
    SEGMENT = 1 << 20

    def __init__(self, tokenizer_json: str, kept: int = 400_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.exact = tokenizers.Tokenizer.from_str(tokenizer_json)
        self.exact.encode_special_tokens = True
        self.ranks = WordRanks.of(tokenizer_json)
        encode = self.encode_chunk

        class Known(dict):
            def __missing__(self, chunk):
                ids = encode(chunk)
                if len(chunk) <= longest:
                    if len(self) >= kept:
                        self.clear()
                    self[chunk] = ids
                return ids

        self.known = Known()

    def encode_whole(self, text: str) -> bytes:
        return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        if self.ranks and not self.WIDE.search(chunk):
            return array("I", self.ranks.encode(chunk)).tobytes()
        return self.encode_whole(chunk)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.ODD.search(text):
            return self.encode_whole(text)
        if len(text) <= self.SEGMENT:
            return b"".join(map(self.known.__getitem__, text.split()))
        out, at = [], 0
        while at < len(text):
            gap = re.compile(r"\s").search(text, min(len(text), at + self.SEGMENT))
            end = gap.start() if gap else len(text)
            out.append(b"".join(map(self.known.__getitem__, text[at:end].split())))
            at = end
        return b"".join(out)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin): longest items first,
    each into the bin with the least room that takes it, or a new one."""
    n = len(sizes)
    bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    some, fills = 0, []  # bit r: there is a bin with r free places
    order = np.argsort(-sizes, kind="stable")
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = some >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        bin_of[i], offset[i] = b, capacity - r
        fills[b] += s
        if r > s:
            room[r - s].append(b)
            some |= 1 << (r - s)
    return bin_of, offset, np.array(fills, np.int64)


def pieces_of(docs: DataFrame, keep: tuple[str, ...], text: str, tokenizer_path: str, capacity: int, end_id: int,
              with_ids: bool) -> DataFrame:
    """``_row`` (the kept columns as a struct), ``piece``, ``start``, ``length``, ``ids_crc32``, ``_item``
    (a number of the piece) and, if asked for, ``ids``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")
    slim = docs.select(row, F.coalesce(docs[text], F.lit("")).alias("_text"))
    schema = T.StructType([slim.schema["_row"], *(T.StructField(c, T.LongType()) for c in (
        "piece", "start", "length", "ids_crc32", "_item"))])
    if with_ids:
        schema = schema.add("ids", "binary")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokenizer = ChunkTokenizer(file.value)
        item = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                took, cols, raws = [], [[], [], [], [], []], []
                for k, value in enumerate(part.column(1)):
                    ids = memoryview(tokenizer.encode(value.as_py()) + end)
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at:at + 4 * capacity]
                        took.append(k)
                        for c, x in zip(cols, (p, at // 4, len(cut) // 4, zlib.crc32(cut), item)):
                            c.append(x)
                        item += 1
                        if with_ids:
                            raws.append(bytes(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(took, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
                    + [pa.array(raws, pa.binary())] * with_ids, names=schema.names)

    return slim.mapInArrow(run, schema)


def _merge(others: int, capacity: int):
    """Best fit over the underfull bins of a few groups; ``others``: groups beside the merged one."""

    def run(rows: pa.Table) -> pa.Table:
        node, at, fill = (rows.column(c).to_numpy() for c in ("node", "at", "fill"))
        nodes, first, place = np.unique(node, return_index=True, return_inverse=True)
        bin_of, offset, fills = best_fit(fill[first], capacity)
        least = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(least, bin_of, nodes)  # a merged bin has the least number of its parts
        done = (capacity - fills) * NEARLY < capacity
        order = np.lexsort((least, fills))
        rank = np.arange(len(order)) - np.searchsorted(fills[order], fills[order])
        spare = np.empty(len(fills), bool)
        spare[order] = rank >= others  # no group is left that could bring a part for it
        done |= spare
        b = bin_of[place]
        return pa.table({"bin": rows.column("bin"), "node": least[b], "at": at + offset[place], "fill": fills[b],
                         "part": pa.array(rows.column("part").to_numpy() // FAN), "done": done[b]})

    return run


def pack_items(items: DataFrame, capacity: int, n_items: int) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``, by best fit of their ``length`` (1 to
    ``capacity``); ``_item`` must be a number of the row."""
    spark = items.sparkSession
    groups = max(1, -(-n_items // ITEMS))
    schema = T.StructType([*items.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_bin", "_at", "_fill", "_part"))])
    k = items.columns.index("length")

    def local(batches):
        part = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        bin_of, offset, fills = best_fit(rows.column(k).to_numpy(), capacity)
        out = pa.Table.from_arrays([*rows.columns, pa.array((part << 33) + bin_of), pa.array(offset), pa.array(fills[bin_of]),
                                    pa.array(np.full(len(bin_of), part, np.int64))], names=schema.names)
        yield from out.to_batches(max_chunksize=10_000)

    placed = materialize(items.repartition(groups, F.xxhash64("_item")).mapInArrow(local, schema), "placed")
    parts = (placed.agg(F.max("_part")).first()[0] or 0) + 1
    under = placed.filter(((capacity - F.col("_fill")) * NEARLY >= capacity) & (F.lit(parts) > 1))
    state = under.filter("_at = 0").select(F.col("_bin").alias("bin"), F.col("_bin").alias("node"), F.lit(0).cast("long").alias("at"),
                                           F.col("_fill").alias("fill"), F.col("_part").alias("part"))
    ended = []
    while parts > 1:
        parts = -(-parts // FAN)
        level = materialize(state.groupBy(F.expr(f"part div {FAN}").alias("_group")).applyInArrow(
            _merge(parts - 1, capacity), "bin long, node long, at long, fill long, part long, done boolean"), "level")
        ended.append(level.filter("done").select("bin", "node", "at"))
        state = level.filter("not done").drop("done")
    keep = [F.col(c) for c in items.columns]
    if not ended:
        return placed.select(*keep, F.col("_bin").alias("sequence_id"), F.col("_at").alias("offset"))
    moved = ended[0]
    for x in ended[1:]:
        moved = moved.unionByName(x)
    return placed.join(moved, F.col("_bin") == F.col("bin"), "left").select(
        *keep, F.coalesce("node", "_bin").alias("sequence_id"), (F.col("_at") + F.coalesce("at", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, text: str = "text",
                   keep: tuple[str, ...] = ("doc_id",), end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: the ``keep`` columns, ``piece``, ``start`` (ids of the document before it),
    ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, if asked for, ``ids`` (binary).

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, into
    pieces of ``capacity``. A null or empty text is one id. Null ids and repeated rows are
    packed as rows of their own; ties in length go by the order of dealing, which is
    free; an empty table gives no pieces. Only the ``keep`` columns of ``docs`` are
    read beside the text, so other columns may have any name; a kept column of a
    result's name stands before it. The tokenizer must split at white space."""
    pieces = materialize(pieces_of(docs, keep, text, tokenizer_path, capacity, end_id, with_ids), "pieces")
    slim = pieces.drop("ids")
    full = F.col("length") == capacity
    packed = pack_items(slim.filter(~full), capacity, slim.filter(~full).count()).unionByName(
        slim.filter(full).select("*", (-1 - F.col("_item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    if with_ids:
        packed = packed.join(pieces.select("_item", "ids"), "_item")
    return packed.select("_row.*", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_pieces``, ``length`` and ``ids`` (binary) of every sequence, from pieces with ids.
    A group holds at most a sequence's capacity of ids."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.size("p").alias("n_pieces"), "length", whole.alias("ids"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return pack_documents(table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"))
