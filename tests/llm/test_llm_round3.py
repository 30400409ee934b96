"""Hard-negative mining, the conversation trie and best-fit packing against SQL and
brute force, with nulls, ties, repeated rows, long texts, hot groups and empty tables."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from lakeweave.llm import best_fit, conversation_trie, hard_negatives
from lakeweave.llm.conversation_trie import OP12_SQL, op12_conversation_trie, prefix_trie, rebuilt
from lakeweave.llm.line_rules import quality_rules
from lakeweave.llm.text import WordHasher
from lakeweave.llm.hard_negatives import OP11_SQL, SuffixIndex, integer_rows, mined, op11_threshold_negatives

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


# hard negatives ---------------------------------------------------------------

def brute_mined(rows, anchor, positives=5, negatives=3):
    """rows: id -> (label, integer vector)."""
    out = []
    for a in sorted(i for i in rows if anchor(i)):
        score = {i: sum(int(x) * int(y) for x, y in zip(rows[a][1], rows[i][1])) for i in rows if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:positives]:
            fits = [i for i in order if rows[i][0] != rows[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:negatives])]
    return sorted(out)


def test_index_finds_all_pairs_over_any_threshold():
    rng = np.random.default_rng(1)
    rows = (rng.standard_normal((700, 40)) * rng.choice([1, 30, 400], (700, 1))).astype(np.int64)
    x = (rng.standard_normal((60, 40)) * 50).astype(np.int64)
    s = x @ rows.T
    for share in (0.0, 0.01, 0.3, 0.9, 1.5):
        t = share * np.sqrt((x ** 2).sum(1)) * 400
        i, j, got = SuffixIndex(rows, float((t / np.sqrt((x ** 2).sum(1))).min())).search(x, t)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*np.nonzero(s >= t[:, None] - 1e-6)))
        assert (np.rint(got) == s[i, j]).all()


def test_op11_matches_sql(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small_dir}/embeddings.parquet'")
    got = op11_threshold_negatives(spark, small_dir)
    assert sorted(map(tuple, got.select(*MINED).collect())) == sorted(con.sql(OP11_SQL).fetchall())


def test_op11_odd_rows_ties_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((400, 12))
    v[50:120] = v[50]  # one vector many times, under many labels
    v[200] *= 1e4  # one long vector
    v[300:310] = 0
    rows = [(i, (x / 4).tolist(), int(i % 3), "x", 0) for i, x in enumerate(v)]
    odd = [(1000, None, 1, "x", 0), (1050, [float("nan")] * 12, 1, "x", 0), (1100, [None] * 12, 1, "x", 0), (1150, v[0].tolist(), None, "x", 0),
           (None, v[0].tolist(), 1, "x", 0), (1200, [1e30] * 12, 1, "x", 0), (1250, [float("inf")] * 12, 1, "x", 0)]
    df = spark.createDataFrame(rows + odd + rows[:20], "vec_id long, embedding array<double>, label int, w string, q int")
    want = brute_mined({r[0]: (r[2], [int(np.floor(256 * x)) for x in r[1]]) for r in rows}, lambda i: i % 50 == 0)
    slim = integer_rows(df, "vec_id", F.col("label"), "embedding")
    assert sorted(map(tuple, mined(slim, F.col("vec_id") % 50 == 0).collect())) == want and want
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)  # several blocks
    monkeypatch.setattr(hard_negatives, "SAMPLE", 20)  # poor first thresholds
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    assert sorted(map(tuple, mined(slim, F.col("vec_id") % 50 == 0).collect())) == want
    assert mined(slim.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert mined(slim.filter("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


def test_op11_scores_beyond_double_precision(spark):
    big = {0: (1, [2 ** 29 + 1, 3]), 1: (1, [2 ** 29 + 3, 5]), 2: (0, [2 ** 28 + 2 ** 20, 7]), 3: (0, [2 ** 28 + 2 ** 20, 8]), 50: (0, [5])}
    df = spark.createDataFrame([(i, lab, q) for i, (lab, q) in big.items()], "vec_id long, label long, q array<int>")
    want = brute_mined(big, lambda i: i == 0)
    assert sorted(map(tuple, mined(df, F.col("vec_id") == 0).collect())) == want and len(want) == 2


# line rules -----------------------------------------------------------------------

DOCS = "doc_id long, text string, source string"


def test_blocks_of_boilerplate_go_and_copies_stay(spark):
    words = lambda tag, n: " ".join(f"{tag}{j}" for j in range(n))
    menu = [words(f"menu{k}w", 3) for k in range(10)]
    own = lambda i, lines=9: [words(f"d{i}l{k}w", 12) for k in range(lines)]
    rows = [(i, "\n".join(menu + own(i) + [x.upper() for x in menu]), "header and footer") for i in range(200)]
    rows += [(1000 + i, "\n".join(["We use cookies here", "Read all about it"] + own(1000 + i)), "notice on top") for i in range(60)]
    rows += [(2000 + i, "\n".join(own(2000 + i)[:4] + menu[:3] + own(2000 + i)[4:]), "inside") for i in range(60)]
    rows += [(3000 + i, "\n".join(menu + own(3000 + i, 2)), "header and footer") for i in range(5)]  # hardly more than the menu
    near = own(4000)
    rows += [(4000 + i, "\n".join(near[:i % 9] + [words(f"z{i}w", 12)] + near[i % 9 + 1:]), "copies") for i in range(60)]
    rows += [(5000 + i, "\n".join(near), "copies") for i in range(60)]
    rows += [(6000 + i, "\n".join(own(6000 + i)), "copies") for i in range(60)]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[i].n_removed_lines == 20 and out[i].kept for i in range(200))
    assert all(out[1000 + i].n_removed_lines == 2 and out[1000 + i].kept for i in range(60))
    assert all(out[2000 + i].n_removed_lines == 3 and out[2000 + i].kept for i in range(60))
    assert all(out[3000 + i].n_removed_lines == 10 for i in range(5))
    assert all(out[k + i].n_removed_lines == 0 and out[k + i].kept for k in (4000, 5000, 6000) for i in range(60))


# conversation trie --------------------------------------------------------------

def brute_trie(sequences):
    """sequences: id -> list of (key, words)."""
    members = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(k for k, _ in s[:d])].append(c)
    words = {tuple(k for k, _ in s[:d]): s[d - 1][1] if d else 0 for s in sequences.values() for d in range(len(s) + 1)}
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    total = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(total[k][0] for k in kids[p]) or 1
        saved = sum(total[k][1] for k in kids[p]) + (len(members[p]) - 1) * words[p]
        total[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(sequences[c]) == len(p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("run, fan", [(8192, 32), (3, 2), (1, 3)])
def test_op12_random_tries(spark, monkeypatch, run, fan):
    monkeypatch.setattr(conversation_trie, "RUN", run)
    monkeypatch.setattr(conversation_trie, "FAN", fan)
    rng = np.random.default_rng(run)
    seqs = {int(i) - 40: [(b"%d" % k, int(k) + 1) for k in rng.integers(0, 2, rng.integers(0, 7))] for i in range(220)}
    seqs |= {1000 + i: seqs[-3] for i in range(150)}  # a group of copies over many runs
    seqs |= {2000: [(b"0", 1)] * 60, 2001: [(b"0", 1)] * 61}  # long ones
    df = spark.createDataFrame([(c, [k for k, _ in s], [w for _, w in s]) for c, s in seqs.items()] + [(None, [b"0"], [1])],
                               "conv_id long, turns array<binary>, words array<long>").repartition(6)
    got = prefix_trie(df).select(*NODE)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_trie(seqs)
    assert prefix_trie(df.limit(0)).count() == 0


def test_op12_matches_sql(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small_dir}/conversations.parquet'")
    got = op12_conversation_trie(spark, small_dir).select(*NODE).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(OP12_SQL).fetchall()))


def test_op12_rebuilt_edges(spark):
    rows = [(20, 2, "a", "two words"), (20, None, "u", None), (20, 1, None, "x\ty\x0bz"), (21, 1, "u", "own 1"), (21, 2, "u", "own 2"),
            (21, 3, "u", "own 3"), (21, 4, "u", "own 4"), (23, 1, "u", "é" * 50_000 + " end"), (41, 1, "u", "a"), (41, 1, "u", "a"),
            (-1, 1, "u", "neg"), (None, 1, "u", "no id")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in rebuilt(df).collect()}
    assert set(got) == {20, 21, 23, 41, -1}
    text = {20: ["", "x\ty\x0bz", "two words"], 21: [f"own {i}" for i in range(1, 5)], 23: ["é" * 50_000 + " end"], 41: ["a", "a"], -1: ["neg"]}
    for c, r in got.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = text.get(base, [])[:h] + text[c][h:]
        assert r.words == [len(t.replace("\t", " ").replace("\x0b", " ").split()) for t in whole]
    assert got[20].turns[:1] == got[21].turns[:1] or zlib.crc32(b"21") % 4 == 0
    assert prefix_trie(rebuilt(df)).filter("depth = 0").first().n_convs == 5


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(3)
    data = "".join(rng.choice(list("abcé \n\t"), 50_000)).encode() + b"x" * 9000 + b" end"
    whole_words, whole_starts = WordHasher()(data)
    monkeypatch.setattr(WordHasher, "SLICE", 1000)
    words, starts = WordHasher()(data)
    assert (words == whole_words).all() and (starts == whole_starts).all()


# best-fit packing ---------------------------------------------------------------

def whole(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    return len(by)


def test_best_fit_leaves_no_two_bins_that_fit_together():
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 101, 3000), np.full(50, 51), rng.integers(1, 8, 500), np.array([], np.int64)):
        bins, offset, fills = best_fit.best_fit(sizes, 100)
        got = np.zeros(len(fills), np.int64)
        np.add.at(got, bins, sizes)
        assert (got == fills).all() and fills.max(initial=0) <= 100
        a = np.sort(fills)
        assert len(a) < 2 or a[0] + a[1] > 100
        for b in range(len(fills)):
            mine = np.argsort(offset[bins == b])
            assert (offset[bins == b][mine] == np.cumsum(sizes[bins == b][mine]) - sizes[bins == b][mine]).all()


def test_word_ranks_give_the_ids_of_the_library():
    t = best_fit.ChunkTokenizer(open(public.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert t.ranks
    rng = np.random.default_rng(9)
    letters = [chr(c) for c in range(256) if not chr(c).isspace() and not 0x1c <= c <= 0x1f]
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(5000)] + letters
    words += ["".join(rng.choice(list("etaoinshrdlu'.ÄÖéß19"), rng.integers(1, 30))) for _ in range(5000)] + ["don't", "I'LL", "x" * 500]
    assert all(t.encode_chunk(w) == t.encode_whole(w) for w in words)
    other = open(public.path("byte_bpe_50k.json"), encoding="utf-8").read()
    assert best_fit.WordRanks.of(other) is None


def test_op13_ids_cover_texts_and_tree_keeps_fill(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), (10**6 + 3, "a\x1cb É́ İstanbul ΣΑΣ <|endoftext|> 日本語's"), (None, "no id"),
           (10**6 + 3, "repeated"), (10**6 + 4, "long " * 400_000), (10**6 + 5, "x" * 30_000)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    df = df.withColumn("piece", F.lit("x")).withColumn("sequence_id", F.lit(1)).withColumn("ids", F.lit(2)).withColumn("_item", F.lit(3))
    path = public.path("word_bpe_49k.json")
    got = best_fit.pack_documents(df, path, with_ids=True).collect()
    exact = best_fit.ChunkTokenizer(open(path, encoding="utf-8").read()).exact
    want = collections.Counter()
    for r in df.collect():
        ids = np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            cut = ids[a:a + 2048].tobytes()
            want[r.doc_id, p, a, len(cut) // 4, zlib.crc32(cut), cut] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    total = sum(r.length for r in got)
    assert whole(got, 2048) <= 1.01 * -(-total // 2048) + 1
    monkeypatch.setattr(best_fit, "ITEMS", 20)  # many partitions and two levels
    monkeypatch.setattr(best_fit, "FAN", 3)
    rows = best_fit.pack_documents(df, path).collect()
    assert len(rows) == len(got) and whole(rows, 2048) <= 1.1 * -(-total // 2048) + 1
    assert best_fit.pack_documents(df.limit(0), path).count() == 0


def test_op13_passing_on_few_bins_changes_no_count(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sizes = np.concatenate([np.full(300, 60), rng.integers(1, 45, 40)])
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "_item long, length long")
    monkeypatch.setattr(best_fit, "ITEMS", 20)
    monkeypatch.setattr(best_fit, "FAN", 3)
    few = whole(best_fit.pack_items(items, 100, len(sizes)).collect(), 100)
    merge = best_fit._merge
    monkeypatch.setattr(best_fit, "_merge", lambda others, capacity: merge(10**9 if others else 0, capacity))
    assert whole(best_fit.pack_items(items, 100, len(sizes)).collect(), 100) == few


def test_op13_sequences_hold_their_ids(spark, small_dir):
    packed = best_fit.pack_documents(spark.read.parquet(f"{small_dir}/documents.parquet"), public.path("word_bpe_49k.json"), with_ids=True)
    rows = collections.defaultdict(list)
    for r in packed.collect():
        rows[r.sequence_id].append((r.offset, bytes(r.ids)))
    for r in best_fit.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(x for _, x in sorted(rows[r.sequence_id])) and len(r.ids) == 4 * r.length and r.n_pieces == len(rows[r.sequence_id])
