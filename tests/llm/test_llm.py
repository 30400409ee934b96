"""The training-data operators against brute force, exact round trips and held-out
labels, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import base64
import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers as public
from pyspark.sql import functions as F

from lakeweave.llm import ef_lm, ngram_join, nn_descent, token_counts, toxicity
from lakeweave.llm.bpe import ByteBPE, RankBitmap, encode_decode
from lakeweave.llm.bradley_terry import quality_scores
from lakeweave.llm.line_rules import OP2_SQL, LineRules, quality_rules, repeated_words
from lakeweave.llm.packing import Mixture, pack
from lakeweave.llm.sharding import balanced_shards
from lakeweave.llm.text import WordHasher

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string"


def frame(spark, rows):
    """Documents with two extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, "x") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, nulls in every column, ties, repeated rows, one long text."""
    long = " ".join(f"w{k % 977}" for k in range(30000))
    return frame(spark, [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one two", "b"), (4, "one two", "b"),
                         (5, "One TWO", "b"), (None, "no id here", "c"), (6, long, "b"), (7, "日本語 x" * 40 + "'s don't", "a")])


@pytest.fixture(scope="module")
def sf(small_dir):
    return small_dir


def test_word_hashes_follow_words():
    h = WordHasher()
    words = [b"a", b"b", b"ab", b"ba", b"x" * 5000, b"x" * 5001, "é".encode(), b"a"]
    got, starts = h(b" \t".join(words) + b"\n")
    assert len(set(got.tolist())) == 7 and got[0] == got[-1] and len(starts) == 8
    assert len(h(b" \n")[0]) == 0 and len(h(b"")[0]) == 0


def test_op1_ranks_held_out_quality(spark, sf, odd):
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_scores(d, l).join(l, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    out = quality_scores(odd, l.filter("doc_id < 0")).collect()
    assert len(out) == 9 and all(r.predicted == 1 and 0 <= r.score <= 1 for r in out)
    assert quality_scores(odd.limit(0), l).count() == 0


def test_op2_matches_sql_and_removes_boilerplate(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(OP2_SQL)
    got = quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert repeated_words(b"a b c a b c d".split()) == 6 and repeated_words(b"a b c".split()) == 0

    own = lambda i: "\n".join(" ".join(f"t{i}x{k}y{j}" for j in range(12)) for k in range(5))
    note = "Share this page with your friends now"
    rows = [(i, own(i).replace("\n", f"\n{note.upper() if i % 2 else note}\n", 1), "h") for i in range(30)]
    rows += [(100 + i, "\n".join([f"only{i} " + "q " * 20, *[note] * 0, " ".join([note] * 1)]), "h") for i in range(3)]
    copies = [(200 + i, own(999), "h") for i in range(40)]  # one document, often
    near = [(300 + i, own(998).replace(f"t998x{i % 5}y3", f"z{i}"), "h") for i in range(40)]  # copies with a word changed
    out = {r.doc_id: r for r in quality_rules(frame(spark, rows + copies + near), LineRules(min_docs=20)).collect()}
    assert all(out[i].n_removed_lines == 1 and out[i].kept for i in range(30))
    assert all(out[i].n_removed_lines == 0 and out[i].kept for i in [*range(200, 240), *range(300, 340)])


def test_op2_edges(spark, odd):
    out = quality_rules(odd, keep=("doc_id",)).collect()
    assert len(out) == 9 and sum(r.n_words == 0 for r in out) == 3 and all(r.base_failed for r in out if r.doc_id != 6)
    assert quality_rules(odd.limit(0)).count() == 0


def test_op3_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 16)).astype(np.float32)
    v[100:140] = v[100]  # one vector many times
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (None, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in sorted(nn_descent.nearest_rows(df, F.col("vec_id") % 20 == 0).collect()):
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 900, 20):
        s = v.astype(float) @ v[q].astype(float)
        want = [j for j in np.lexsort((np.arange(900), -s)) if j != q][:20]
        assert len(got[q]) == 20 and all(abs(x - s[j]) < 1e-9 for j, x in got[q])
        hits += len({j for j, _ in got[q]} & set(want))
    assert hits / 900 >= 0.9
    assert [j for j, _ in got[100]] == [j for j in range(101, 121)]  # ties to the smaller id
    few = df.filter("vec_id < 5")
    assert nn_descent.nearest_rows(few, F.col("vec_id") % 20 == 0).count() == 4
    assert nn_descent.nearest_rows(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_op3_one_long_vector_and_a_near_equal_cluster(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3000, 16))
    v[200:400] = v[200] + 1e-5 * rng.standard_normal((200, 16))  # near-equal, not equal
    v[7] *= 1e6
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in nn_descent.nearest_rows(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    right = {}
    for q in range(0, 3000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        right[q] = len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20
    assert np.mean(list(right.values())) >= 0.9
    assert np.mean([right[q] for q in range(200, 400, 20)]) >= 0.9


def test_op3_graph_converges_and_beam_grows(spark, monkeypatch):
    v = np.random.default_rng(6).standard_normal((1500, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    nodes = nn_descent.graph_nodes(rows)
    edges = nn_descent.neighbour_graph(nodes)
    assert edges.filter("fresh").count() * 1000 < 1500 * nn_descent.NEIGHBOURS
    around = nn_descent.neighbourhoods(edges, nn_descent.NEIGHBOURS).groupBy(F.col("w").alias("u")).agg(F.collect_set("x").alias("around"))
    some = nodes.orderBy("node").limit(20).select(F.col("node").alias("q"), F.col("node").alias("start"), "unit", "v")
    monkeypatch.setattr(nn_descent, "BEAM", 8)  # too few for 20 neighbours
    assert nn_descent.enough_beam(some, nodes, nn_descent.materialize(around, "around_test"), [], 20) > 20


def test_op4_search_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(300):
        t = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / max(np.linalg.norm(w), 1e-12)))
    index = toxicity.BlockMaxIndex(vectors, 40)
    full = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        full[i, t] = w
    for t, w in vectors[:60]:
        q = np.zeros(40)
        q[t] = w
        s = full @ q
        want = [i for i in np.lexsort((np.arange(300), -np.round(s, 12))) if s[i] > 0][:15]
        got = index.search(t, w, 15)
        assert np.allclose([x for x, _ in got], s[want]) and len(got) == len(want)


def test_op4_catches_toxic(spark, sf, odd):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, l)
    got = toxicity.toxicity_scores(d, model, ["doc_id"]).join(l, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93
    out = toxicity.toxicity_scores(odd.select("doc_id", "text"), model, ["doc_id"]).collect()
    assert len(out) == 9 and all(r.predicted == 0 for r in out)
    none = toxicity.fit(odd, l.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(odd.select("doc_id", "text"), none, ["doc_id"]).collect())


def test_op5_prefix_sums(spark, odd):
    df = odd.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"))
    rows = balanced_shards(df, 3, "doc_id", F.col("size")).collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    total, at, slots = sum(r["size"] for r in rows), 0, collections.defaultdict(list)
    for r in order:
        assert r.shard == min(2, (2 * at + r["size"]) * 3 // (2 * total))
        at += r["size"]
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 9 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    even = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(9).cast("long").alias("size"))
    n = [r["count"] for r in balanced_shards(even, 24, "doc_id", F.col("size")).groupBy("shard").count().collect()]
    assert len(n) == 24 and max(n) - min(n) <= 1
    assert balanced_shards(df.limit(0), 3, "doc_id", F.col("size")).count() == 0


def test_op6_equals_tiktoken(spark, odd, sf):
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = ByteBPE(open(path, "rb").read(), public.PATTERN)
    odd_texts = ["", "a" * 30000, "ab" * 9000, " " * 999, "\x1c \x1d", "don't WE'LL", "日本語" * 900, "\x85\xa0 x", "²½ é\u0301"]
    texts = odd_texts + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t, ids in zip(texts, bpe.encode_texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and bpe.decode(ids) == t.encode()
        pieces = [p.encode() for p in bpe.split(t[:400])]
        for p in pieces:
            if p not in ranks:
                assert bpe.encode_one(p) == bpe.encode_pieces([p])[0]
    out = encode_decode(odd, path, public.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == 9 and [r.decoded_sha256 for r in out if r.doc_id in (1, 2)] == [empty, empty]


def test_rank_bitmap():
    b, held = RankBitmap(50000), set()
    rng = np.random.default_rng(0)
    for x in rng.integers(0, 50000, 3000).tolist():
        b.add(x)
        held.add(x)
        if x % 3:
            b.discard(b.first())
            held.discard(min(held))
        assert b.first() == min(held, default=-1)


def test_op7_mixture_is_exact():
    totals = [1, 700, 33, 5000, 33]
    for weights in (None, [1, 5, 2, 5, 1]):
        m = Mixture(totals, weights, 64)
        w = np.asarray(totals if weights is None else weights, float)
        order = sorted(((y + 0.5) / w[s], s) for s, n in enumerate(totals) for y in range(n))
        a = m.taken(np.arange(m.n_windows + 1))
        for k in range(m.n_windows + 1):
            given = collections.Counter(s for _, s in order[:64 * k])
            assert a[k].tolist() == [given[s] for s in range(5)]


def test_op7_pieces_make_up_documents(spark, odd, sf):
    docs = odd.select("doc_id", "text", "source").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").withColumn("doc_id", F.col("doc_id") + 100))
    args = (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rows = pack(docs, *args, with_ids=True).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for k, s in by_seq.items():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at == 1024 or k == max(by_seq)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(args[0])
    tok.encode_special_tokens = True
    for d in docs.filter("doc_id <> 4").collect():
        want = tok.encode(d.text or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[d.doc_id], key=lambda r: r.start)
        assert [x for r in parts for x in np.frombuffer(r.ids, "<u4").tolist()] == want and parts[0].doc_tokens == len(want)
    assert sum(r.length for r in by_doc[4]) == 2 * by_doc[4][0].doc_tokens
    assert pack(docs.limit(0), *args).count() == 0


def test_op8_equals_plain_dynamic_programming(spark, odd):
    scores = token_counts.zipf_scores(public.path("piece_bpe_32k.model"))
    trie = token_counts.ForwardTrie(scores, max_terminals=50)

    def plain(word):
        best = [(0.0, 0)]
        for i in range(len(word)):
            spelled = len(word[i].encode())
            options = [(best[i][0] + spelled * trie.floor, -(best[i][1] + spelled))]
            options += [(best[j][0] + scores[word[j:i + 1]], -(best[j][1] + 1)) for j in range(i + 1) if word[j:i + 1] in scores]
            s, n = max(options)
            best.append((s, -n))
        return best[-1]

    texts = [r.text or "" for r in odd.collect()] + ["the theme thereof \U0001F600 ab", "naïve naïveté"]
    for t in texts:
        want = [plain("▁" + w) for w in t.split()]
        n, tokens, _, score = trie.count([t])[0]
        assert (n, tokens) == (len(want), sum(x for _, x in want)) and math.isclose(score, sum(s for s, _ in want), rel_tol=1e-9, abs_tol=1e-9)
    assert token_counts.unigram_token_counts(odd, scores).count() == 9


def brute_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    low = {k: i for k, (i, _) in enumerate(sets)}
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and sets[b][1]
             and 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1])]
    while True:
        now = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if now == low:
            return sorted((i, len(s), low[k]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_op9_equals_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(ngram_join, "FEW", 3)  # so that small groups meet over hubs
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, k = [], 0
    for family in range(4):
        base = rng.choice(vocabulary, int(rng.integers(8, 90))).tolist()
        for _ in range(40):
            text = list(base)
            for _ in range(int(rng.integers(0, 5))):
                text[int(rng.integers(len(text)))] = str(rng.choice(vocabulary))
            rows.append((k, " ".join(text[:len(text) - int(rng.integers(0, 4))])))
            k += 1
    rows += [(k, ""), (k + 1, None), (k + 2, "A b"), (k + 3, "a B"), (k + 4, rows[0][1]), (k + 4, rows[0][1])]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent)
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, width, percent)


def test_op9_edges(spark, odd):
    out = ngram_join.similar_components(odd).collect()
    assert len(out) == 9 and {r.component_id for r in out if r.id in (4, 5)} == {4}
    assert ngram_join.similar_components(odd.limit(0)).count() == 0
    left = ngram_join.one_of_each(odd)
    assert left.columns == odd.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7]


def test_op10_equals_plain_model(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.filter("doc_id is not null").select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    rows = docs.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: (t or "").encode().lower().split() + [0]
    one, two = collections.Counter(), collections.Counter()
    for r in rows:
        if not held(r.doc_id):
            w = tokens(r.text)
            one.update(w)
            two.update(zip([0, *w], w))
    n, v = sum(one.values()), len(one)
    assert v < ef_lm.HEAD
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    want = {}
    for r in rows:
        w = tokens(r.text)
        score = sum(math.log10((two[a, b] + ef_lm.MU * p(b)) / (one[a] + ef_lm.MU)) if one[a] else math.log10(p(b)) for a, b in zip([0, *w], w))
        want[r.doc_id] = (held(r.doc_id), len(w), sum(one[x] > 0 for x in w), sum(math.log10(p(x)) for x in w), score)
    got = ef_lm.lm_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        h, m, known, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, m, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and abs(r.score - score) <= 1.3e-4 * m
    assert ef_lm.lm_scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize("head, words, vocabulary", [(1, 300, 900), (20, 300, 900), (None, 6000, 90000)])
def test_op10_counts_every_context(spark, monkeypatch, head, words, vocabulary):
    if head:
        monkeypatch.setattr(ef_lm, "HEAD", head)
        monkeypatch.setattr(ef_lm, "SHARD_TOKENS", 700)  # so that several shards share a text
    rng = np.random.default_rng(10)
    rows = [(1, None), (2, ""), (2, "")]  # null, empty and repeated
    for k in range(3, 53):
        if k % 5:
            first = rng.integers(0, vocabulary, words // 2)
            text = np.stack([first, (first * 7 + rng.integers(0, 2, len(first))) % vocabulary], axis=1).ravel()  # rare words in pairs that return
        else:
            text = np.minimum(rng.zipf(1.3, words), vocabulary)
        rows.append((k, " ".join(f"W{x}" for x in text)))
    rows.append(rows[-1])
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    one, two = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = [*(t or "").lower().split(), 0]
            one.update(w)
            two.update(zip([0, *w], w))
    n, v = sum(one.values()), len(one)
    assert v > ef_lm.HEAD
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    want = []
    for i, t in rows:
        w = [*(t or "").lower().split(), 0]
        score = sum(math.log10((two[a, b] + ef_lm.MU * p(b)) / (one[a] + ef_lm.MU)) for a, b in zip([0, *w], w))
        want.append((i, held(i), len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), score))
    got = ef_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    assert len(got) == len(want)
    for g, x in zip(sorted(map(tuple, got)), sorted(want)):
        assert g[:5] == x[:5] and math.isclose(g[5], x[5], rel_tol=1e-9) and abs(g[6] - x[6]) <= 1.3e-4 * x[2]


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (10, 11), (1000, 2**60), (5000, 6000), (3000, 2**20)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        e = ef_lm.EliasFano(v)
        q = np.concatenate([v, v + np.uint64(1), rng.integers(0, top, 500).astype(np.uint64)])
        at = np.searchsorted(v, q)
        want = np.where((at < len(v)) & (v[np.minimum(at, len(v) - 1)] == q), at, -1)
        assert (e.find(q) == want).all() and (e.get(np.arange(len(v))) == v).all()


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
        assert stage(spark, odd.limit(0), sf).count() == 0
