"""Text functions by hand-written rows; operators against DuckDB and naive versions."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe import catalog, plans, sources, streaming
from lathe import functions as fn
from lathe.operators import cluster, evaluate, labels, terms, vectors

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark conversations".split()
SLOW = {"cooc_window", "ppmi"}


def one(spark, text, function):
    return spark.createDataFrame([(text,)], "text string").select(function(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Hello, WORLD http://a.b/c @me #Tag", "hello world tag"), ("www.x.y", ""), (None, ""), ("naïve ÉCOLE!", "naïve école"), ("a  b", "a b")],
)
def test_clean_joined(spark, text, want):
    assert one(spark, text, fn.clean_joined) == want


@pytest.mark.parametrize(("text", "want"), [("RT  @you camelCase soooo #Hash", "camel Case soo Hash"), ("x" * 5000, "xx"), ("", "")])
def test_clean_title(spark, text, want):
    assert one(spark, text, fn.clean_title) == want


LINKS = "use httpx and wwwroot then HTTPS now http://a.b/c www.x.y HTTP://A.B WWW.Z https://d e"


@pytest.mark.parametrize(
    ("function", "want"),
    [
        (fn.clean_title, "use httpx and wwroot then HTTPS now HTTP://A.B WW.Z e"),
        (fn.clean_post, "use httpx and wwroot then HTTPS now HTTP A B WW Z e"),
        (fn.clean_hash, "use httpx and wwwroot then https now http a b www z e"),
        (fn.clean_joined, "use and then now e"),
    ],
)
def test_links(spark, function, want):
    """Only the first cleaner takes any word that begins like a link for one, and lowers before it looks."""
    assert one(spark, LINKS, function) == want


def test_profile_finds_links_of_any_case(spark):
    rows = sources.from_list(spark, ["WWW.A.B is here", "Http too", "none"])
    assert round(plans.profile(rows).first().links, 6) == 0.666667


def test_clean_post(spark):
    assert one(spark, "Fish &amp; chips... #yum!", fn.clean_post) == "Fish chips yum"


@pytest.mark.parametrize(("text", "want"), [("hello", 0), ("привет", 1), ("日本語", 2), ("مرحبا", 3), ("שלום", 4), ("สวัสดี", 5), ("नमस्ते", 6), ("abcdefghijklmnopй", 0), ("", 0)])
def test_script_id(spark, text, want):
    assert one(spark, text, fn.script_id) == want


def test_tokens(spark):
    assert one(spark, "The cat's a-b x 12 cats", fn.analyzer_tokens) == ["cat", "12", "cats"]
    assert one(spark, "one two three", lambda c: fn.with_bigrams(F.split(c, " "))) == ["one", "two", "three", "one two", "two three"]
    assert one(spark, "ab", fn.char_ngrams) == [" ab", "ab ", " ab "]


def test_empty_and_tiny_batches(spark):
    with pytest.raises(ValueError):
        sources.reject_empty(sources.from_list(spark, []).filter("false"))
    two = sources.from_list(spark, ["one text", "another text"])
    assert [r.label for r in plans.preset_c(two).orderBy("row_id").collect()] == [0, 1]
    assert [r.label for r in plans.preset_a(sources.from_list(spark, ["", "x"])).collect()] == [0, 0]


def test_average_linkage_matches_naive():
    x = np.random.default_rng(0).standard_normal((30, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups, heights = [[i] for i in range(30)], []
    while len(groups) > 1:
        d, i, j = min((np.mean([1 - x[a] @ x[b] for a in p for b in q]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        heights.append(d)
        groups[i] += groups.pop(j)
    merges = cluster.average_linkage(x)
    assert np.allclose(merges[:, 2], heights)
    assert len(set(cluster.cut(merges, 30, 7).tolist())) == 7


def test_hdbscan_finds_blobs():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.1, (40, 2)) for c in (0, 5, 10)] + [rng.uniform(-20, 20, (6, 2))])
    found = cluster.hdbscan(x, 15, 5)
    assert len({*found[:120]} - {-1}) == 3 and (found[:120] == -1).mean() < 0.2


def test_agreement_of_hand_tables(spark):
    same = spark.createDataFrame([(i, i % 3, 9 - i % 3) for i in range(30)], "row_id long, truth long, pred long")
    row = evaluate.combined(same).first()
    assert (round(row.ari, 9), round(row.nmi, 9)) == (1, 1)
    flat = same.withColumn("pred", F.lit(1).cast("long"))
    assert round(evaluate.combined(flat).first().ari, 9) == 0


def test_svd_keeps_inner_products(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 4)) @ rng.standard_normal((4, 12))
    rows = spark.createDataFrame([(i, str(j), float(a[i, j])) for i in range(20) for j in range(12)], "row_id long, term string, w double")
    v = np.array([r.v for r in vectors.truncated_svd(rows, 4).orderBy("row_id").collect()])
    assert np.allclose(v @ v.T, a @ a.T, atol=1e-6)


def test_reduce_modes(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, v array<double>").cache()

    def of(mode, dim):
        return np.array([r.v for r in plans.reduced(points, 60, mode, dim, 5).orderBy("row_id").collect()])

    v = of("svd", 4)
    assert v.shape == (60, 4) and np.allclose(v @ v.T, x @ x.T, atol=1e-6)
    s = of("spectral", 3)
    assert s.shape == (60, 3) and np.allclose(np.linalg.norm(s, axis=1), 1)
    assert np.allclose(of("none", 4), x)


def test_presets_reduce(spark, monkeypatch):
    """The third preset reduces by its settings; the second appends a spectral block and merges in 1 and 4 rounds."""
    seen = []

    def spy(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a: (seen.append((name, *a[1:])), real(*a))[1])

    spy(plans, "reduced")
    spy(plans, "_spectral")
    spy(plans.labels, "merge_mutual")
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{chr(97 + i % 4)}{chr(97 + x)}" for x in rng.integers(0, 20, 40)) for i in range(64)]
    batch = sources.from_list(spark, texts).cache()
    assert plans.preset_c(batch, plans.Settings(reduce_mode="spectral", reduce_dim=6, spectral_knn=7), lsa=8).count() == 64
    assert [c[0] for c in seen[:2]] == ["reduced", "_spectral"] and seen[0][1:] == (64, "spectral", 6, 7)
    seen.clear()
    assert plans.preset_b(batch, lsa=8, ppmi=8).count() == 64
    assert [c[0] for c in seen] == ["_spectral", "merge_mutual", "merge_mutual"] and [c[-1] for c in seen[1:]] == [1, 4]


def test_cuts_of_one_tree_equal_runs_of_their_own(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.4, (30, 6)) for c in rng.normal(0, 2, (5, 6))])
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, v array<double>").cache()
    ks = (2, 3, 5, 8, 13, 21, 34, 55)
    for most in (6000, 100):
        got = {k: {} for k in ks}
        for r in cluster.linkage_cuts(points, ks, most).collect():
            got[r.k][r.row_id] = r.label
        for k in ks:
            assert got[k] == {r.row_id: r.label for r in cluster.linkage_labels(points, k, most).collect()}
    edges = vectors.symmetric(vectors.knn(points, 6)).cache()
    scores = {k: vectors.modularity(edges, cluster.linkage_labels(points, k)).first()[0] for k in ks}
    best = max(ks, key=lambda k: (round(scores[k], 12), -k))
    assert {r.row_id: r.label for r in cluster.best_cut(points, edges, ks).collect()} == {r.row_id: r.label for r in cluster.linkage_labels(points, best).collect()}


def test_many_terms_stay_distributed(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a = np.where(rng.random((40, 4)) < 0.8, rng.random((40, 4)), 0) @ rng.standard_normal((4, 25))
    rows = spark.createDataFrame([(i, f"t{j}", float(a[i, j])) for i in range(40) for j in range(25)], "row_id long, term string, w double").filter("w <> 0").cache()
    words = spark.createDataFrame([(f"t{j}", [float(j), 1.0]) for j in range(25)], "term string, v array<double>")

    def pooled():
        return {r.row_id: np.round(r.v, 9).tolist() for r in vectors.pooled(rows, words, F.col("w") * 2).collect()}

    want = pooled()
    monkeypatch.setattr(vectors, "DENSE_BYTES", 0)
    got = {r.row_id: r.v for r in vectors.truncated_svd(rows, 4).collect()}
    v = np.array([got.get(i, [0.0] * 4) for i in range(40)])
    assert np.allclose(v @ v.T, a @ a.T, atol=1e-6) and pooled() == want


def test_unit_length_of_wide_vectors(spark):
    x = np.random.default_rng(0).standard_normal((20, 3000))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(20, [0.0] * 3000)], "row_id long, v array<double>")
    got = {r.row_id: r.u for r in df.select("row_id", vectors.unit(F.col("v")).alias("u")).collect()}
    assert np.allclose([got[i] for i in range(20)], x / np.linalg.norm(x, axis=1, keepdims=True)) and not any(got[20])


def test_neighbours_with_ties(spark):
    x = np.random.default_rng(1).integers(0, 3, (60, 3)).astype(float)
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, v array<double>")
    d = np.round(np.sqrt(((x[:, None] - x) ** 2).sum(-1)), 12)
    want = {i: sorted((d[i, j], j) for j in range(60) if j != i)[:7] for i in range(60)}
    got = {i: [] for i in range(60)}
    for r in vectors.knn(points, 7, "euclidean").orderBy("src", "rank").collect():
        got[r.src].append((r.dist, r.dst))
    assert {i: [j for _, j in g] for i, g in got.items()} == {i: [j for _, j in g] for i, g in want.items()}


def _topics(n, rng, words=6, topics=12):
    return [" ".join(f"topic{i % topics}word{x}" for x in rng.integers(0, 30, words)) for i in range(n)]


def test_titles_have_a_path_of_their_own(spark):
    rng = np.random.default_rng(7)
    batch = sources.from_list(spark, [*_topics(240, rng), "", "http://only.a/link"]).cache()
    assert plans.profile(batch).first().is_titles
    for sample in (6000, 120):
        got = {r.row_id: r.label for r in plans.preset_b(batch, lsa=16, ppmi=16, sample=sample).collect()}
        assert len(got) == 242 and got[240] == got[241] == -1
        same = [got[i] == got[j] for i in range(240) for j in range(i) if i % 12 == j % 12]
        other = [got[i] == got[j] for i in range(240) for j in range(i) if i % 12 != j % 12]
        assert np.mean(same) > 0.05 > 10 * np.mean(other)


def test_titles_that_fall_through_are_refined(spark, monkeypatch):
    monkeypatch.setattr(plans, "title_path", lambda *a: None)
    calls = []
    for name in ("refine", "protected"):
        real = getattr(plans.labels, name)
        monkeypatch.setattr(plans.labels, name, lambda *a, name=name, real=real: (calls.append(name), real(*a))[1])
    batch = sources.from_list(spark, _topics(80, np.random.default_rng(8))).cache()
    assert plans.preset_b(batch, lsa=8, ppmi=8).count() == 80 and calls == ["refine", "protected"]


def test_diffuse_batches_merge_a_pair(spark, monkeypatch):
    monkeypatch.setattr(plans.vectors, "explained_variance", lambda p: 0.01)
    calls = []
    real = plans.labels.merge_most_similar
    monkeypatch.setattr(plans.labels, "merge_most_similar", lambda *a: (calls.append(1), real(*a))[1])
    batch = sources.from_list(spark, _topics(80, np.random.default_rng(9), words=30)).cache()
    assert plans.preset_b(batch, lsa=8, ppmi=8, titles=False).count() == 80 and calls == [1]


@pytest.mark.parametrize(("preset", "n"), [(plans.preset_c, 8_001), (plans.preset_b, 15_001)])
def test_large_batches(spark, preset, n):
    batch = spark.range(n).select(F.col("id").alias("row_id"), F.concat_ws(" ", *(F.concat(F.lit("t"), (F.col("id") % 9).cast("string"), F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(40)).cast("string")) for j in range(8))).alias("text"))
    got = preset(batch).groupBy("label").count().collect()
    sizes = [r["count"] for r in got]
    assert sum(sizes) == n and 0.15 * n < sizes.count(1) < 0.25 * n


def test_fallback_answers(spark):
    def broken(batch):
        raise RuntimeError("no")

    batch = sources.from_list(spark, [*_topics(120, np.random.default_rng(10)), ""])
    got = {r.row_id: r.label for r in plans.with_fallback(broken)(batch).collect()}
    assert len(got) == 121 and got[120] == -1 and len(set(got.values())) == 4
    assert {r.label for r in plans.with_fallback(broken)(sources.from_list(spark, ["", "x y"])).collect()} == {0}


def test_command_line(spark, tmp_path):
    from lathe.__main__ import main

    sources.from_list(spark, _topics(60, np.random.default_rng(11))).withColumnRenamed("row_id", "n").write.parquet(str(tmp_path / "in"))
    main([str(tmp_path / "in"), str(tmp_path / "out"), "--preset", "a", "--id", "n"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_settled_tables_are_released(spark):
    mark = sources.held()
    df = sources.settled(spark.range(5))
    assert df.count() == 5 and sources.held() == mark + 1
    sources.release(mark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_entry_without_the_optional_part(monkeypatch):
    """A missing library of the optional part leaves the other queries."""
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("lathe.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lathe.llm", None)
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalog.ORACLES)


def test_window_cooccurrence_counts_both_ways(spark):
    batch = spark.createDataFrame([(1, "a b a a"), (2, "c"), (3, "b c"), (4, None)], "row_id long, text string")
    words = F.split("text", " ")
    got = {(r.t1, r.t2): r.n for r in terms.window_cooccurrence(batch, words, 2).collect()}
    assert got == {("a", "b"): 3, ("b", "a"): 3, ("a", "a"): 4, ("b", "c"): 1, ("c", "b"): 1}
    among = spark.createDataFrame([("a",), ("b",)], "term string")
    got = {(r.t1, r.t2): r.n for r in terms.window_cooccurrence(batch, words, 2, among).collect()}
    assert got == {("a", "b"): 3, ("b", "a"): 3, ("a", "a"): 4}


def test_labels_of_empty_rows_are_noise(spark):
    batch = spark.range(4).withColumnRenamed("id", "row_id")
    got = labels.expand(batch, spark.createDataFrame([(1, 5), (2, 7)], "row_id long, label long"))
    assert [r.label for r in got.orderBy("row_id").collect()] == [-1, 5, 7, -1]


def test_stream_labels_each_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sources.from_list(spark, ["a b", "c d"]).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema("row_id long, text string").parquet(str(tmp_path / "in/*"))
    q = streaming.cluster_stream(stream, plans.preset_c, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def plain(rows):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


def test_sparse_products_hold_little(spark):
    """A batch's entries are added up some at a time: not 100,000 x 200 numbers at once."""
    import tracemalloc

    rng = np.random.default_rng(12)
    row, code, w = np.repeat(np.arange(100), 1000), rng.integers(0, 50, 100_000), rng.random(100_000)
    m = rng.standard_normal((50, 200))
    tracemalloc.start()
    got = vectors._sums(row, code, w, m, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros((100, 50))
    np.add.at(want, (row, code), w)
    assert np.allclose(got, want @ m) and peak < 40 << 20


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours_of_many_parts(spark, monkeypatch, metric):
    """Sides of several parts and blocks; copies are at distance 0, however long their vectors are; rows that aren't numbers have no neighbours."""
    x = np.random.default_rng(13).standard_normal((400, 6)) + 100
    x[200:260] = x[:60]
    x[399] = np.nan
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, v array<double>").repartition(5)
    monkeypatch.setattr(vectors, "BLOCK", 30)
    monkeypatch.setattr(vectors, "SIDE", 6 * 8 * 90)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T if metric == "cosine" else np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    want = {i: sorted((d[i, j].round(9), j) for j in range(399) if j != i)[:5] for i in range(399)}
    got = {}
    for r in vectors.knn(points, 5, metric).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((round(r.dist, 9), r.dst))
    assert set(got) == set(want) and all(np.allclose([a for a, _ in got[i]], [a for a, _ in want[i]], atol=1e-9) for i in want)
    assert all(got[i][0] == (0, i + 200) and got[i + 200][0] == (0, i) for i in range(60))


def test_spectral_sends_rows_not_sums(spark, monkeypatch):
    """Products of a graph come back by rows; what is sent doesn't grow with the number of tasks."""
    monkeypatch.setattr(vectors.Sparse, "square", lambda *a: pytest.fail("a sum over all rows from every task"))
    pairs = [(a + 8 * g, b + 8 * g) for g in range(3) for a in range(8) for b in range(8) if a != b] + [(0, 8), (8, 0), (8, 16), (16, 8)]
    edges = spark.createDataFrame([(*p, 1.0) for p in pairs], "src long, dst long, w double").repartition(6)
    v = np.array([r.v for r in vectors.spectral(edges, 3).orderBy("row_id").collect()])
    a = np.zeros((24, 24))
    a[tuple(np.array(pairs).T)] = 1
    deg = a.sum(1)
    value, vector = np.linalg.eigh(a / np.sqrt(deg[:, None] * deg))
    want = vector[:, -3:] * value[-3:]
    assert v.shape == (24, 3) and np.allclose(v @ v.T, want @ want.T, atol=1e-6)


@pytest.mark.parametrize("name", ["l2_normalise", "smooth_mean"])
def test_small_negative_numbers_keep_their_sign(spark, tmp_path, name):
    """SQL rounds what is just below 0 to -0, and so do the queries."""
    rng = np.random.default_rng(14)
    rows = [(i, [float(x) for x in rng.standard_normal(4).astype(np.float32)] + [-1e-9, 1e-9], 0) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(str, plain(df.collect()))) == sorted(map(str, plain(want)))
    assert any("-0.0," in str(r) or "-0.0)" in str(r) for r in plain(df.collect()))


def test_many_terms_of_fewer_rows_are_turned(spark, monkeypatch):
    """Where only the rows' side fits, the products go by it, in slabs; terms meet no dense vectors."""
    monkeypatch.setattr(vectors, "_wide_svd", lambda *a: pytest.fail("joins of dense vectors"))
    rng = np.random.default_rng(15)
    a = np.where(rng.random((12, 3)) < 0.9, rng.random((12, 3)), 0) @ rng.standard_normal((3, 60))
    rows = spark.createDataFrame([(i * 7, f"t{j}", float(a[i, j])) for i in range(12) for j in range(60)], "row_id long, term string, w double").filter("w <> 0")
    monkeypatch.setattr(vectors, "DENSE_BYTES", 60 * 3 * 8 // 2)
    got = {r.row_id: r.v for r in vectors.truncated_svd(rows, 3).collect()}
    v = np.array([got.get(i * 7, [0.0] * 3) for i in range(12)])
    assert np.allclose(v @ v.T, a @ a.T, atol=1e-6)


def test_svd_by_joins(spark, monkeypatch):
    """Where neither side fits."""
    for name in ("DENSE_BYTES", "SLABS_BYTES"):
        monkeypatch.setattr(vectors, name, 0)
    a = np.random.default_rng(16).standard_normal((12, 2)) @ np.random.default_rng(17).standard_normal((2, 9))
    rows = spark.createDataFrame([(i, f"t{j}", float(a[i, j])) for i in range(12) for j in range(9)], "row_id long, term string, w double")
    v = np.array([r.v for r in vectors.truncated_svd(rows, 2).orderBy("row_id").collect()])
    assert np.allclose(v @ v.T, a @ a.T, atol=1e-6)


def test_packed_pairs_equal_plain_ones(spark, monkeypatch):
    """Pairs of many tasks and buckets, of words that don't fit one byte each, and their PPMI; no join or aggregation meets rows of pairs."""
    from collections import Counter

    from lathe.operators import pairs

    monkeypatch.setattr(pairs, "WORDS", 50)
    monkeypatch.setattr(pairs, "PAIRS", 40)
    monkeypatch.setattr(pairs, "ROWS", 7)
    rng = np.random.default_rng(18)
    texts = [" ".join(["a", "b", "é", "日本", "zz", "q"][min(5, int(x))] for x in rng.exponential(1.5, n)) for n in rng.integers(0, 30, 60)]
    batch = spark.createDataFrame([*enumerate(texts), (99, None)], "row_id long, text string").repartition(3)
    want = Counter()
    for t in texts:
        w = t.split(" ")
        for i in range(len(w)):
            for x in w[i + 1 : i + 5]:
                want[w[i], x] += 1
                want[x, w[i]] += 1
    words = F.split("text", " ")
    df = terms.window_cooccurrence(batch, words, 4)
    rows = df.collect()
    assert {(r.t1, r.t2): r.n for r in rows} == want and len(rows) == len(want)
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
    plain_w = {(r.t1, r.t2): round(r.w, 9) for r in terms.ppmi(df).collect()}
    got = terms.window_ppmi(batch, words, 4).collect()
    assert {(r.t1, r.t2): round(r.w, 9) for r in got} == plain_w and len(got) == len(plain_w)
    assert terms.window_cooccurrence(batch.filter("row_id = 99"), words, 4).count() == terms.window_ppmi(batch.filter("false"), words, 4).count() == 0


def test_counts_shuffle_texts_not_terms(spark):
    """Rows of one id count together, wherever they are; terms aren't dealt out once more."""
    batch = spark.createDataFrame([(1, "a b a"), (2, "b"), (1, "a c")], "row_id long, text string").repartition(3)
    df = terms.term_counts(batch, F.split("text", " "))
    assert {(r.row_id, r.term, r.n) for r in df.collect()} == {(1, "a", 3), (1, "b", 1), (1, "c", 1), (2, "b", 1)}
    assert not [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x and "term" in x]
