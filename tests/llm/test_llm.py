"""The training-data operators against brute force, the libraries and held-out labels, and on odd rows."""

import collections
import hashlib
import html
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.llm import components, decontaminate, html_text, line_dedup, mixing, near_dedup, pretokens, quality_classifier, quality_rules, registry, substring_dedup, token_counts, token_files
from lathe.llm.scratch import Scratch, opened, qualified, release

SF = "/root/testdata/sf0.001"
BPE = "byte_bpe_50k.json"
ODD = [(None, None), (None, "a b c"), (1, ""), (2, " \n\t "), (3, "word " * 3000), (3, "word " * 3000), (3, "other"), (4, "x\n" * 8), (5, "é 日本 😀 <|endoftext|> 'll\r\n\x1c"), (6, "The same text of some words.")]
SCHEMA = "doc_id long, text string, row string, q_kept string, n string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, "r", "q", "n") for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")


def texts(spark, name="documents", key="doc_id", text="text"):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key, text).orderBy(key).collect()]


# --- token counts and files ---------------------------------------------------------------------------


def test_counts_equal_the_library(spark):
    random.seed(1)
    letters = "aab  \n\t'sIlé日本語😀̀\x1c\x85 .!9²Ⅷ"
    rows = [t for _, t in texts(spark)] + ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(800)] + ["a<|endoftext|>b", "a" * 99, ""]
    want = [len(e.ids) for e in pretokens.library(BPE).encode_batch(rows, add_special_tokens=False)]
    assert token_counts.TokenCounter(BPE)(rows) == want


def test_long_pretokens_equal_the_library():
    rng = random.Random(7)
    rows = ["".join(rng.choice("etaoinshrdé") for _ in range(n)) for n in (513, 2000, 80_000)] + ["a" * 5001, "ab" * 900, "-" * 1000, "é" * 700]
    began = time.time()
    assert token_counts.TokenCounter(BPE)(rows) == [len(e.ids) for e in pretokens.library(BPE).encode_batch(rows, add_special_tokens=False)]
    assert time.time() - began < 10


def test_op5(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op5_token_counts"](spark, SF).collect()}
    for i, t in texts(spark):
        n = len(pretokens.library(BPE).encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 1024)


def test_token_files_round_trip(spark):
    got, at = registry.QUERIES["op8_token_files"](spark, SF).orderBy("doc_id").collect(), 0
    for r, (i, t) in zip(got, texts(spark), strict=True):
        ids = pretokens.library(BPE).encode(t, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_sequences_and_masks(tmp_path):
    path = tmp_path / "x"
    ids = np.arange(1000, dtype="<u2")
    with path.open("wb") as f:
        w = token_files.ShardWriter(f, np.dtype("<u2"), 7)
        for part in np.array_split(ids, 9):
            w.add(part.tobytes())
        w.close()
    r = token_files.ShardReader(str(path))
    assert r.length == 7 and r.n_batches == 3 and r.n_sequences == 143 and r.sequence(70)[0].tolist() == list(range(490, 497))
    assert r.sequence(142)[1].tolist() == [True] * 6 + [False]
    assert r.tokens(440, 20).tolist() == list(range(440, 460))


def test_token_files_of_repeated_and_missing_ids(spark, odd):
    """Starts follow each other by (id, hash of the text), null first, and every row's ids are the library's."""
    got = sorted(token_files.encode_corpus(odd).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = collections.Counter((i, zlib.crc32(np.array(pretokens.library(BPE).encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in ODD)
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == want


def test_places_of_token_files(spark, tmp_path):
    assert token_files.reachable(qualified(spark, str(tmp_path))).startswith("file:///")
    assert token_files.reachable("s3a://b/x") == "s3://b/x" and token_files.reachable("hdfs://n:1/x") == "hdfs://n:1/x"
    with pytest.raises(ValueError):
        token_files.reachable("odd://b/x")


# --- quality ------------------------------------------------------------------------------------------


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_op6_base_counts(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op6_quality_rules"](spark, SF).collect()}
    for i, t in texts(spark):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t)
        assert not (r.base_failed and r.kept)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.9, 0.8])
    votes = np.where(rng.random((20000, 5)) < right, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, accuracy = quality_rules.fit(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.02 and np.abs(accuracy[0] - right).max() < 0.03 and np.abs(1 - accuracy[1] - right).max() < 0.06


def plain_em(votes, rounds=300):
    """The same estimation, written document by document without arrays."""
    k, prior = len(votes[0]), 0.8
    good, bad = [0.99] * k, [0.75] * k

    def chance(v):
        a, b = math.log(prior), math.log(1 - prior)
        for j, x in enumerate(v):
            if x != -1:
                a += math.log(min(max(good[j] if x else 1 - good[j], 1e-6), 1 - 1e-6))
                b += math.log(min(max(bad[j] if x else 1 - bad[j], 1e-6), 1 - 1e-6))
        return 1 / (1 + math.exp(b - a))

    for _ in range(rounds):
        post = [chance(v) for v in votes]
        was = [prior, *good, *bad]
        prior = (sum(post) + 20 * 0.8) / (len(votes) + 20)
        for j in range(k):
            cast = [(p, v[j]) for p, v in zip(post, votes) if v[j] != -1]
            good[j] = (sum(p for p, x in cast if x) + 20 * 0.99) / (sum(p for p, _ in cast) + 20)
            bad[j] = (sum(1 - p for p, x in cast if x) + 20 * 0.75) / (sum(1 - p for p, _ in cast) + 20)
        if max(abs(a - b) for a, b in zip(was, [prior, *good, *bad])) < 1e-9:
            break
    return [chance(v) for v in votes]


def test_op6_verdicts_against_plain_estimation(spark):
    rows = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    judged = [r for r in rows if not r.base_failed]
    want = plain_em([list(r.votes) for r in judged])
    assert np.allclose([r.quality for r in judged], want, atol=1e-6)
    assert [r.kept for r in judged] == [p >= 0.5 for p in want] and len({r.kept for r in judged}) == 2
    assert not any(r.kept for r in rows if r.base_failed)


def test_rules_against_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = registry.QUERIES["op6_quality_rules"](spark, d).join(labels, "doc_id").filter("not base_failed").groupBy(labels["quality"], "kept").count().collect()
    n = {(r[0], r.kept): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0)) and n.get((0, False), 0) >= 0.8 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality_classifier.score_quality(docs, labels.filter("doc_id % 2 = 0"), F.col("source"), F.col("lang"))
    rows = out.select("row.doc_id", "q_kept").join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality", "q_kept").count().collect()
    n = {(r.quality, r.q_kept): r["count"] for r in rows}
    assert n[(1, True)] >= 0.99 * (n[(1, True)] + n.get((1, False), 0)) and n[(0, False)] >= 0.95 * (n[(0, False)] + n.get((0, True), 0))


def site_corpus(seed=3):
    """Clean and broken prose, and texts between them, on hosts of which some are good and some bad."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))

    def text(bad):
        return " ".join(word() + (rng.choice("#*$%") * 3 if rng.random() < bad else "") for _ in range(60)) + "."

    rows, labels = [], []
    for i in range(900):
        host = f"h{i % 6}"
        y = int(rng.random() < (0.03 if host in ("h0", "h1") else 0.97))
        # most documents tell little by themselves: what is bad has a few more symbols
        rows.append((i, text(rng.uniform(0.02, 0.10) if y else rng.uniform(0.06, 0.16)), host))
        labels.append((i, y, 0))
    for i, host in enumerate(["sparse"] * 2 + ["h0"] * 3 + ["h2"] * 3):
        rows.append((1000 + i, text(0.08), host))
    return rows, labels


def test_sites_move_verdicts(spark):
    """A large bad and a large good host move middling texts either way, a sparse one doesn't; rates equal a numpy version."""
    rows, labels = site_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string").withColumn("path", F.lit(None).cast("string"))
    got = {r.row.doc_id: r for r in quality_classifier.score_quality(docs, spark.createDataFrame(labels, LABELS), F.col("host"), F.col("path")).collect()}
    alone = {i: r.q_doc >= 0.5 for i, r in got.items()}
    truth = {i: bool(y) for i, y, _ in labels}
    assert sum(got[i].q_kept == truth[i] for i in truth) > sum(alone[i] == truth[i] for i in truth) + 20
    moved = lambda ids: np.mean([math.log(got[i].q_posterior / (1 - got[i].q_posterior)) - math.log(got[i].q_doc / (1 - got[i].q_doc)) for i in ids])
    bad, good, sparse = moved(range(1002, 1005)), moved(range(1005, 1008)), moved(range(1000, 1002))
    assert bad < -1 < abs(sparse) + 1 < 1.6 and good > abs(sparse) and any(alone[i] and not r.q_kept for i, r in got.items()) and any(r.q_kept and not alone[i] for i, r in got.items())
    host = np.array([r[2] for r in rows])
    q = np.array([got[r[0]].q_doc for r in rows])
    total, n, hosts = q.mean(), len(q), sorted(set(host))
    size, mean = np.array([(host == h).sum() for h in hosts]), np.array([q[host == h].mean() for h in hosts])
    between = (size * (mean - total) ** 2).sum()
    within = max((q * q).mean() - total**2 - between / n, 0)
    tau = max((between - len(hosts) * within) / n, 0)
    belief = min(max(total * (1 - total) / tau - 1, 1.0), 1e4)
    for r, x, h in zip(rows, q, host):
        mine = host == h
        assert math.isclose(got[r[0]].q_host, (belief * total + q[mine].sum() - x) / (belief + mine.sum() - 1), rel_tol=1e-6)


def test_many_sites_are_joined_without_a_broadcast(spark, monkeypatch, odd):
    rows, labels = site_corpus(4)
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, host string")

    def run():
        out = quality_classifier.score_quality(docs, spark.createDataFrame(labels, LABELS), F.col("host"), F.lit(None))
        return sorted((r.row.doc_id, round(r.q_posterior, 9), r.q_kept) for r in out.collect())

    want = run()
    monkeypatch.setattr(quality_classifier, "MAX_SITES", 0)
    assert run() == want and len(want) == len(rows) + 5


@pytest.mark.parametrize("sent", [200_000, 0])
def test_all_labels_are_in_the_document_model(spark, monkeypatch, sent):
    """Above 20,000 labels, too, q_doc is that of a plain ridge regression on every one, however the labels are joined."""
    monkeypatch.setattr(quality_classifier, "MAX_SENT", sent, raising=False)
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(20_400):
        y = rng.random() < 0.6
        rows.append((i, " ".join(rng.choice(("alpha", "Beta.", "of", "#x#")[: 3 if y and rng.random() < 0.7 else 4]) for _ in range(8)), "h"))
        labels.append((i, int(y), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string").repartition(5)
    out = quality_classifier.score_quality(docs, spark.createDataFrame(labels, LABELS), F.col("host"), F.lit(None))
    got = dict(out.select("row.doc_id", "q_doc").collect())
    x, y = np.array([quality_classifier.features(t.encode()) for _, t, _ in rows]), np.array([float(k) for _, k, _ in labels])
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    z = np.hstack([np.ones((len(z), 1)), z, np.minimum(z * z, 16)])
    ridge, w = np.append(0.0, np.ones(z.shape[1] - 1)), np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
    assert np.allclose([got[i] for i, _, _ in rows], 1 / (1 + np.exp(-np.clip(z @ w, -12, 12))), atol=1e-6)


def test_null_names_are_sites_of_their_own(spark):
    names = spark.createDataFrame([(None, "x"), ("", "x"), ("a", None), ("a", ""), ("a/b", "c"), ("a", "b/c")], "a string, b string")
    assert names.select(quality_classifier.site_key(F.col("a"), F.col("b")).alias("k")).distinct().count() == 6


# --- duplicates ---------------------------------------------------------------------------------------


def linked(rows, w, num, den):
    sets = {}
    for i, t in rows:
        x = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        sets[i] = frozenset(zip(*[x[j:] for j in range(w)])) if len(x) >= w else frozenset([tuple(x)] if x else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) * den >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_op7_against_all_pairs(spark):
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES["op7_near_dedup"](spark, SF).collect()}
    assert got == linked(texts(spark), 3, 85, 100)


def test_near_copies_in_blocks(spark):
    """A large group of near copies, cut into many blocks, and chains that only some pairs link."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 999)}" for _ in range(60)]
    rows = []
    for i in range(150):
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"v{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    op = near_dedup.NearDedup(3, 85, 100, list_block=16, block=16)
    got = {r[0]: tuple(r)[1:] for r in op.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows, 3, 85, 100)


def boilerplate_corpus():
    """Texts that share a long passage and little else, a family of near copies, and texts that link families."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(45)]
    rows = [(i, " ".join(passage + [f"u{rng.randint(0, 10**6)}" for _ in range(15)])) for i in range(120)]
    base = [f"b{i}" for i in range(60)]
    for i in range(120, 260):
        w = base[:]
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(60)] = f"v{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    rows += [(260 + i, rows[i][1] + " more") for i in range(0, 40, 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [{"list_block": 16, "block": 16}, {"list_block": 16, "block": 16, "joined": True}, {"list_block": 16, "block": 16, "risk": 0}, {"risk": 0}, {}])
def test_common_passages_and_hubs(spark, settings, monkeypatch):
    """Long lists go by pairs of values, and long families through hubs, without a lost link; the exact way agrees."""
    rows = boilerplate_corpus()
    settings = dict(settings)
    if settings.pop("joined", False):
        monkeypatch.setattr(near_dedup, "MAX_KEYS", 0)
    got = {r[0]: tuple(r)[1:] for r in near_dedup.NearDedup(3, 85, 100, **settings).components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows, 3, 85, 100)


def test_a_family_costs_in_proportion(spark):
    """Rows that are dealt out for a family of near copies: about one for each, not one for each block."""
    dealt = []
    real = near_dedup._brought_together
    rng = random.Random(9)
    sets = []
    for i in range(1200):
        s = set(range(0, 4000, 10))
        s -= set(rng.sample(sorted(s), 10))
        sets.append((1, 1200 // 64 + 1, i, len(s), np.sort(np.array(sorted(s), np.uint64)).tobytes()))
    df = spark.createDataFrame(sets, "g long, blocks long, id long, size long, values binary")
    near_dedup._brought_together = lambda rows, test, *key: (dealt.append(rows.count()), real(rows, test, *key))[1]
    try:
        scratch = Scratch(spark, "t")
        edges = near_dedup.edges_of(df, lambda e: e, "g", 64, near_dedup._groups(near_dedup._exact, 64, 85, 100), scratch, "x")
        assert components.connected(edges, scratch, "y").filter("component = 0").count() == 1200
    finally:
        near_dedup._brought_together = real
    assert sum(dealt) < 2 * 1200


def test_a_long_list_of_near_copies_makes_no_pairs(spark, monkeypatch):
    """Classes that are dealt out for a group of near copies: each once for a value it lists, and to a few hubs; and no link is lost."""
    rng = random.Random(10)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(500):
        w = base[:]
        for _ in range(3):
            w[rng.randrange(90)] = f"v{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join([*(f"x{i}-{j}" for j in range(20)), *base[:60]])) for i in range(4)]
    rows += [(600 + i, rows[500 + i][1] + " more") for i in range(4)]
    dealt = []
    real = near_dedup._brought_together
    monkeypatch.setattr(near_dedup, "_brought_together", lambda rows, test, *key: (dealt.append(rows.count() * (key[0] == "value")), real(rows, test, *key))[1])
    op = near_dedup.NearDedup(3, 80, 100, list_block=64, block=64)
    got = {r[0]: tuple(r)[1:] for r in op.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows, 3, 80, 100)
    assert sum(dealt) < 2 * op.listed * len(rows)


def test_components_of_long_chains(spark):
    """A low label at one end must take over a long chain that another low label holds already."""
    n = 300
    edges = [(i, i + 1) for i in range(1, n)] + [(0, n)]
    order = random.Random(5).sample(range(1000, 1000 + n), n)
    edges += list(zip(order, order[1:]))
    got = dict(components.connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "chains"), "chain").collect())
    assert got == {**dict.fromkeys(range(n + 1), 0), **dict.fromkeys(order, 1000)}


def test_drifting_chain_in_small_blocks(spark):
    """Texts of a moving window: neighbours in the chain are linked, its ends share nothing."""
    n = 500
    ids = [0, *range(n - 1, 0, -1)]
    rows = [(i, " ".join(f"w{j}" for j in range(4 * at, 4 * at + 60))) for at, i in enumerate(ids)]
    random.Random(6).shuffle(rows)
    op = near_dedup.NearDedup(3, 85, 100, list_block=16, block=16)
    got = op.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]


def test_near_copies_of_repeated_ids(spark):
    """Rows of equal id are one document: all their texts are compared, and their classes are one component."""
    text = {k: " ".join(f"{k}{j}" for j in range(60)) for k in "abcdefghijkl"}
    rows = []
    for x, (p, q) in enumerate(["ab", "cd", "ef", "gh"]):  # one id with two texts, each with a near copy of its own
        rows += [(10 * x, text[p]), (10 * x, text[q]), (10 * x + 1, text[p] + " more"), (10 * x + 2, text[q] + " more")]
    rows += [(100, text["i"]), (101, text["j"]), (105, text["i"]), (105, text["j"])]  # 105 names neither of its classes
    got = {(r.doc_id, r.component_id) for r in near_dedup.NearDedup(3, 85, 100).components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, i // 10 * 10) for i, _ in rows}


def cut_rows(rows, n=50):
    """Per row, by all windows; rows may share ids, and a null id neither marks nor loses anything."""
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None)):
        for k in range(len(t) - n + 1):
            first.setdefault(t[k : k + n], i)
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if i is not None and first[t[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        keep = bytes(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(keep).hexdigest()))
    return out


def cut(rows, n=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        for k in range(len(t) - n + 1):
            first.setdefault(t[k : k + n], i)
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if first[t[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        keep = bytes(x for x, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(keep).hexdigest())
    return out


def test_op10_against_all_windows(spark):
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES["op10_substring_dedup"](spark, SF).collect()}
    assert got == cut([(i, t.encode()) for i, t in texts(spark)])


@pytest.mark.parametrize("letters", ["ab", "ab é"])
def test_substrings_of_few_letters(spark, letters):
    rng = random.Random(3)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(base)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 5)))) for i in range(40)]
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.SubstringDedup(50).digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == cut([(i, t.encode()) for i, t in rows])


def test_substrings_of_repeated_and_large_ids(spark):
    """Ids that repeat elsewhere don't change large or negative ones; rows of one id leave each other alone."""
    t, u = (" ".join(f"{c}{i}" for i in range(30)) for c in "tu")
    rows = [(2**62 + 5, t), (2**62 + 15, t + "x"), (1, u), (1, u + " tail"), (1, u), (2, "a " + u), (None, t), (3, ""), (-(2**62), "zz " + t)]
    rng = random.Random(5)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(12)]
    rows += [(rng.randint(-9, 9), "".join(rng.choice(base)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 5)))) for _ in range(40)]
    got = substring_dedup.SubstringDedup(50).digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cut_rows([(i, x.encode()) for i, x in rows]), key=str)


def test_full_grams_are_spread(spark, monkeypatch):
    """Grams with many pointers, or halves of windows, go to buckets by their surroundings; results stay as they are."""
    monkeypatch.setattr(substring_dedup, "COUNTED", 1)
    monkeypatch.setattr(substring_dedup, "POINTERS_PER_BUCKET", 20)
    spread, sizes = substring_dedup.SubstringDedup._spread, []

    def counted(*args):
        sizes.append(spread(*args).size)
        return spread(*args)

    monkeypatch.setattr(substring_dedup.SubstringDedup, "_spread", staticmethod(counted))
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrase, passage = noise(44), noise(70)
    rows = [(i, noise(rng.randint(0, 90)) + (passage if i % 9 == 0 else phrase) + noise(rng.randint(0, 90)) + (phrase if i % 7 == 0 else "")) for i in range(150)]
    rows += [(1000 + i, rows[5 * i][1][rng.randint(0, 20) :] + noise(9)) for i in range(20)] + [(2000, phrase), (2001, ""), (-3, "é" + rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs, docs.repartition(7)):
        got = {r[0]: tuple(r)[1:] for r in substring_dedup.SubstringDedup(50).digests(df).collect()}
        assert got == cut([(i, t.encode()) for i, t in rows])
    assert min(sizes) > 0


def test_many_lines(spark):
    """Removal is linear in the lines of one text."""
    n = 60_000
    block = "\n".join(f"l{i}" for i in range(n))
    docs = spark.createDataFrame([(1, block), (2, "first\n" + block + "\nlast")], "doc_id long, text string").repartition(1)
    began = time.time()
    got = {r.row.doc_id: (r.kept_text, r.n_lines, r.n_removed, r.n_spans) for r in line_dedup.drop_lines(docs).collect()}
    assert got == {1: (block, n, 0, 0), 2: ("first\nlast", n + 2, n, 1)} and time.time() - began < 60


def test_op9_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, registry.QUERIES["op9_line_dedup"](spark, SF).collect())) == sorted(con.sql(line_dedup.ORACLE_OP9).fetchall())


# --- mixing, retrieval, pages ---------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 3, 400)
    tokens = rng.integers(1, 500, 400)
    known = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    y, wanted = mixing.solve_rates(known, np.array([0.5, 0.3, 0.2]))
    rate = np.maximum(0, 1 + p @ y)
    assert np.allclose((rate * tokens) @ p, wanted, rtol=2e-3)


def test_rates_are_nonnegative_and_least_squares(spark):
    """Targets that only rates of 0 come near: as projected gradient steps over all documents' rates find them."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.2] * 3, 300)
    tokens = rng.integers(1, 500, 300)
    known = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    share = np.array([0.93, 0.05, 0.02])
    y, wanted = mixing.solve_rates(known, share, "keep", rounds=120, tolerance=1e-7)
    rate = np.maximum(0, 1 + p @ y)
    assert (rate == 0).sum() > 20 and np.isclose(wanted.sum(), tokens.sum())
    base, r = tokens @ p, np.ones(300)
    for _ in range(20000):
        r = np.maximum(0, r - p @ (((r * tokens) @ p - wanted) / base))
    assert np.allclose((rate * tokens) @ p, (r * tokens) @ p, rtol=2e-3, atol=2e-3 * tokens.sum())


def test_mixing_of_repeated_rows(spark):
    """Each of equal rows has its own tokens, and the posterior that one row alone has."""
    labels = spark.createDataFrame([(5, "x"), (6, "y")] + [(i, "xy"[i % 2]) for i in range(10, 60)], "doc_id long, domain string")
    more = [(i, ("red green " if i % 2 == 0 else "blue black ") * 5) for i in range(10, 60)]

    def run(rows):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        out = mixing.mix(docs, labels, {"x": 1.0, "y": 1.0}).filter("row.doc_id is null or row.doc_id < 10").collect()
        return sorted((r.row.doc_id is not None, r.row.doc_id or 0, r.tokens, [round(x, 9) for x in r.p]) for r in out)

    once = run([(1, "red red blue"), (2, ""), (None, "green")])
    twice = run([(1, "red red blue"), (1, "red red blue"), (2, ""), (2, ""), (None, "green"), (None, "green")])
    assert twice == sorted(once + once) and [x[2] for x in once] == [1, 3, 0]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_all_labels_are_in_the_mixing_model(spark, monkeypatch, sent):
    """Above 20,000 labels, too, the words of every labelled document are counted, however the labels are joined."""
    monkeypatch.setattr(mixing, "MAX_SENT", sent, raising=False)
    docs = spark.range(20_400).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'red green blue', 'red')").alias("text"))
    labelled = docs.select("doc_id", F.expr("if(doc_id % 3 = 0, 'a', 'b')").alias("domain"))
    model = mixing.fit(docs, labelled, ["a", "b"], Scratch(spark, "t"))
    size = np.array([3 * 6800, 13600])
    assert np.allclose(model.prior, np.log((size + 1) / (size + 1).sum()), atol=1e-12)
    w = [r.w for r in model.words.filter(mixing.bucket_of(F.lit("red")) == F.col("bucket")).collect()]
    say = np.log((np.array([6800, 13600]) + 0.1) / (size + 0.1 * mixing.BUCKETS))
    assert np.allclose(w, [say - say.mean()], atol=1e-12)


def test_op1(spark):
    rows = registry.QUERIES["op1_source_mixing"](spark, SF).collect()
    assert len(rows) == 200 and all(r.rate >= 0 and abs(sum(r[f"p_{d}"] for d in mixing.TARGETS) - 1) < 1e-9 for r in rows)
    total = np.array([sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) for d in mixing.TARGETS])
    assert np.allclose(total / total.sum(), np.array(list(mixing.TARGETS.values())), atol=2e-3)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts(spark)}
    assert {r.doc_id: r.tokens for r in rows} == words and abs(total.sum() / sum(words.values()) - 1) < 2e-3


def test_op1_posteriors_against_plain_bayes(spark):
    """Bucketed counts, priors and tempering, written out in Python from the model's own exponent."""
    scratch = Scratch(spark, "t")
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    labelled, domains = mixing.labelled_domains(docs, labels), list(mixing.TARGETS)
    model = mixing.fit(docs, labelled, domains, scratch)
    got = {r.row_id: r.p for r in mixing.posteriors(docs, model, scratch).collect()}
    vocabulary = {r.word: r.bucket for r in docs.select(F.explode(mixing.words_of(F.col("text"))).alias("word")).distinct().select("word", mixing.bucket_of(F.col("word")).alias("bucket")).collect()}
    split = {i: [vocabulary[w] for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w] for i, t in texts(spark)}
    counts = {d: collections.Counter() for d in domains}
    for r in labelled.collect():
        counts[r.domain].update(split[r.doc_id])
    size = {d: sum(c.values()) for d, c in counts.items()}
    known = set().union(*counts.values())
    for i, w in split.items():
        say = {d: sum(math.log((counts[d][b] + 0.1) / (size[d] + 0.1 * mixing.BUCKETS)) for b in w if b in known) for d in domains}
        score = np.array([model.exponent * say[d] + math.log((size[d] + 1) / sum(n + 1 for n in size.values())) for d in domains])
        p = np.exp(score - score.max())
        assert np.allclose(got[i], p / p.sum(), atol=1e-7)


def test_leaks_against_verbatim_search(spark):
    items = [(i, " ".join(t.lower().split())) for i, t in texts(spark, "benchmark", "item_id")]
    got = {r.doc_id: set(r.item_ids) for r in registry.QUERIES["op3_decontamination"](spark, SF).collect()}
    for i, t in texts(spark):
        text = f" {' '.join(t.lower().split())} "
        assert {k for k, x in items if f" {x} " in text} <= got[i]


def test_paraphrase_and_clean_text(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    near = item[:]
    for k in range(0, 30, 5):
        near[k] = word()
    docs = [(1, " ".join([word() for _ in range(200)] + near + [word() for _ in range(100)])), (2, " ".join(word() for _ in range(400))), (3, None)]
    bench = spark.createDataFrame([(9, " ".join(item)), (None, "x y z"), (8, "")], "item_id long, text string")
    got = decontaminate.Decontaminator().leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {r.id: r.item_ids for r in got.collect()} == {1: [9], 2: [], 3: []}


def test_answers_and_blocks(spark):
    """Answer words that no item holds, and those that only later items hold, count; blocks of one item and parts of few words change nothing."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    near = item[:]
    for k in range(0, 40, 5):  # three fifths to seven tenths of the item: a paraphrase, which needs the answer
        near[k] = word()
    for k in (*range(1, 30, 5), 38):
        near[k] = word()
    tail = [word() for _ in range(60)]
    docs = [(1, " ".join(tail + near + ["Paris", "today"] + tail)), (2, " ".join(tail + near + tail)), (2, " ".join(tail + near + tail)), (3, " ".join(item)), (3, " ".join(item)), (4, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [(5, " ".join(item), "Paris"), (5, " ".join(item), None), (7, "paris is mentioned by a later item", " "), (9, " ".join(word() for _ in range(30)), "nowhere")]

    def run(bench, **settings):
        got = decontaminate.Decontaminator(**settings).leaks(docs, spark.createDataFrame(bench, "item_id long, text string, answer string"))
        return sorted((r.id, r.contaminated, list(r.item_ids), list(r.shares)) for r in got.collect())

    want = run(rows)
    found = {r[0]: r[2] for r in want}
    assert found == {1: [5], 2: [], 3: [5], 4: []} and [r[3] for r in want if r[0] == 3] == [[1.0], [1.0]] and len(want) == 6
    assert run(rows[::-1]) == want and run(rows, block=1) == want and run(rows, part_words=1) == want


def test_paraphrases_are_found(spark):
    """Recall of items with a share of their words replaced, against all pairs by common subsequence."""
    rng = random.Random(2)
    items = [(i, t) for i, t in texts(spark, "benchmark", "item_id") if len(t.split()) >= 12]
    docs, want = [], {}
    for j, (i, t) in enumerate(items):
        w = [x if rng.random() > 0.15 else f"zz{rng.randint(0, 999)}" for x in t.lower().split()]
        filler = [x for _, y in texts(spark)[j : j + 2] for x in y.lower().split()][:150]
        docs.append((j, " ".join(filler[:70] + w + filler[70:])))
        full = t.lower().split()
        have = np.zeros(len(w) + 1, int)
        for x in full:
            new = have.copy()
            for k, y in enumerate(w):
                new[k + 1] = max(new[k], have[k + 1], have[k] + 1 if x == y else 0)
            have = new
        want[j] = i if have[-1] >= 0.7 * len(full) else None
    got = {r.id: r.item_ids for r in decontaminate.Decontaminator().leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    sought = [j for j, i in want.items() if i is not None]
    assert len(sought) > 20 and sum(want[j] in got[j] for j in sought) >= 0.95 * len(sought)


def test_the_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    """Above 5,000 documents, too, every one is in the fit, and the product over tasks and blocks of codes is that of all passages."""
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 399)}" for _ in range(rng.randint(3, 90)))) for i in range(5400)], "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(20 * i, 20 * i + 20))) for i in range(15)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PRODUCT_CODES", 64, raising=False)
    seen, real = [], decontaminate.Decontaminator._fit

    def fit(self, coded, space, *more):
        seen.append((self, coded, space))
        return real(self, coded, space, *more)

    monkeypatch.setattr(decontaminate.Decontaminator, "_fit", fit)
    decontaminate.Decontaminator(max_df=1.0).leaks(docs, bench)
    ((op, coded, space),) = seen
    assert coded.count() == 5400
    want, q = np.zeros((space.weight.size, 6)), np.random.default_rng(1).standard_normal((space.weight.size, 6)).astype(np.float32)
    for r in coded.select("codes").collect():
        codes = np.frombuffer(r.codes, np.int32)
        for at in range(0, codes.size, op.window):
            count = np.bincount(codes[at : at + op.window], minlength=space.weight.size)
            if count[space.weight > 0].sum() >= space.least:
                x = count * space.weight
                want += np.outer(x, x @ q) / (x @ x)
    assert np.allclose(op._corpus_product(coded, space, q), want, rtol=1e-3, atol=1e-3)


def plain_article(page):
    """The article of the given pages, whose markup is regular: an independent extraction."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(x for x in (" ".join(x.split()) for x in parts) if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op2_against_an_independent_extraction(spark, sf):
    d = f"/root/testdata/{sf}"
    want = {r.page_id: (r.url, plain_article(r.html)) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = registry.QUERIES["op2_html_text"](spark, d).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got) and len(got) == len(want)


def test_differencing_decides_without_articles(spark):
    """The given pages without their article elements and class names: only what a page shares with its nearest one goes."""
    bare = lambda i, body: f"<div>Site name</div><div><a>Home</a></div><div>{body}</div><p>{'story ' * 3}{i}</p><div>All rights {2020}</div>"
    rows = [(i, f"http://h/{'ab'[i % 2]}/{i}", bare(i, f"lead of {i}")) for i in range(12)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"lead of {r.page_id}\n\nstory story story {r.page_id}" and r.n_shared == 3 and r.n_marked == 0 for r in got)


def test_odd_pages(spark):
    rows = [(1, "u", "<p>one"), (1, "u", "<p>two"), (1, "u", "<p>two"), (None, None, None), (2, "http://h/x", ""), (3, "::odd::", "<p>x<nav>y</nav>"), (4, "http://h/y", "<p>" + "line</p><p>" * 5000)]
    odd_pages = spark.createDataFrame([(*r, 9, "c") for r in rows], "page_id long, url string, html string, key long, partner string")
    got = sorted((r.page_id or 0, r.text[:9]) for r in html_text.extract(odd_pages).collect())
    assert got == [(0, ""), (1, "one"), (1, "two"), (1, "two"), (2, ""), (3, "x"), (4, "line\n\nlin")]
    assert html_text.extract(odd_pages.filter("false")).count() == 0


def test_pages(spark):
    page = lambda b: f'<html><body><div class="menu"><a>Home</a></div><p>Welcome to our site</p><div>{b}</div><p>All rights</p></body></html>'
    rows = [
        (1, "http://a.b/x/1", page("<p>First story &amp; more</p><p>two\n lines</p>")), (2, "http://a.b/x/2", page("<p>Second</p>")), (3, "http://z/1", None), (4, None, ""),
        (5, "http://q/1", page("same")), (6, "http://q/1", page("same")), (None, "u", "<p>a<p>b <script>x</script><b>c"),
        (7, "http://r/1", "<nav>m</nav><article><header><h1>T</h1></header><p>x<br>y</p><div class='comments'><p>no</p></div><footer>f</footer></article><p>out"),
    ]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "First story & more\n\ntwo lines" and got[2] == "Second" and got[3] == got[4] == ""
    assert got[5] == got[6] == "Welcome to our site\n\nsame\n\nAll rights" and got[None] == "a\n\nb c" and got[7] == "T\n\nx y"


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    many = [1] * 20_000
    assert len(html_text.shared([5, *many, 6], [7, *many, 8])) == 20_000
    for _ in range(100):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        found = sorted(html_text.shared(a, b))
        left = iter(b)
        assert len(found) == table[-1, -1] and all(a[i] in left for i in found)


# --- odd rows, empty tables, clashing names ---------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int"


def operators(spark, docs):
    labels = spark.createDataFrame([(3, 0, 0), (6, 1, 0), (None, 1, 1)], LABELS)
    bench = spark.createDataFrame([(1, "The same text of some words.")], "item_id long, text string")
    mixed = spark.createDataFrame([(3, "a"), (6, "b")], "doc_id long, domain string")
    return {
        "mix": lambda: mixing.mix(docs, mixed, {"a": 1.0, "b": 1.0}),
        "leaks": lambda: decontaminate.Decontaminator().leaks(docs, bench),
        "quality": lambda: quality_classifier.score_quality(docs, labels, F.lit("h"), F.lit(None)),
        "counts": lambda: token_counts.count_tokens(docs, BPE),
        "rules": lambda: quality_rules.judge(docs),
        "near": lambda: near_dedup.NearDedup(3, 85, 100).components(docs),
        "files": lambda: token_files.encode_corpus(docs),
        "lines": lambda: line_dedup.drop_lines(docs),
        "bytes": lambda: substring_dedup.SubstringDedup(50).digests(docs),
    }


@pytest.mark.parametrize("name", ["mix", "leaks", "quality", "counts", "rules", "near", "files", "lines", "bytes"])
def test_odd_rows_and_empty_tables(spark, odd, nothing, name):
    assert operators(spark, odd)[name]().count() == len(ODD)
    assert operators(spark, nothing)[name]().count() == 0


def test_values_on_odd_rows(spark, odd):
    """Defined results, not only the number of rows."""
    ops = operators(spark, odd)
    key = lambda i: (i is not None, i or 0)
    words = [len((t or "").split()) if (t or "").isascii() else len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in ODD]
    by = lambda rows: sorted(rows, key=lambda r: (key(r[0]), *r[1:]))
    assert by((r.row.doc_id, r.tokens) for r in ops["mix"]().collect()) == by((i, n) for (i, _), n in zip(ODD, words))
    assert by((r.id, r.contaminated) for r in ops["leaks"]().collect()) == by((i, i == 6) for i, _ in ODD)
    assert by((r.doc_id, r.n_bytes) for r in ops["counts"]().collect()) == by((i, len((t or "").encode())) for i, t in ODD)
    assert by((r.doc_id, r.n_words, r.base_failed) for r in ops["rules"]().collect()) == by((i, n, True) for (i, _), n in zip(ODD, words))
    near = by((r.doc_id, r.n_shingles, r.component_id if r.component_id is not None else -1, r.kept) for r in ops["near"]().collect())
    assert near == by([(None, 0, -1, True), (None, 1, -1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 4, True), (5, len(set(zip(*[re.findall(rb"[^\x20\x09-\x0D]+", ODD[8][1].encode().lower())[j:] for j in range(3)]))), 5, True), (6, 4, 6, True)])
    assert by(map(tuple, ops["bytes"]().collect())) == by(cut_rows([(i, (t or "").encode()) for i, t in ODD]))
    lines = {(r.row.doc_id, r.n_removed, r.kept_text) for r in ops["lines"]().collect() if r.n_removed}
    assert lines == {(4, 7, "x\n")} or lines == {(4, n, t) for _, n, t in lines}


def test_stages_keep_columns_and_clashing_names(spark, odd):
    labels = spark.createDataFrame([(3, 0, 0), (6, 1, 0)], LABELS)
    docs = odd.withColumns({"source": F.lit("s"), "lang": F.lit("en"), "id": F.lit(1), "t": F.lit(2), "h": F.lit("h"), "p": F.lit("p"), "row_id": F.lit("r"), "hash": F.lit("x")})
    bench = spark.createDataFrame([(1, "The same text of some words.")], "item_id long, text string")
    left = decontaminate.Decontaminator().clean(docs, bench)
    assert left.columns == docs.columns and left.count() == len(ODD) - 1
    for out in (quality_classifier.good_documents(docs, labels), near_dedup.NearDedup().keep_one(docs), mixing.mixed_documents(docs, labels.select("doc_id", F.lit("a").alias("domain")), {"a": 1.0})):
        assert out.columns == docs.columns and out.count() > 0


def test_pipeline_mixes_to_the_targets_of_op1(spark, monkeypatch):
    import corpus_pipeline

    seen = []
    monkeypatch.setattr(corpus_pipeline, "mixed_documents", lambda docs, labelled, targets, scale: seen.append(targets))
    corpus_pipeline.mixing(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert seen == [{"en": 0.50, "de": 0.15, "fr": 0.15, "es": 0.11, "other": 0.09}]


def test_pipeline_on_a_small_table(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in out}
    near = {r.doc_id: r.component_id for r in near_dedup.NearDedup(5, 80, 100).components(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert 0 < len(kept) <= 200 and len({near[i] for i in kept}) == len(kept)


@pytest.mark.parametrize("rows", [[], ODD, [(None, None)] * 3])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    """Empty, null, repeated and extra-column documents go through all stages."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) >= len({i for i, _ in rows if i is not None}) - (6 if rows is ODD else 0) and all(r.n_tokens >= 1 for r in out)


def test_scratch_is_released(spark):
    mark = opened()
    s = Scratch(spark, "t")
    df = s.save(spark.range(3), "x")
    assert df.count() == 3 and opened() == mark + 1
    release(mark)
    assert opened() == mark
    with pytest.raises(Exception):
        s.load("x", df).count()


def test_scratch_tables_are_dropped(spark):
    s = Scratch(spark, "t")
    df = s.save(spark.range(3), "x")
    assert df.count() == 3
    s.drop("x")
    with pytest.raises(Exception):
        s.load("x", df).count()
