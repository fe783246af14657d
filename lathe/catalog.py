"""Every registered query and, where SQL can express it, its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import plans, sources, streaming
from .operators import cluster, evaluate, labels, terms, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return sources.text_batch(sources.read_table(spark, d, "documents"), "doc_id")


def _posts(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns under one id."""
    t = sources.read_table(spark, d, "conversations")
    return t.select((F.col("conv_id") * 2**32 + F.col("turn")).alias("row_id"), "text")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return sources.text_batch(sources.read_table(spark, d, "pages"), "page_id", "html")


def _points(spark: SparkSession, d: str) -> DataFrame:
    t = sources.read_table(spark, d, "embeddings")
    return t.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    t = sources.read_table(spark, d, "embeddings")
    return t.select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("label"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    t = sources.read_table(spark, d, "embeddings")
    return t.select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("truth"), (F.col("vec_id") % 7).alias("pred"))


def _n(spark: SparkSession, d: str) -> int:
    return _docs(spark, d).count()


# --- SQL building blocks -------------------------------------------------------------------------

SP = r"\s\p{Z}\x1c-\x1f\x{85}"
S_, NS_, W_ = f"[{SP}]", f"[^{SP}]", r"[\p{L}\p{N}_]"
STOP = ", ".join(f"'{w}'" for w in fn.STOP_WORDS)


def _re(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def _squeeze(x: str) -> str:
    return _re(_re(x, f"{S_}+", " "), "^ | $", "")


def _clean(x: str, to: str = "") -> str:
    x = _re(f"lower(coalesce({x}, ''))", f"http{NS_}+|www{NS_}+", to)
    x = _re(_re(x, f"@{W_}+", to), f"#({W_}+)", r"\1")
    return _squeeze(_re(x, rf"[^\p{{L}}\p{{N}}_{SP}]", to))


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{W_}{{2,}}'), lambda w: w NOT IN ({STOP}))"


DOCS = "docs AS (SELECT doc_id AS row_id, text FROM documents)"
POSTS = "posts AS (SELECT conv_id * 4294967296 + turn AS row_id, text FROM conversations)"
TERMS = f"""{DOCS},
clean AS (SELECT row_id, {_clean('text')} AS text FROM docs),
counts AS (SELECT row_id, term, count(*) AS n FROM (SELECT row_id, unnest({_tokens('text')}) AS term FROM clean) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM counts GROUP BY term),
total AS (SELECT count(*) AS n_docs FROM docs),
vocab AS (SELECT term, df, cf FROM freq, total WHERE df >= 2 AND df <= 0.95 * n_docs)"""
TFIDF = f"""{TERMS},
raw AS (SELECT row_id, term, n * (ln((1.0 + n_docs) / (1 + df)) + 1) AS w FROM counts JOIN vocab USING (term), total),
tfidf AS (SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM raw)"""
EMB = "e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings)"


def _knn_sql(k: int, dist: str = "list_cosine_distance(a.v, b.v)", name: str = "knn") -> str:
    return f"""{name} AS (
  SELECT src, dst, CAST(rank AS INTEGER) AS rank, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank
    FROM (SELECT a.row_id AS src, b.row_id AS dst, round({dist}, 12) AS dist FROM e a JOIN e b ON a.row_id <> b.row_id)
  ) WHERE rank <= {k})"""


SYM = "sym AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM knn UNION ALL SELECT dst, src FROM knn))"
FLAT = "flat AS (SELECT row_id, label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e)"
CENT = f"""{FLAT},
means AS (SELECT label, i, avg(x) AS x FROM flat GROUP BY label, i),
cent AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM means),
cvec AS (SELECT label, list(x ORDER BY i) AS c FROM cent GROUP BY label)"""
PAIRS = "pairs AS (SELECT CAST(label AS BIGINT) AS truth, vec_id % 7 AS pred FROM embeddings)"
CONT = f"{PAIRS}, cont AS (SELECT truth, pred, count(*) AS n FROM pairs GROUP BY ALL)"
SCORES = f"""{CONT},
ta AS (SELECT sum(n) AS n FROM cont GROUP BY truth), pb AS (SELECT sum(n) AS n FROM cont GROUP BY pred),
m AS (SELECT (SELECT sum(n) FROM cont) AS n, (SELECT sum(n*(n-1)/2) FROM cont) AS ab,
  (SELECT sum(n*(n-1)/2) FROM ta) AS a, (SELECT sum(n*(n-1)/2) FROM pb) AS b,
  (SELECT sum(n*ln(n)) FROM cont) AS lab, (SELECT sum(n*ln(n)) FROM ta) AS la, (SELECT sum(n*ln(n)) FROM pb) AS lb),
s AS (SELECT (ab - a*b/(n*(n-1)/2)) / ((a+b)/2 - a*b/(n*(n-1)/2)) AS ari,
  ((ln(n)-la/n) + (ln(n)-lb/n) - (ln(n)-lab/n)) / (((ln(n)-la/n) + (ln(n)-lb/n)) / 2) AS nmi FROM m),
c AS (SELECT ari, nmi, (greatest(0.0, ari) + nmi) / 2 AS combined FROM s)"""


def _rounded(x: Column, places: int = 6) -> Column:
    """x rounded as SQL engines round floating point numbers: what is negative and rounds to 0 is -0."""
    near = F.round(x, places)
    return F.when((near == 0) & (x < 0), F.lit(-0.0)).otherwise(near)


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: _rounded(F.col(c), places) for c in columns})


# --- sources and text functions --------------------------------------------------------------------


@query("text_batch", f"WITH {DOCS} SELECT row_id, text FROM docs")
def _(s, d):
    return sources.reject_empty(_docs(s, d))


@query("label_sink", "SELECT vec_id AS row_id, label AS cluster_id FROM embeddings")
def _(s, d):
    return sources.aligned_labels(_labels(s, d), "label")


@query("health", "SELECT 'healthy' AS status")
def _(s, d):
    return sources.health(s)


@query("clean_bl", f"WITH {DOCS} SELECT row_id, {_clean('text')} AS clean FROM docs")
def _(s, d):
    return _docs(s, d).select("row_id", fn.clean_joined(F.col("text")).alias("clean"))


@query("clean_pages", f"SELECT page_id AS row_id, md5({_clean('html')}) AS clean_md5 FROM pages")
def _(s, d):
    return _pages(s, d).select("row_id", F.md5(fn.clean_joined(F.col("text"))).alias("clean_md5"))


@query("clean_spaced", f"WITH {DOCS} SELECT row_id, {_clean('text', ' ')} AS clean FROM docs")
def _(s, d):
    return _docs(s, d).select("row_id", fn.clean_spaced(F.col("text")).alias("clean"))


def _cased(x: str) -> str:
    """Links, retweet marks, mentions, hash signs and joined capitals, as the cleaners that keep case take them."""
    x = _re(_re(f"coalesce({x}, '')", rf"https?://{NS_}+|www\.{NS_}+", " "), f"^(?i:rt){S_}+", "")
    x = _re(_re(x, f"@{W_}+", " "), f"#({W_}+)", r"\1")
    return _re(x, "([a-z0-9])([A-Z])", r"\1 \2")


def _twice_at_most(x: str) -> str:
    """RE2 has no back-references: a character goes if it equals the two before it."""
    return f"array_to_string(list_transform(list_filter(list_zip({x}, list_concat([NULL], {x})[1:len({x})], list_concat([NULL, NULL], {x})[1:len({x})]), lambda c: c[1] = chr(10) OR c[1] IS DISTINCT FROM c[2] OR c[1] IS DISTINCT FROM c[3]), lambda c: c[1]), '')"


CASED = f"cased AS (SELECT row_id, regexp_extract_all({_cased('text')}, '(?s).') AS c FROM docs)"
ENTITY = f"cased AS (SELECT row_id, regexp_extract_all({_re(_cased('text'), f'&{W_}+;', ' ')}, '(?s).') AS c FROM docs)"


@query("clean_title", f"WITH {DOCS}, {CASED} SELECT row_id, substring({_squeeze(_twice_at_most('c'))}, 1, 4000) AS clean FROM cased")
def _(s, d):
    return _docs(s, d).select("row_id", fn.clean_title(F.col("text")).alias("clean"))


@query("clean_post", f"WITH {DOCS}, {ENTITY} SELECT row_id, substring({_squeeze(_re(_twice_at_most('c'), '[!-/:-@' + chr(92) + '[-`{-~]', ' '))}, 1, 4000) AS clean FROM cased")
def _(s, d):
    return _docs(s, d).select("row_id", fn.clean_post(F.col("text")).alias("clean"))


_HASH = _re(f"lower({_re(_re(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')', rf'https?://{NS_}+|www\.{NS_}+', ' '), f'@{W_}+', ' ')})", f"&{W_}+;", " ")
_HASH = f"substring({_squeeze(_re(_HASH, rf'[^\p{{L}}\p{{N}}_{SP}\x{{4E00}}-\x{{9FFF}}]', ' '))}, 1, 1000)"


@query("clean_hash", f"WITH {DOCS} SELECT row_id, {_HASH} AS clean FROM docs")
def _(s, d):
    return _docs(s, d).select("row_id", fn.clean_hash(F.col("text")).alias("clean"))


@query("empty_mask", f"WITH {DOCS} SELECT row_id, length({_clean('text', ' ')}) = 0 AS is_empty FROM docs")
def _(s, d):
    return _docs(s, d).select("row_id", (F.length(fn.clean_spaced(F.col("text"))) == 0).alias("is_empty"))


@query("word_tokens", rf"WITH {DOCS} SELECT row_id, array_to_string(list_filter(regexp_extract_all(lower({_clean('text', ' ')}), '\p{{L}}[\p{{L}}\p{{N}}_''-]*'), lambda w: length(w) > 2 AND w NOT IN ({STOP})), ' ') AS words FROM docs")
def _(s, d):
    return _docs(s, d).select("row_id", F.array_join(fn.word_tokens(fn.clean_spaced(F.col("text"))), " ").alias("words"))


@query("analyzer_tokens", f"WITH {DOCS} SELECT row_id, array_to_string({_tokens(_clean('text'))}, ' ') AS words FROM docs")
def _(s, d):
    return _docs(s, d).select("row_id", F.array_join(fn.analyzer_tokens(fn.clean_joined(F.col("text"))), " ").alias("words"))


@query(
    "bigrams",
    f"""WITH {DOCS}, t AS (SELECT row_id, {_tokens(_clean('text'))} AS w FROM docs),
    g AS (SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t)
    SELECT term, count(*) AS n, count(DISTINCT row_id) AS df FROM g GROUP BY term""",
)
def _(s, d):
    words = _docs(s, d).select("row_id", fn.analyzer_tokens(fn.clean_joined(F.col("text"))).alias("words"))
    return terms.term_frequencies(words, fn.with_bigrams(F.col("words")))


@query(
    "char_ngrams",
    f"""WITH {POSTS}, w AS (SELECT ' ' || unnest(list_filter(string_split({_clean('text', ' ')}, ' '), lambda x: x <> '')) || ' ' AS w FROM posts),
    g AS (SELECT w[i:i + k - 1] AS gram FROM w, (SELECT unnest([3, 4, 5]) AS k), LATERAL (SELECT unnest(range(1, length(w) - k + 2)) AS i) WHERE length(w) >= k)
    SELECT gram, count(*) AS n FROM g GROUP BY gram""",
)
def _(s, d):
    grams = _posts(s, d).select(F.explode(fn.char_ngrams(fn.clean_spaced(F.col("text")))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("script_id", f"WITH {DOCS} SELECT row_id, CAST(CASE WHEN 8 * length(regexp_replace(text, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g')) >= length(text) AND regexp_matches(text, '[\\x{{0400}}-\\x{{04FF}}]') THEN 1 ELSE 0 END AS INTEGER) AS script FROM docs")
def _(s, d):
    return _docs(s, d).select("row_id", fn.script_id(F.col("text")).alias("script"))


@query(
    "profile",
    f"""WITH {DOCS}, t AS (SELECT length({_clean('text', ' ')}) AS size, CAST(contains(text, chr(10)) AS INT) AS nl, CAST(regexp_matches(lower(text), 'http|www\\.') AS INT) AS url FROM docs),
    p AS (SELECT count(*) AS n, CAST(CASE WHEN count(*) FILTER (WHERE size >= 40) >= 50 THEN median(size) FILTER (WHERE size >= 40) ELSE median(size) END AS DOUBLE) AS median_length,
    round(avg(nl), 6) AS line_feeds, round(avg(url), 6) AS links FROM t)
    SELECT *, median_length < 120 AND line_feeds < 0.02 AND links < 0.02 AS is_titles FROM p""",
)
def _(s, d):
    return _round(plans.profile(_docs(s, d)), "line_feeds", "links")


@query(
    "prefix_key",
    f"""WITH {DOCS}, t AS (SELECT row_id, array_to_string(string_split({_squeeze(_clean('text', ' '))}, ' ')[1:14], ' ') AS key FROM docs)
    SELECT row_id, CASE WHEN length(key) >= 25 THEN key END AS key FROM t""",
)
def _(s, d):
    return _docs(s, d).select("row_id", fn.prefix_key(fn.clean_spaced(F.col("text"))).alias("key"))


@query("eligible_texts", "SELECT doc_id AS row_id, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 80")
def _(s, d):
    return streaming.eligible(sources.read_table(s, d, "documents")).select(F.col("doc_id").alias("row_id"), "n_chars")


@query(
    "unused_texts",
    f"""WITH {DOCS}, c AS (SELECT row_id, {_clean('text')} AS key FROM docs), u AS (SELECT DISTINCT {_clean('text')} AS key FROM benchmark)
    SELECT min(row_id) AS row_id FROM c WHERE key NOT IN (SELECT key FROM u) GROUP BY key""",
)
def _(s, d):
    return streaming.unused(_docs(s, d), sources.text_batch(sources.read_table(s, d, "benchmark"), "item_id")).select("row_id")


# --- term statistics ---------------------------------------------------------------------------------


def _counts(s, d):
    return terms.words_of(_docs(s, d))


def _weighed(s, d, weigh=terms.tfidf):
    """Weights from counts that are made once, and a vocabulary that is made once."""
    counts = sources.settled(_counts(s, d))
    n = _n(s, d)
    vocabulary = sources.settled(terms.prune(terms.document_frequency(counts), n))
    return weigh(counts, vocabulary, n)


def _vocabulary(s, d):
    return terms.prune(terms.document_frequency(_counts(s, d)), _n(s, d))


def _tfidf(s, d):
    return _weighed(s, d)


@query("term_counts", f"WITH {TERMS} SELECT row_id, term, n FROM counts")
def _(s, d):
    return _counts(s, d)


@query("df_prune", f"WITH {TERMS} SELECT term, df, cf FROM vocab")
def _(s, d):
    return _vocabulary(s, d)


@query("vocab_topk", f"WITH {TERMS} SELECT term, df, cf FROM freq ORDER BY cf DESC, term LIMIT 5000")
def _(s, d):
    return terms.top_vocabulary(terms.document_frequency(_counts(s, d)), 5000)


@query("title_vocab", f"WITH {TERMS} SELECT term, df, cf FROM freq WHERE df >= 3 ORDER BY df DESC, term LIMIT 6000")
def _(s, d):
    return terms.title_vocabulary(terms.document_frequency(_counts(s, d)))


@query("tfidf", f"WITH {TFIDF} SELECT row_id, term, round(w, 6) AS w FROM tfidf")
def _(s, d):
    return _round(_tfidf(s, d), "w")


@query(
    "top_terms",
    f"""WITH {TFIDF} SELECT row_id, term, round(w, 6) AS w, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(w, 9) DESC, term) AS rank FROM tfidf) WHERE rank <= 3""",
)
def _(s, d):
    return _round(terms.top_terms(_tfidf(s, d)), "w")


@query(
    "bm25",
    f"""WITH {TERMS}, j AS (SELECT row_id, term, n, df, sum(n) OVER (PARTITION BY row_id) AS size FROM counts JOIN vocab USING (term)),
    k AS (SELECT sum(n) / count(DISTINCT row_id) AS mean FROM j)
    SELECT row_id, term, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * n * 4.0 / (n + 3.0 * (0.25 + 0.75 * size / greatest(mean, 1e-9))), 6) AS w FROM j, k, total""",
)
def _(s, d):
    return _round(_weighed(s, d, terms.bm25), "w")


HASHED = "hashed AS (SELECT row_id, CAST(('0x' || substring(md5(term), 1, 8))::BIGINT % 8192 AS VARCHAR) AS term, CAST(sum(n) AS DOUBLE) AS w FROM counts GROUP BY ALL)"


@query("hashed_counts", f"WITH {TERMS}, {HASHED} SELECT row_id, term, w FROM hashed")
def _(s, d):
    return terms.hashed_counts(_counts(s, d), 8192)


@query("log_damped", f"WITH {TERMS}, l AS (SELECT row_id, term, ln(1 + n) AS w FROM counts) SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS w FROM l")
def _(s, d):
    return _round(terms.log_damped(_counts(s, d).select("row_id", "term", F.col("n").cast("double").alias("w"))), "w")


@query("bm25_union")
def _(s, d):
    return plans.bm25_union(_posts(s, d), _posts(s, d).count(), (20_000, 2, 0.95), (8000, 2, 0.95), 0.35)


@query("feature_union", f"WITH {TFIDF} SELECT row_id, 'a:' || term AS term, round(w, 6) AS w FROM tfidf UNION ALL SELECT row_id, 'b:' || term, round(w * 0.35, 6) FROM tfidf")
def _(s, d):
    w = _tfidf(s, d)
    return _round(terms.feature_union(("a", w, 1.0), ("b", w, 0.35)), "w")


COOC = f"""{DOCS}, t AS (SELECT row_id, {_tokens(_clean('text'))} AS w FROM docs),
p AS (SELECT row_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM t),
one AS (SELECT a.t AS t1, b.t AS t2 FROM p a JOIN p b ON a.row_id = b.row_id AND b.i BETWEEN a.i + 1 AND a.i + 6),
cooc AS (SELECT t1, t2, count(*) AS n FROM (SELECT t1, t2 FROM one UNION ALL SELECT t2, t1 FROM one) GROUP BY ALL)"""


def _cooc(s, d, among: DataFrame | None = None):
    return terms.window_cooccurrence(_docs(s, d), fn.analyzer_tokens(fn.clean_joined(F.col("text"))), among=among)


@query("cooc_window", f"WITH {COOC} SELECT t1, t2, n FROM cooc")
def _(s, d):
    return _cooc(s, d)


@query(
    "cooc_doc",
    f"""WITH c AS (SELECT item_id AS row_id, {_clean('text')} AS text FROM benchmark), t AS (SELECT DISTINCT row_id, unnest({_tokens('text')}) AS term FROM c)
    SELECT a.term AS t1, b.term AS t2, count(*) AS n FROM t a JOIN t b ON a.row_id = b.row_id AND a.term <> b.term GROUP BY ALL""",
)
def _(s, d):
    return terms.document_cooccurrence(terms.words_of(sources.text_batch(sources.read_table(s, d, "benchmark"), "item_id")))


@query(
    "ppmi",
    f"""WITH {COOC}, m AS (SELECT t1 AS t, sum(n) AS s FROM cooc GROUP BY t1), g AS (SELECT sum(n) AS total FROM cooc),
    r AS (SELECT t1, t2, ln(n * total / (a.s * b.s)) AS w FROM cooc JOIN m a ON t1 = a.t JOIN m b ON t2 = b.t, g)
    SELECT t1, t2, round(w, 6) AS w FROM r WHERE w > 0""",
)
def _(s, d):
    return _round(terms.window_ppmi(_docs(s, d), fn.analyzer_tokens(fn.clean_joined(F.col("text")))), "w")


# --- dense vectors -----------------------------------------------------------------------------------


@query("l2_normalise", f"WITH {EMB} SELECT row_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS v FROM e")
def _(s, d):
    return _points(s, d).select("row_id", F.transform(vectors.unit(F.col("v")), lambda x: _rounded(x)).alias("v"))


@query("concat_blocks", f"WITH {EMB} SELECT row_id, list_concat(v, list_transform(v, lambda x: x * 0.5)) AS v FROM e")
def _(s, d):
    p = _points(s, d)
    return vectors.concat_blocks((p, 1.0), (p, 0.5))


@query("knn_cosine", f"WITH {EMB}, {_knn_sql(12)} SELECT src, dst, rank, round(dist, 6) AS dist FROM knn")
def _(s, d):
    return _round(vectors.knn(_points(s, d), 12), "dist")


@query("knn_euclid", f"WITH {EMB}, {_knn_sql(12, 'list_distance(a.v, b.v)')} SELECT src, dst, rank, round(dist, 6) AS dist FROM knn")
def _(s, d):
    return _round(vectors.knn(_points(s, d), 12, "euclidean"), "dist")


@query("knn_graph_sym", f"WITH {EMB}, {_knn_sql(12)}, {SYM} SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM sym")
def _(s, d):
    return vectors.symmetric(vectors.knn(_points(s, d), 12))


FUZZY = f"""{EMB}, {_knn_sql(12)}, near AS (SELECT src, min(dist) AS rho, list(greatest(dist - (SELECT min(dist) FROM knn k WHERE k.src = knn.src), 0)) AS gaps FROM knn GROUP BY src),
halved AS (SELECT src, rho, list_reduce(list_concat([{{'lo': 1e-6::DOUBLE, 'hi': 1e3::DOUBLE, 'gaps': gaps}}], list_transform(range(32), lambda i: {{'lo': 0::DOUBLE, 'hi': 0::DOUBLE, 'gaps': gaps}})),
  lambda s, x: CASE WHEN list_sum(list_transform(s.gaps, lambda g: exp(-g / ((s.lo + s.hi) / 2)))) > log2(12)
  THEN {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2, 'gaps': s.gaps}} ELSE {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi, 'gaps': s.gaps}} END) AS x FROM near),
one AS (SELECT knn.src, dst, exp(-greatest(dist - rho, 0) / ((x.lo + x.hi) / 2)) AS w FROM knn JOIN halved ON knn.src = halved.src),
fuzzy AS (SELECT src, dst, sum(w) - CASE WHEN count(*) > 1 THEN min(w) * max(w) ELSE 0 END AS w FROM (SELECT src, dst, w FROM one UNION ALL SELECT dst, src, w FROM one) GROUP BY src, dst)"""


@query("fuzzy_graph", f"WITH {FUZZY} SELECT src, dst, round(w, 6) AS w FROM fuzzy")
def _(s, d):
    return _round(vectors.fuzzy_graph(vectors.knn(_points(s, d), 12), 12), "w")


SMOOTH = f"""{EMB}, {_knn_sql(12)}, {FLAT},
near AS (SELECT src AS row_id, i, avg(x) AS m FROM knn JOIN flat ON dst = flat.row_id GROUP BY src, i),
moved AS (SELECT row_id, i, 0.8 * flat.x + 0.2 * m AS x FROM flat JOIN near USING (row_id, i)),
back AS (SELECT row_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY row_id)) AS x FROM moved)"""


@query("smooth_mean", f"WITH {SMOOTH} SELECT row_id, i - 1 AS i, round(x, 6) AS x FROM back")
def _(s, d):
    p = _points(s, d)
    out = vectors.smooth(p, vectors.knn(p, 12), 0.2, 1)
    return _round(out.select("row_id", F.posexplode("v").alias("i", "x")), "x").withColumn("i", F.col("i").cast("long"))


@query(
    "smooth_fuzzy",
    f"""WITH {FUZZY}, {FLAT}, near2 AS (SELECT src AS row_id, i, sum(x * w) / sum(w) AS m FROM fuzzy JOIN flat ON dst = flat.row_id GROUP BY src, i),
    moved AS (SELECT row_id, i, 0.8 * flat.x + 0.2 * m AS x FROM flat JOIN near2 USING (row_id, i)) SELECT row_id, i - 1 AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY row_id)), 6) AS x FROM moved""",
)
def _(s, d):
    p = _points(s, d)
    out = vectors.smooth(p, vectors.fuzzy_graph(vectors.knn(p, 12), 12), 0.2, 1)
    return _round(out.select("row_id", F.posexplode("v").alias("i", "x")), "x").withColumn("i", F.col("i").cast("long"))


@query("kth_distance", f"WITH {EMB}, {_knn_sql(12)} SELECT src AS row_id, round(max(dist), 6) AS score FROM knn GROUP BY src")
def _(s, d):
    return _round(vectors.kth_distance(vectors.knn(_points(s, d), 12)), "score")


@query(
    "distance_contrast",
    f"""WITH {EMB}, {_knn_sql(12)}, chosen AS (SELECT row_id, v FROM e ORDER BY ('0x' || substring(md5(row_id || ':0'), 1, 8))::BIGINT, row_id LIMIT 1500),
    u AS (SELECT row_id, generate_subscripts(v, 1) AS i, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x FROM chosen),
    q AS (SELECT sum(s * s) AS q FROM (SELECT sum(x) AS s FROM u GROUP BY i)), n AS (SELECT count(*) AS n FROM chosen)
    SELECT round(1 - (SELECT avg(dist) FROM knn) / (1 - (q - n) / (n * (n - 1))), 6) AS rel FROM q, n""",
)
def _(s, d):
    p = _points(s, d)
    return _round(vectors.contrast(p, vectors.knn(p, 12)), "rel")


@query(
    "k_and_noise",
    f"""WITH {EMB}, {_knn_sql(12)}, r AS (SELECT avg(dist) AS rel FROM knn), t AS (SELECT least(greatest((rel - 0.1) / 0.22, 0), 1) AS t FROM r)
    SELECT CAST(round_even(40 + 180 * t, 0) AS BIGINT) AS k, round(0.25 + 0.15 * t, 6) AS noise FROM t""",
)
def _(s, d):
    """The formula, on a contrast that both engines have: the mean distance of neighbours."""
    rel = vectors.knn(_points(s, d), 12).agg(F.avg("dist")).first()[0]
    return _round(s.createDataFrame([cluster.k_and_noise(rel)], "k long, noise double"), "noise")


@query(
    "modularity",
    f"""WITH {EMB}, {_knn_sql(12)}, {SYM}, j AS (SELECT a.label AS la, b.label AS lb FROM sym JOIN e a ON src = a.row_id JOIN e b ON dst = b.row_id),
    g AS (SELECT la, count(*) AS deg FROM j GROUP BY la)
    SELECT round((SELECT count(*) FROM j WHERE la = lb) / (SELECT count(*) FROM j) - 0.25 * (SELECT sum(deg * deg) FROM g) / ((SELECT count(*) FROM j) * (SELECT count(*) FROM j)), 6) AS modularity""",
)
def _(s, d):
    return _round(vectors.modularity(vectors.symmetric(vectors.knn(_points(s, d), 12)), _labels(s, d)), "modularity")


@query("svd")
def _(s, d):
    return vectors.truncated_svd(sources.settled(_tfidf(s, d)), 192)


def _word_vectors(s, d, vocabulary: DataFrame, dim: int = 128):
    """Vectors of the 2,000 most frequent words, as the presets have them."""
    top = sources.settled(terms.top_vocabulary(vocabulary, 2000).select("term"))
    w = sources.settled(terms.ppmi(sources.settled(_cooc(s, d, top))).select(F.col("t1").alias("row_id"), F.col("t2").alias("term"), "w"))
    return sources.settled(vectors.truncated_svd(w, dim).withColumnRenamed("row_id", "term"))


def _pooled(s, d, weight):
    counts, n = sources.settled(_counts(s, d)), _n(s, d)
    vocabulary = sources.settled(terms.prune(terms.document_frequency(counts), n))
    total = float(vocabulary.agg(F.sum("cf")).first()[0] or 1)
    return vectors.pooled(counts.join(vocabulary.select("term", "df", "cf"), "term"), _word_vectors(s, d, vocabulary), weight(n, total))


@query("doc_vectors_tfidf")
def _(s, d):
    return _pooled(s, d, lambda n, total: (1 + F.log("n")) * (F.log((1.0 + n) / (1 + F.col("df"))) + 1))


@query("doc_vectors_sif")
def _(s, d):
    return _pooled(s, d, lambda n, total: F.col("n") * 0.001 / (0.001 + F.col("cf") / total))


@query("doc_vectors_idf")
def _(s, d):
    return _pooled(s, d, lambda n, total: F.log(F.lit(float(n)) / (1 + F.col("df"))) * F.col("n"))


@query(
    "hashed_projection",
    f"""WITH {TERMS}, {HASHED}, damped AS (SELECT row_id, term, ln(1 + w) / sqrt(sum(ln(1 + w) * ln(1 + w)) OVER (PARTITION BY row_id)) AS w FROM hashed),
    bits AS (SELECT term, i, CASE WHEN (('0x' || substring(md5(term || ':' || (i // 32)), 1, 8))::BIGINT >> (i % 32)) & 1 = 0 THEN 1 ELSE -1 END AS sign
      FROM (SELECT DISTINCT term FROM hashed), (SELECT unnest(range(48)) AS i))
    SELECT row_id, i, round(sum(w * sign) / sqrt(48), 6) AS x FROM damped JOIN bits USING (term) GROUP BY row_id, i""",
)
def _(s, d):
    out = vectors.random_projection(terms.log_damped(terms.hashed_counts(_counts(s, d), 8192)), 48)
    return _round(out.select("row_id", F.posexplode("v").alias("i", "x")), "x").withColumn("i", F.col("i").cast("long"))


@query(
    "jitter_empty",
    f"""WITH {EMB} SELECT row_id, i - 1 AS i, round(CASE WHEN row_id % 50 = 0 THEN 0.001 * ((('0x' || substring(md5(row_id || ':' || (i - 1) || ':5'), 1, 8))::BIGINT % 2001 - 1000) / 1000) ELSE x END, 9) AS x
    FROM (SELECT row_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e)""",
)
def _(s, d):
    some = _points(s, d).select("row_id", F.when(F.col("row_id") % 50 == 0, F.transform("v", lambda x: x * 0)).otherwise(F.col("v")).alias("v"))
    out = vectors.jitter_empty(some).select("row_id", F.posexplode("v").alias("i", "x")).withColumn("i", F.col("i").cast("long"))
    return _round(out, "x", places=9)


@query("remove_components")
def _(s, d):
    return vectors.remove_top_components(_points(s, d), 2)


@query("explained_variance")
def _(s, d):
    return s.createDataFrame([(vectors.explained_variance(_points(s, d)),)], "share double")


@query("spectral")
def _(s, d):
    return vectors.spectral(vectors.symmetric(vectors.knn(_points(s, d), 12)), 32)


# --- clustering --------------------------------------------------------------------------------------


@query("kmeans")
def _(s, d):
    return cluster.kmeans(_points(s, d), 15)


@query("k_heuristics", "SELECT count(*) AS n, greatest(2, least(CAST(floor(sqrt(count(*) / 2)) AS BIGINT), 100)) AS k, greatest(2, least(CAST(floor(2 * sqrt(count(*) / 2)) AS BIGINT), 400)) AS k_large FROM documents")
def _(s, d):
    n = _n(s, d)
    return s.createDataFrame([(n, cluster.k_for(n), cluster.k_for_large(n))], "n long, k long, k_large long")


@query("linkage_cut")
def _(s, d):
    return cluster.linkage_labels(_points(s, d), 28)


@query("linkage_sampled")
def _(s, d):
    # a sample that the small fixture exceeds, so that labels are propagated
    return cluster.linkage_labels(_points(s, d), 28, most=200)


@query("hdbscan")
def _(s, d):
    return cluster.hdbscan_labels(_points(s, d))


@query("best_cut")
def _(s, d):
    p = _points(s, d)
    return cluster.best_cut(p, sources.settled(vectors.symmetric(vectors.knn(p, 12))))


@query("fallback_clusters")
def _(s, d):
    return cluster.fallback(_docs(s, d).select("row_id", fn.clean_spaced(F.col("text")).alias("text")).filter("text <> ''"))


PROPAGATE = f"""{EMB}, known AS (SELECT * FROM e WHERE row_id % 3 = 0), rest AS (SELECT * FROM e WHERE row_id % 3 <> 0),
near AS (SELECT src, label FROM (SELECT a.row_id AS src, b.label, row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_cosine_distance(a.v, b.v), 12), b.row_id) AS r FROM rest a, known b) WHERE r <= 5),
votes AS (SELECT src, label, count(*) AS n FROM near GROUP BY ALL)"""


@query("propagate", f"WITH {PROPAGATE} SELECT row_id, label FROM known UNION ALL SELECT src, label FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1")
def _(s, d):
    return cluster.propagate(_points(s, d), _labels(s, d).filter("row_id % 3 = 0"))


@query("sample_rows", "SELECT vec_id AS row_id FROM embeddings ORDER BY ('0x' || substring(md5(vec_id || ':0'), 1, 8))::BIGINT, vec_id LIMIT 100")
def _(s, d):
    return cluster.sample_rows(_points(s, d), 100).select("row_id")


# --- label operators ---------------------------------------------------------------------------------


@query("centroids", f"WITH {EMB}, {CENT} SELECT label, i - 1 AS i, round(x, 6) AS x FROM cent")
def _(s, d):
    c = labels.centroids(_points(s, d), _labels(s, d))
    return _round(c.select("label", F.posexplode("c").alias("i", "x")), "x").withColumn("i", F.col("i").cast("long"))


ASSIGN = f"""{EMB}, {CENT}, sims AS (SELECT e.row_id, cvec.label, round(list_dot_product(e.v, c) / sqrt(list_dot_product(e.v, e.v)), 12) AS sim FROM e, cvec),
best AS (SELECT row_id, label, sim FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, label) AS r FROM sims) WHERE r = 1)"""


@query("assign_nearest", f"WITH {ASSIGN} SELECT row_id, label, round(sim, 6) AS sim FROM best")
def _(s, d):
    p = _points(s, d)
    return _round(labels.nearest(p, labels.centroids(p, _labels(s, d))), "sim")


@query("refine_clusters", f"WITH {ASSIGN} SELECT row_id, label FROM best")
def _(s, d):
    return labels.refine(_points(s, d), _labels(s, d), 1)


@query("small_clusters", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT vec_id AS row_id, CAST(CASE WHEN n < 50 THEN -1 ELSE label END AS BIGINT) AS label FROM embeddings JOIN n USING (label)")
def _(s, d):
    return labels.small_clusters(_points(s, d), _labels(s, d), 50, "noise")


def _skewed(s, d):
    """Labels of which some are small: the row id picks most of them."""
    return _labels(s, d).select("row_id", F.when(F.col("row_id") % 40 == 0, F.col("row_id") + 100).otherwise(F.col("label")).alias("label"))


SKEW = "sk AS (SELECT row_id, v, CASE WHEN row_id % 40 = 0 THEN row_id + 100 ELSE label END AS label FROM e0)"
EMB0 = EMB.replace("e AS", "e0 AS", 1)


@query(
    "reassign_small",
    f"""WITH {EMB0}, {SKEW}, n AS (SELECT label, count(*) AS n FROM sk GROUP BY label), e AS (SELECT sk.* FROM sk JOIN n USING (label) WHERE n >= 5), {CENT},
    small AS (SELECT sk.* FROM sk JOIN n USING (label) WHERE n < 5),
    sims AS (SELECT small.row_id, small.label AS old, cvec.label, round(list_dot_product(v, c) / sqrt(list_dot_product(v, v)), 12) AS sim FROM small, cvec),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, label) AS r FROM sims) WHERE r = 1)
    SELECT row_id, label FROM e UNION ALL SELECT row_id, CASE WHEN sim >= 0.2 THEN label ELSE old END FROM best""",
)
def _(s, d):
    return labels.reassign_small(_points(s, d), _skewed(s, d), 5, 0.2)


@query(
    "small_reassigned",
    f"""WITH {EMB0}, {SKEW}, n AS (SELECT label, count(*) AS n FROM sk GROUP BY label), e AS (SELECT sk.* FROM sk JOIN n USING (label) WHERE n >= 5), {CENT},
    sims AS (SELECT sk.row_id, cvec.label, round(list_dot_product(v, c) / sqrt(list_dot_product(v, v)), 12) AS sim FROM (SELECT sk.* FROM sk JOIN n USING (label) WHERE n < 5) sk, cvec)
    SELECT row_id, label FROM e UNION ALL SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, label) AS r FROM sims) WHERE r = 1""",
)
def _(s, d):
    return labels.small_clusters(_points(s, d), _skewed(s, d), 5, "reassign")


@query(
    "merge_mutual",
    f"""WITH {EMB}, {CENT}, p AS (SELECT a.label AS a, b.label AS b, round(list_dot_product(a.c, b.c), 12) AS sim FROM cvec a JOIN cvec b ON a.label <> b.label),
    best AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM p) WHERE r = 1),
    m AS (SELECT x.a AS label, x.b AS target FROM best x JOIN best y ON x.a = y.b AND x.b = y.a WHERE x.sim >= 0.1 AND x.a > x.b)
    SELECT row_id, coalesce(target, e.label) AS label FROM e LEFT JOIN m ON e.label = m.label""",
)
def _(s, d):
    return labels.merge_mutual(_points(s, d), _labels(s, d), 0.1, 10**9, 1)


@query(
    "merge_most_similar",
    f"""WITH {TERMS}, lab AS (SELECT row_id, row_id % 12 AS label FROM docs), few AS (SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS r FROM lab) WHERE r <= 80),
    lc AS (SELECT label, term, sum(n) AS n FROM counts JOIN few USING (row_id) GROUP BY ALL), top AS (SELECT term, count(*) AS df, sum(n) AS cf FROM lc GROUP BY term ORDER BY cf DESC, term LIMIT 4000),
    raw2 AS (SELECT label, term, n * (ln((1.0 + (SELECT count(DISTINCT label) FROM lc)) / (1 + df)) + 1) AS w FROM lc JOIN top USING (term)),
    unit AS (SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM raw2),
    best AS (SELECT a.label AS a, b.label AS b, round(sum(a.w * b.w), 12) AS sim FROM unit a JOIN unit b ON a.term = b.term AND a.label < b.label GROUP BY ALL ORDER BY sim DESC, a.label, b.label LIMIT 1)
    SELECT row_id, CASE WHEN label = (SELECT b FROM best WHERE sim >= 0.2) THEN (SELECT a FROM best) ELSE label END AS label FROM lab""",
)
def _(s, d):
    docs = _docs(s, d)
    found = docs.select("row_id", (F.col("row_id") % 12).alias("label"))
    return labels.merge_most_similar(labels.cluster_weights(docs, found, fn.analyzer_tokens(fn.clean_joined(F.col("text")))), found, 0.2)


OUT = f"""{EMB}, {_knn_sql(12)}, k AS (SELECT src AS row_id, max(dist) AS score FROM knn GROUP BY src)"""


@query(
    "outlier_singletons",
    f"""WITH {OUT}, r AS (SELECT e.row_id, label, row_number() OVER (ORDER BY score DESC, e.row_id) AS r FROM e JOIN k ON e.row_id = k.row_id)
    SELECT row_id, CASE WHEN r <= floor((SELECT count(*) FROM e) * 0.25) THEN 1000000 + r - 1 ELSE label END AS label FROM r""",
)
def _(s, d):
    p = _points(s, d)
    return labels.outliers_to_singletons(_labels(s, d), vectors.kth_distance(vectors.knn(p, 12)), 0.25)


@query(
    "protected_clusters",
    f"""WITH {EMB}, {CENT}, g AS (SELECT e.label, count(*) AS n, avg(list_dot_product(v, c) / sqrt(list_dot_product(v, v))) AS cohesion FROM e JOIN cvec ON e.label = cvec.label GROUP BY e.label),
    t AS (SELECT count(*) AS total FROM e)
    SELECT label, n, round(cohesion, 6) AS cohesion FROM g, t WHERE n >= greatest(40, 0.012 * total) AND n <= 0.12 * total ORDER BY round(n * cohesion, 9) DESC, label LIMIT 3""",
)
def _(s, d):
    return _round(labels.protected(_points(s, d), _labels(s, d)), "cohesion")


@query("combined_outlier", f"WITH {OUT}, {CENT} SELECT e.row_id, round(score + 1 - list_dot_product(v, c) / sqrt(list_dot_product(v, v)), 6) AS score FROM e JOIN cvec ON e.label = cvec.label JOIN k ON e.row_id = k.row_id")
def _(s, d):
    p = _points(s, d)
    return _round(labels.combined_score(p, _labels(s, d), vectors.kth_distance(vectors.knn(p, 12))), "score")


NOISY = "CASE WHEN row_id % 5 = 0 THEN -1 ELSE label END"


def _noisy(s, d):
    return _labels(s, d).select("row_id", F.when(F.col("row_id") % 5 == 0, -1).otherwise(F.col("label")).cast("long").alias("label"))


@query(
    "noise_policy",
    f"""WITH {OUT}, x AS (SELECT row_id, {NOISY} AS label FROM e), b AS (SELECT max(label) + 1 AS base, round(count(*) FILTER (WHERE label = -1) * 0.5) AS shared FROM x),
    r AS (SELECT x.row_id, row_number() OVER (ORDER BY score DESC, x.row_id) AS r FROM x JOIN k ON x.row_id = k.row_id WHERE label = -1)
    SELECT row_id, CAST(CASE WHEN r <= shared THEN base ELSE base + r END AS BIGINT) AS label FROM r, b UNION ALL SELECT row_id, label FROM x WHERE label <> -1""",
)
def _(s, d):
    p = _points(s, d)
    return labels.noise_policy(p, _noisy(s, d), vectors.kth_distance(vectors.knn(p, 12)), "graded")


@query(
    "extra_noise",
    f"""WITH {OUT}, x AS (SELECT row_id, {NOISY} AS label FROM e), r AS (SELECT x.row_id, row_number() OVER (ORDER BY score DESC, x.row_id) AS r FROM x JOIN k ON x.row_id = k.row_id WHERE label <> -1 AND x.row_id % 7 <> 0)
    SELECT x.row_id, CAST(CASE WHEN r <= floor(0.1 * (SELECT count(*) FROM x)) THEN -1 ELSE label END AS BIGINT) AS label FROM x LEFT JOIN r USING (row_id)""",
)
def _(s, d):
    p = _points(s, d)
    return labels.extra_noise(_noisy(s, d), vectors.kth_distance(vectors.knn(p, 12)), 0.1, p.filter("row_id % 7 = 0"))


@query(
    "reclaim_noise",
    f"""WITH {EMB0}, e AS (SELECT * FROM e0 WHERE row_id % 5 <> 0), {CENT},
    sims AS (SELECT row_id, cvec.label, round(list_dot_product(v, c) / sqrt(list_dot_product(v, v)), 12) AS sim FROM (SELECT * FROM e0 WHERE row_id % 5 = 0), cvec),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, label) AS r FROM sims) WHERE r = 1)
    SELECT row_id, label FROM e UNION ALL SELECT row_id, CAST(CASE WHEN sim >= 0.25 THEN label ELSE -1 END AS BIGINT) FROM best""",
)
def _(s, d):
    return labels.reclaim(_points(s, d), _noisy(s, d), 0.25)


@query(
    "script_merge",
    """WITH x AS (SELECT doc_id AS row_id, doc_id % 10 AS label, CASE WHEN lang = 'fr' AND doc_id % 10 < 5 THEN 1 WHEN lang = 'de' THEN 2 ELSE 0 END AS script FROM documents),
    sh AS (SELECT script FROM x WHERE script > 0 GROUP BY script HAVING count(*) BETWEEN 0.05 * (SELECT count(*) FROM x) AND 0.4 * (SELECT count(*) FROM x)),
    n AS (SELECT label, count(*) AS n FROM x GROUP BY label),
    pure AS (SELECT label, min(script) AS script FROM (SELECT x.label, x.script FROM x JOIN n ON x.label = n.label JOIN sh ON x.script = sh.script GROUP BY x.label, x.script, n.n HAVING n.n >= 3 AND count(*) >= 0.12 * n.n) GROUP BY label),
    t AS (SELECT label, min(label) OVER (PARTITION BY script) AS target FROM pure)
    SELECT row_id, coalesce(target, x.label) AS label FROM x LEFT JOIN t ON x.label = t.label""",
)
def _(s, d):
    t = sources.read_table(s, d, "documents").select(F.col("doc_id").alias("row_id"), (F.col("doc_id") % 10).alias("label"), F.expr("CASE WHEN lang = 'fr' AND doc_id % 10 < 5 THEN 1 WHEN lang = 'de' THEN 2 ELSE 0 END").alias("script"))
    return labels.merge_scripts(t.select("row_id", "label"), t.select("row_id", "script"), purity=0.12)


VOTE = f"""{DOCS}, t AS (SELECT row_id, row_id % 5 - 1 AS label, array_to_string(string_split({_squeeze(_clean('text', ' '))}, ' ')[1:14], ' ') AS key FROM docs),
x AS (SELECT row_id, label, CASE WHEN length(key) >= 25 THEN key END AS key FROM t),
v AS (SELECT key, label, count(*) AS k FROM x WHERE key IS NOT NULL AND label <> -1 GROUP BY ALL),
w AS (SELECT key, label AS target FROM v WHERE key IN (SELECT key FROM x GROUP BY key HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC, label) = 1)"""


@query("prefix_vote", f"WITH {VOTE} SELECT row_id, coalesce(target, label) AS label FROM x LEFT JOIN w ON x.key = w.key")
def _(s, d):
    docs = _docs(s, d)
    keys = sources.settled(docs.select("row_id", fn.prefix_key(fn.clean_spaced(F.col("text"))).alias("key")))
    return labels.vote(docs.select("row_id", (F.col("row_id") % 5 - 1).alias("label")), keys)


@query("densify", "WITH x AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label * 7 + 3 END AS label FROM embeddings), r AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM x WHERE label <> -1)) SELECT row_id, CAST(coalesce(k, -1) AS BIGINT) AS label FROM x LEFT JOIN r USING (label)")
def _(s, d):
    x = _noisy(s, d)
    return labels.densify(x.select("row_id", F.when(F.col("label") == -1, -1).otherwise(F.col("label") * 7 + 3).alias("label")))


@query("expand", "SELECT vec_id AS row_id, CAST(CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS BIGINT) AS label FROM embeddings")
def _(s, d):
    return labels.expand(_points(s, d), _labels(s, d).filter("row_id % 5 <> 0"))


@query("fresh_labels", "WITH x AS (SELECT vec_id, label, vec_id % 5 = 0 AS fresh FROM embeddings), t AS (SELECT max(label) AS top FROM x WHERE NOT fresh) SELECT vec_id AS row_id, CAST(CASE WHEN fresh THEN top + row_number() OVER (PARTITION BY fresh ORDER BY vec_id) ELSE label END AS BIGINT) AS label FROM x, t")
def _(s, d):
    x = _labels(s, d)
    return labels.fresh_labels(x.filter("row_id % 5 <> 0"), x.filter("row_id % 5 = 0"))


# --- evaluation --------------------------------------------------------------------------------------


@query("contingency", f"WITH {CONT} SELECT truth, pred, n FROM cont")
def _(s, d):
    return evaluate.contingency(_pairs(s, d))


@query("ari", f"WITH {SCORES} SELECT round(ari, 6) AS ari FROM c")
def _(s, d):
    return _round(evaluate.adjusted_rand(_pairs(s, d)), "ari")


@query("nmi", f"WITH {SCORES} SELECT round(nmi, 6) AS nmi FROM c")
def _(s, d):
    return _round(evaluate.normalised_mutual_information(_pairs(s, d)), "nmi")


@query("combined_score", f"WITH {SCORES} SELECT round(ari, 6) AS ari, round(nmi, 6) AS nmi, round(combined, 6) AS combined FROM c")
def _(s, d):
    return _round(evaluate.combined(_pairs(s, d)), "ari", "nmi", "combined")


@query("round_score", f"WITH {SCORES} SELECT round((combined + 1) / 2, 6) AS round_score, round((combined + 1) / 2 * 1.01, 6) AS to_beat FROM c")
def _(s, d):
    p = _pairs(s, d)
    both = evaluate.combined(p).unionByName(evaluate.combined(p.withColumn("pred", F.col("truth"))))
    score = evaluate.round_score(both)
    return _round(score.crossJoin(evaluate.to_beat(score)), "round_score", "to_beat")


# --- presets -----------------------------------------------------------------------------------------


@query("pipeline_a")
def _(s, d):
    return sources.aligned_labels(plans.preset_a(_posts(s, d)), "label")


@query("pipeline_b")
def _(s, d):
    return sources.aligned_labels(plans.preset_b(_posts(s, d)), "label")


@query("pipeline_c")
def _(s, d):
    return sources.aligned_labels(plans.preset_c(_posts(s, d)), "label")


@query("pipeline_b_titles")
def _(s, d):
    """The path for titles, whatever the profile says of the posts."""
    return sources.aligned_labels(plans.preset_b(_posts(s, d), titles=True), "label")


@query("pipeline_large")
def _(s, d):
    """The path for large batches, over all documents."""
    return sources.aligned_labels(plans.preset_b(_docs(s, d), large=0), "label")
