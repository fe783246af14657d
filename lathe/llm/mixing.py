"""Mixing a corpus to target weights with soft domain membership.

1. A multinomial naive Bayes model over all words of all labelled documents gives each document its
   posterior over domains. Words are counted by hash bucket, so that the model has a fixed number of
   rows whatever the vocabulary; a document's words meet it in a join and are summed by document. One
   exponent for all documents, chosen by log loss on labelled documents held out of a first fit,
   tempers the evidence, since words of one document are not independent.
2. Nonnegative document rates r minimise the weighted squared distance of the expected domain totals
   sum_i r_i tokens_i p_i(d) from their targets, by projected gradient steps from r = 1 in the
   metric in which a document weighs its tokens. The unprojected steps add up to one number for each
   domain, so r_i = max(0, 1 + p_i . y), and each step is one aggregation over (tokens, posterior)
   that sends one row to the driver.

The targets are shares of the corpus's own number of tokens (keep), or of the least number at which no
domain has to shrink (cover), so that a corpus is mixed by repeating documents and none has to go. A
document is taken floor(r) times and once more with the probability of the fraction, decided by a hash
of its id.

Null or empty text has no tokens and the prior as its posterior; its rate moves nothing. Texts of any
length are used whole. A null id is a document like others. With no labels the posterior is even over
the targets' domains. Repeated rows count as often as they occur, each with its own tokens; an empty
table gives an empty result. Other columns, whatever their names, are carried in `row` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

#: Labels that are sent to every task (about 60 bytes each); more are joined by a shuffle.
MAX_SENT = 200_000
#: Rows of the model: hash buckets of words.
BUCKETS = 1 << 16
#: Exponents of the evidence that are tried, and the one that is used if no labelled row is left to try them on.
EXPONENTS = tuple(2.0**-k for k in range(11))
DEFAULT_EXPONENT = 2.0**-4


def words_of(text: Column) -> Column:
    """Lower-case words between ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class Model:
    """words: (bucket, w: centred log-likelihood of each domain), of BUCKETS rows at most; prior: logs; exponent."""

    def __init__(self, words: DataFrame, prior: np.ndarray, exponent: float = 1.0):
        self.words, self.prior, self.exponent = words, prior, exponent

    def score(self, exponent: float | None = None) -> Column:
        """Log-odds of each domain from the sums s0, s1 ... of a document."""
        e = self.exponent if exponent is None else exponent
        return F.array(*(F.col(f"s{i}") * e + F.lit(float(p)) for i, p in enumerate(self.prior)))


def labelled_rows(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, text, domain) of all labelled rows; the least domain of an id counts."""
    labelled = labelled.select(F.col(id_col).alias("id"), "domain").dropna().filter(F.col("domain").isin(domains))
    labelled = labelled.groupBy("id").agg(F.min("domain").alias("domain"))
    few = labelled.count() <= MAX_SENT
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(labelled) if few else labelled.hint("merge"), "id")


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of all labelled rows, tempered by one of three in four on the others. labelled: (id_col, domain)."""
    rows = scratch.save(labelled_rows(docs, labelled, domains, id_col, text_col), "labelled")
    tried = F.pmod(F.xxhash64(F.lit("tried"), "id"), F.lit(4)) == 0
    counts = rows.select("domain", tried.alias("tried"), F.explode(words_of(F.col("text"))).alias("word")).groupBy(bucket_of(F.col("word")).alias("bucket")).agg(
        *(F.count(F.when((F.col("domain") == d) & ~F.col("tried"), 1)).alias(f"c{i}") for i, d in enumerate(domains)),
        *(F.count(F.when(F.col("domain") == d, 1)).alias(f"a{i}") for i, d in enumerate(domains)),
    )
    counts = scratch.save(counts, "counts")
    part = _model(counts, "c", domains, scratch)
    sums = word_sums(rows.filter(tried).select(F.struct("id", "domain").alias("key"), "text"), part, "key")
    # one row comes back: the log loss of every exponent
    loss = [F.sum(_log_loss(part.score(e), F.array_position(F.array(*map(F.lit, domains)), F.col("key.domain")))) for e in EXPONENTS]
    found = sums.agg(*loss).first()
    model = _model(counts, "a", domains, scratch)
    model.exponent = EXPONENTS[int(np.argmin(found))] if found[0] is not None else DEFAULT_EXPONENT
    return model


def _model(counts: DataFrame, name: str, domains: list[str], scratch: Scratch) -> Model:
    """Naive Bayes from the counts name0, name1 ... of each bucket."""
    n = [f"{name}{i}" for i in range(len(domains))]
    # priors by words rather than rows, as the totals to be matched count words
    size = np.array([float(x or 0) for x in counts.agg(*map(F.sum, n)).first()])
    prior = np.log((size + 1) / (size + 1).sum())
    w = F.array(*(F.log((F.col(c) + 0.1) / F.lit(size[i] + 0.1 * BUCKETS)) for i, c in enumerate(n)))
    # centred, so that a bucket outside the model says nothing
    mean = F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / len(domains)
    seen = counts.filter(sum(map(F.col, n)) > 0)
    return Model(scratch.save(seen.select("bucket", F.transform(w, lambda x: x - mean).alias("w")), f"model-{name}"), prior)


def _log_loss(score: Column, right: Column) -> Column:
    top = F.array_max(score)
    return top + F.log(F.aggregate(score, F.lit(0.0), lambda a, x: a + F.exp(x - top))) - F.get(score, (right - 1).cast("int"))


def word_sums(rows: DataFrame, model: Model, *keys: str) -> DataFrame:
    """(keys, tokens, s0, s1 ...) for every distinct key; rows of one key have one text, and sums are those of one row."""
    k = len(model.prior)
    rows = rows.select(*keys, F.posexplode_outer(words_of(F.col("text"))).alias("at", "word")).withColumn("bucket", bucket_of(F.col("word")))
    # at most BUCKETS rows: a bound that doesn't grow with docs
    flat = model.words.select("bucket", *(F.col("w")[i].alias(f"w{i}") for i in range(k)))
    rows = rows.join(F.broadcast(flat), "bucket", "left")
    copies = F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1))
    sums = rows.groupBy(*keys).agg(copies.alias("copies"), F.count("word").alias("n"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(k)))
    return sums.select(*keys, (F.col("n") / F.col("copies")).cast("long").alias("tokens"), "copies", *((F.col(f"t{i}") / F.col("copies")).alias(f"s{i}") for i in range(k)))


def posteriors(docs: DataFrame, model: Model, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, row_t, copies, tokens, p) for every distinct (id, text) of docs; copies: rows that hold it."""
    text = docs[text_col].cast("string")
    sums = word_sums(docs.select(docs[id_col].alias("row_id"), F.xxhash64(text).alias("row_t"), text.alias("text")), model, "row_id", "row_t")
    sums = sums.select("row_id", "row_t", "copies", "tokens", model.score().alias("score"))
    top = F.array_max("score")
    sums = sums.withColumn("e", F.transform("score", lambda x: F.exp(x - top)))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return scratch.save(sums.select("row_id", "row_t", "copies", "tokens", F.transform("e", lambda x: x / total).alias("p")), "posteriors")


def solve_rates(known: DataFrame, targets: np.ndarray, scale: str = "cover", rounds: int = 60, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(y, wanted totals): rates are max(0, 1 + p . y). known: (tokens, p), and copies if rows stand for several.

    Steps are scaled by the totals at r = 1, for which a step of 1 never overshoots, and carry momentum.
    """
    k = len(targets)
    copies = F.col("copies") if "copies" in known.columns else F.lit(1)

    def totals(y: np.ndarray) -> np.ndarray:
        rate = F.greatest(F.lit(0.0), sum((F.col("p")[i] * float(y[i]) for i in range(k)), F.lit(1.0)))
        row = known.agg(*(F.sum(rate * F.col("tokens") * copies * F.col("p")[i]).alias(f"t{i}") for i in range(k))).first()
        return np.array([row[i] or 0.0 for i in range(k)])

    now = totals(np.zeros(k))
    if not now.sum():
        return np.zeros(k), now
    share = targets / targets.sum()
    wanted = share * {"cover": (now[share > 0] / share[share > 0]).max(), "keep": now.sum()}[scale]
    base = np.maximum(now, 1e-9 * now.sum())
    y, lead, t = np.zeros(k), np.zeros(k), 1.0
    for _ in range(rounds):
        miss = (totals(lead) if lead.any() else now) - wanted
        if np.abs(miss).sum() <= tolerance * wanted.sum():
            return lead, wanted
        new = lead - miss / base
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (miss / base) @ (new - y) > 0:  # the momentum points uphill: start it again
            t, t_new = 1.0, 1.0
        lead = new + (t - 1) / t_new * (new - y)
        y, t = new, t_new
    return lead, wanted


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], scale: str = "cover", id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """Each row of docs as the struct `row`, with tokens, p (by the order of targets), domain, rate and copies.

    carried: the columns of docs in `row`, all by default; only these are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    domains = list(targets)
    model = fit(docs, labelled, domains, scratch, id_col=id_col, text_col=text_col)
    known = posteriors(docs, model, scratch, id_col, text_col)
    y, _ = solve_rates(known, np.array(list(targets.values()), float), scale)
    rate = F.greatest(F.lit(0.0), sum((F.col("p")[i] * float(y[i]) for i in range(len(domains))), F.lit(1.0)))
    text = docs[text_col].cast("string")
    rows = docs.select(F.struct(*(docs[c] for c in carried or docs.columns)).alias("row"), docs[id_col].alias("row_id"), F.xxhash64(text).alias("row_t"))
    known = known.select(F.col("row_id").alias("k_id"), F.col("row_t").alias("k_t"), "tokens", "p")
    out = rows.join(known, F.col("row_id").eqNullSafe(F.col("k_id")) & (F.col("row_t") == F.col("k_t"))).select("row", "row_id", "tokens", "p", rate.alias("rate"))
    chance = F.pmod(F.xxhash64(F.lit("copies"), "row_id"), F.lit(1_000_000)) / F.lit(1e6)
    copies = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    best = F.array_position("p", F.array_max("p")).cast("int")
    return out.select("row", "tokens", "p", F.element_at(F.array(*map(F.lit, domains)), best).alias("domain"), "rate", copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], scale: str = "cover") -> DataFrame:
    """docs with every document as often as the mix takes it."""
    taken = mix(docs, labelled, targets, scale).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


#: Domains of the labelled documents and their target weights.
TARGETS = {"en": 0.50, "de": 0.15, "fr": 0.15, "es": 0.11, "other": 0.09}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of good labelled documents; `other` for poor or toxic ones."""
    poor = (F.col("quality") == 0) | (F.col("toxic") == 1)
    lang = docs.select("doc_id", "lang").join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    return lang.select("doc_id", F.when(poor, "other").otherwise(F.col("lang")).alias("domain"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = mix(docs, labelled_domains(docs, labels), TARGETS, "keep", carried=["doc_id"])
    return out.select("row.doc_id", "tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)), "domain", "rate", "copies")
