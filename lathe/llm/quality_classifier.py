"""Quality classifier with hierarchical empirical Bayes.

A logistic model on counts of one text gives each document's evidence. Grouped aggregation sums the
document posteriors by host and by path; a site's rate is its own mean shrunk toward the level
above (path to host, host to the global rate), the more so the fewer documents it has. The strength
of shrinking at each level comes from the data by the method of moments. A document's quality is its
own evidence combined with its site's log-odds, from which its own share is taken out first. How much
the site counts is one weight, fitted on a quarter of the labelled documents with the evidence of a model
of the others: where sites say nothing of quality it is next to 0, where they do, a site moves verdicts
either way. The model that scores is fitted on all labelled documents. Both are fitted by Newton steps of
which each is one aggregation over a table of features.

Null text is scored as empty text; texts of any length are read whole. A null host or path is a site of
its own, apart from one named "". With no usable label of both kinds every document keeps the prior 0.5
and the evidence 0, so all are kept. Repeated rows count as often as they occur; repeated labels of one
id count once (the lowest); an empty table gives an empty result. Other columns, whatever their names,
pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table
from .textstats import Stats

#: Labels that are sent to every task (about 60 bytes each); more are joined by a shuffle.
MAX_SENT = 200_000
MOST = 1e4
#: Sites up to which their table is sent to every task (about 100 bytes each).
MAX_SITES = 200_000


def features(raw: bytes) -> list[float]:
    s = Stats(raw)
    words, letters, lines = max(1, s.n_words), max(1, s.upper + s.lower), max(1, len(s.lines))
    return [
        s.word_chars / words,
        min(1.0, s.n_symbols / words),
        min(1.0, float(s.byte[33]) / words),
        s.upper / letters,
        s.digits / max(1, s.word_chars),
        s.letters / max(1, len(s.raw) - s.blanks),
        len(set(s.words)) / words,
        s.n_adjacent / words,
        s.n_dup_lines / lines,
        min(1.0, s.raw.count(b" | ") / words),
        float(s.byte[44] + s.byte[46]) / words,
        min(1.0, s.n_ended_lines / lines),
        float(np.log1p(s.n_words)),
        float(s.n_function_words > 0),
    ]


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _summed(rows: DataFrame, of) -> np.ndarray | None:
    """The sum of of(x, y), an array, over the batches of rows (x, y); one row for each task comes back. None without rows."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = [np.frombuffer(r["sums"]) for r in rows.select("x", "y").mapInArrow(run, "sums binary").collect()]
    return np.sum(parts, axis=0) if parts else None


class LogisticModel:
    """Ridge logistic regression on standardised features and their squares, by Newton steps."""

    def __init__(self, mean, scale, weight, rate):
        self.mean, self.scale, self.weight, self.rate = mean, scale, weight, rate

    @staticmethod
    def _wide(z: np.ndarray) -> np.ndarray:
        z = np.clip(z, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.minimum(z * z, 16)])

    @classmethod
    def fit(cls, rows: DataFrame, ridge: float = 1.0, rounds: int = 25) -> LogisticModel | None:
        """The model of all rows (x, y); none without labels of both kinds."""
        sums = _summed(rows, lambda x, y: np.concatenate([[len(y), y.sum(), (y * y).sum()], x.sum(0), (x * x).sum(0)]))
        if sums is None:
            return None
        n, rate, k = sums[0], sums[1] / sums[0], (sums.size - 3) // 2
        if sums[2] / n - rate * rate < 1e-12:
            return None
        mean = sums[3 : 3 + k] / n
        scale = np.sqrt(np.maximum(sums[3 + k :] / n - mean * mean, 0)) + 1e-6
        w = np.zeros(2 * k + 1)
        penalty = np.full(w.size, ridge)
        penalty[0] = 0
        wide = cls._wide

        def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = wide((x - mean) / scale)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).ravel()])

        for _ in range(rounds):
            sums = _summed(rows, slopes)
            curve = sums[w.size :].reshape(w.size, w.size) + np.diag(penalty + 1e-9)
            step = np.linalg.solve(curve, sums[: w.size] - penalty * w)
            w = w + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w, float(rate))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._wide((x - self.mean) / self.scale) @ self.weight, -12, 12)


def labelled_rows(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str, id_col: str, text_col: str) -> DataFrame:
    """(x: features, y: label, h and p: site keys, held: out of the model that the site's weight is fitted with) of all labelled rows."""
    labels = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).dropna()
    labels = labels.groupBy("id").agg(F.min("y").alias("y"))
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[id_col].alias("id"), host.alias("h"), path.alias("p"))
    held = (F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(4)) == 0).alias("held")

    def run(batches):
        for batch in batches:
            x = [features(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], ["x", *batch.schema.names[1:]])

    def measured(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(run, ", ".join(["x array<double>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])]))

    if labels.count() <= MAX_SENT:
        rows = measured(rows.join(F.broadcast(labels), "id").select("text", "y", "h", "p", held))
    else:  # features, not texts, are shuffled
        rows = measured(rows.filter("id is not null")).join(labels.hint("merge"), "id")
    return rows.select("x", "y", "h", "p", "held" if "held" in rows.columns else held)


def judged_alone(rows: DataFrame, model: LogisticModel, part: LogisticModel) -> DataFrame:
    """(h, p, q_doc: by the model, e: evidence by the part model, y) of labelled rows."""
    prior = float(np.log(model.rate / (1 - model.rate)))
    base = float(np.log(part.rate / (1 - part.rate)))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2))
                q, e = 1 / (1 + np.exp(-model.logit(x))), part.logit(x) - base + prior
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q), pa.array(e), batch.column(3)], ["h", "p", "q_doc", "e", "y"])

    return rows.select("h", "p", "x", "y").mapInArrow(run, "h string, p string, q_doc double, e double, y double")


def site_weight(rows: DataFrame, strength: float = 4.0, rounds: int = 50) -> float:
    """The nonnegative weight of the site's log-odds (less the prior) beside the evidence, by Newton steps. rows: (e, site, y).

    strength: of a normal prior around 0, so that few labels don't make a site count.
    """
    w = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.least(F.greatest(F.col("e") + F.lit(w) * F.col("site"), F.lit(-30.0)), F.lit(30.0))))
        sums = rows.agg(F.sum((F.col("y") - p) * F.col("site")).alias("slope"), F.sum(p * (1 - p) * F.col("site") ** 2).alias("curve")).first()
        if sums["slope"] is None:
            break
        new = max(0.0, w + float(np.clip((sums["slope"] - strength * w) / (sums["curve"] + strength), -0.5, 0.5)))
        if abs(new - w) < 1e-9:
            break
        w = new
    return w


def site_key(*names: Column) -> Column:
    """A string that is the same for equal names only, nulls being names too."""
    return F.to_json(F.array(*(n.cast("string") for n in names)))


def evidence(model: LogisticModel | None, text: Column) -> Column:
    """Log-odds of good text that the document alone adds to the label rate."""
    if model is None:
        return F.lit(0.0)
    base = float(np.log(model.rate / (1 - model.rate)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        x = np.array([features(t or b"") for t in texts.cast(pa.binary()).to_pylist()])
        return pa.array(model.logit(x) - base)

    return score(text.cast("string"))


def _shrink(groups: DataFrame, parent: str) -> Column:
    """Documents' worth of belief in the level above, by the method of moments over the groups.

    Var(site mean) = tau + within / n, with within the variance in a site; the belief is
    rate (1 - rate) / tau - 1, as of a beta distribution. One row comes back, whatever the number of sites.
    """
    m = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(parent)) ** 2).alias("between"),
    ).first()
    if not m["n"]:
        return F.lit(MOST)
    rate = m["s"] / m["n"]
    within = max(m["q"] / m["n"] - rate * rate - m["between"] / m["n"], 0.0)
    tau = max((m["between"] - m["k"] * within) / m["n"], 0.0)
    belief = rate * (1 - rate) / tau - 1 if tau > 0 else MOST
    return F.lit(float(min(max(belief, 1.0), MOST)))


class Sites:
    """Rates of hosts and of paths, shrunk toward the level above.

    scored: (h, p, q_doc). What is shuffled is one partial sum for each task and site.
    """

    def __init__(self, scored: DataFrame, scratch: Scratch):
        p = F.col("q_doc")
        sites = scored.groupBy("h", "p").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"))
        sites = scratch.save(sites, "sites")
        whole = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k")).first()
        self.total = F.lit(float(whole["s"] / whole["n"]) if whole["n"] else 0.5)
        hosts = sites.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))).withColumn("above", self.total)
        self.by_host = _shrink(hosts, "above")
        hosts = hosts.select("h", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
        both = sites.join(hosts, "h").withColumn("above", (self.by_host * self.total + F.col("host_s")) / (self.by_host + F.col("host_n")))
        self.by_path = _shrink(both, "above")
        self.table = scratch.save(both.select("h", "p", F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s"), "rates")
        self.small = whole["k"] <= MAX_SITES

    def rates(self, scored: DataFrame) -> DataFrame:
        """scored with q_host and q_path, both without the row's own share."""
        own, one = F.col("q_doc"), F.lit(1.0)
        out = scored.join(F.broadcast(self.table) if self.small else self.table, ["h", "p"])
        out = out.withColumn("q_host", (self.by_host * self.total + F.col("host_s") - own) / (self.by_host + F.col("host_n") - one))
        return out.withColumn("q_path", (self.by_path * F.col("q_host") + F.col("path_s") - own) / (self.by_path + F.col("path_n") - one))


def _log_odds(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(safe / (1 - safe))


SCORES = ("q_evidence", "q_doc", "q_host", "q_path", "q_posterior", "q_kept")


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """Each row of docs, as the struct `row`, with q_evidence, q_doc, q_host, q_path, q_posterior, q_kept.

    carried: the columns of docs in `row`, all by default. The texts are read twice (site sums, then
    scores). While there are at most MAX_SITES sites nothing else is shuffled; beyond, (id, hash of the
    text, site) meet the site table, and their scores the rows, by keys that no host shares.
    """
    scratch = Scratch(docs.sparkSession, "sites")
    host, path = site_key(host), site_key(host, path)
    rows = scratch.save(labelled_rows(docs, labels, host, path, label, id_col, text_col), "labelled")
    model = LogisticModel.fit(rows)
    rate = model.rate if model else 0.5
    prior = float(np.log(rate / (1 - rate)))

    def scored(*columns: Column) -> DataFrame:
        out = docs.select(*columns, host.alias("h"), path.alias("p"), evidence(model, docs[text_col]).alias("q_evidence"))
        return out.withColumn("q_doc", 1 / (1 + F.exp(-(F.col("q_evidence") + F.lit(prior)))))

    sites = Sites(scored(), scratch)
    weight = 0.0
    part = LogisticModel.fit(rows.filter("not held")) if model else None
    if part:
        known = sites.rates(judged_alone(rows.filter("held"), model, part))
        known = known.select("e", (_log_odds(F.col("q_path")) - F.lit(prior)).alias("site"), "y")
        weight = site_weight(scratch.save(known, "known"))
    row = F.struct(*(docs[c] for c in carried or docs.columns)).alias("row")

    def judged(out: DataFrame) -> DataFrame:
        out = sites.rates(out)
        out = out.withColumn("q_posterior", 1 / (1 + F.exp(-(F.col("q_evidence") + F.lit(prior) + F.lit(weight) * (_log_odds(F.col("q_path")) - F.lit(prior))))))
        return out.withColumn("q_kept", F.col("q_posterior") >= threshold)

    if sites.small:
        return judged(scored(row)).select("row", *SCORES)
    keys = docs[id_col].alias("k_id"), F.xxhash64(docs[text_col].cast("string")).alias("k_t")
    known = judged(scored(*keys).dropDuplicates(["k_id", "k_t", "p"])).select(F.col("k_id").alias("b_id"), F.col("k_t").alias("b_t"), F.col("p").alias("b_p"), *SCORES)
    whole = docs.select(row, docs[id_col].alias("k_id"), F.xxhash64(docs[text_col].cast("string")).alias("k_t"), path.alias("k_p"))
    return whole.join(known, F.col("k_id").eqNullSafe(F.col("b_id")) & (F.col("k_t") == F.col("b_t")) & (F.col("k_p") == F.col("b_p"))).select("row", *SCORES)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their columns."""
    kept = score_quality(docs, labels, F.col("source"), F.col("lang"))
    return kept.filter("q_kept").select("row.*")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_quality(docs, labels, F.col("source"), F.col("lang"), carried=["doc_id", "source", "lang"])
    return out.select("row.doc_id", "row.source", "row.lang", "q_doc", "q_host", "q_path", "q_posterior", F.col("q_kept").alias("kept"))
