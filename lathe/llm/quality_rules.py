"""Quality rules as weak supervision.

Each rule votes keep (1) or reject (0) on a text, or abstains (-1). Documents with the same votes
are one pattern; expectation-maximisation over pattern counts estimates each rule's accuracy for
good and for bad text, and the posterior probability of good text replaces an all-must-pass filter. Texts that fail the base rule are decided and don't take
part in the estimation.

Null text has no words: it fails the base rule. Rules abstain where they have nothing to judge.
Repeated rows count as often as they occur; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, spans, table
from .textstats import Stats

KEEP, REJECT, ABSTAIN = 1, 0, -1


RUNS = (b"##", b"**", b"$$", b"%%", b"&&", b"||", b"<<", b">>", b" | ")


def _band(value: float, good: tuple[float, float], fair: tuple[float, float]) -> int:
    """Keep inside good, reject outside fair, else abstain."""
    if good[0] <= value <= good[1]:
        return KEEP
    return ABSTAIN if fair[0] <= value <= fair[1] else REJECT


RULES = {
    "word_length": lambda s: _band(s.word_chars / s.n_words, (3, 9), (2.5, 12)),
    "symbols": lambda s: _band(s.n_symbols / s.n_words, (0, 0.02), (0, 0.1)),
    "duplicate_lines": lambda s: _band(s.n_dup_lines / len(s.lines), (0, 0.1), (0, 0.3)) if len(s.lines) > 2 else ABSTAIN,
    "repeated_windows": lambda s: _band(s.repeat_words / s.n_words, (0, 0.1), (0, 0.3)),
    "adjacent_repeats": lambda s: _band(s.n_adjacent / s.n_words, (0, 0.02), (0, 0.1)),
    "capitals": lambda s: _band(s.upper / max(1, s.upper + s.lower), (0, 0.15), (0, 0.4)),
    "line_ends": lambda s: _band(min(1.0, s.n_ended_lines / len(s.lines)), (0.6, 1), (0.1, 1)) if s.lines else ABSTAIN,
    "function_words": lambda s: KEEP if s.n_function_words >= 3 else REJECT if s.n_words >= 50 and s.n_function_words < 1 else ABSTAIN,
    "exclamations": lambda s: _band(s.byte[33] / s.n_words, (0, 0.02), (0, 0.2)),
    "letters": lambda s: _band(s.letters / max(1, len(s.raw) - s.blanks), (0.92, 1), (0.87, 1)),
    "symbol_runs": lambda s: _band(sum(map(s.raw.count, RUNS)) / s.n_words, (0, 0.005), (0, 0.05)),
    "digits": lambda s: _band(s.digits / max(1, s.word_chars), (0, 0.1), (0, 0.3)),
}


def votes_of(stats: Stats) -> list[int]:
    if not stats.n_words:
        return [ABSTAIN] * len(RULES)
    return [rule(stats) for rule in RULES.values()]


def fit(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.8, start: tuple[float, float] = (0.99, 0.75), strength: float = 20.0, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Expectation-maximisation: the share of good text, and per rule P(keep | good), P(keep | bad).

    start: both to begin with. A rule rarely rejects good text, and bad text breaks few of the rules,
    so one rejection weighs more than one vote to keep. strength: the weight of start, in documents.
    """
    keep, cast = patterns == KEEP, patterns != ABSTAIN
    good, bad = (np.full(patterns.shape[1], x) for x in start)
    begin = prior
    for _ in range(rounds):
        post = posterior(patterns, prior, np.stack([good, bad]))
        was = np.concatenate([[prior], good, bad])
        wg, wb = counts * post, counts * (1 - post)
        prior = float((wg.sum() + strength * begin) / (counts.sum() + strength))
        good = (wg @ keep + strength * start[0]) / (wg @ cast + strength)
        bad = (wb @ keep + strength * start[1]) / (wb @ cast + strength)
        if np.abs(np.concatenate([[prior], good, bad]) - was).max() < 1e-9:
            break
    return prior, np.stack([good, bad])


def posterior(patterns: np.ndarray, prior: float, accuracy: np.ndarray) -> np.ndarray:
    """Probability of good text for each row of votes."""
    keep, cast = patterns == KEEP, patterns != ABSTAIN
    accuracy = np.clip(accuracy, 1e-6, 1 - 1e-6)
    say = np.where(keep[:, None, :], np.log(accuracy), np.log(1 - accuracy)) * cast[:, None, :]
    score = say.sum(axis=2) + np.log([prior, 1 - prior])
    gap = np.clip(score[:, 1] - score[:, 0], -700, 700)
    return 1 / (1 + np.exp(gap))


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes array<int>"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the counts and the votes. Narrow."""
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            rows = []
            for text in raw:
                s = Stats(text or b"")
                s.repeat_words = s.n_repeat_words
                rows.append((s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.repeat_words, votes_of(s)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {ids}, {COLUMNS}").withColumnRenamed("id", id_col)


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed, quality (the posterior) and kept for every row of docs.

    The texts are read once; counts and votes go through a table. Patterns number at most three to
    the power of the number of rules, whatever the size of docs, so they fit the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "rules")
    measured = scratch.save(measure(docs, id_col, text_col), "measured")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = measured.filter(~base_failed).groupBy("votes").count().collect()
    if rows:
        patterns, counts = np.array([r["votes"] for r in rows]), np.array([r["count"] for r in rows], float)
        prior, accuracy = fit(patterns, counts)
    else:
        prior, accuracy = 0.8, np.full((2, len(RULES)), 0.5)
    odds = F.lit(float(np.log(prior / (1 - prior))))
    accuracy = np.clip(accuracy, 1e-6, 1 - 1e-6)
    for j in range(len(RULES)):
        yes, no = (float(np.log(a[0, j] / a[1, j])) for a in (accuracy, 1 - accuracy))
        vote = F.col("votes")[j]
        odds = odds + F.when(vote == KEEP, yes).when(vote == REJECT, no).otherwise(0.0)
    quality = 1 / (1 + F.exp(-odds))
    return (
        measured.withColumn("base_failed", base_failed)
        .withColumn("quality", quality)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
