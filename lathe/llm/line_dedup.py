"""Repeated runs of lines, by overlapping windows of three lines.

Every window of three consecutive lines is hashed (128 bits, from the digests of its lines). A window
whose lines have been seen before, in the order of doc_id and then position, is a later occurrence; a
line goes if a later occurrence covers it, so overlapping windows merge into longer runs. Windows of
blank lines alone don't count, and texts of fewer than three lines keep everything.

The main path is DataFrame functions only. The first occurrence of each window comes from a
partial aggregation, so a window that every document holds is one row for each task. Going back to
the documents is a join on the window against its first place; where one window holds many rows,
adaptive execution splits that side.

Null text stays null and has no lines. A null id comes after all others. Rows of equal id follow each
other by a hash of their text; equal rows count as one document. What is done in a row is linear in its
number of lines, so that a very long text costs in proportion. An empty table gives an empty result. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

LAST = 2**63 - 1


def _windows(lines: str, size: int) -> Column:
    """Per window start: (place, hash, hash) of the window's lines; blank windows left out."""

    def at(i: Column) -> Column:
        part = F.slice(F.col(lines), i + 1, size)
        return F.struct(i.alias("place"), F.xxhash64(part).alias("h1"), F.xxhash64(F.lit(1), part).alias("h2"), F.exists(part, lambda x: x["filled"]).alias("filled"))

    n = F.size(lines)
    every = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), at))
    return F.filter(every, lambda w: w["filled"])


def mark(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct (id, text): row_id, row_t1, row_t2, and gone, the sorted places of the lines that go."""
    scratch = Scratch(docs.sparkSession, "lines")
    text = docs[text_col].cast("string")
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("row_id"),
        F.xxhash64(text).alias("row_t1"),
        F.xxhash64(F.lit(1), text).alias("row_t2"),
        F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != "").alias("filled"))).alias("lines"),
    )
    places = rows.select("row_id", "row_t1", "row_t2", F.inline(_windows("lines", size))).drop("filled")
    places = scratch.save(places, "places")
    where = F.struct("row_id", "row_t1", "row_t2", "place")
    first = places.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first <> last").select("h1", "h2", "first")
    later = places.join(first, ["h1", "h2"]).filter(where > F.col("first"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("place", F.col("place") + size - 1)))))
    return later.groupBy("row_id", "row_t1", "row_t2").agg(covered.alias("gone"))


def drop_lines(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """Each row of docs as the struct `row`, with kept_text, n_lines, n_removed and n_spans.

    carried: the columns of docs in `row`, all by default; these and the text, once, are shuffled.
    """
    gone = mark(docs, size, id_col, text_col)
    text = docs[text_col].cast("string")
    rows = docs.select(
        F.struct(*(docs[c] for c in carried or docs.columns if c != text_col)).alias("rest"), docs[text_col].alias("own"),
        F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("row_id"), F.xxhash64(text).alias("row_t1"), F.xxhash64(F.lit(1), text).alias("row_t2"),
    )
    out = rows.join(gone, ["row_id", "row_t1", "row_t2"], "left").withColumn("text", F.col("own").cast("string")).withColumn("lines", F.split("text", "\n", -1))
    # array_except goes through a hash set, so both expressions below are linear in the lines
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    count = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    spans = F.size(F.array_except("gone", F.transform("gone", lambda x: x + 1)))
    spans = F.when(F.col("gone").isNull(), 0).otherwise(spans).cast("long")
    row = F.struct(*((F.col("own") if c == text_col else F.col("rest").getField(c)).alias(c) for c in carried or docs.columns))
    return out.select(
        row.alias("row"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        count.alias("n_removed"), spans.alias("n_spans"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents"), carried=["doc_id"])
    return out.select("row.doc_id", "n_lines", "n_removed", "n_spans", F.md5("kept_text").alias("kept_md5"))


ORACLE_OP9 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS place, unnest(lines) AS line, len(lines) AS n FROM d
),
w AS (
  SELECT doc_id, place, n,
         line || chr(10) || lead(line, 1) OVER s || chr(10) || lead(line, 2) OVER s AS run
  FROM l WINDOW s AS (PARTITION BY doc_id ORDER BY place)
),
r AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) AS nth
  FROM w WHERE run IS NOT NULL AND regexp_replace(run, '[ \t\r\n\v\f]', '', 'g') <> ''
),
g AS (SELECT DISTINCT doc_id, place + k AS place FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
m AS (
  SELECT l.doc_id, l.place, l.line, g.place IS NOT NULL AS gone,
         coalesce(lag(g.place IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.place), false) AS before
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.place = g.place
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       count(*) FILTER (WHERE gone AND NOT before) AS n_spans,
       md5(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM m GROUP BY doc_id
"""
