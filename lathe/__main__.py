"""Labels for a table of texts: python -m lathe IN OUT [--preset a|b|c] [--id COLUMN] [--text COLUMN] [--fallback]."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import plans, sources


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lathe", description="Cluster the texts of a Parquet table and write (row_id, cluster_id).")
    parser.add_argument("table", help="Parquet table with an id and a text column")
    parser.add_argument("output", help="Parquet table to write")
    parser.add_argument("--preset", choices=sorted(plans.PRESETS), default="c")
    parser.add_argument("--id", default="row_id", help="integer id column")
    parser.add_argument("--text", default="text", help="text column")
    parser.add_argument("--fallback", action="store_true", help="label by the fallback clusterer if the preset fails")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    preset = plans.with_fallback(plans.PRESETS[args.preset]) if args.fallback else plans.PRESETS[args.preset]
    mark = sources.held()
    batch = sources.text_batch(spark.read.parquet(args.table), args.id, args.text)
    sources.aligned_labels(preset(sources.reject_empty(batch)), "label").write.mode("overwrite").parquet(args.output)
    sources.release(mark)


if __name__ == "__main__":
    main()
