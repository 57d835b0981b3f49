"""Run a query from the shell: python -m panelforge NAME DIRECTORY OUTPUT [--force]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from panelforge.plans import catalogue
from panelforge.sources.io import write_table


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="panelforge", description="Run a query over a directory of tables and write its rows.")
    p.add_argument("name", choices=sorted(catalogue.QUERIES))
    p.add_argument("directory")
    p.add_argument("output", help="path that ends in .parquet or .csv")
    p.add_argument("--force", action="store_true", help="overwrite an existing output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("panelforge").getOrCreate()
    write_table(catalogue.QUERIES[a.name](spark, a.directory), a.output, a.force)


if __name__ == "__main__":
    main()
