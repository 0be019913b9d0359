"""python -m hopwise: the command line."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from hopwise.plans.options import parse
from hopwise.plans.run import run


def main(argv: list[str]) -> int:
    options = parse(argv)
    logging.basicConfig(level=logging.INFO if options.verbose else logging.WARNING)
    spark = SparkSession.builder.config("spark.sql.shuffle.partitions", max(8, options.partitions)).getOrCreate()
    for name, path in run(spark, options).items():
        print(name, path)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
