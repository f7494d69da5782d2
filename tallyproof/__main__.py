"""python -m tallyproof extract|structure|verify|all PATH: a JSON row a line."""

from __future__ import annotations

import os
import sys


def main(args: list[str]) -> int:
    from tallyproof.plans.documents import STEPS

    if len(args) != 2 or args[0] not in STEPS or ("://" not in args[1] and not os.path.exists(args[1])):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tallyproof").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for row in STEPS[args[0]](spark, args[1]).toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
