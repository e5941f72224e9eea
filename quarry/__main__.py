"""python -m quarry QUERY SF_DIR OUT: runs a registered query and writes its rows as Parquet. OUT must not lie in SF_DIR."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quarry import plans


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in plans.queries():
        print(__doc__, "\nQueries:", *sorted(plans.queries()), file=sys.stderr)
        return 2
    name, sf_dir, out = args
    if out.rstrip("/").startswith(sf_dir.rstrip("/")):
        print("The output must differ from the inputs.", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"quarry {name}").getOrCreate()
    plans.queries()[name](spark, sf_dir).write.mode("overwrite").parquet(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
