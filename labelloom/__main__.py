"""python -m labelloom run TABLES OUT: a consistency run; python -m labelloom query NAME TABLES OUT: one query to parquet."""

from __future__ import annotations

import json
import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    if len(args) == 3 and args[0] == "run":
        from labelloom.plans.runs import consistency_run

        spark = SparkSession.builder.appName("labelloom").getOrCreate()
        print(json.dumps(consistency_run(spark, args[1], args[2]), ensure_ascii=False))
        return 0
    if len(args) == 4 and args[0] == "query":
        from labelloom.plans import catalogue, data_queries

        queries = {**catalogue.QUERIES, **data_queries.QUERIES}
        spark = SparkSession.builder.appName("labelloom").getOrCreate()
        queries[args[1]](spark, args[2]).write.mode("overwrite").parquet(args[3])
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
