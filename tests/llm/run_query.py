"""Time queries of the llm package and compare them with their SQL twins where there are any.

python tests/llm/run_query.py SF_DIR QUERY...
"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle_check import compare, duck  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ["SCRATCH"]).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, twins = duck(folder), entry.queries(), entry.oracle_sql()
    for name in names:
        started = time.time()
        print(name, *compare(spark, con, name, queries[name], twins.get(name), folder), round(time.time() - started, 1), flush=True)
