"""Run as a program, from a folder other than the repository's: queries in a session whose workers cannot see the repository.

python shipping.py REPOSITORY SF_DIR all|NAME...; prints the names of the queries that failed, each with the reason."""

import os
import sys

root, sf, *wanted = sys.argv[1:]
os.environ.pop("PYTHONPATH", None)
sys.path.insert(0, root)

import __spark_entry__ as entry  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
for name, query in entry.queries().items():
    if name in wanted:
        try:
            query(spark, sf).write.format("noop").mode("overwrite").save()
        except Exception as e:
            print("FAILED", name, str(e)[-300:].replace("\n", " "))
print("DONE")
