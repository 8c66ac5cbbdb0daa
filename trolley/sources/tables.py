"""Long ``(basket, item)`` line sources over the parquet tables.

Only the needed columns are read (``ReadSchema`` shows the pruning). The
lineitem-part join is left to the planner: ``part`` is broadcast only when
its size (file statistics, then AQE's runtime measure) is under
``spark.sql.autoBroadcastJoinThreshold``; otherwise it is a sort-merge join
whose skewed partitions AQE splits.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of ``part`` a basket's items can be taken from.
PART_ITEM_COLUMNS = ("p_brand", "p_type", "p_name")


# Tables that each source reads.
SOURCE_TABLES = {"orders": ("lineitem", "part"), "events": ("events",)}


def state(spark: SparkSession, sf_dir: str, source: str) -> str:
    """A hash of the path, length and modification time of every file a source reads.

    Two calls to the file system for each table, whatever its number of files."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen = hashlib.sha256()
    for name in SOURCE_TABLES.get(source, ()):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        files = jvm.org.apache.commons.lang3.ArrayUtils.toString(path.getFileSystem(conf).listStatus(path))
        for found in re.findall(r"path=([^;]*)|length=(\d+)|modification_time=(\d+)", files):
            seen.update(repr(found).encode())
    return seen.hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str, item: str = "p_brand") -> DataFrame:
    """Order lines with their part attribute: ``(basket, item, line)``.

    ``basket`` is ``l_orderkey``; ``line`` is ``l_linenumber`` (kept for the
    wide layout's column order).
    """
    if item not in PART_ITEM_COLUMNS:
        raise ValueError(f"item must be one of {PART_ITEM_COLUMNS}")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    pa = table(spark, sf_dir, "part").select("p_partkey", item)
    return li.join(pa, li.l_partkey == pa.p_partkey).select(
        F.col("l_orderkey").alias("basket"),
        F.col(item).alias("item"),
        F.col("l_linenumber").alias("line"),
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream as baskets: ``(basket=user_id, item=event_type)``."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type")
    return ev.select(F.col("user_id").alias("basket"), F.col("event_type").alias("item"))
