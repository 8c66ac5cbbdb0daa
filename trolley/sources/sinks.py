"""Exports of the mined tables.

Spark's CSV sink rejects arrays, so the CSV frames carry ``"a, b"`` labels;
parquet keeps the arrays. Paths are the caller's (a shared folder on a
cluster). A CSV is a folder of parts with a header each, or with
``single=True`` one file with one header, as the dashboard's download is.
"""

from __future__ import annotations

import csv
import io
import uuid

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions.labels import item_label


def rules_export_frame(rules: DataFrame) -> DataFrame:
    """Rules as written to CSV: ``antecedent, consequent, confidence, lift, support``."""
    return rules.select(
        item_label("antecedent").alias("antecedent"),
        item_label("consequent").alias("consequent"),
        "confidence",
        "lift",
        "support",
    )


def itemsets_export_frame(itemsets: DataFrame) -> DataFrame:
    """Itemsets as written to CSV: ``items, freq``."""
    return itemsets.select(item_label("items").alias("items"), F.col("freq"))


def write_csv(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; quotes inside fields are doubled (RFC 4180, as pandas
    writes and reads them)."""
    frame.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_csv_file(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file with one header, quoted as ``write_csv`` does.

    Tasks write headerless parts side by side; the parts are then joined in
    their order behind the header, by the file system where it can (``concat``)
    and else as a stream of bytes, so no task and no memory holds the table.
    The file appears at its path when it is whole."""
    spark = frame.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target, parts, whole = (hadoop.Path(p) for p in (path, *(f"{path}.{x}-{uuid.uuid4().hex}" for x in ("parts", "whole"))))
    fs = target.getFileSystem(conf)
    if fs.exists(target) and mode != "overwrite":
        if mode == "ignore":
            return
        raise FileExistsError(path)
    frame.write.option("header", False).option("quote", '"').option("escape", '"').csv(parts.toString())
    try:
        names = sorted(s.getPath().toString() for s in fs.globStatus(hadoop.Path(parts, "part-*")) if s.getLen())
        header = io.StringIO()
        csv.writer(header, lineterminator="\n").writerow(frame.columns)
        out = fs.create(whole)
        out.write(header.getvalue().encode("utf-8"))
        out.close()
        _join(spark, fs, whole, [hadoop.Path(n) for n in names])
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(whole, target):
            raise OSError(f"{whole.toString()} could not be renamed to {path}")
    finally:
        fs.delete(parts, True)
        fs.delete(whole, True)


def _join(spark, fs, whole, parts: list) -> None:
    """Append the files ``parts`` to the file ``whole``."""
    if not parts:
        return
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    array = gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
    for k, p in enumerate(parts):
        array[k] = p
    try:
        fs.concat(whole, array)
        return
    except UnsupportedOperationException:  # a file system without it
        pass
    head = jvm.org.apache.hadoop.fs.Path(whole.toString() + ".head")
    fs.rename(whole, head)
    out = fs.create(whole)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        for p in [head, *parts]:
            part = fs.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
        fs.delete(head, True)


def write_parquet(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    frame.write.mode(mode).parquet(path)


def export_rules(rules: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", single: bool = False) -> None:
    if fmt == "csv":
        (write_csv_file if single else write_csv)(rules_export_frame(rules), path, mode)
    elif fmt == "parquet":
        write_parquet(rules, path, mode)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")


def export_itemsets(itemsets: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", single: bool = False) -> None:
    if fmt == "csv":
        (write_csv_file if single else write_csv)(itemsets_export_frame(itemsets), path, mode)
    elif fmt == "parquet":
        write_parquet(itemsets, path, mode)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")
