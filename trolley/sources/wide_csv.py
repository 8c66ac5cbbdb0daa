"""Wide transaction CSV reader (``Item(s)``, ``Item 1`` … ``Item k``).

The header names the columns; every cell is read as text under an explicit
schema. Rows are checked for their field count the way pandas does: a short
row is filled with nulls, a row with more fields than the header is an error
(``fold_wide`` raises on a non-null ``_extra``) — even when the extra fields
are empty. Spark keeps the raw text of any row whose field count differs
from the header in a corrupt-record column; for those rows only, the fields
are counted outside quotes. Quotes follow RFC 4180 (a doubled quote inside a
quoted field is one quote). Quoted newlines need ``multi_line=True``, which
makes each file one split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.operators.baskets import EXTRA_COLUMN

_RAW = "_raw_row"
# A quoted field, with doubled quotes inside it: a quote opens one only where a field starts.
_QUOTED = r'(^|,)"(?:[^"]|"")*"'


def _reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )


def read_wide_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    header = _reader(spark, multi_line).csv(path).columns
    schema = T.StructType(
        [T.StructField(c, T.StringType(), True) for c in header] + [T.StructField(_RAW, T.StringType(), True)]
    )
    rows = (
        _reader(spark, multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RAW)
        .schema(schema)
        .csv(path)
    )
    fields = F.size(F.split(F.regexp_replace(F.col(_RAW), _QUOTED, "$1"), ","))
    extra = F.when(F.col(_RAW).isNotNull() & (fields > F.lit(len(header))), F.col(_RAW))
    return rows.select(*[F.col(f"`{c}`") for c in header], extra.alias(EXTRA_COLUMN))
