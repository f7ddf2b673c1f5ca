"""Canonical text of (composite) keys, their structured form, and typed literals.

A part is `{bytes in name}:{name}#{value}`, parts are joined by a vertical bar; null, empty text and
all types stay apart. Types that cannot be keys are refused.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import UnsupportedColumnType

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def value_type(field: T.StructField, unsigned: Iterable[str] = ()) -> str:
    """Name of the key type of a column; `unsigned` names columns stored as unsigned integers, which Spark's schema does not tell."""
    kind = field.dataType
    if field.name in set(unsigned):
        return "uint64"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "utf8"
    if isinstance(kind, _INTEGERS):
        return "int64"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.DateType):
        return "date32"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp_micros"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    raise UnsupportedColumnType(field.name, kind.simpleString())


def plain_value(column: Column, field: T.StructField, unsigned: Iterable[str] = ()) -> Column:
    """The key's value as text: days, microseconds and unscaled decimals as integers; null stays null."""
    kind = value_type(field, unsigned)
    if kind in ("utf8", "int64", "boolean"):
        return column.cast("string")
    if kind == "uint64":
        return column.cast("decimal(20,0)").cast("string")
    if kind == "date32":
        return F.unix_date(column).cast("string")
    if kind == "timestamp_micros":
        if isinstance(field.dataType, T.TimestampNTZType):  # wall time as if in UTC, whatever the session's zone
            day = F.unix_date(column.cast("date")).cast("long") * 86_400_000_000
            time = (F.hour(column) * 3600 + F.minute(column) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")
            return (day + time).cast("string")
        return F.unix_micros(column).cast("string")
    # Unscaled digits: the text without its point, and without leading zeros.
    digits = F.regexp_replace(F.regexp_replace(column.cast("string"), r"\.", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(column == 0, F.lit("0")).otherwise(digits)


def encoded_value(column: Column, field: T.StructField, unsigned: Iterable[str] = ()) -> Column:
    kind, text = value_type(field, unsigned), plain_value(column, field, unsigned)
    if kind == "utf8":
        some = F.concat(F.lit("utf8:"), F.octet_length(text).cast("string"), F.lit(":"), text)
    elif kind == "boolean":
        some = F.concat(F.lit("bool:"), text)
    elif kind == "decimal":
        of = f"decimal128({field.dataType.precision},{field.dataType.scale})"
        some = F.concat(F.lit(f"decimal:{len(of)}:{of}:"), text)
    else:
        some = F.concat(F.lit(f"{kind}:"), text)
    return F.coalesce(some, F.lit("null"))


def _fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def encode_key(df: DataFrame, keys: Sequence[str], unsigned: Iterable[str] = ()) -> Column:
    """Canonical text of the key columns of df; never null."""
    parts = [F.concat(F.lit(f"{len(f.name.encode())}:{f.name}#"), encoded_value(df[f.name], f, unsigned)) for f in _fields(df, keys)]
    return F.concat_ws("|", *parts)


def structured_key(df: DataFrame, keys: Sequence[str], unsigned: Iterable[str] = ()) -> Column:
    """array of struct(column, value_type, value): the key for readers that do not parse the text."""
    return F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), F.when(df[f.name].isNull(), F.lit("null")).otherwise(F.lit(value_type(f, unsigned))).alias("value_type"), plain_value(df[f.name], f, unsigned).alias("value"))
            for f in _fields(df, keys)
        ]
    )


def typed_value(kind: str, value: str | None, target: T.DataType | None = None) -> Any:
    """A part's value as a Python value of its column's type."""
    if value is None or kind == "null":
        return None
    if kind == "boolean":
        return value == "true"
    if kind == "date32":
        return dt.date(1970, 1, 1) + dt.timedelta(days=int(value))
    if kind == "timestamp_micros":
        zone = None if isinstance(target, T.TimestampNTZType) else dt.UTC
        return dt.datetime(1970, 1, 1, tzinfo=zone) + dt.timedelta(microseconds=int(value))
    if kind in ("int64", "uint64"):
        return Decimal(value) if isinstance(target, T.DecimalType) else int(value)
    if kind == "decimal":
        return Decimal(value).scaleb(-target.scale if isinstance(target, T.DecimalType) else 0)
    return value


def keys_frame(spark: SparkSession, parts: list[list[dict[str, Any]]], schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Structured keys as a DataFrame of typed key columns."""
    own = T.StructType([T.StructField(k, schema[k].dataType, True) for k in keys])
    rows = []
    for key in parts:
        by = {p["column"]: p for p in key}
        rows.append(tuple(typed_value(by[k]["value_type"], by[k]["value"], schema[k].dataType) for k in keys))
    return spark.createDataFrame(rows, own)


def unsigned_columns(spark: SparkSession, path: str) -> list[str]:
    """Columns of a Parquet file that its footer marks as unsigned integers."""
    text = spark.sparkContext._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        spark.sparkContext._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration())
    )
    try:
        schema = text.getFooter().getFileMetaData().getSchema()
        out = []
        for i in range(schema.getFieldCount()):
            field = schema.getType(i)
            note = field.getLogicalTypeAnnotation()
            if note is not None and str(note.toString()).replace(" ", "").lower().endswith(",false)") and "INTEGER" in str(note.toString()).upper():
                out.append(str(field.getName()))
        return out
    finally:
        text.close()
