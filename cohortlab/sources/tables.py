"""Scans and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.columns import sanitize


def strip_header(df: DataFrame) -> DataFrame:
    """Header names stripped of surrounding spaces."""
    return df.toDF(*[c.strip() for c in df.columns])


def discover_columns(df: DataFrame, columns=None, pattern: str | None = None,
                     contains: list[str] | None = None) -> list[str]:
    """Column discovery by explicit list, regex, or all-of-substrings."""
    names = list(df.columns)
    out: list[str] = []
    if columns:
        out += [c for c in columns if c in names]
    if pattern:
        rx = re.compile(pattern)
        out += [c for c in names if rx.match(c) and c not in out]
    if contains:
        out += [c for c in names if all(s in c for s in contains) and c not in out]
    return out


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
               columns=None, pattern: str | None = None, header: bool = True) -> DataFrame:
    """Scan a table (S1) with optional column pruning by name list or regex.

    The projection is expressed with ``select`` so Catalyst prunes the columns in the file
    reader (``ReadSchema`` in the plan) — only the named columns are read.
    """
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        df = r.option("header", header).option("multiLine", False).csv(path)
    else:
        df = r.format(fmt).load(path)
    df = strip_header(df)
    if columns or pattern:
        df = df.select(*[F.col(f"`{c}`") for c in discover_columns(df, columns, pattern)])
    return df


def read_optional(spark: SparkSession, path: str | None, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Missing optional input -> empty table with the declared schema (S3)."""
    if path:
        try:
            return read_table(spark, path, fmt=fmt, schema=schema if fmt == "csv" else None)
        except Exception as e:  # noqa: BLE001 - an absent file is the expected case
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Replace a whole result table (S4). ``sort_by`` clusters rows inside each file so that
    parquet min/max statistics skip row groups for filters on those columns."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def to_output_types(df: DataFrame) -> DataFrame:
    """Datetimes -> ISO text, floating NaN/inf -> null."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype.startswith("timestamp") or dtype == "date":
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(name))
        elif dtype in ("double", "float"):
            out.append(sanitize(c).alias(name))
        else:
            out.append(c.alias(name))
    return df.select(*out)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header, quoting only when needed."""
    to_output_types(df).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def _finite(c, t: T.DataType, fill):
    """``c`` with every floating number in it made finite; None when its type holds none."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return sanitize(c, fill)
    if isinstance(t, T.ArrayType) and _finite(c, t.elementType, fill) is not None:
        return F.transform(c, lambda x: _finite(x, t.elementType, fill))
    if isinstance(t, T.MapType) and _finite(c, t.valueType, fill) is not None:
        return F.transform_values(c, lambda k, v: _finite(v, t.valueType, fill))
    if isinstance(t, T.StructType):
        parts = [(f.name, _finite(c.getField(f.name), f.dataType, fill)) for f in t.fields]
        if any(x is not None for _, x in parts):
            built = F.struct(*[(c.getField(n) if x is None else x).alias(n) for n, x in parts])
            return F.when(c.isNotNull(), built)
    return None


def sanitize_non_finite(df: DataFrame, fill=None) -> DataFrame:
    """inf / NaN -> ``fill`` in every floating column, also inside arrays, maps and structs at any depth (S8). Keys of
    maps and null values stay as they are."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        x = _finite(c, f.dataType, fill)
        out.append((c if x is None else x).alias(f.name))
    return df.select(*out)
