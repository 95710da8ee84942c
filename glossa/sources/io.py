"""Sources and sinks (A1-A4): item tables as CSV/TSV/Parquet, metrics as JSON/CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quoted_csv import csv_options, read_csv

ITEMS_SCHEMA = T.StructType([
    T.StructField("pid", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("da_question", T.StringType()),
    T.StructField("da_answer", T.StringType()),
])

SOURCE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])

COMPLETIONS_SCHEMA = T.StructType([
    T.StructField("pid", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("sample_idx", T.LongType()),
    T.StructField("text", T.StringType()),
])


def read_items(spark: SparkSession, path: str, fmt: str = "csv", sep: str = ",",
               schema: T.StructType = ITEMS_SCHEMA) -> DataFrame:
    """A1 / A2: read an item table; columns are matched by the names in the header.

    Columns in another order and further columns are fine, absent text columns are
    null, and a file without the id column (the first of ``schema``) gets the row
    position as id.  A file is read by as many tasks as it has byte ranges, quoted line
    breaks or not (``quoted_csv``)."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raw = read_csv(spark, path, sep)
    names = {c.lstrip("\ufeff").strip(): c for c in raw.columns if c != "_position"}
    first = schema.fields[0]
    texts = [f for f in schema.fields[1:] if f.name in names]
    if not texts:
        raise ValueError(f"none of the columns {[f.name for f in schema.fields]} in {path}")
    if first.name not in names:
        names[first.name] = "_position"
    return raw.select(*[
        F.col(f"`{names[f.name]}`").cast(f.dataType).alias(f.name) if f.name in names
        else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_items(df: DataFrame, path: str, sep: str = ",") -> None:
    """A3: write an item or issue table as CSV (quoted where needed)."""
    df.write.mode("overwrite").options(**csv_options(sep)).csv(path)


def write_metrics(wide: DataFrame, out_dir: str) -> None:
    """A4: the wide result rows (one per model) as JSON and as CSV."""
    base = out_dir.rstrip("/")
    wide.write.mode("overwrite").json(f"{base}/json")
    wide.write.mode("overwrite").options(**csv_options(",")).csv(f"{base}/csv")


def read_metrics(spark: SparkSession, out_dir: str, schema: T.StructType,
                 fmt: str = "json") -> DataFrame:
    base = out_dir.rstrip("/")
    if fmt == "json":
        return spark.read.schema(schema).json(f"{base}/json")
    return spark.read.schema(schema).options(**csv_options(",")).csv(f"{base}/csv")
