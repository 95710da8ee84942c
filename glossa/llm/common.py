"""Small helpers that all operators share: written steps, size-checked joins, Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.session import scratch_dir, ship

#: A side of at most this many narrow rows (a key and a few numbers) may be broadcast.
BROADCAST_ROWS = 1_000_000

_STEPS: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` below the shared checkpoint folder and read it back.

    Executors that are lost later cost only the tasks that read the table.  Shuffle
    files of the finished step are given back at once (Spark frees them only when
    the driver collects its garbage).
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    _STEPS.append(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._glossa_step = path
    return out


def forget(*steps: DataFrame) -> None:
    """Delete written steps once all that reads them has been written in turn."""
    for step in steps:
        drop_steps(step.sparkSession, [step._glossa_step])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no column of that name (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def steps_so_far() -> list[str]:
    return list(_STEPS)


def drop_steps(spark: SparkSession, paths: list[str]) -> None:
    """Delete written steps whose results have been written elsewhere."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        if path in _STEPS:
            _STEPS.remove(path)


def keep_keys(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi (or anti) join on a written key table: broadcast behind a row count, else a shuffle."""
    side = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return df.join(side, key, how)


def in_arrow(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """mapInArrow with a function from a batch to dictionaries of columns."""
    to = arrow_schema(schema)
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], type=f.type, from_pandas=False) if not isinstance(columns[f.name], pa.Array)
                         else columns[f.name] for f in to], schema=to)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def with_row_key(df: DataFrame, *columns: str) -> DataFrame:
    """A key of the whole row content, equal for repeated rows: 128 bits of hash over ``columns``."""
    return df.withColumn("_row", F.md5(F.to_json(F.struct(*columns))))
