"""CSV files with quoted line breaks, read by many tasks a file (A1, A2).

The text source deals the lines of a file to tasks by byte range.  Whether a line break ends a record depends on the quotes before it:
a range gives the parity of its quotes, and the ends it would have for either state before it.  The parities' running sum (exclusive or)
over the ranges of a file then tells each range the state it begins in and the number of records before it.  A second pass cuts
records at the line breaks outside quotes.  Records inside a range need no shuffle; the two open ends of a range (a record
that crosses ranges) are put together by record number.

Quotes stand around fields, and inside them twice, as RFC 4180 has it; line breaks are LF or CR LF, and stay as they are inside quotes; empty
lines outside quotes are no records.  A file whose last quote is open, or whose header differs from the first file's, is an error.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

# Tasks get the two functions of this module by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ranges up to which their states are broadcast; beyond, lines are dealt by range and put back in order.
BROADCAST_RANGES = 1_000_000


def csv_options(sep: str) -> dict[str, str]:
    # Quoted multi-line text.  A null is written as the marker \\N and an empty
    # string as "", so both survive a round trip; whitespace is data, never trimmed.
    return {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "sep": sep,
            "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false", "mode": "FAILFAST"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line, quotes, blank): the lines of each byte range, in order within it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("line"),
                        (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))).cast("int").alias("quotes"),
                        value.isin("", "\r").alias("blank"))


def _runs(files: list, starts: np.ndarray) -> list[tuple[int, int]]:
    """The row ranges of a batch that lie in one byte range."""
    cut = [0] + [i for i in range(1, len(files)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]] + [len(files)]
    return list(zip(cut[:-1], cut[1:]))


def _columns(batch: pa.RecordBatch, *names: str):
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _survey(batches):
    """One row for each byte range: parity of its quotes; record ends if it begins outside (0) or inside (1) quotes."""
    now, parity, ends = None, 0, [0, 0]
    for batch in batches:
        file, start, quotes, blank = _columns(batch, "file", "start", "quotes", "blank")
        for a, b in _runs(file, start):
            if (file[a], start[a]) != now:
                if now is not None:
                    yield _surveyed(now, parity, ends)
                now, parity, ends = (file[a], start[a]), 0, [0, 0]
            after = (parity + np.cumsum(quotes[a:b])) % 2
            before = np.concatenate([[parity], after[:-1]])
            for state in (0, 1):
                ends[state] += int(((after == state) & ~((before == state) & blank[a:b])).sum())
            parity = int(after[-1])
    if now is not None:
        yield _surveyed(now, parity, ends)


def _surveyed(now, parity, ends):
    return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [int(now[1])], "parity": [parity], "ends0": [ends[0]], "ends1": [ends[1]]},
                                      schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("parity", pa.int32()), ("ends0", pa.int64()), ("ends1", pa.int64())]))


def _cut(batches):
    """The records of each byte range; those open at either end of it as fragments (whole = false)."""
    now, inside, number, held, opened = None, 0, 0, [], False
    for batch in batches:
        file, start, quotes, blank, state, first = _columns(batch, "file", "start", "quotes", "blank", "state", "first")
        line = batch.column("line")
        for a, b in _runs(file, start):
            out = []
            if (file[a], start[a]) != now:
                if held:
                    yield _records([(now[0], number, int(now[1]), False, "\n".join(held))])
                now, inside, number, held, opened = (file[a], start[a]), int(state[a]), int(first[a]), [], bool(state[a])
            after = (inside + np.cumsum(quotes[a:b])) % 2
            if not inside and not held and not after.any():
                # no quoted line break here: each line that is not blank is a record
                keep = np.flatnonzero(~blank[a:b]) + a
                if len(keep):
                    n = len(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(file[keep], pa.string()), pa.array(np.arange(number, number + n)), pa.array(start[keep].astype(np.int64)),
                                                      pa.array(np.ones(n, bool)), line.take(pa.array(keep))], schema=_RECORDS)
                    number += n
                continue
            for text, ended, is_blank in zip(line.slice(a, b - a).to_pylist(), (after == 0).tolist(), blank[a:b].tolist()):
                if ended and is_blank and not held and not opened:
                    continue
                held.append(text)
                if ended:
                    out.append((now[0], number, int(now[1]), not opened, "\n".join(held)))
                    number, held, opened = number + 1, [], False
            inside = int(after[-1])
            if out:
                yield _records(out)
    if held:
        yield _records([(now[0], number, int(now[1]), False, "\n".join(held))])


_RECORDS = pa.schema([("file", pa.string()), ("number", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("record", pa.string())])


def _records(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORDS.types)], schema=_RECORDS)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, number, record), (file, records)): the records of every file, numbered from 0 in the order of the file."""
    lines = _lines(spark, path)
    ranges = lines.select("file", "start", "quotes", "blank").mapInArrow(_survey, "file string, start long, parity int, ends0 long, ends1 long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("state", (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).cast("int"))
    ranges = ranges.withColumn("ends", F.when(F.col("state") == 0, F.col("ends0")).otherwise(F.col("ends1")))
    # one row for each byte range (128 MB of input, as Spark is set): a small table
    ranges = written(ranges.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0))), "csv-ranges")
    files = ranges.groupBy("file").agg(F.sum("ends").alias("records"), (F.sum("parity") % 2).alias("open"))
    bad = files.where("open <> 0").select("file").first()
    if bad is not None:
        raise ValueError(f"a quote is not closed in {bad['file']}")
    state = ranges.select("file", "start", "state", "first")
    if state.count() <= BROADCAST_RANGES:
        # a join from the side of the lines, which keeps their order within a range
        joined = lines.join(F.broadcast(state), ["file", "start"])
    else:
        joined = lines.withColumn("_i", F.monotonically_increasing_id()).join(state, ["file", "start"]).sortWithinPartitions("file", "start", "_i")
    cut = joined.select("file", "start", "line", "quotes", "blank", "state", "first").mapInArrow(_cut, "file string, number long, start long, whole boolean, record string")
    parts = cut.where("not whole").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"))
    joined_up = parts.select("file", "number", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return cut.where("whole").select("file", "number", "record").unionByName(joined_up), files.select("file", "records")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The columns of the files' header, as strings, and ``_position``: the row's place in the files, by path, from 0."""
    options = csv_options(sep)
    names = spark.read.options(**options).csv(path).columns
    records, files = read_records(spark, path)
    options.pop("header")
    text = F.regexp_replace("record", "\r$", "")
    text = F.when(F.col("number") == 0, F.regexp_replace(text, "^﻿", "")).otherwise(text)
    row = F.from_csv(text, ", ".join(f"c{i} string" for i in range(len(names))), options)
    offset = files.select("file", F.coalesce(F.sum(F.col("records") - 1).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    parsed = records.select("file", "number", row.alias("r"))
    # the header of every file must be that of the first
    same = F.coalesce(*[F.when(~F.col(f"r.c{i}").eqNullSafe(n.removeprefix("﻿")), F.lit(False)) for i, n in enumerate(names)], F.lit(True))
    body = F.when(F.col("number") > 0, True).when(same, False).otherwise(F.raise_error(F.concat(F.lit("another header in "), F.col("file"))).cast("boolean"))
    # few rows: one for each file
    placed = parsed.where(body).join(F.broadcast(offset), "file")
    return placed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], (F.col("_offset") + F.col("number") - 1).alias("_position"))
