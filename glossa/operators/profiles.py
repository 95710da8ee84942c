"""Language profiles that follow their corpus (E1): gram counts by input file, added up.

Counts of grams add up over files, so a profile is the sum of count tables, each made from some of the corpus's files and published with their
fingerprints (path, size and time of change).  A refresh counts the files that no usable table covers; a table is usable while all its files
are still there unchanged.  The fitted profile is published under the tables it was made of: an unchanged corpus is a read, a
changed one gives a new profile, and only new files are read again.

A count table holds at most (|letters| + 1) ** n rows for each language, however many files it covers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import DEFAULT_LETTERS
from ..sources.ledger import Ledger
from .language import gram_counts, profile_of_counts

Reader = Callable[[list[str]], DataFrame]


def _name(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def fingerprints(spark: SparkSession, path: str) -> dict[str, str]:
    """Fingerprint -> file, for the Parquet files of ``path`` that hold rows (no column is read)."""
    meta = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return {_name(f["file_path"], str(f["file_size"]), f["t"]): f["file_path"]
            for f in meta.distinct().select("file_path", "file_size", F.col("file_modification_time").cast("string").alias("t")).collect()}


class ProfileStore:
    """Profiles of a corpus of Parquet files, kept below ``root``.

    ``read`` makes (text, lang) rows of a list of files."""

    def __init__(self, spark: SparkSession, root: str, read: Reader | None = None, n: int = 3, letters: str = DEFAULT_LETTERS):
        self.spark, self.n, self.letters = spark, n, letters
        self.read = read or (lambda files: spark.read.parquet(*files).select("text", "lang"))
        setting = _name(str(n), letters)
        self._counts = Ledger(spark, f"{root.rstrip('/')}/counts-{setting}")
        self._profiles = Ledger(spark, f"{root.rstrip('/')}/profiles-{setting}")

    def tables(self, files: dict[str, str]) -> tuple[dict[str, dict], list[str]]:
        """The usable count tables that cover no file twice, the largest first, and the fingerprints that none covers."""
        chosen, left = {}, set(files)
        for run, entry in sorted(self._counts.runs().items(), key=lambda e: (-len(e[1]["files"]), e[0])):
            if left.issuperset(entry["files"]):
                chosen[run] = entry
                left -= set(entry["files"])
        return chosen, sorted(left)

    def refresh(self, path: str, languages: Sequence[str]) -> DataFrame:
        """The profile (gram, lang, logp) of the corpus as it is now."""
        files = fingerprints(self.spark, path)
        chosen, new = self.tables(files)
        if new:
            # every language is counted, so that other sets of languages need no further pass
            rows = self.read([files[f] for f in new]).where(F.col("lang").isNotNull())
            self._counts.commit(_name(*new), gram_counts(rows, n=self.n, letters=self.letters), {"files": new})
            chosen, new = self.tables(files)
            if new:
                raise RuntimeError(f"files of {path} changed while they were counted")
        langs = sorted(set(languages))
        run = _name(",".join(langs), *sorted(chosen))
        if not self._profiles.has(run):
            counts = self._counts.read_of(list(chosen.values())) if chosen else gram_counts(self.spark.createDataFrame([], "text string, lang string"))
            counts = counts.where(F.col("lang").isin(langs)).groupBy("lang", "gram").agg(F.sum("c").alias("c"))
            self._profiles.commit(run, profile_of_counts(counts, langs))
        return self._profiles.read_of([self._profiles.runs()[run]])
