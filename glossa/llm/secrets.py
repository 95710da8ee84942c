"""Secret scans with an incremental blob ledger.

Every historical version of a file is addressed by its content (SHA-256).  The ledger holds which blob has
been scanned by which rule version, and what was found.  A scan takes the pairs of blob and rule version
that the ledger does not have, scans each blob once, adds the pairs to the ledger, and joins the findings
back to all paths that have or had that content.  All of it is DataFrame work.

Rule versions are packs of patterns; raising a pack's version makes its pairs unseen, and no others.

Defined cases: null text is the empty blob; an empty blob has no findings; repeated rows and copies
share a blob and each get its findings; an empty history changes nothing; other columns stay aside.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .spans import Kind, digest, find, per_blob, shown

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Pack:
    version: str
    kinds: list[Kind] = field(hash=False)
    #: A pattern that any text with a finding matches.
    gate: str = "(?s)."
    first: int = 0


BASE = Pack("base-1", [
    Kind("assign", ASSIGN, lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= 8),
    Kind("access", r"AKIA[A-Z0-9]+", lambda v: F.char_length(v) >= 16),
    Kind("hex", r"[0-9a-f]{32,}"),
], gate=r"AKIA[A-Z0-9]|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")

MORE = Pack("more-1", [
    Kind("pem", r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Kind("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
], gate=r"-----BEGIN |eyJ[A-Za-z0-9_-]{10}|gh[pousr]_|(?i:bearer)\x20", first=100)

PACKS = [BASE, MORE]
LEDGER = "blob binary, version string, spans array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def scan(history: DataFrame, ledger: DataFrame | None = None, packs: list[Pack] = PACKS) -> tuple[DataFrame, DataFrame]:
    """(paths, new ledger rows): ``history`` is (path columns..., text), one row a version.

    ``paths`` is the path columns with blob; the second table has the pairs that were unseen, with their
    spans (an empty array where nothing was found).  Append it to the ledger to use it next time.
    """
    keys = [c for c in history.columns if c != "text"]
    gates = F.array(*[F.when(F.col("_text").rlike(p.gate), F.lit(p.version)) for p in packs])
    seen = history.withColumn("_text", text_of()).select(
        *keys, F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("blob"), F.array_compact(gates).alias("_open"), "_text")
    # texts go on only where a pack may find something in them
    seen = written(seen.withColumn("_text", F.when(F.size("_open") > 0, F.col("_text"))), "secret-blobs")
    blobs = seen.groupBy("blob").agg(F.min("_text").alias("text"), F.first("_open").alias("_open"))
    pairs = blobs.select("*", F.explode(F.array(*[F.lit(p.version) for p in packs])).alias("version"))
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "version"), ["blob", "version"], "left_anti")
    pairs = written(pairs, "secret-pairs")
    found = None
    for p in packs:
        mine = pairs.filter((F.col("version") == p.version) & F.array_contains("_open", p.version)).select("blob", "text")
        part = (find(mine, p.kinds).withColumn("ord", F.col("ord") + p.first)
                .withColumn("version", F.lit(p.version)))
        found = part if found is None else found.unionByName(part)
    spans = found.groupBy("blob", "version").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("spans"))
    fresh = (pairs.select("blob", "version").join(spans, ["blob", "version"], "left")
             .withColumn("spans", F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"))))
    return seen.select(*keys, "blob"), written(fresh, "secret-ledger")


def findings(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """``paths`` (with blob) with all spans of the ledger for their content; no spans: an empty array."""
    spans = (ledger.filter(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).select("blob", "s.*"))
    all_spans = written(per_blob(spans), "secret-findings")
    out = paths.join(all_spans, "blob", "left")
    return out.withColumn("spans", F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<start:bigint,ord:int,end:bigint,kind:string>>")))


def report(docs: DataFrame, ledger: DataFrame | None = None, arrivals: int = 1) -> DataFrame:
    """The findings of ``docs`` (doc_id, text), one row a document, as counts and digests.

    With more than one arrival the rows come in parts, dealt by a hash of doc_id and text, each scanned against the ledger that those
    before it left: content that an earlier part had is not scanned again.  Results do not depend on the number.
    """
    rows = docs.select("doc_id", "text")
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals))
    paths, full = None, ledger
    for i in range(arrivals):
        here, fresh = scan(rows if arrivals == 1 else rows.filter(part == i), full)
        paths = here if paths is None else paths.unionByName(here)
        full = fresh if full is None else full.unionByName(fresh)
    base = F.filter("spans", lambda s: s["ord"] < BASE.first + len(BASE.kinds))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return findings(paths, full).select(
        "doc_id", *[count(k.name).alias(f"n_{k.name}") for k in BASE.kinds],
        digest(base).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
