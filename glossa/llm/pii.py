"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

Seeds are the matches of the base patterns.  Each seed, each further token that looks like an identifier
(it holds a digit or ``@``) and each run of such tokens between single spaces is an instance; the words around it are
lexical patterns (the word before, the two words before, the word before with the word after).  Patterns and
instances form a bipartite graph per kind, scored in turns: a pattern's confidence is the smoothed mean score of its
distinct instances, those of any form, and a shape's weight is that of the instances with the shape.  An
instance's score is 1 for seeds; else the best confidence of its patterns, which counts in full once it reaches ``CONFIDENT`` and
before that by the weight of the instance's shape.  After ``ROUNDS`` turns, tokens and runs of any shape whose
score reaches ``CONFIDENT`` by a pattern with at least ``SUPPORT`` distinct seeds are added as ``ctx_<kind>``; one
inside another is not.  All of it is DataFrame work.

Defined cases: null and empty texts have no spans; repeated rows and copies share a blob and its spans; a token
that overlaps a base span is no candidate; an empty table gives an empty result; ties in score go to the first kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, text_of, written
from .spans import CONTEXT, Kind, digest, find, per_blob, shown

ROUNDS, CONFIDENT, SUPPORT = 3, 0.8, 5
#: Mass of the zero that a pattern's mean is smoothed with.
SMOOTH = 1.0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """The Luhn check of the digits of a value."""
    turned = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(1), F.least(F.char_length(turned), F.lit(19))), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(4)).cast("int"), F.lit(0)) <= 255))


# The base patterns; possessive loops and starts that cannot lie inside a run keep them linear in the text.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _parts),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda v: F.when(F.char_length(_digits(v)).between(12, 19), _luhn(v)).otherwise(False)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.char_length(_digits(v)).between(9, 15)),
]
TOKEN = Kind("token", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def _shape(value: Column) -> Column:
    """9 for runs of digits, a for runs of letters, other characters as they are."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]+", "9")


def _patterns(found: DataFrame, starts_run: Column | None = None) -> DataFrame:
    """``found`` with the patterns around each instance; the words before the first token of a run belong to the run."""
    starts_run = F.lit(False) if starts_run is None else starts_run
    # a word that may be cut by the end of the context is no word of a pattern
    left = F.when(F.char_length("left") < CONTEXT, F.col("left")).otherwise(F.regexp_replace("left", r"^[^\x20\x09-\x0D]+", ""))
    right = F.when(F.char_length("right") < CONTEXT, F.col("right")).otherwise(F.regexp_replace("right", r"[^\x20\x09-\x0D]++\z", ""))
    words_before = F.filter(F.split(F.lower(left), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    words_after = F.filter(F.split(F.lower(right), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = found.withColumn("_b", words_before).withColumn("_a", words_after)
    one = F.element_at("_b", -1)
    pats = F.array(F.when(~starts_run & (F.size("_b") >= 1), F.concat(F.lit("1 "), one)),
                   F.when(~starts_run & (F.size("_b") >= 2), F.concat(F.lit("2 "), F.element_at("_b", -2), F.lit(" "), one)),
                   F.when((F.size("_b") >= 1) & (F.size("_a") >= 1), F.concat(F.lit("3 "), one, F.lit(" _ "), F.element_at("_a", 1))))
    return out.withColumn("patterns", F.array_compact(pats)).drop("_b", "_a", "left", "right")


def candidates(base: DataFrame, tokens: DataFrame) -> DataFrame:
    """(blob, start, end, value, patterns): tokens that touch no base span, and runs of them between single spaces."""
    both = (base.select("blob", "start", "end", F.lit(True).alias("is_base"), *[F.lit(None).cast("string").alias(c) for c in ("value", "left", "right")])
            .unionByName(tokens.select("blob", "start", "end", F.lit(False).alias("is_base"), "value", "left", "right")))
    # base spans end before them and begin after them
    order = W.partitionBy("blob").orderBy("start", F.desc("is_base"), "end")
    before = F.max(F.when(F.col("is_base"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(F.when(F.col("is_base"), F.col("start")), ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    free = (both.withColumn("_b", before).withColumn("_a", after)
            .filter(~F.col("is_base") & (F.coalesce("_b", F.lit(0)) <= F.col("start")) & (F.col("_a").isNull() | (F.col("_a") >= F.col("end")))))
    line = W.partitionBy("blob").orderBy("start")
    follows = (F.lag("end").over(line) + 1 == F.col("start")) & F.lag("right").over(line).startswith(" ")
    free = (free.withColumn("_follows", F.coalesce(follows, F.lit(False)))
            .withColumn("_run", F.sum((~F.col("_follows")).cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("_heads", ~F.col("_follows") & F.coalesce(F.lead("_follows").over(line), F.lit(False))))
    free = written(free.select("blob", "start", "end", "value", "left", "right", "_run", "_follows", "_heads"), "pii-free")
    inside = free.filter(F.col("_follows") | F.col("_heads")).groupBy("blob", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda t: t["value"]), " ").alias("value"),
        F.min_by("left", "start").alias("left"), F.max_by("right", "start").alias("right"))
    cols = ["blob", "start", "end", "value", "patterns"]
    return _patterns(free, F.col("_heads")).select(*cols).unionByName(_patterns(inside).select(*cols))


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def discover(base: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans (blob, start, end, kind, ord) that patterns learned from ``base`` find among ``tokens``."""
    seeds = _patterns(base)
    free = written(candidates(base, tokens), "pii-tokens")
    # the graph: distinct (pattern, kind, instance); a token may be of each kind that has enough seeds in its pattern
    seed_edges = written(seeds.select("kind", "ord", "value", F.explode("patterns").alias("pattern"), F.lit(1.0).alias("seed")).distinct(), "pii-seeds")
    supported = written(seed_edges.groupBy("kind", "ord", "pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT).select("kind", "ord", "pattern"), "pii-supported")
    open_edges = free.select("blob", "start", "end", "value", F.explode("patterns").alias("pattern")).join(_small(supported), "pattern")
    open_edges = written(open_edges, "pii-open")
    edges = written(seed_edges.drop("ord").unionByName(open_edges.select("kind", "value", "pattern", F.lit(0.0).alias("seed")).distinct())
                    .groupBy("kind", "value", "pattern").agg(F.max("seed").alias("seed")), "pii-graph")
    shape = _shape(F.col("value")).alias("shape")
    scores = edges.groupBy("kind", "value").agg(F.max("seed").alias("score")).select("kind", "value", shape, "score")
    scores = written(scores, "pii-scores")
    for _ in range(ROUNDS):
        confident = (edges.join(scores, ["kind", "value"]).groupBy("kind", "pattern")
                     .agg((F.sum("score") / (F.count("*") + SMOOTH)).alias("confidence"), F.sum("seed").alias("support"))
                     .filter(F.col("support") >= SUPPORT))
        confident = written(confident, "pii-patterns")
        weights = written(scores.groupBy("kind", "shape").agg((F.sum("score") / (F.count("*") + SMOOTH)).alias("weight")), "pii-shapes")
        best = edges.join(_small(confident), ["kind", "pattern"], "left").groupBy("kind", "value").agg(
            F.max("seed").alias("seed"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("c"))
        of_others = F.when(F.col("c") >= CONFIDENT, F.col("c")).otherwise(F.col("c") * F.col("weight"))
        scores = (best.select("kind", "value", "seed", "c", shape).join(_small(weights), ["kind", "shape"])
                  .select("kind", "value", "shape", F.greatest("seed", of_others).alias("score")))
        scores = written(scores, "pii-scores")
    # an instance is taken where one of its own patterns is confident
    hits = open_edges.join(_small(confident.filter(F.col("confidence") >= CONFIDENT)), ["kind", "pattern"])
    best = hits.groupBy("blob", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("ord"))).alias("_k"), F.max_by("ord", F.struct("confidence", -F.col("ord"))).alias("_o"))
    outer = W.partitionBy("blob").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    best = best.withColumn("_in", F.max("end").over(outer)).filter(F.col("_in").isNull() | (F.col("_in") < F.col("end")))
    return best.select("blob", "start", "end", F.concat(F.lit("ctx_"), F.col("_k")).alias("kind"), (F.col("_o") + 100).alias("ord"))


def spans_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs' columns with blob, (blob, spans)): base spans and discovered ones of every distinct text."""
    gate = F.col("_text").rlike("[0-9@]")
    rows = docs.withColumn("_text", text_of())
    rows = rows.select(*docs.columns, F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("blob"), gate.alias("_open"))
    slim = rows.filter("_open").select("blob", "text")
    blobs = written(slim.groupBy("blob").agg(F.min("text").alias("text")), "pii-blobs")
    base = written(find(blobs, KINDS, context=True), "pii-base")
    tokens = written(find(blobs, [TOKEN], context=True), "pii-candidates")
    found = discover(base, tokens)
    spans = per_blob(base.select("blob", "kind", "ord", "start", "end").unionByName(found.select("blob", "kind", "ord", "start", "end")))
    return rows, written(spans, "pii-spans")


def report(docs: DataFrame) -> DataFrame:
    """One row a document: counts and digests of the base spans, and all spans."""
    rows, spans = spans_of(docs.select("doc_id", "text"))
    out = rows.select("doc_id", "blob").join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", F.from_json(F.lit("[]"), SPANS)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", *[count(k.name).alias(f"n_{k.name}") for k in KINDS],
                      digest(F.filter("spans", lambda s: s["ord"] < len(KINDS))).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Other columns are put aside in one struct, so that they may have any names.
    """
    aside = [c for c in docs.columns if c != "text"]
    packed = F.struct(F.lit(0).alias("n"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(aside)])
    keep = [F.col("text") if c == "text" else F.col("row")[f"c{aside.index(c)}"].alias(c) for c in docs.columns]
    rows, spans = spans_of(docs.select(packed.alias("row"), "text"))
    merged = F.aggregate("spans", F.from_json(F.lit("[]"), SPANS), lambda a, s: F.when(
        (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"]),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.try_element_at(a, F.lit(-1)).withField("end", F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"])))))
        .otherwise(F.concat(a, F.array(s))))
    cut = F.aggregate("_merged", F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at")), lambda a, s: F.struct(
        F.concat(a["out"], F.array(F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.concat(F.lit("["), F.upper(F.regexp_replace(s["kind"], "^ctx_", "")), F.lit("]")))).alias("out"), s["end"].alias("at")))
    spanned = (rows.filter("_open").join(spans, "blob", "left")
               .withColumn("_merged", merged).withColumn("_cut", cut)
               .withColumn("text", F.when(F.size("_merged") > 0, F.concat(F.array_join("_cut.out", ""), F.substring(F.col("text"), (F.col("_cut.at") + 1).cast("int"), F.char_length("text"))))
                           .otherwise(F.col("text"))))
    return rows.filter(~F.col("_open")).select(*keep).unionByName(spanned.select(*keep))
