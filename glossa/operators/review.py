"""Translation replies, review replies and resume (H1-H8).

Service replies are rows of an ``attempts(id, attempt, content, error)`` table;
every step is a column job or a grouped pass over at most ``max_attempts``
rows per item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_break, strip
from .language import is_target, with_detected

# Section labels of translation replies, review keys and defaults.
Q_LABEL = "Danish Question:"
A_LABEL = "Danish Answer:"
FLAGS = ["en_ok", "da_ok", "math_ok_en", "math_ok_da", "crosslang_ok"]
MAX_ATTEMPTS = 3
ERROR_CHARS = 150


def _before(s: Column, label: str) -> Column:
    """What precedes the first ``label``; all, if there is none.  Bytes are searched, no text is turned into another form."""
    return F.substring_index(s, label, 1)


def _after(s: Column, head: Column, label: str) -> Column:
    """What follows ``head`` and the ``label`` after it; bytes are cut, which needs no count of characters."""
    return F.substr(s.cast("binary"), F.octet_length(head) + len(label.encode()) + 1, F.octet_length(s)).cast("string")


def parse_sections(df: DataFrame, content: str = "content") -> DataFrame:
    """H1: split a reply into (da_q, da_a).

    Both labels: question between the first question label and the next answer
    label, answer after that label (up to a second question label); only the
    answer label: text before / between the first two answer labels; no label:
    the lines cut in halves.  Null content gives empty parts."""
    # each cut of the text is a column, as an expression named twice would cut it twice
    t, seg, lines, count, head, rest = (F.col(c) for c in ("_t", "_seg", "_lines", "_count", "_head", "_rest"))
    has_q, has_a = F.col("_has_q"), F.col("_has_a")
    x = df.withColumn("_t", strip(F.coalesce(F.col(content), F.lit(""))))
    x = x.withColumn("_has_q", t.contains(Q_LABEL)).withColumn("_has_a", t.contains(A_LABEL))
    # the text in which the answer label is looked for: with a question label, what is between the first two of them
    x = x.withColumn("_rest", F.when(has_q & has_a, _after(t, _before(t, Q_LABEL), Q_LABEL)))
    x = x.withColumn("_seg", F.when(has_q & has_a, _before(rest, Q_LABEL)).when(has_a, t)) \
        .withColumn("_lines", F.when(~has_a, one_break(t)))
    # a stripped text does not end in a line break; an empty one has no line
    x = x.withColumn("_count", F.when(lines == "", F.lit(0)).otherwise(F.octet_length(lines) - F.octet_length(F.replace(lines, F.lit("\n"), F.lit(""))) + 1))
    mid = (count / 2).cast("int")
    x = x.withColumn("_head", F.when(has_a, _before(seg, A_LABEL)).otherwise(F.call_function("substring_index", lines, F.lit("\n"), mid)))
    # what follows the first answer label, or the line break after the first half
    x = x.withColumn("_rest", F.when(has_a, _after(seg, head, A_LABEL)).when(mid > 0, _after(lines, head, "\n")).otherwise(lines))
    both_a = ~has_q | seg.contains(A_LABEL)
    da_q = strip(F.when(~has_a | both_a, head).otherwise(F.lit("")))
    da_a = strip(F.when(~has_a, rest).when(both_a, F.when(has_q, rest).otherwise(_before(rest, A_LABEL))).otherwise(F.lit("")))
    kept = [c for c in df.columns if c not in ("da_q", "da_a")]
    return x.select(*kept, da_q.alias("da_q"), da_a.alias("da_a"))


def accept_translations(parsed: DataFrame, profile: DataFrame, target: str,
                        languages: Sequence[str]) -> DataFrame:
    """H2: adds ``accepted``: both parts non-empty and both detected as ``target``."""
    # decided in the row of the attempt: no part is shuffled or joined back
    found = with_detected(parsed, {"_lang_q": "da_q", "_lang_a": "da_a"}, profile, languages)
    both = is_target(F.col("_lang_q"), F.col("da_q"), target) & is_target(F.col("_lang_a"), F.col("da_a"), target)
    return found.select(*parsed.columns, ((F.col("da_q") != "") & (F.col("da_a") != "") & both).alias("accepted"))


def first_accepted(items: DataFrame, attempts: DataFrame, profile: DataFrame, target: str,
                   languages: Sequence[str], max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """H3: the first accepted attempt of each item (at most ``max_attempts``);
    items without one keep empty target texts."""
    tried = attempts.where((F.col("attempt") < max_attempts) & F.col("error").isNull()
                           & F.col("content").isNotNull())
    judged = accept_translations(parse_sections(tried), profile, target, languages)
    # a filter on what is cut from the replies would be pushed below the cuts, which would then be made again for each mention;
    # rejected attempts leave nothing but their id to be sorted and sent, and a null attempt is no minimum
    first = judged.select("id", F.when(F.col("accepted"), F.col("attempt")).alias("_try"),
                          F.when(F.col("accepted"), F.struct("da_q", "da_a")).alias("_parts")) \
        .groupBy("id").agg(F.min_by("_parts", "_try").alias("w"))
    src = items.select(F.col("pid").alias("id"), "question", "answer")
    return src.join(first, "id", "left").select(
        "id", "question", "answer",
        F.coalesce(F.col("w.da_q"), F.lit("")).alias("da_question"),
        F.coalesce(F.col("w.da_a"), F.lit("")).alias("da_answer"))


def pending_items(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """H4: items not written yet (anti join on the id, no reliance on row order)."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def _clean_reply(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    s = F.when(s.startswith("```"), F.regexp_replace(F.regexp_replace(s, r"^```[a-zA-Z0-9]*\s*", ""),
                                                    r"\s*```$", "")).otherwise(s)
    return F.when(s.rlike(r"(?s)\{.*\}"), F.regexp_extract(s, r"(?s)(\{.*\})", 1)).otherwise(s)


#: Marks put before the text of a JSON string, and of a number that is none, while an object is taken apart; signs
#: that JSON text cannot hold as they are stand in for escaped backslashes and quotes.
_TEXT, _NO_NUMBER, _BACKSLASH, _QUOTE = "\\u0003", "\\u0004", "\u0001", "\u0002"


def json_fields(text: Column) -> Column:
    """The (key, value) pairs of a JSON object in order, repeated keys too; null if ``text`` is no JSON object.

    Accepts what a lenient reader does: repeated keys, and NaN, Infinity and -Infinity as values.  A
    value is null for JSON null; it begins with U+0003 if it is a string (its content follows), and is JSON text otherwise.

    The text is cut at its quotes once, which tells strings from the rest without a loop in a pattern, so that
    long replies cost their length."""
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    marked = F.array_join(F.transform(F.split(hidden, '"', -1), lambda part, i: F.when(i % 2 == 1, F.concat(F.lit(_TEXT), part)).otherwise(
        F.regexp_replace(part, r"-?Infinity|NaN", '"' + _NO_NUMBER.replace("\\", "\\\\") + '$0"'))), '"')
    shown = F.replace(F.replace(marked, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    options = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    # in brackets, so that anything after the object is an error or a second element
    objects = F.from_json(F.concat(F.lit("["), shown, F.lit("]")), "array<map<string,string>>", options)
    one = F.when(~text.rlike("[\u0001\u0002]") & (F.size(objects) == 1), F.element_at(objects, 1))
    clean = lambda v: F.when(F.ascii(v) == 3, v).otherwise(F.regexp_replace(
        F.replace(v, F.lit(_TEXT), F.lit("")), r'^\x04(.*)$|"\\u0004(-?Infinity|NaN)"', "$1$2"))
    return F.transform(F.map_entries(one), lambda e: F.struct(F.substring(e["key"], 2, 2 ** 31 - 1).alias("key"), clean(e["value"]).alias("value")))


def parse_reviews(attempts: DataFrame) -> DataFrame:
    """H5: parse each reply: strip a code fence, keep first '{' to last '}', parse
    as a JSON object; ``parsed`` is false otherwise.  The last of repeated keys counts, and NaN is a
    number.  Missing keys take their defaults; an explicit null stays null.  Flags are kept as JSON text."""
    x = attempts.withColumn("_s", _clean_reply(F.col("content"))).withColumn("_f", json_fields(F.col("_s")))
    parsed = F.col("error").isNull() & F.col("content").isNotNull() & F.col("_f").isNotNull()
    # one lookup for each key: the value in an array, empty if the key is missing
    for k in [*FLAGS, "name_mismatch", "issues", "severity", "comment", "verdict"]:
        name = F.lit(k)
        found = F.transform(F.filter("_f", lambda e: e["key"] == name), lambda e: e["value"])  # noqa: B023
        x = x.withColumn(f"_{k}", F.slice(found, F.greatest(F.size(found), F.lit(1)), 1))

    def present(k):
        return F.size(f"_{k}") > 0

    def value(k):
        return F.get(f"_{k}", F.lit(0))

    def content(k):
        """A string's content; JSON text of another value."""
        return F.when(F.ascii(value(k)) == 3, F.substring(value(k), 2, 2 ** 31 - 1)).otherwise(value(k))

    def json_text(k):
        as_json = F.to_json(F.array(content(k)))
        return F.when(F.ascii(value(k)) == 3, F.substring(as_json, F.lit(2), F.length(as_json) - 2)).otherwise(value(k))

    cols = {f: json_text(f) for f in FLAGS}
    cols["name_mismatch"] = F.when(~present("name_mismatch"), F.lit("false")).otherwise(json_text("name_mismatch"))
    cols["issues"] = F.when(~present("issues"), F.lit("[]")).otherwise(F.coalesce(content("issues"), F.lit("null")))
    for k, default in (("severity", ""), ("comment", ""), ("verdict", "ISSUE")):
        cols[k] = F.when(~present(k), F.lit(default)).otherwise(content(k))
    return x.select("id", "attempt", "content", "error", parsed.alias("parsed"),
                    *[F.when(parsed, c).alias(k) for k, c in cols.items()])


def first_parseable(attempts: DataFrame, items: DataFrame,
                    max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """H6: per item the first parseable review of at most ``max_attempts``; when
    none parses: verdict 'ISSUE' and comment 'Model error: ' + the first 150
    characters of the last reply (or its error; nothing when there is no reply).
    Every item has a result."""
    p = parse_reviews(attempts.where(F.col("attempt") < max_attempts))
    fields = FLAGS + ["name_mismatch", "issues", "severity", "comment", "verdict"]
    last_msg = F.coalesce(F.col("error"), strip(F.coalesce(F.col("content"), F.lit(""))))
    g = p.groupBy("id").agg(
        F.min_by(F.struct(*fields), F.when(F.col("parsed"), F.col("attempt"))).alias("w"),
        F.max_by(last_msg, F.col("attempt")).alias("_last"))
    ok = F.col("w").isNotNull()
    out = [F.when(ok, F.col(f"w.{f}")).alias(f) for f in FLAGS + ["name_mismatch", "severity"]]
    out.append(F.when(ok, F.col("w.issues")).otherwise(F.lit("[]")).alias("issues"))
    out.append(F.when(ok, F.col("w.comment")).otherwise(
        F.concat(F.lit("Model error: "), F.coalesce(F.substring("_last", 1, ERROR_CHARS), F.lit("")))).alias("comment"))
    out.append(F.when(ok, F.col("w.verdict")).otherwise(F.lit("ISSUE")).alias("verdict"))
    return items.select(F.col("pid").alias("id")).join(g, "id", "left").select("id", *out)


def is_issue(verdict: Column) -> Column:
    """H7: every review but an explicit verdict OK (any case) is an issue."""
    return F.upper(F.coalesce(verdict, F.lit(""))) != "OK"


def issue_report(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """H8: the source row of every issue plus ten ``qa_*`` columns."""
    issues = reviews.where(is_issue(F.col("verdict")))
    qa = issues.select(F.col("id").alias("pid"), *[
        F.col(c).alias(f"qa_{c}") for c in FLAGS + ["name_mismatch", "issues", "severity",
                                                    "comment", "verdict"]])
    return items.join(qa, "pid")
