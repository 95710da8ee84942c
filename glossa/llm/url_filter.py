"""URL filters: rules for hosts and path prefixes, carried to aliases over redirect and canonical-link edges.

A rule (host, path prefix) fits a url whose host is the rule's or a subdomain of it and whose path starts
with the rule's.  The longest rule (host and path) wins, then the longest path, then allow before block.

Pages without a rule take the decision of their equivalence class: urls are joined to the addresses that
they redirect to (meta refresh) or declare as canonical (link rel=canonical, og:url), and connected components of these
edges are classes.  Urls that the protocol equates are one address: upper case in scheme or host, the default port, an empty path,
a fragment.  With ``spellings`` (off by default) so are those that sites commonly redirect to each other
(http and https, ``www.`` and ``m.``, tracking parameters and their order, trailing slash, index page, ``.html``).  Within a class an explicit allow of any member takes
precedence over blocks of others; a class without any rule, and a page without an address, is allowed.
Every member has a vote, link targets that are no rows of the table too.

Defined cases: a null url or one without ``://`` has empty host and path, no rule and verdict allow; null
html has no links; repeated rows are judged row by row; relative link targets are resolved against the
page's url, and are no edges if it has none; targets without a host (``mailto:``) are no edges; a tag that is never
closed is none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path prefix
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The winning rule as a struct (verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    best_last = sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[2]), r[0] == "allow"))
    for verdict, h, p in best_last:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def address(url: Column, spellings: bool = False) -> Column:
    """One form for all urls that the protocol equates; with ``spellings``, for those that sites commonly redirect to each other."""
    if not spellings:
        scheme = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1), UPPER, LOWER)
        port = F.when(scheme == "http", F.regexp_replace(host_of(url), ":80$", "")).when(scheme == "https", F.regexp_replace(host_of(url), ":443$", "")).otherwise(host_of(url))
        path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
        return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), port, path, F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*(\?[^#]*)", 1)))
    host = F.regexp_replace(host_of(url), r"^(www|m)\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(r"^(utm_\w+|ref|fbclid|gclid|sessionid)(=|$)"))), "&")
    return F.when(host_of(url) != "", F.concat(F.lit("//"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


# Linear in the text: loops are possessive, and a tag that is never closed is taken to the end of the text once.
TAG = r"""(?i)<(?:link|meta)\b(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\z)"""
ATTRIBUTE = r"""(?<![^\s"'<>/=])[^\s"'<>/=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
BLANKS = " \t\r\n\f"


def _attribute(attributes: Column, name: str) -> Column:
    """The value of the first attribute of that name without its quotes, or an empty string."""
    first = F.get(F.filter(attributes, lambda a: a.rlike(rf"^(?i){name}\s*+=")), F.lit(0))
    value = F.regexp_extract(F.coalesce(first, F.lit("")), r"(?s)=\s*+(.*)$", 1)
    return F.btrim(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"), F.lit(BLANKS))


def _target(tag: Column) -> Column:
    """What a redirect or canonical tag points to, as it is written; an empty string for other tags."""
    attributes = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 0)
    content = _attribute(attributes, "content")
    # a delay, perhaps a separator, perhaps `url=`, and the target, perhaps in quotes of its own
    after = F.regexp_extract(content, r"(?is)^[\d.]*+\s*+[;,]?+\s*+(?:url\s*+=\s*+)?+(.*)$", 1)
    after = F.btrim(F.regexp_replace(after, r"""(?s)^(["'])(.*?)(?:\1.*)?$""", "$2"), F.lit(BLANKS))
    link = tag.rlike(r"^(?i)<link")
    return (F.when(link & _attribute(attributes, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), _attribute(attributes, "href"))
            .when(~link & _attribute(attributes, "http-equiv").rlike(r"^(?i)refresh$"), after)
            .when(~link & (_attribute(attributes, "property").rlike(r"^(?i)og:url$") | _attribute(attributes, "name").rlike(r"^(?i)og:url$")), content)
            .otherwise(F.lit("")))


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` parts."""
    parts = F.split(path, "/")
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(ends, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1))))
                       .when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    return F.array_join(kept, "/")


def resolved(url: Column, target: Column) -> Column:
    """A link target as an absolute url; ``url`` is that of the page.  Null where the page's url is needed and has no host."""
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?:)//", 1)
    base = F.when(host_of(url) != "", F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?://[^/?#]*)", 1))
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.regexp_extract(path_of(url), r"(?s)^(.*)/", 1), F.lit("/"))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*+:"), target)
            .when(target.startswith("//"), F.concat(F.when(scheme != "", scheme).otherwise(F.lit("http:")), target))
            .when(target.startswith("/"), F.concat(base, _without_dots(path), rest))
            .when(path == "", F.concat(base, path_of(url), rest))
            .otherwise(F.concat(base, _without_dots(F.concat(folder, path)), rest)))


def link_targets(url: Column, html: Column) -> Column:
    """Targets of redirect and canonical links in a page, absolute."""
    tags = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAG), 0),
                    lambda t: t.endswith(">") & t.rlike(r"(?i)canonical|refresh|og:url"))
    found = F.filter(F.transform(tags, _target), lambda t: (t != "") & ~t.startswith("#"))
    return F.transform(found, lambda t: resolved(url, t))


def judge(pages: DataFrame, rules=RULES, spellings: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every row of ``pages``."""
    url = F.col("url")
    seen = (pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), address(url, spellings).alias("address"),
                         link_targets(url, F.col("html")).alias("targets"))
            .withColumn("targets", F.array_distinct(F.filter(F.transform("targets", lambda t: F.struct(
                address(t, spellings).alias("address"), rule_of(host_of(t), path_of(t), rules).alias("_rule"))), lambda t: t["address"].isNotNull())))
            .withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)))
    seen = written(seen, "url-pages")
    # nodes are addresses: spellings of one address meet in it without an edge table of their own
    edges = seen.select(F.col("address").alias("a"), F.explode("targets.address").alias("b")).filter("a <> b").distinct()
    classes = written(components(edges, "url-edges"), "url-classes")
    # one row per address and kind of rule, then per class: combined before each shuffle
    voters = seen.select("address", "_rule").unionByName(seen.filter("address is not null").select(F.explode("targets").alias("t")).select("t.*"))
    votes = voters.filter("address is not null and _rule is not null").groupBy("address").agg(
        F.max(F.col("_rule.verdict") == "allow").alias("allow"), F.max(F.col("_rule.verdict") == "block").alias("block"))
    known = voters.filter("address is not null").select("address").distinct()
    placed = known.join(classes.withColumnRenamed("node", "address"), "address", "left").withColumn("component", F.coalesce("component", "address"))
    placed = written(placed.join(votes, "address", "left"), "url-votes")
    decided = placed.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block")).select(
        "component", F.when(F.col("allow"), "allow").when(F.col("block"), "block").otherwise("allow").alias("class_verdict"))
    by_address = written(placed.select("address", "component").join(decided, "component"), "url-decisions")
    return (seen.join(by_address, "address", "left")
            .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                    F.coalesce("_rule.verdict", "class_verdict", F.lit("allow")).alias("verdict"), "component"))
