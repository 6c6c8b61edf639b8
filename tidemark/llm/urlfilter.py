"""URL filters that follow redirects and canonical links, with SQL expressions alone.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the
longest that fits a URL decides. Pages and the targets of their redirects (meta
refresh) and canonical links are nodes: host, path and query without scheme and
fragment. The links' connected components are the classes of aliases. A URL that no
rule fits is blocked if any URL of its class is blocked by a rule; an explicit allow
keeps the URL it fits, whatever its aliases are.

Rules are a table of any length. Up to ``SHORT`` of them, counted, are one map from a host
to its rules inside the expression that judges a URL: no join and no shuffle. Of longer
lists, a URL's host and its parent domains meet the hosts of
the rules by an equality join, which tells the lengths of the paths to try; these
prefixes meet the rules by a second one. No URL meets rules that don't fit it, so work
follows the URLs, not the list. Spark broadcasts the rules if they are below its own
size bound, else both sides are shuffled. Links are extracted and written once; without
any there are no aliases and the rules' verdicts stand, else only nodes with links go
through the component rounds.

Defined cases: a null url or one without "://" has an empty host and path, fits no
rule, has no aliases and is allowed; a null html has no links; targets that are
relative resolve against the page's <base> or URL, with dot segments removed; repeated
rows get equal verdicts; of rules of one length an allow wins, repeated rules count
once, null rules are none; no rules, no pages or both give the same rows without a rule;
urls and html of any length are taken whole; of the pages only page_id, url and html
are read, other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rules that are held in an expression.
SHORT = 100
LINK = r"""(?i)<link\b[^>]*?\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
BASE = r"""(?i)<base\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query; null without a host."""
    path = path_of(url)
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def without_dots(path: Column) -> Column:
    """A path whose segments "." and ".." are resolved."""
    keep = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    segments = F.split(path, "/")
    done = F.aggregate(segments, F.array().cast("array<string>"), keep)
    folder = F.element_at(segments, -1).isin(".", "..")
    return F.when(F.regexp_like(path, F.lit(r"(^|/)\.\.?(/|$)")), F.concat(F.array_join(done, "/"), F.when(folder, "/").otherwise(""))).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """An absolute URL for a link target of a page."""
    root = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_replace(F.when(path_of(url) == "", "/").otherwise(path_of(url)), "[^/]*$", "")
    path, rest = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "[?#].*$", 0)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, without_dots(path), rest))
        .when(path == "", F.concat(root, path_of(url), rest))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), rest))
    )


def rule_table(spark: SparkSession, rules: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """at (host), prefix (path), r (size, allow, rule, verdict) of rules (verdict, rule)."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, rule string")
    host = F.substring_index("rule", "/", 1)
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 2)")
    r = F.struct(F.length("rule").alias("size"), (F.col("verdict") == "allow").cast("int").alias("allow"), F.col("rule"), F.col("verdict"))
    best = rules.where("rule is not null and verdict is not null").select(host.alias("at"), F.concat(F.lit("/"), path).alias("prefix"), r.alias("r"))
    return materialise(best.groupBy("at", "prefix").agg(F.max("r").alias("r")), "url-rules")


def parents() -> Column:
    """A host and its parent domains."""
    return F.expr("transform(sequence(1, size(split(host, '[.]'))), n -> substring_index(host, '.', -n))")


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path and others) with r, the longest fitting rule of each, null for none."""
    few = rules.select("at", "prefix", "r.*").limit(SHORT + 1).collect()
    if len(few) <= SHORT:
        return urls.withColumn("r", among(few))
    tried = materialise(rules.groupBy("at").agg(F.collect_set(F.length("prefix")).alias("sizes")), "url-rule-sizes")
    here = urls.where("host <> '' and path <> ''").select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(parents())).alias("at"))
    some = here.join(tried, "at").select("host", "path", "at", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
    found = some.select("host", "path", "at", F.expr("substring(path, 1, n)").alias("prefix")).join(rules, ["at", "prefix"])
    best = materialise(found.groupBy("host", "path").agg(F.max("r").alias("r")), "url-verdicts")
    return urls.join(best, ["host", "path"], "left")


def among(rules: list) -> Column:
    """The longest of a few rules that fits host and path."""
    kind = "struct<prefix: string, r: struct<size: int, allow: int, rule: string, verdict: string>>"
    whole = lambda x: F.struct(F.lit(x.prefix).alias("prefix"), F.struct(*[F.lit(x[k]).alias(k) for k in ("size", "allow", "rule", "verdict")]).alias("r"))
    of = {}
    for x in sorted(rules):
        of.setdefault(x.at, []).append(whole(x))
    none = F.array().cast(f"array<{kind}>")
    if not of:
        return F.lit(None).cast("struct<size: int, allow: int, rule: string, verdict: string>")
    known = F.create_map(*[c for at, xs in of.items() for c in (F.lit(at), F.array(*xs).cast(f"array<{kind}>"))])
    near = F.flatten(F.transform(parents(), lambda p: F.coalesce(F.try_element_at(known, p), none)))
    fits = F.filter(near, lambda x: F.startswith(F.col("path"), x["prefix"]))
    return F.when((F.col("host") != "") & (F.col("path") != ""), F.array_max(F.transform(fits, lambda x: x["r"])))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's node and that of each target of its redirects and canonical links."""
    url = F.col("url")
    base = F.replace(F.regexp_extract(F.regexp_extract("html", BASE, 0), HREF, 1), F.lit("&amp;"), F.lit("&"))
    tags = lambda tag, attr: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.replace(F.regexp_extract(t, attr, 1), F.lit("&amp;"), F.lit("&")))
    links = F.concat(tags(LINK, HREF), tags(REFRESH, TARGET))
    some = F.regexp_like("html", F.lit(r"(?i)canonical|http-equiv"))
    out = pages.where(some).select(node_of(url).alias("a"), url, base.alias("base"), F.explode(links).alias("target")).where("a is not null and target <> ''")
    out = out.withColumn("base", F.when(F.col("base") == "", url).otherwise(resolved(F.col("base"), url)))
    return out.select("a", node_of(resolved(F.col("target"), F.col("base"))).alias("b")).where("b is not null")


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; ``rules``: (verdict, host/path)."""
    url = F.col("url")
    rules = rule_table(pages.sparkSession, rules)
    own = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    edges = materialise(link_edges(pages), "url-links")
    if edges.isEmpty():
        verdict = F.coalesce(F.col("r.verdict"), F.lit("allow"))
        return fitting(own.drop("node"), rules).select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
    at = F.concat(F.lit("://"), F.col("node"))
    classes = materialise(components(edges).select("node", "component", host_of(at).alias("host"), path_of(at).alias("path")), "url-classes")
    blocked = fitting(classes, rules).where("r.verdict = 'block'").select("component").distinct()
    aliases = materialise(classes.join(materialise(blocked, "blocked-classes"), "component").select("node", F.lit(True).alias("blocked")), "blocked-aliases")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return fitting(own, rules).join(aliases, "node", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
