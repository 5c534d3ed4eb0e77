"""Block and allow rules over hosts and paths, carried to aliases along redirects.

A rule is a host, a path and a verdict. It fits its host and all subdomains of it if the path of the url
starts with the rule's path; of the rules that fit, the longest wins. Distinct (host, path) pairs meet the rules in
two equi-joins: every suffix of a host meets the path lengths that rules of that host have, and the prefixes
of those lengths meet the rules. No url is held against all rules of a host.

Urls without a rule of their own take the verdict of their aliases: redirects and canonical links
are undirected edges between urls (host, path and query; scheme and fragment do not count), and the connected
components over them are equivalence classes. A class with a blocked url is blocked, unless one of its urls is
explicitly allowed: allow has precedence. A class without either, and a url without edges, is allowed.

Edges come from the pages themselves (``<link rel="canonical">`` and ``<meta http-equiv="refresh">``, outside
of comments and scripts; relative references are resolved against the url of the page) and from a
table of redirects, if there is one. Pages are only joined to tables with one row per url or per
(host, path), so a url that stands on a third of the pages is a skewed many-to-one join, which adaptive
execution splits; components never gather a hub.

Defined cases: a null url and one without ``://`` have an empty host and path, fit no rule and have
no edges (allow); a null or empty html has no edges; a rule without a host fits nothing; of equal
rules with both verdicts allow wins; of fitting rules of equal length the one with the longer host
wins; repeated pages are judged each; ids may be null or repeat; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.llm.common import components
from sonaria.session import materialise

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULE_SCHEMA = "host string, path string, verdict string"

_SKIPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_ATTRIBUTE = r"""(?is)\s{0}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def alias_of(url: Column) -> Column:
    """What urls are told apart by: host, path and query; null without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*(\?[^#]*)", 1)
    path = path_of(url)
    rooted = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(host_of(url) != "", F.concat(host_of(url), rooted, query))


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE.format(name)
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.trim(F.regexp_replace(value, "(?i)&amp;", "&"))


def _without_dots(path: Column) -> Column:
    """Path with its ``.`` and ``..`` segments removed."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)

    def step(seen: Column, part: Column) -> Column:
        up = F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", seen).otherwise(F.concat(seen, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(closed, "/")


def resolved(base: Column, reference: Column) -> Column:
    """Absolute url of a reference found on the page ``base``."""
    scheme = F.regexp_extract(base, "^([^:/?#]*)://", 1)
    host, path = host_of(base), path_of(base)
    root = F.concat(scheme, F.lit("://"), host)
    bare = F.regexp_extract(reference, "^([^?#]*)", 1)
    rest = F.regexp_extract(reference, "^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(F.when(path == "", F.lit("/")).otherwise(path), "^(.*/)", 1)
    return (
        F.when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), reference)
        .when(reference.startswith("//"), F.concat(scheme, F.lit(":"), reference))
        .when(reference.startswith("/"), F.concat(root, _without_dots(bare), rest))
        .when(bare == "", F.concat(root, path, rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, bare)), rest))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): urls joined by a canonical link or a refresh of a page."""
    # Most pages name neither, and are dropped before any other pattern is tried.
    named = pages.select("url", "html").where(
        F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://")
    )
    tag = F.col("tag")
    tags = named.select(
        "url", F.explode(F.regexp_extract_all(F.regexp_replace("html", _SKIPPED, ""), F.lit(_TAG), 0)).alias("tag")
    )
    links = F.lower(_attribute(tag, "rel"))
    refresh = F.regexp_extract(_attribute(tag, "content"), r"(?is)^[\d.\s]*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    target = F.when(
        tag.rlike("(?i)^<link") & F.array_contains(F.split(links, r"\s+"), "canonical"), _attribute(tag, "href")
    ).when(tag.rlike("(?i)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh"), F.trim(refresh))
    found = tags.select("url", target.alias("target")).where(F.col("target") != "")
    return found.select(
        alias_of(F.col("url")).alias("a"), alias_of(resolved(F.col("url"), F.col("target"))).alias("b")
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())


def redirect_edges(redirects: DataFrame) -> DataFrame:
    """(a, b) of a table of from_url, to_url."""
    return redirects.select(
        alias_of(F.col("from_url")).alias("a"), alias_of(F.col("to_url")).alias("b")
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())


def matching_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the distinct (host, path) pairs that a rule fits."""
    known = (
        rules.where("host != ''")
        .groupBy(F.translate("host", UPPER, LOWER).alias("suffix"), F.coalesce("path", F.lit("")).alias("prefix"))
        .agg(F.min("verdict").alias("verdict"))
    )
    lengths = known.select("suffix", F.char_length("prefix").alias("long")).distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    candidates = (
        places.where("host != ''")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .join(lengths, "suffix")
        .where(F.char_length("path") >= F.col("long"))
        .withColumn("prefix", F.expr("substring(path, 1, long)"))
    )
    rule = F.concat("suffix", "prefix")
    longest = F.struct(F.char_length(rule), F.char_length("suffix"))
    return (
        candidates.join(known, ["suffix", "prefix"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(rule.alias("rule"), "verdict"), longest).alias("own"))
        .select("host", "path", "own.rule", "own.verdict")
    )


def alias_verdicts(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """alias, verdict of the urls whose equivalence class holds a ruled url."""
    classes = materialise(components(edges, "a", "b"), "aliases").select(
        "root",
        F.col("node").alias("alias"),
        F.regexp_extract("node", "^([^/]*)", 1).alias("host"),
        F.regexp_extract("node", "^[^/]*([^?]*)", 1).alias("path"),
    )
    own = matching_rules(classes.select("host", "path"), rules)
    # "allow" comes before "block", so the least verdict of a class is its verdict.
    whole = classes.join(own, ["host", "path"]).groupBy("root").agg(F.min("verdict").alias("verdict"))
    return classes.join(whole, "root").select("alias", "verdict")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and ``via_alias``, one row per page."""
    url = F.col("url")
    placed = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), alias_of(url).alias("alias")
    )
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirect_edges(redirects))
    own = matching_rules(placed.select("host", "path"), rules)
    aliases = alias_verdicts(edges, rules).withColumnRenamed("verdict", "alias_verdict")
    return (
        placed.join(own, ["host", "path"], "left")
        .join(aliases, "alias", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("verdict", "alias_verdict", F.lit(ALLOW)).alias("verdict"),
            F.expr("rule is null and alias_verdict is not null").alias("via_alias"),
        )
    )
