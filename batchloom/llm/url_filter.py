"""URL filters that reach all aliases of a page.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and of the
rules that fit a url the longest decides. Pages that redirect to each other, or name each other
as canonical, are one document under several urls: connected components over these links are found as
joins, and a block decision for one url of a component holds for all that have no rule of their own,
unless some url of the component is explicitly allowed.

Everything is DataFrame functions: the rules of a host are looked up once per distinct host, and
the pages join that small table; the html stays where it is read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.graph import components
from batchloom.llm.stored import stored

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str]

_LINK = r"(?i)<link\b[^>]*>"
_META = r"(?i)<meta\b[^>]*>"
_CANONICAL = r"""(?i)\brel\s*=\s*["']?\s*canonical\b"""
_REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
_HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TARGET = r"""(?i)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)"""


def lower_ascii(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What two spellings of one url share: no scheme, no fragment, the host in lower case."""
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest))


def rules_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """(verdict, host, path) from pairs such as ("block", "example.com/en/")."""
    rows = [(verdict, *rule.partition("/")) for verdict, rule in rules]
    return spark.createDataFrame(
        [(verdict, host, slash + path) for verdict, host, slash, path in rows],
        "verdict string, rule_host string, rule_path string",
    )


def _with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (with _host and _path) and the _rule that decides: a struct, or null.

    Longest first; of equally long ones that with the longer host, then allow.
    """
    hosts = urls.select("_host").where("_host <> ''").distinct()
    labels = F.split("_host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    rule = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("length"),
        F.length("rule_host").alias("host_length"),
        (F.col("verdict") == ALLOW).alias("allowed"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_path").alias("path"),
        "verdict",
    )
    by_host = stored(
        hosts.select("_host", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("_host")
        .agg(F.collect_set(rule).alias("_rules"))
    )
    fits = F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path"]))
    return urls.join(by_host, "_host", "left").withColumn("_rule", F.array_max(fits)).drop("_rules")


def _absolute(link: Column, host: Column, path: Column) -> Column:
    """A link of a page as a url; null if it leads to no other page."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("x://"), host)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when((link == "") | link.startswith("#") | (host == ""), F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .otherwise(F.concat(base, folder, link))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): urls that pages redirect to or name as canonical."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    tags = lambda tag, mark: F.filter(
        F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(mark)
    )
    href = lambda t: F.concat(*[F.regexp_extract(t, _HREF, i) for i in (1, 2, 3)])
    links = F.concat(
        F.transform(tags(_LINK, _CANONICAL), href),
        F.transform(tags(_META, _REFRESH), lambda t: F.regexp_extract(t, _TARGET, 1)),
    )
    return (
        pages.where(html.rlike(r"(?i)\bcanonical\b|\brefresh\b"))
        .select(url.alias("source"), F.explode(links).alias("link"))
        .select("source", _absolute(F.col("link"), host_of(F.col("source")), path_of(F.col("source"))).alias("target"))
        .where("target IS NOT NULL")
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    url_col: str = "url",
    html_col: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """`pages` with host, path, rule and verdict (`allow` or `block`); columns of these names are replaced.

    `rules` are (verdict, "host/path") pairs, or a table of verdict, rule_host and rule_path.
    `redirects` (source, target) are further links. The verdict is that of the longest rule that fits the url; else
    `allow` if a rule allows any url in its component, `block` if a rule blocks one, else `allow`. `rule` is
    null where the url has no rule of its own. A url that is null or has no `://` has an empty host and
    path, no rule and no aliases. Rows stay as they are, repeated ones too. Without rules
    all are allowed.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = rules_table(spark, rules)
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c not in (url_col, html_col)])
    columns = pages.columns
    url = F.col(f"`{url_col}`")
    links = page_links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        named = redirects.select("source", "target")
        links = named if links is None else links.unionAll(named)
    judged = _with_rule(pages.withColumns({"_host": host_of(url), "_path": path_of(url)}), rules)
    if links is None:
        alias = judged.select(key_of(url).alias("_key"), F.lit(None).cast("string").alias("_alias")).limit(0)
    else:
        links = stored(links)
        found = components(
            links.select(key_of(F.col("source")).alias("a"), key_of(F.col("target")).alias("b"))
        )
        found = stored(found)
        ends = links.select(F.explode(F.array("source", "target")).alias("url")).distinct()
        ends = ends.withColumns(
            {"_host": host_of(F.col("url")), "_path": path_of(F.col("url")), "node": key_of(F.col("url"))}
        )
        decided = _with_rule(ends, rules).where("_rule IS NOT NULL").select("node", "_rule.verdict")
        by_component = (
            found.join(decided, "node")
            .groupBy("component")
            .agg(F.min("verdict").alias("_alias"))  # `allow` comes before `block`
        )
        alias = stored(
            found.join(by_component, "component").select(F.col("node").alias("_key"), "_alias")
        )
    return (
        judged.withColumn("_key", key_of(url))
        .join(alias, "_key", "left")
        .select(
            *[F.col(f"`{c}`") for c in columns],
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            F.col("_rule.rule").alias("rule"),
            F.coalesce("_rule.verdict", "_alias", F.lit(ALLOW)).alias("verdict"),
        )
    )
