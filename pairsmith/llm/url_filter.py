"""URL rules whose decisions follow redirects and canonical links.

Pages that redirect to each other, or name each other as canonical, are aliases
of one resource: connected components over those links. A url that no rule fits
gets the decision of its aliases.
"""

from pyspark.sql import Column, DataFrame, functions as F

from pairsmith.llm import shared

#: Rules are one expression of the plan.
MAX_RULES = 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def with_alias_key(df: DataFrame, url_column: str, name: str) -> DataFrame:
    """``df`` with what two urls of one resource share: host, path and query, without scheme and fragment; null without a host."""
    url = F.col(url_column)
    parts = df.withColumns({"__host": host_of(url), "__tail": F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)})
    key = F.concat("__host", F.when(F.col("__tail") == "", F.lit("/")).otherwise(F.col("__tail")))
    return parts.withColumn(name, F.when(F.col("__host") != "", key)).drop("__host", "__tail")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, allow, rule) of the longest rule that fits, or null; of equal lengths an allowing one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fits = []
    for verdict, rule_host, rule_path in rules:
        on_host = (host == rule_host) | host.endswith(f".{rule_host}")
        found = F.struct(F.lit(len(rule_host + rule_path)).alias("length"), F.lit(verdict == "allow").alias("allow"), F.lit(rule_host + rule_path).alias("rule"))
        fits.append(F.when(on_host & path.startswith(rule_path), found))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,allow:boolean,rule:string>")


def links(pages: DataFrame, url_column: str, html_column: str) -> DataFrame:
    """(a, b) alias keys of pages and of the urls that they redirect to or name as canonical."""
    tags = F.regexp_extract_all(F.col(html_column), F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    tag = pages.select(F.col(url_column).alias("url"), F.explode(F.filter(tags, lambda t: t.rlike(r"(?i)canonical|refresh"))).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?i)^<link.*\srel\s*=\s*[\"']?\s*canonical\b"), F.regexp_extract("tag", r"(?is)\shref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?i)^<meta.*\shttp-equiv\s*=\s*[\"']?\s*refresh\b"), F.regexp_extract("tag", r"(?is)url\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    # Step by step: Spark keeps a step whose result is used again, and evaluates it once.
    steps = tag.withColumn("target", F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&"))).where("target <> ''")
    steps = steps.withColumns({"scheme": F.regexp_extract("url", r"(?s)^(.*?)://", 1), "host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    steps = steps.withColumn("root", F.concat("scheme", F.lit("://"), "host"))
    target = F.col("target")
    full = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat("scheme", F.lit(":"), target))
        .when(target.startswith("/"), F.concat("root", target))
        .otherwise(F.concat("root", F.when(F.col("path") == "", F.lit("/")).otherwise(F.regexp_extract("path", r"(?s)^(.*/)", 1)), target))
    )
    ends = with_alias_key(with_alias_key(steps.withColumn("full", full), "url", "a"), "full", "b")
    # As a table, since a filter on the ends would evaluate all steps again.
    return shared.written(ends.select("a", "b"), "links").where("a is not null and b is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_column: str = "url", html_column: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict, which replace columns of these names.

    A rule's own verdict stands. Of the others, one with a blocked alias is
    blocked unless an alias is explicitly allowed: allowing has precedence; all
    else is allowed. ``redirects`` (from_url, to_url) adds links to those found
    in the pages. Null urls and html have no links; relative targets resolve
    against the page; repeated rows get equal verdicts; aliases need not be
    pages themselves.
    """
    edges = links(pages, url_column, html_column)
    if redirects is not None:
        edges = edges.union(with_alias_key(with_alias_key(redirects, "from_url", "a"), "to_url", "b").select("a", "b"))
    groups = shared.components(edges)
    node = groups.withColumn("url", F.concat(F.lit("//://"), "node")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    found = shared.written(node.select("node", "component", rule_for(F.col("host"), F.col("path"), rules).alias("found")), "alias-rules")
    decided = found.groupBy("component").agg(F.max("found.allow").alias("allowed"), F.max(~F.col("found.allow")).alias("blocked"))
    blocked = groups.join(decided.where("blocked and not coalesce(allowed, false)"), "component").select(F.col("node").alias("__blocked"))

    base = pages.drop("host", "path", "rule", "verdict")
    url = F.col(url_column)
    rows = with_alias_key(base.withColumns({"host": host_of(url), "path": path_of(url)}), url_column, "__key")
    rows = rows.withColumn("__own", rule_for(F.col("host"), F.col("path"), rules)).join(blocked, F.col("__key") == F.col("__blocked"), "left")
    by_rule = F.when(F.col("__own.allow"), F.lit("allow")).when(~F.col("__own.allow"), F.lit("block"))
    by_alias = F.when(F.col("__blocked").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(*base.columns, "host", "path", F.col("__own.rule").alias("rule"), F.coalesce(by_rule, by_alias).alias("verdict"))
