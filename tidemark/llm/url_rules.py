"""URL filter: rules on host and path, and block decisions that follow redirects and canonical links.

A rule names a host (and so its subdomains) and the start of a path; the longest rule that fits decides. Pages tell of
other addresses of themselves by a canonical link or a refresh; these links are the edges of a graph over addresses (host,
path and query, without scheme and fragment), whose connected components are the sets of aliases. An address without a
rule is blocked if a rule blocks one of its aliases and none allows one; an address's own rule always holds.

Defined results: an address that is null or without "://" has an empty host and path, no rule and no aliases, and is
allowed; repeated rows are judged each; links inside comments and scripts do not count; a relative link is joined to the
page's folder as written. Other columns pass through; added columns replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components

#: Rules as (action, host/path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))
#: Rules become expressions, so a list may hold so many.
MOST_RULES = 500

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"^[^/?#]*"
PATH = r"^[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*(\?[^#]*)"
CANONICAL = r"""(?i)<link\s(?:[^>]*\s)?rel\s*=\s*["']?canonical(?:["'\s][^>]*)?>"""
HREF = r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\s(?:[^>]*\s)?http-equiv\s*=\s*["']?refresh(?:["'\s][^>]*)?>"""
TARGET = r"""(?i)url\s*=\s*["']?([^"'\s>]+)"""
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), HOST, 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), PATH, 1), F.lit(""))


def address_of(url: Column) -> Column:
    return F.concat(host_of(url), path_of(url), F.coalesce(F.regexp_extract(_rest(url), QUERY, 1), F.lit("")))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, action); null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pairs of addresses that pages declare to be the same: columns ``a``, ``b``."""
    seen = F.regexp_replace(html, UNSEEN, " ")
    said = F.when(F.col(html).rlike("(?i)canonical|refresh"), F.concat(
        F.transform(F.regexp_extract_all(seen, F.lit(CANONICAL), F.lit(0)), lambda tag: F.regexp_extract(tag, HREF, 1)),
        F.transform(F.regexp_extract_all(seen, F.lit(REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, TARGET, 1))))
    u = F.col(url)
    rows = pages.where(host_of(u) != "").select(
        address_of(u).alias("a"), host_of(u).alias("host"), path_of(u).alias("path"), F.explode(said).alias("link"))
    link = F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^.*/", 0)).otherwise("/")
    target = (F.when(link.contains("://"), link)
              .when(link.startswith("//"), F.concat(F.lit("x:"), link))
              .when(link.startswith("/"), F.concat(F.lit("x://"), "host", link))
              .otherwise(F.concat(F.lit("x://"), "host", folder, link)))
    return (rows.where("link <> ''").select("a", address_of(target).alias("b"))
            .where("a <> b").distinct())


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", more_links: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``. ``more_links``: further pairs of addresses ``a``, ``b``."""
    edges = links(pages, url, html)
    if more_links is not None:
        edges = edges.unionByName(more_links.select("a", "b"))
    u = F.col(url)
    done = pages.withColumns({"host": host_of(u), "path": path_of(u)})
    done = done.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("rule", F.col("_rule.rule"))
    groups = components(edges)
    own = rule_of(F.regexp_extract("v", HOST, 0), F.regexp_extract("v", PATH, 1), rules)["action"]
    decided = groups.groupBy("component").agg(
        (F.max((own == "block").cast("int")) > F.coalesce(F.max((own == "allow").cast("int")), F.lit(0))).alias("blocked"))
    blocked = (groups.join(decided.where("blocked"), "component")
               .select(F.col("v").alias("_address"), F.lit("block").alias("_alias")))
    out = done.withColumn("_address", address_of(u)).join(blocked, "_address", "left")
    return out.withColumn("verdict", F.coalesce("_rule.action", "_alias", F.lit("allow"))).drop("_rule", "_address", "_alias")
