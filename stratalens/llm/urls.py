"""URL filters with redirect equivalence. DataFrame functions only.

A page that redirects to, or names as its canonical address, another URL is an alias of it. Aliases are the edges of
a graph whose components share a decision: a URL that no rule fits is allowed if any URL of its component is allowed
by a rule, else blocked if any is blocked by one, else allowed. A URL that a rule fits keeps that rule's verdict.

Only pages with such links, and the URLs they name, enter the graph. Rules are few (a literal expression; at most
MOST_RULES) and are evaluated with the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.components import components
from stratalens.llm.cut import cut

MOST_RULES = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What identifies a page: host, path (/ if empty) and query; scheme and fragment do not count. Null without ://."""
    p, query = path(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host(url), F.when(p == "", "/").otherwise(p), query))


def rule(host_: Column, path_: Column, rules: Sequence[Rule]) -> Column:
    """The number of the longest rule (host and path) that fits, -1 if none does. Of equally long rules, an allowing
    one goes first, then the one first in order."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    which = F
    for i, (_, h, p) in enumerate(ordered):
        which = which.when(((host_ == h) | host_.endswith("." + h)) & path_.startswith(p), F.lit(i))
    return which.otherwise(F.lit(-1)) if ordered else F.lit(-1)


def _of_rule(at: Column, rules: Sequence[Rule], field: str) -> Column:
    """The rule's string or its verdict, by the number that rule() gives; null for -1."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    values = [r[1] + r[2] if field == "rule" else r[0] for r in ordered]
    return F.get(F.array(*[F.lit(v) for v in values]), at) if values else F.lit(None).cast("string")


def _attribute(tag: Column, name: str) -> Column:
    got = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    return F.regexp_replace(got, rf"""(?is)^\s{name}\s*=\s*["']?|["']$""", "")


def _absolute(link: Column, url: Column) -> Column:
    """A link against the page's URL: absolute, scheme-relative, host-relative, query-only or path-relative."""
    scheme, site = F.regexp_extract(url, r"^([^:/?#]*):", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    p = path(url)
    folder = F.when(p == "", "/").otherwise(F.regexp_extract(p, r"(?s)^(.*/)", 1))
    return (
        F.when(link.rlike(r"(?i)^https?://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, p, link)).when((link != "") & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#"), F.concat(site, folder, link))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses of pages and of what they redirect to or name as canonical. Pages without :// have none. An
    end is null if a link leads nowhere."""
    page = pages.select(F.col(url).alias("_url"), F.col(html).alias("_html")).where(F.col("_url").contains("://") & F.col("_html").rlike(r"(?i)canonical|http-equiv"))
    canonical = _attribute(F.regexp_extract("_html", r"""(?is)<link(?=\s)(?=[^>]*\srel\s*=\s*["']?canonical\b)[^>]*>""", 0), "href")
    refresh = _attribute(F.regexp_extract("_html", r"""(?is)<meta(?=\s)(?=[^>]*\shttp-equiv\s*=\s*["']?refresh\b)[^>]*>""", 0), "content")

    def target(content: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(content, r"(?is)^[\s\d.]*[;,]\s*url\s*=\s*(.*)$", 1), "^['\"]|['\"]$", "")

    # one step a projection: each is used several times by the next, and would be copied there otherwise
    named = page.select("_url", canonical.alias("_canonical"), refresh.alias("_refresh"))
    named = named.select("_url", F.explode(F.array("_canonical", target(F.col("_refresh")))).alias("_link")).where("_link != ''")
    named = named.select("_url", F.regexp_replace(F.trim(F.regexp_replace("_link", "[\\t\\r\\n]", "")), "&amp;", "&").alias("_link"))
    named = named.select("_url", _absolute(F.col("_link"), F.col("_url")).alias("_to"))
    return named.select(address(F.col("_url")).alias("a"), address(F.col("_to")).alias("b"))


def judge(pages: DataFrame, rules: Sequence[Rule], *, key: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, alias_of) of each page.

    redirects: more aliases, if known from elsewhere, as (from_url, to_url). alias_of is the least address of the
    page's component, null if it has no alias. Null urls and urls without :// have an empty host and path, fit no
    rule and are allowed. Repeated rows are judged each. No pages: no rows.
    """
    edges = links(pages, url, html)
    if redirects is not None:
        more = redirects.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b"))
        edges = edges.union(more)
    edges = cut(edges.distinct(), "url-links")
    parts = components(edges)
    # addresses have no scheme: one is put before them to take them apart again
    there = F.concat(F.lit("x://"), F.col("node"))
    ruled = parts.withColumn("_rule", rule(host(there), path(there), rules))
    own = _of_rule(F.col("_rule"), rules, "verdict")
    verdicts = ruled.withColumn("_own", own).groupBy("component").agg(F.max(F.col("_own") == "allow").alias("_allow"), F.max(F.col("_own") == "block").alias("_block"))
    shared = parts.join(verdicts, "component").select("node", F.col("component").alias("alias_of"), F.when(F.col("_allow"), "allow").when(F.col("_block"), "block").alias("_shared"))
    rows = pages.select(F.col(key), F.col(url).alias("_url")).select(key, host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), address(F.col("_url")).alias("node"))
    rows = rows.withColumn("_rule", rule(F.col("host"), F.col("path"), rules)).join(shared, "node", "left")
    return rows.select(key, "host", "path", _of_rule(F.col("_rule"), rules, "rule").alias("rule"), F.coalesce(own, "_shared", F.lit("allow")).alias("verdict"), "alias_of")
