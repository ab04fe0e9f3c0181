"""URL filters that reach aliases: block decisions spread over redirects and canonical links.

A page that redirects (meta refresh, or a given table of redirects) or names a canonical address is an alias of its
target. Aliases are the connected components of these links, found by rounds of joins; links, components and addresses
stay in tables. A rule fits its host and all subdomains, from a path on; of the rules that fit, the longest wins.

Precedence: an address's own rule always decides, so an explicit allow stands against a block that reaches it through
aliases. An address without a rule is blocked when any address of its component is blocked by a rule, pages that were
never fetched included; else it is allowed.

An address (a node of the links) is host, path and query, without scheme and fragment, the empty path read as ``/``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.components import components
from vitalgrid.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query, host and path apart.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

# One attribute value: in double quotes, in single quotes, or bare.
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The node of a url; null without ``://`` or host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host_of(url), path, query))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def own_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of rule and verdict of the longest rule that fits, null where none does.

    Of rules of one length the one with the longer host wins, then an allow.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(ranked):
        out = F.when(
            _fits(rule, host, path), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        ).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?i)\s{name}{_VALUE}"
    parts = [F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]
    return F.replace(F.concat(*parts), F.lit("&amp;"), F.lit("&"))


def page_targets(html: Column) -> Column:
    """Addresses as written that a page names as its canonical one or refreshes to; comments and scripts don't count."""
    some = html.rlike("(?i)canonical|http-equiv")
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    tags = F.when(some, F.regexp_extract_all(bare, F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), 0)).otherwise(
        F.array().cast("array<string>")
    )
    canonical = F.transform(
        F.filter(
            tags,
            lambda t: t.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"),
        ),
        lambda t: F.trim(_attribute(t, "href")),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike("(?i)^<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh")),
        lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"""(?i)[;,]\s*url\s*=\s*['"]?([^'"]*)""", 1)),
    )
    return F.filter(F.concat(canonical, refresh), lambda u: u != "")


def _without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments worked out."""
    start = F.array().cast("array<string>")
    done = F.aggregate(
        F.split(path, "/"),
        start,
        lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1))))
        .when(s == ".", a)
        .otherwise(F.concat(a, F.array(s))),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.array_join(done, "/"), tail)).otherwise(path)


def resolved(url: Column, ref: Column) -> Column:
    """The absolute form of a reference found on the page at ``url``."""
    scheme = F.regexp_extract(url, "^[^:/?#]*", 0)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    path = F.regexp_extract(ref, "^[^?#]*", 0)
    rest = F.substring(ref, F.length(path) + 1, F.length(ref))
    folder = F.regexp_extract(path_of(url), "^.*/", 0)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))  # mailto:, javascript: and the like
        .when(ref.startswith("/"), F.concat(root, _without_dots(path), rest))
        .when(path == "", F.concat(root, path_of(url), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def alias_links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Distinct links (a, b) between different addresses, from the pages and from rows (url, target) of redirects."""
    named = pages.select("url", F.explode(page_targets(F.col("html"))).alias("ref"))
    found = named.select("url", resolved(F.col("url"), F.col("ref")).alias("target"))
    if redirects is not None:
        found = found.unionByName(
            redirects.select("url", resolved(F.col("url"), F.trim("target")).alias("target"))
        )
    links = found.select(address(F.col("url")).alias("a"), address(F.col("target")).alias("b"))
    return links.where("a <> b").distinct()


def blocked_aliases(links: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Addresses whose component has one that a rule blocks: node, component."""
    reach = materialize(components(links), "aliases")
    host, path = F.regexp_extract("node", "^[^/]*", 0), F.regexp_extract("node", "^[^/]*([^?]*)", 1)
    blocked = reach.where(own_rule(host, path, rules)["verdict"] == "block").select("component").distinct()
    return reach.join(blocked, "component").select("node", "component")


def judged_pages(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and alias_of.

    ``alias_of`` is the component (its smallest address) through which a block came, else null. A null url or one
    without ``://`` has empty host and path, fits no rule, has no aliases and is allowed. Null html names no target.
    Repeated urls get equal answers, a row each; empty table: no rows. Very long html is scanned once per pattern.
    Other columns are ignored, whatever their names.
    """
    links = materialize(alias_links(pages.select("url", "html"), redirects), "alias_links")
    rows = pages.select("page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("node")
    )
    rows = rows.withColumn("own", own_rule(F.col("host"), F.col("path"), rules))
    columns = ["page_id", "host", "path"]
    none = F.lit(None).cast("string")
    # only pages that no rule decides meet the aliases, and none with a null key
    ruled = rows.where("own is not null or node is null").select(
        *columns,
        F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.lit("allow")).alias("verdict"),
        none.alias("alias_of"),
    )
    if links.limit(1).count() == 0:
        reached = rows.select("node", none.alias("component")).limit(0)
    else:
        reached = blocked_aliases(links, rules)
    open_rows = rows.where("own is null and node is not null").join(reached, "node", "left")
    judged = open_rows.select(
        *columns,
        none.alias("rule"),
        F.when(F.col("component").isNotNull(), "block").otherwise("allow").alias("verdict"),
        F.col("component").alias("alias_of"),
    )
    return ruled.unionByName(judged)
