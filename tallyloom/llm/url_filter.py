"""URL filter with redirect equivalence.

Rules block or allow hosts and paths. A page may go by several addresses: its redirect (meta refresh) and its canonical
link name others. Addresses joined by such edges, in either direction and over any number of steps, are aliases: an
address that no rule fits is blocked if an alias is blocked by a rule, unless an alias is explicitly allowed. A rule that
fits an address itself always decides about it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import settle
from tallyloom.llm.components import components

# (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
MAX_RULES = 20_000  # rules travel inside the plan

ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
LINK, META = r"(?i)<link\b[^>]*>", r"(?i)<meta\b[^>]*>"
# After the seconds of a refresh; an unquoted address runs to the end.
REFRESH_URL = r"""(?is)^[\d.\s]*[;,]?\s*url\s*=\s*(?:"([^"]*)|'([^']*)|([^"'\s].*))"""
# Character references that addresses hold; the ampersand's come last.
REFERENCES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))



def host_of(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A to Z lower-cased; empty for null and other texts."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 2)


def key_of(url: Column) -> Column:
    """What names an address: host, path and query, whatever the scheme and the fragment; null without a host."""
    path = path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 3)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def resolved(target: Column, url: Column) -> Column:
    """A link's target as seen from a page's address; null if the target is empty or the page has no host."""
    root = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    full = (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, folder, target))
    )
    return F.when((F.coalesce(target, F.lit("")) != "") & (host_of(url) != ""), full)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. No join: host suffixes are looked up."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    by_host: dict[str, list[Column]] = {}
    for verdict, rule_host, rule_path in rules:
        rule = F.struct(
            F.lit(len(rule_host + rule_path)).alias("size"), F.lit(rule_host + rule_path).alias("rule"),
            F.lit(verdict).alias("verdict"), F.lit(rule_path).alias("path"),
        )
        by_host.setdefault(rule_host, []).append(rule)
    table = F.create_map(*[x for h, fits in by_host.items() for x in (F.lit(h), F.array(*fits))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    longest = F.array_max(F.filter(found, lambda r: path.startswith(r["path"])))
    return F.when(longest.isNotNull(), F.struct(longest["rule"].alias("rule"), longest["verdict"].alias("verdict")))


def _one_of(text: Column, pattern: str) -> Column:
    """What the one of three groups that took part holds; empty without a match."""
    return F.concat(*[F.regexp_extract(text, pattern, n) for n in (1, 2, 3)])


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, character references resolved, without blanks around it; empty if it has none."""
    value = _one_of(tag, rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    for reference, character in REFERENCES:
        value = F.replace(value, F.lit(reference), F.lit(character))
    return F.btrim(value, F.lit(" \t\n\f\r"))


def link_targets(html: Column) -> Column:
    """What all canonical links and refreshes of a page name, as written; null for null. `canonical` may be one of several
    words of rel.
    """
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    canonical = F.filter(tags(LINK), lambda t: attribute(t, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"))
    refresh = F.filter(tags(META), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh")
    address = lambda t: F.btrim(_one_of(attribute(t, "content"), REFRESH_URL), F.lit(" \t\n\f\r"))
    return F.concat(F.transform(canonical, lambda t: attribute(t, "href")), F.transform(refresh, address))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): keys of a page's address and of each address that its redirects and canonical links name."""
    hint = F.col("html").rlike("(?i)canonical|refresh")
    found = pages.where(hint & F.col("url").isNotNull()).select("url", F.explode(link_targets(F.col("html"))).alias("target"))
    return found.select(key_of(F.col("url")).alias("a"), key_of(resolved(F.col("target"), F.col("url"))).alias("b")).where(
        "a is not null and b is not null"
    )


def alias_verdicts(edges: DataFrame, rules=RULES) -> DataFrame:
    """(key, verdict) for addresses with edges whose aliases a rule fits: allow if it allows one, else block."""
    nodes = components(edges, "url-aliases")
    address = F.concat(F.lit("http://"), F.col("node"))
    ruled = nodes.withColumn("verdict", rule_of(host_of(address), path_of(address), rules)["verdict"])
    ruled = settle(ruled, "url-ruled")
    # "allow" sorts before "block": allowing takes precedence.
    decided = ruled.where("verdict is not null").groupBy("root").agg(F.min("verdict").alias("verdict"))
    return ruled.drop("verdict").join(decided, "root").select(F.col("node").alias("key"), "verdict")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages' rows (page_id, url, html; others are ignored) as (page_id, host, path, rule, verdict).

    rule is the rule that fits, else null; without one the verdict follows the aliases, else it is allow. Rows, repeats
    included, get a row each; a null url or one without :// has empty host and path and is allowed; null html has no links.
    """
    edges = settle(alias_edges(pages), "url-edges")
    own = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key")
    )
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    aliases = alias_verdicts(edges, rules).withColumnRenamed("verdict", "by_alias")
    return own.join(aliases, "key", "left").select(
        "page_id", "host", "path", "own.rule", F.coalesce("own.verdict", "by_alias", F.lit("allow")).alias("verdict")
    )
