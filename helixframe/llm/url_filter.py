"""URL filter: host and path rules, and a blocked Bloom filter of listed canonical URLs before an exact hash join.

The filter's blocks of 256 bits follow the list's length up to a bound, so its broadcast is at most 64 MB; a longer
list only lets more false positives through to the exact join, which removes them all. Everything is a DataFrame
expression; no Python runs on the executors.

A null URL, or one without "://", has an empty host and path, fits no rule and is listed nowhere. Repeated rows are
judged alike, ties between rules of one length go to the longer host; an empty list lists nothing, an empty table gives an
empty one. Very long URLs are URLs like others. Other columns of pages and list, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import flag_possible

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`verdict` for URLs on `host` or a subdomain whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, rest = text.partition("/")
        return cls(verdict, host, slash + rest)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without a last slash, and sorted query fields without tracking fields; no scheme or fragment."""
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host_of(url), r"^www\.|:(80|443)$", ""), F.regexp_replace(path_of(url), "/+$", ""), query)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest fitting rule, else nulls. Rules are configuration: each is one expression."""
    text, verdict = None, None
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", list_col: str = "url", blocks: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, canonical, listed) of every page.

    verdict: the longest rule's; without one, "block" if the page's canonical URL is that of a listed URL, else "allow".
    """
    url = F.col("url")
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(url.contains("://"), canonical(url)).alias("canonical"))
    rows = rows.withColumn("rule", rule).withColumn("ruled", ruled)
    wanted = listed.select(canonical(F.col(list_col)).alias("key")).filter(F.col("key").isNotNull() & (F.col("key") != "")).distinct()
    probed = flag_possible(rows, "canonical", wanted, "key", "possible", blocks)
    keep = ["id", "host", "path", "rule", "ruled", "canonical"]
    never = probed.filter("NOT possible").select(*keep, F.lit(False).alias("listed"))
    exact = probed.filter("possible").select(*keep).join(wanted, F.col("canonical") == F.col("key"), "left").select(*keep, F.col("key").isNotNull().alias("listed"))
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("listed"), "block").otherwise("allow"))
    return never.unionByName(exact).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "canonical", "listed")
