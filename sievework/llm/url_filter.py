"""Judge urls by rules, and hosts without a rule by trust and distrust that spread over links.

A rule is a host and the beginning of a path; it fits its host and all subdomains, and
the longest fitting rule decides.  Hosts with pages that rules allow are trusted seeds,
hosts with blocked pages distrusted ones, by the share of their judged pages.  Trust
flows along links (personalised PageRank from the trusted seeds); distrust flows
against them, from blocked hosts to those that link there.  Links are the absolute
``href``s of pages, counted per pair of different hosts.  A page without a rule is
blocked if its host's distrust exceeds ``ratio`` times its trust, else allowed.

Defined cases: a missing url, or one without ``://``, has an empty host and path, no
rule, and is allowed unless the empty host were distrusted; a missing page has no
links; repeated rows count each; without links only a host's own pages speak for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sievework.session import materialize


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed rules of the numbered query.
RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
)


@dataclass(frozen=True)
class LinkSettings:
    damping: float = 0.85
    ratio: float = 1.0
    tolerance: float = 1e-4
    most_rounds: int = 50


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(f"`{url}`"), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(f"`{url}`"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The text and the verdict of the longest fitting rule, on columns ``host`` and ``path``."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``src, dst, n``: links between different hosts."""
    target = F.explode(F.regexp_extract_all(F.col(f"`{html}`"), F.lit(_LINK), F.lit(1)))
    links = pages.select(host_of(url).alias("src"), target.alias("dst")).withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return links.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, links: DataFrame, s: LinkSettings) -> DataFrame:
    """``host, trust, distrust`` from seeds of the same columns, over ``src, dst, n``."""
    links = materialize(links, "host-links")
    scores = materialize(seeds.select("host", "trust", "distrust"), "host-scores")
    if links.isEmpty():
        return scores
    out = links.groupBy("src").agg(F.sum("n").alias("_out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("_in"))
    weighed = links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("_out")).alias("along"), (F.col("n") / F.col("_in")).alias("against"))
    weighed = materialize(weighed, "host-links")
    keep, zero = 1 - s.damping, F.lit(0.0)
    base = scores.select("host", (keep * F.col("trust")).alias("trust"), (keep * F.col("distrust")).alias("distrust"))
    scores = base
    for _ in range(s.most_rounds):
        along = weighed.join(scores, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (s.damping * F.col("along") * F.col("trust")).alias("trust"), zero.alias("distrust"))
        against = weighed.join(scores, F.col("dst") == F.col("host")).select(F.col("src").alias("host"), zero.alias("trust"), (s.damping * F.col("against") * F.col("distrust")).alias("distrust"))
        moved = base.unionByName(along).unionByName(against).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        moved = materialize(moved, "host-scores")
        signed = moved.unionByName(scores.select("host", (-F.col("trust")).alias("trust"), (-F.col("distrust")).alias("distrust")))
        change = signed.groupBy("host").agg(F.abs(F.sum("trust")).alias("t"), F.abs(F.sum("distrust")).alias("d")).agg(F.sum("t"), F.sum("d"), F.count("*")).first()
        scores = moved
        if (change[0] or 0) + (change[1] or 0) <= s.tolerance:
            break
    return scores


def url_filter(
    pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", html: str = "html", settings: LinkSettings = LinkSettings()
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages``."""
    text, verdict = matched_rule(rules)
    judged = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = materialize(judged.select("*", text.alias("rule"), verdict.alias("by_rule")), "judged")
    counts = judged.groupBy("host").agg(F.count(F.when(F.col("by_rule") == "allow", 1)).alias("a"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("b"))
    total = F.greatest(F.col("a") + F.col("b"), F.lit(1))
    seeds = counts.select("host", (F.col("a") / total).alias("trust"), (F.col("b") / total).alias("distrust"))
    scores = spread(seeds, host_links(pages, url, html), settings)
    found = judged.join(scores, "host", "left")
    blocked = F.coalesce(F.col("distrust") > settings.ratio * F.col("trust"), F.lit(False))
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
