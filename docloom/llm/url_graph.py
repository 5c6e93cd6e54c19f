"""URL filters: rules first, then trust and distrust propagated over the host graph.

Personalised PageRank spreads trust from hosts that rules allow along links, and
distrust from hosts that rules block against links: who links to a blocked host
inherits distrust.  Verdicts use exposure, distrust weighted by the share of a host's own
links, so that it is the same however many others link to the same place.  All of it is DataFrame work on host edges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import store

#: (rule, verdict): a host suffix and a path prefix; the longest rule that fits decides.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (struct of rule and verdict) that fits, or null; rules are a short parameter, so this is one expression."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        ours = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        fits = F.when(ours, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


#: Character references that can stand in the part of a link that names its host.
REFERENCES = ((r"&(?:#47|#[xX]2[fF]|sol);", "/"), (r"&(?:#58|#[xX]3[aA]|colon);", ":"), (r"&(?:#46|#[xX]2[eE]|period);", "."), (r"&(?:#45|#[xX]2[dD]|hyphen|dash);", "-"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``n``: links between different hosts in the pages' href attributes.

    Absolute links and those that begin with ``//`` name a host; all others stay on their own.
    """
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?\s*([a-z&/][^"'\s>]+)"""), F.lit(1))).alias("link"))
    link = F.col("link")
    for written, meant in REFERENCES:
        link = F.regexp_replace(link, written, meant)
    links = links.select("src", F.regexp_replace(link, r"^//", "http://").alias("link")).where(F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    links = links.select("src", host_of(F.col("link")).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(pages: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """``host``, ``trust``, ``distrust``, ``exposure`` of each host that any seed reaches.

    ``seeds`` has ``host``, ``trusted`` and ``blocked`` weights; each kind is scaled to
    the number of its seeds, so scores do not depend on the size of the web.  A host shares
    out its trust over its links and its distrust over those that lead to it; its exposure
    is what the hosts that it links to have, weighted by its links.  Rounds go on until no more
    than ``tolerance`` of the mass is left to spread, or scores move by no more than that
    share of their sum.  Only hosts and links are moved, summed up by pairs of hosts; a host
    with very many links is split by Spark's skew join, as sums are formed before the next shuffle.
    """
    kinds = seeds.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "host", F.col("trusted").cast("double").alias("weight")), F.struct(F.lit("distrust").alias("kind"), "host", F.col("blocked").cast("double").alias("weight")))).alias("s")).select("s.*").where("weight > 0")
    kinds = kinds.unionAll(kinds.where("kind = 'distrust'").withColumn("kind", F.lit("exposure")))
    start = store(kinds, "seeds")
    edges = store(host_edges(pages), "host-edges")
    # trust follows links, distrust goes against them; a sender divides its score by its links of that direction
    moves = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionAll(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    totals = moves.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    parts = moves.join(totals, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("part"))
    # exposure goes the way of distrust, but is divided by all links of the host that takes it
    given = edges.join(edges.groupBy("src").agg(F.sum("n").alias("all")), "src").select(F.lit("exposure").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("part"))
    moves = store(parts.unionAll(given), "host-moves")
    scores = start.select("kind", "host", ((1 - damping) * F.col("weight")).alias("score"))
    rounds = 0 if moves.isEmpty() else math.ceil(math.log(tolerance) / math.log(damping))
    for _ in range(rounds):
        gained = scores.join(moves, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        base = start.select("kind", "host", ((1 - damping) * F.col("weight")).alias("own"))
        new = gained.join(base, ["kind", "host"], "full").select("kind", "host", (F.coalesce("own", F.lit(0.0)) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        new = store(new, "host-scores")
        both = new.join(scores.withColumnRenamed("score", "old"), ["kind", "host"], "full")
        change, total = both.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))), F.sum("score")).first()
        scores = new
        if not change or change <= tolerance * total:
            break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"), of("exposure").alias("exposure"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, least_distrust: float = 0.05) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    A fitting rule decides.  Seeds are hosts by the share of their pages that rules
    allow or block.  A page without a rule is blocked if its host's exposure reaches
    ``least_distrust`` and exceeds its trust, else allowed.  A url that is null or has no
    ``://`` has an empty host and path, and is allowed.  Ids may be null or repeated; an empty
    table gives no row, null html has no link, and other columns are not looked at.
    """
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    placed = placed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("fit.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = placed.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    scores = store(host_scores(pages, seeds), "scores")
    bad = store(scores.where((F.round("exposure", 9) >= least_distrust) & (F.round("exposure", 9) > F.round("trust", 9))).select("host", F.lit(True).alias("bad")), "bad-hosts")
    rows = placed.join(bad, "host", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bad"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
