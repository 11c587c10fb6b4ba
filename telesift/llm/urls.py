"""URL filters: rules by host and path, and trust that spreads over links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, drop, packed, shared

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if there is none."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, added up before they are shuffled.  Relative links stay on a host."""
    found = pages.select(F.col("_host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("_url"))
    target = host_of(F.when(F.startswith("_url", F.lit("//")), F.concat(F.lit("http:"), F.col("_url"))).otherwise(F.col("_url")))
    return found.select("src", target.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def pagerank(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-6, follow: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, seed summing to 1) over edges (src, dst, share).

    share is the part of src's links that go to dst.  The rank of a host without links goes back to the seeds: that
    solution is the one in which it is lost, scaled to a sum of 1.  Contributions are added up within tasks before they
    are shuffled, so a host that everyone links to is one row per task.  Goes on until `cut_every` rounds reach no
    further host and change the ranks by `tolerance` or less in sum.
    """
    rank = cut(seeds.select("host", F.col("seed").alias("rank")))
    while True:
        last = rank
        for _ in range(cut_every):
            moved = edges.join(rank, edges["src"] == rank["host"]).select(F.col("dst").alias("host"), (follow * F.col("share") * F.col("rank")).alias("x"))
            base = seeds.select("host", ((1 - follow) * F.col("seed")).alias("x"))
            rank = moved.unionByName(base).groupBy("host").agg(F.sum("x").alias("rank"))
        rank = cut(rank)
        # hosts once reached stay reached
        both = rank.join(last.select("host", F.col("rank").alias("was")), "host", "left")
        found = both.agg(F.count(F.when(F.col("was").isNull(), 1)).alias("new"), F.sum(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0)))).alias("change")).first()
        drop(last)
        if not found["new"] and (found["change"] or 0) <= tolerance:
            total = rank.agg(F.sum("rank").alias("t")).first()["t"]
            return rank.withColumn("rank", F.col("rank") / F.lit(total or 1.0))


def judge(pages: DataFrame, rules=RULES, tolerance: float = 1e-6, follow: float = 0.85, most: float = 0.5) -> DataFrame:
    """pages with host, path, rule, trust, distrust and verdict.

    A rule's verdict stands.  Other pages go by their host: trust starts at hosts in proportion to their pages that
    rules allow and follows links; distrust starts likewise at blocked pages and follows links backwards, to those
    that link there.  A host is blocked if distrust is more than `most` of the two; without any of both it is allowed.
    A null url or one without :// has an empty host, which takes part in nothing.  Null html has no links.  Very long
    pages are read whole.  Repeated rows count as pages of their own and get the same verdict.  Of rules that fit with
    equal length the last in the order of (verdict, host, path) holds.  Columns of pages that have one of the new names
    are replaced, all others stay.
    """
    new = ("host", "path", "rule", "trust", "distrust", "verdict")
    p = packed(pages, new).select("_row", F.col("_row.html").alias("html"), host_of(F.col("_row.url")).alias("_host"), path_of(F.col("_row.url")).alias("_path"))
    rule, verdict = best_rule(F.col("_host"), F.col("_path"), rules)
    p = p.withColumns({"_rule": rule, "_verdict": verdict})
    hosts = cut(p.where("_host <> ''").groupBy("_host").agg(F.count(F.when(F.col("_verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("_verdict") == "block", 1)).alias("b")))
    total = hosts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    links = cut(host_links(p))
    scores = []
    for name, col, src, dst in (("trust", "a", "src", "dst"), ("distrust", "b", "dst", "src")):
        if not total[col]:
            scores.append(None)
            continue
        edges = links.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "n")
        out = edges.groupBy("src").agg(F.sum("n").alias("total")).withColumnRenamed("src", "_src")
        edges = cut(edges.join(out, F.col("src") == F.col("_src")).select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
        seeds = hosts.where(F.col(col) > 0).select(F.col("_host").alias("host"), (F.col(col) / float(total[col])).alias("seed"))
        scores.append(pagerank(edges, seeds, tolerance, follow).withColumnRenamed("rank", name))
    known = [s for s in scores if s is not None]
    if not known:
        per_host = hosts.select(F.col("_host").alias("host"))
    elif len(known) == 2:
        per_host = known[0].join(known[1], "host", "full_outer")
    else:
        per_host = known[0]
    for name in ("trust", "distrust"):
        if name not in per_host.columns:
            per_host = per_host.withColumn(name, F.lit(0.0))
    per_host = cut(per_host.select(F.col("host").alias("_h"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    out = p.join(shared(per_host), F.col("_host") == F.col("_h"), "left")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    blocked = d > most * (t + d)
    return out.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), t.alias("trust"), d.alias("distrust"), F.coalesce("_verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"))
