"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, shared

#: Between two words of a text, as far as sizes go.
SPACES = r"[^\x20\x09-\x0D]+"
BINS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with the target of each source.

    Sources in code point order, null last, take the weights in turn.  A target is level * weight, but not above
    `most` times the source's size, with the level chosen so that the targets sum to `share` of all sizes (or all are
    at their limit).  In order of limit / weight the sources that stop are a prefix, so running sums give the level.
    One row per source is all that the two windows see.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_limit = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_limit", most * F.col("source_size")).withColumn("_ratio", F.col("_limit") / F.col("_w"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_stopped", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
    s = s.withColumn("_left_w", F.sum("_w").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("_level", (share * F.sum("source_size").over(every) - F.col("_stopped")) / F.col("_left_w"))
    s = s.withColumn("_final", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"])
    return s.select("source", "source_size", F.coalesce(F.least(F.col("_limit"), F.col("_final") * F.col("_w")), F.col("_limit")).cast("double").alias("target"))


def copies_by_class(classes: DataFrame, target: DataFrame, most: float) -> DataFrame:
    """Expected copies of a document by (source, class): level * preference, at most `most`, summing to the target.

    The same levelling as in targets(), over the few classes of a source.
    """
    by_limit = Window.partitionBy("source").orderBy("_ratio", "_class")
    s = classes.join(target, classes["source"].eqNullSafe(target["source"])).select(classes["source"], "_class", "_words", "_pref", "source_size", "target")
    s = s.withColumn("_ratio", most / F.col("_pref"))
    s = s.withColumn("_stopped", F.coalesce(F.sum(most * F.col("_words")).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_left", F.sum(F.col("_pref") * F.col("_words")).over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("target") - F.col("_stopped")) / F.nullif(F.col("_left"), F.lit(0.0)))
    s = s.withColumn("_final", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(Window.partitionBy("source"))["_level"])
    m = F.least(F.lit(float(most)), F.coalesce(F.col("_final") * F.col("_pref"), F.lit(float(most))))
    return s.select("source", "_class", "source_size", "target", m.alias("_m"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, corrections: int = 3) -> DataFrame:
    """docs with size, source_size, target, copies and taken.

    Every document has expected copies that grow with its length class (half a share more for each doubling, the
    preference) and reach its source's target in sum.  The whole part is certain.  The rest is an inclusion
    probability p; documents are ranked by [u / (1 - u)] / [p / (1 - p)] with u from a hash of doc_id and text, and
    those ranked first are taken until the source's words are full.  Then `corrections` times one document goes in or
    out, the one whose size comes nearest to the words still missing or too many, if that helps.

    The running sum goes over BINS bins of the rank, then BINS bins inside the bin where it ends, then over the rows
    of that last bin: no task holds a source.  Rows equal in all columns rank alike and are taken or left together.
    A null or empty text has size 0; sources of size 0 take nothing; null is a source of its own.  A very long text is
    one document like others, taken whole or not.  Columns of docs that have one of the new names are replaced, all
    others stay.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    base = packed(docs, new).select("_row", "_row.doc_id", "_row.text", "_row.source", size_of(F.col("_row.text")).alias("size"))
    base = base.withColumn("_u", (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52))
    base = base.withColumn("_class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(-1).cast("int"))
    narrow = cut(base.select("source", "size", "_u", "_class"))
    pref = 1.0 + 0.5 * (F.col("_class") + 1)
    classes = narrow.groupBy("source", "_class").agg(F.sum("size").alias("_words")).withColumn("_pref", pref)
    classes = cut(classes)
    target = cut(targets(classes.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most))
    expected = cut(copies_by_class(classes, target, most))
    p = F.col("_m") - F.floor("_m")
    # 0 and 1 need no draw: the first is never reached, the second always is
    key = F.when(p <= 0, F.lit(None)).otherwise(F.col("_u") / (1 - F.col("_u")) / (p / F.greatest(1 - p, F.lit(1e-12))))
    rank = key / (1 + key)

    def placed(df: DataFrame) -> DataFrame:
        e = shared(expected.select(F.col("source").alias("_s"), F.col("_class").alias("_c"), "source_size", "target", "_m"))
        df = df.join(e, df["source"].eqNullSafe(e["_s"]) & (df["_class"] == e["_c"]), "left").drop("_s", "_c")
        return df.withColumn("_rank", rank).withColumn("_b1", F.least(F.floor(F.col("_rank") * BINS), F.lit(BINS - 1)).cast("int")).withColumn("_b2", F.least(F.floor((F.col("_rank") * BINS - F.col("_b1")) * BINS), F.lit(BINS - 1)).cast("int"))

    ranked = placed(narrow)
    certain = ranked.groupBy("source").agg(F.sum(F.floor("_m") * F.col("size")).alias("_certain"), F.max("target").alias("_target"))
    need = cut(certain.select(F.col("source").alias("_s"), (F.col("_target") - F.col("_certain")).alias("_need")))

    def running(df: DataFrame, bins: list[str], by: list[str]) -> DataFrame:
        """Words by bin, with those of all bins before."""
        w = Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        g = df.where("_rank is not null").groupBy("source", *bins).agg(F.sum("size").alias("_words"))
        return g.withColumn("_before", F.coalesce(F.sum("_words").over(w), F.lit(0)))

    def crossing(g: DataFrame, offset: Column, bins: list[str]) -> DataFrame:
        """The bin of each source in which the need is met."""
        hit = (offset + F.col("_before") <= F.col("_need")) & (offset + F.col("_before") + F.col("_words") > F.col("_need"))
        return g.where(hit).select("source", *bins, (offset + F.col("_before")).alias("_sum"), "_need")

    needs = shared(need)
    first = running(ranked, ["_b1"], ["_b1"])
    first = cut(crossing(first.join(needs, F.col("source").eqNullSafe(F.col("_s"))), F.lit(0), ["_b1"]))
    f = shared(first.select(F.col("source").alias("_s"), F.col("_b1").alias("_x1"), "_sum", "_need"))
    inside = ranked.join(f, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b1") == F.col("_x1")))
    second = running(inside, ["_b2", "_sum", "_need", "_b1"], ["_b2"])
    second = cut(crossing(second, F.col("_sum"), ["_b1", "_b2"]))
    f = shared(second.select(F.col("source").alias("_s"), F.col("_b1").alias("_x1"), F.col("_b2").alias("_x2"), "_sum", "_need"))
    inside = ranked.join(f, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b1") == F.col("_x1")) & (F.col("_b2") == F.col("_x2")))
    third = running(inside, ["_rank", "_sum", "_need"], ["_rank"])
    third = cut(crossing(third, F.col("_sum"), ["_rank"]).select(F.col("source").alias("_s"), F.col("_rank").alias("_cut"), (F.col("_need") - F.col("_sum")).alias("_gap")))
    cuts = need.join(third.withColumnRenamed("_s", "_s1"), F.col("_s").eqNullSafe(F.col("_s1")), "left").select("_s", "_cut", F.coalesce("_gap", F.lit(0.0)).alias("_gap"), "_need", F.array().cast("array<struct<rank:double,size:bigint>>").alias("_changed"))
    cuts = cut(cuts)
    me = F.struct(F.col("_rank").alias("rank"), F.col("size").alias("size"))
    inside = F.when(F.col("_cut").isNull(), F.col("_need") > 0.5).otherwise(F.col("_rank") < F.col("_cut"))
    changed = F.array_contains("_changed", me)
    drawn = F.col("_rank").isNotNull() & (inside != changed)
    # the one document that brings a source nearest to its words goes in or out, a few times
    for _ in range(corrections):
        t = shared(cuts)
        delta = F.when(drawn, -F.col("size")).otherwise(F.col("size"))
        open_ = ranked.join(t, F.col("source").eqNullSafe(F.col("_s"))).where("_cut is not null and _rank is not null and size > 0").where(~changed)
        best = open_.groupBy("source").agg(F.min(F.struct(F.abs(F.col("_gap") - delta).alias("miss"), F.col("_rank").alias("rank"), F.col("size").alias("size"), delta.alias("delta"), F.col("_gap").alias("gap"))).alias("_n"))
        best = best.where("_n.miss < abs(_n.gap)").select(F.col("source").alias("_s2"), "_n")
        cuts = cuts.join(best, F.col("_s").eqNullSafe(F.col("_s2")), "left")
        more = F.when(F.col("_n").isNotNull(), F.array_append("_changed", F.struct(F.col("_n.rank").alias("rank"), F.col("_n.size").alias("size")))).otherwise(F.col("_changed"))
        cuts = cut(cuts.select("_s", "_cut", (F.col("_gap") - F.coalesce("_n.delta", F.lit(0))).alias("_gap"), "_need", more.alias("_changed")))
    out = placed(base).join(shared(cuts), F.col("source").eqNullSafe(F.col("_s")), "left")
    copies = (F.floor("_m") + F.coalesce(drawn, F.lit(False)).cast("long")).cast("long")
    return out.select("_row.*", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
