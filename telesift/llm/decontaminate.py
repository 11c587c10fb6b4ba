"""Benchmark decontamination: a prefix-filtered set join of shingles, verified over item-sized windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, shared, words

#: Words of a shingle.  Items of fewer words have one shingle of all their words.
SHINGLE = 3


def shingles(found: Column, n: int) -> Column:
    """The runs of n words of an array, joined by spaces (words hold none), in order."""
    return F.when(F.size(found) >= n, F.transform(F.sequence(F.lit(0), F.size(found) - n), lambda i: F.array_join(F.slice(found, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def windows(benchmark: DataFrame, length: int) -> DataFrame:
    """(item, words): the distinct windows of `length` consecutive words of each item; a shorter item is one window."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("_w")).where("item is not null and size(_w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - length + 1, F.lit(1)))
    return b.select("item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, length))).alias("words")).distinct()


def find(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) for each row of docs.

    n_hit counts the words inside any occurrence of a benchmark window, items are the sorted ids of the items with
    one, contaminated is n_hit > 0.

    Every window is a set of shingles with places.  To hold all of it, a document must hold its rarest shingle: that
    is the prefix.  Only places of shingles that the benchmark has leave the scan; they are counted, each window keeps
    the shingle with the fewest places as its prefix, and documents join on prefixes alone.  The place of a prefix
    fixes where the window would start and end, which must lie inside the document; then every other shingle of the
    window must stand at its own place, which compares words, not hashes.

    A null text has no words; a null item text is no item, nor is an item with a null id; items without words are ignored.  Rows are matched by
    doc_id and a hash of the text, so rows that share a doc_id do not mix, and equal rows get equal results.
    """
    spark = docs.sparkSession
    win = windows(benchmark, length)
    n_win = F.size("words")
    q = F.least(n_win, F.lit(SHINGLE))
    parts = [(n, win.where(q == n).withColumn("shingle_list", shingles(F.col("words"), n))) for n in range(1, SHINGLE + 1)]
    win = parts[0][1]
    for _, part in parts[1:]:
        win = win.unionByName(part)
    win = cut(win.select("item", n_win.alias("n"), q.alias("q"), F.col("shingle_list").alias("s"), F.xxhash64("words").alias("_h"), F.concat_ws(" ", "words").alias("window")))
    lengths = [r["q"] for r in win.select("q").distinct().collect()]
    known = cut(win.select("q", F.explode("s").alias("shingle")).distinct().withColumn("sid", F.xxhash64("shingle")))
    # ids of shingles are hashes; if two benchmark shingles ever shared one, numbering them would be needed
    if known.groupBy("sid").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        known = cut(known.withColumn("sid", F.row_number().over(Window.orderBy("shingle")).cast("long")))
    base = docs.select("doc_id", F.xxhash64("text").alias("_t"), words(F.col("text")).alias("_w"))
    placed = [base.select("doc_id", "_t", F.posexplode(shingles(F.col("_w"), n)).alias("pos", "shingle")) for n in lengths]
    empty = spark.createDataFrame([], "doc_id long, _t long, pos int, shingle string")
    places = empty
    for df in placed:
        places = df if places is empty else places.unionByName(df)
    matches = cut(places.join(shared(known.select("shingle", "sid")), "shingle").select("doc_id", "_t", "pos", "sid").distinct())
    often = matches.groupBy("sid").agg(F.count("*").alias("times"))
    # the prefix of each window: its rarest shingle, at its first place in the window; without it there is no match
    w = win.select("item", "n", "window", "s", F.posexplode("s").alias("at", "shingle")).join(known.select("shingle", "sid"), "shingle").join(often, "sid", "left")
    w = w.groupBy("item", "window", "n").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "at", "sid")).alias("rare"), F.collect_list(F.struct("at", "sid")).alias("need"))
    w = cut(w.groupBy("window", "n").agg(F.first("rare").alias("rare"), F.first("need").alias("need"), F.sort_array(F.collect_set("item")).alias("items")).where("rare.times > 0").withColumn("wid", F.xxhash64("window")))
    prefixes = shared(w.select("wid", "n", F.col("rare.sid").alias("sid"), F.col("rare.at").alias("at"), "need"))
    cand = matches.join(prefixes, "sid").withColumn("start", F.col("pos") - F.col("at")).where("start >= 0")
    need = cand.select("doc_id", "_t", "wid", "n", "start", F.size("need").alias("k"), F.explode("need").alias("x")).select("doc_id", "_t", "wid", "n", "start", "k", (F.col("start") + F.col("x.at")).alias("pos"), F.col("x.sid").alias("sid"))
    m = matches.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_t2"), F.col("pos").alias("_p"), F.col("sid").alias("_s"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_t2")) & (F.col("pos") == F.col("_p")) & (F.col("sid") == F.col("_s"))
    whole = need.join(m, same, "left_semi").groupBy("doc_id", "_t", "wid", "n", "start", "k").agg(F.count("*").alias("got")).where("got = k")
    whole = cut(whole.select("doc_id", "_t", "wid", "n", "start"))
    hit_words = whole.select("doc_id", "_t", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p")).distinct().groupBy("doc_id", "_t").agg(F.count("*").alias("n_hit"))
    items = whole.select("doc_id", "_t", "wid").distinct().join(shared(w.select("wid", "items")), "wid").select("doc_id", "_t", F.explode("items").alias("item"))
    items = items.distinct().groupBy("doc_id", "_t").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = hit_words.join(items.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_t2"), "items"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_t2"))).select(F.col("doc_id").alias("_d"), F.col("_t").alias("_t2"), "n_hit", "items")
    counted = docs.select("doc_id", F.xxhash64("text").alias("_t"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_t2")), "left")
    return out.select("doc_id", "_t", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """The rows of docs that hold no benchmark window, with all their columns.

    Null and empty texts hold none and stay, as do all rows without an item to find; repeated rows share their fate, and
    rows that share a doc_id are told apart by their text.
    """
    bad = find(docs.select("doc_id", "text"), benchmark, length).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("_t").alias("_t2")).distinct()
    return packed(docs).join(bad, F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("_row.text") == F.col("_t2")), "left_anti").select("_row.*")
