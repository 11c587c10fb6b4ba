"""The stored trigram index and deep pages: same rows as the plain way, and what the plans read."""

import re

import pytest
from pyspark.sql import functions as F

from telesift.functions.params import SearchParams
from telesift.operators import search, trigram
from telesift.operators.paging import page_of
from telesift.sources import tables


def captions(spark, *texts, first=0):
    return spark.createDataFrame([(first + i, x) for i, x in enumerate(texts)], "caption_id long, text string")


def found(df):
    return sorted(r.caption_id for r in df.collect())


@pytest.fixture
def index(spark, tmp_path):
    return trigram.Index(spark, str(tmp_path / "index"), buckets=16)


def test_lookup(spark, index):
    all_rows = captions(spark, "The Nation", "station", "ABC tion", "t i o n", "", None, "日本語の字幕", "tiontion")
    index.add(all_rows, 1)
    for q in ("tion", "TION", "nation", "日本語", "本語の", "zzz", "ab", "", "tiontion"):
        want = found(all_rows.where(F.lower("text").contains(q.lower()))) if len(q) > 2 else []
        assert found(index.lookup(all_rows, q)) == want == found(trigram.lookup(trigram.build(all_rows, trigram.grams_of(q)), all_rows, q)), q


def test_changes(spark, index):
    """Captions that came, went, came again with another text; a step that is written twice."""
    a = captions(spark, "first nation", "second nation")
    for _ in range(2):
        index.add(a, 1)
    index.add(captions(spark, "third nation", first=2), 2)
    index.remove(captions(spark, "first nation"), 3)
    assert found(index.candidates("nation")) == [1, 2]
    index.add(captions(spark, "first stationary"), 4)
    assert found(index.candidates("nation")) == [1, 2] and found(index.candidates("station")) == [0]
    other = trigram.Index(spark, index.path + "2", 16)
    index.compact(other)
    assert found(other.candidates("nation")) == [1, 2] and found(other.candidates("station")) == [0]


def buckets(df):
    return sorted(r[0] for r in df.select(F.col("bucket")).distinct().collect())


def test_only_own_buckets(spark, index):
    """A search reads the folders of its grams only, and a caption writes those of its own only."""
    index.add(captions(spark, *[f"text number {i} of many words here" for i in range(50)]), 1)
    whole = len(spark.read.parquet(index.path + "/came").inputFiles())
    plan = index.read("came", trigram.grams_of("tex"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=|INSET)", plan) and "PushedFilters: [" in plan
    df = index.read("came", trigram.grams_of("tex"))
    df.collect()
    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    read = sum(scans.apply(i).metrics().apply("numPartitions").value() for i in range(scans.size()))
    assert read == 1 < whole
    before = set(spark.read.parquet(index.path + "/came").inputFiles())
    index.add(captions(spark, "qqq", first=99), 2)
    new = set(spark.read.parquet(index.path + "/came").inputFiles()) - before
    assert len(new) == 1
    index.remove(captions(spark, "qqq", first=99), 3)
    assert len(spark.read.parquet(index.path + "/went").inputFiles()) == 1 and found(index.candidates("qqq")) == []


@pytest.mark.parametrize("offset, size", [(0, 7), (95, 10), (500, 50), (990, 50), (1000, 5), (5000, 5)])
def test_deep_page(spark, offset, size):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("k"))
    order = [F.col("k").desc_nulls_last(), F.col("id").asc()]
    want = [r.id for r in rows.orderBy(*order).collect()][offset : offset + size]
    df = page_of(rows, order, offset, size, shallow=100)
    assert [r.id for r in df.orderBy(*order).collect()] == want
    if offset + size > 100 and want:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "SinglePartition" not in plan


def test_deep_search(spark, sf, monkeypatch):
    t = tables.bind(spark, sf)
    plain = [search.search(t, SearchParams(q="the", page=p)).collect() for p in (0, 3, 5)]
    monkeypatch.setattr(search, "SHALLOW", 0)
    monkeypatch.setattr("telesift.operators.paging.page_of.__defaults__", (0,))
    deep = [search.search(t, SearchParams(q="the", page=p)).collect() for p in (0, 3, 5)]
    assert deep == plain and all(plain)


def test_lists(spark, index):
    """Captions of a gram are stored in lists: rows grow with the grams, not with the captions that have them."""
    rows = captions(spark, *["The same Text of many"] * 500, "a\0b\0c", "\U0001f600x\U0001f600y", "ab", first=7).coalesce(1)
    index.add(rows, 1)
    want = {(g, r.caption_id) for r in rows.collect() for g in trigram.grams_of(r.text)}
    stored = spark.read.parquet(index.path + "/came")
    assert stored.count() == len({g for g, _ in want}) < 30
    assert sorted(map(tuple, trigram.single(stored).select("gram", "caption_id").collect())) == sorted(want)


def test_lists_of_some(spark, index, monkeypatch):
    """Texts beyond what is listed together: the same grams in more rows."""
    rows = captions(spark, *[f"text number {i}" for i in range(40)], None, "").coalesce(1)
    plain = trigram.build(rows)
    whole = trigram.postings(rows)
    monkeypatch.setattr(trigram, "TOGETHER", 50)
    parts = [trigram.listed([i], [f"text number {i}"]).num_rows for i in range(40)]
    assert whole.count() < sum(parts)
    assert sorted((r.gram, i) for r in whole.collect() for i in r.ids) == sorted((r.gram, r.caption_id) for r in plain.collect())


@pytest.mark.parametrize("signs", [40, 300_000])
def test_lists_of_many_signs(signs):
    """Texts of a few signs, and of so many that a run and its caption do not fit in 64 bits."""
    every = "".join(chr(0x10000 + i * 7919 % signs) for i in range(300_000))
    texts = [every[i : i + 2000] for i in range(0, 300_000, 2000)] + ["AbC", "ab", ""]
    got = trigram.listed([5 * i for i in range(len(texts))], texts)
    want = {}
    for i, x in enumerate(texts):
        for g in trigram.grams_of(x):
            want.setdefault(g, []).append(5 * i)
    assert dict(zip(got["gram"].to_pylist(), got["ids"].to_pylist(), strict=True)) == want and got.num_rows == len(want)
