"""An inverted index of character trigrams for literal substring search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ascii_fold, contains_folded


STORED = "gram string, ids array<long>, step long, bucket int"
POSTING = pa.schema([("gram", pa.string()), ("ids", pa.list_(pa.int64()))])
#: Signs of text whose grams are listed together.
TOGETHER = 1 << 20
#: Captions whose ids are equal but for so many bits are listed together when an index is compacted.
BLOCK = 20


def trigrams(x: Column) -> Column:
    """The distinct runs of three characters.  One pass of a lookahead finds them, so time grows with the text."""
    return F.array_distinct(F.regexp_extract_all(ascii_fold(x), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def build(captions: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(gram, caption_id): rebuilt, or appended to for new captions and anti-joined for deleted ones.

    only: the grams that are wanted; others make no row.
    """
    grams = trigrams(F.col("text"))
    return captions.select(F.explode(grams if only is None else F.filter(grams, lambda g: g.isin(only))).alias("gram"), "caption_id")


def listed(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """(gram, ids): each run of three characters of the texts, with the captions that have it."""
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    signs += 32 * ((signs >= 65) & (signs <= 90))
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    inside = np.flatnonzero(row[2:] == row[:-2])
    used = np.bincount(signs) > 0
    known, place = np.flatnonzero(used), (np.cumsum(used) - 1)[signs]
    width, bits = len(known).bit_length(), len(texts).bit_length()
    keys, names = (place[inside] << width | place[inside + 1]) << width | place[inside + 2], None
    if 3 * width + bits > 63:  # so many different signs that the runs get numbers of their own
        names, keys = np.unique(keys, return_inverse=True)
    pairs = keys << bits | row[inside]
    pairs.sort()
    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
    gram, row = pairs >> bits, pairs & (1 << bits) - 1
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    keys = gram[starts] if names is None else names[gram[starts]]
    starts, low = np.append(starts, len(gram)), (1 << width) - 1
    parts = np.stack([keys >> 2 * width, keys >> width & low, keys & low], axis=1)
    text = known[parts].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.array(ids, np.int64)[row], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string()), lists], schema=POSTING)


def postings(captions: DataFrame) -> DataFrame:
    """(gram, ids): build() with the captions of a gram in lists, one for each TOGETHER signs of text.

    A list costs eight bytes a caption where a row of its own costs its gram as well, and a place in the sort.
    """

    def run(batches):
        for b in batches:
            ids, texts, n = [], [], 0
            for i, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py() or ""
                if n and n + len(text) > TOGETHER:
                    yield listed(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(i.as_py())
                texts.append(text)
                n += len(text)
            yield listed(ids, texts)

    return captions.where("caption_id is not null").select(F.col("caption_id").cast("long"), "text").mapInArrow(run, "gram string, ids array<long>")


def grams_of(q: str) -> list[str]:
    """The grams of a search text."""
    folded = q.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return sorted({folded[i : i + 3] for i in range(len(folded) - 2)})


def lookup(index: DataFrame, captions: DataFrame, q: str) -> DataFrame:
    """Captions that contain q, by the grams of q and then by the text itself; none for fewer than three characters."""
    grams = grams_of(q)
    if not grams:
        return captions.limit(0)
    hits = index.where(F.col("gram").isin(grams)).groupBy("caption_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    return captions.join(hits.select("caption_id"), "caption_id", "left_semi").where(contains_folded(F.col("text"), q))


def maintain(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after captions came and went."""
    return index.join(removed.select("caption_id"), "caption_id", "left_anti").unionByName(build(added))


class Index:
    """A stored index of trigrams: folders of buckets by gram, with rows of captions that came and of captions that went.

    A row has a gram, some of the captions with it, and the step at which it was written.  A gram of a caption counts unless the caption went at a later step, so
    steps must grow; a step that is written again changes nothing.  A caption touches only the buckets of its grams, and a
    search reads only those of its own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, kind: str, step: int) -> None:
        rows = rows.withColumns({"step": F.lit(step).cast("long"), "bucket": self.bucket(F.col("gram"))})
        rows.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{kind}")

    def add(self, captions: DataFrame, step: int) -> None:
        """Captions (caption_id, text) that came."""
        self.write(postings(captions), "came", step)

    def remove(self, captions: DataFrame, step: int) -> None:
        """Captions (caption_id, text as it was) that went."""
        self.write(postings(captions), "went", step)

    def read(self, kind: str, grams: list[str]) -> DataFrame:
        """The rows of the buckets of some grams.  The condition on buckets is constant, so other folders are not opened."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], "gram string, caption_id long, step long, bucket int")
        rows = self.spark.read.schema(STORED).parquet(f"{self.path}/{kind}")
        return single(rows.where(F.col("bucket").isin([self.bucket(F.lit(g)) for g in grams]) & F.col("gram").isin(grams)))

    def candidates(self, q: str) -> DataFrame:
        """(caption_id) of captions that have all grams of q, which has one at least."""
        grams = grams_of(q)
        came = self.read("came", grams).groupBy("caption_id", "gram").agg(F.max("step").alias("step"))
        went = self.read("went", grams).groupBy("caption_id", "gram").agg(F.max("step").alias("_gone"))
        there = came.join(went, ["caption_id", "gram"], "left").where("_gone is null or step > _gone")
        return there.groupBy("caption_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("caption_id")

    def lookup(self, captions: DataFrame, q: str) -> DataFrame:
        """Captions that contain q; none for fewer than three characters."""
        if not grams_of(q):
            return captions.limit(0)
        return captions.join(self.candidates(q), "caption_id", "left_semi").where(contains_folded(F.col("text"), q))

    def compact(self, other: Index) -> None:
        """What counts, written to another index."""
        rows = self.spark.read.schema(STORED)
        came = single(rows.parquet(f"{self.path}/came")).groupBy("caption_id", "gram").agg(F.max("step").alias("step"))
        went = single(rows.parquet(f"{self.path}/went")).groupBy("caption_id", "gram").agg(F.max("step").alias("_gone"))
        there = came.join(went, ["caption_id", "gram"], "left").where("_gone is null or step > _gone")
        other.write(there.groupBy("gram", F.shiftright("caption_id", BLOCK)).agg(F.collect_list("caption_id").alias("ids")).select("gram", "ids"), "came", 0)


def single(rows: DataFrame) -> DataFrame:
    """Stored rows with one caption each."""
    return rows.select("gram", F.explode("ids").alias("caption_id"), "step", "bucket")
