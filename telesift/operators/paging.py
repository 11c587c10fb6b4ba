"""Pages of an ordered table, however deep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Up to so many rows a page is a top-k, which each task does for its own rows.
SHALLOW = 10_000


def page_of(rows: DataFrame, order: list[Column], offset: int, size: int, shallow: int = SHALLOW) -> DataFrame:
    """Rows offset to offset + size of rows in a total order.

    A deep page takes rank selection: the rows are dealt into ranges of the order and written, a count for each range says
    which of them hold the page, and only these are ranked, each in its own task.  Nothing passes through one task but
    the ranges of the page.  Pass narrow rows (the order and an id) and join the rest afterwards.
    """
    if offset + size <= shallow:
        return rows.orderBy(*order).offset(offset).limit(size)
    ranges = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    first, starts = 0, {}
    for r in ranges.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():  # a row a range
        if first < offset + size and first + r["n"] > offset:
            starts[r["_range"]] = first
        first += r["n"]
    if not starts:
        return rows.limit(0)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    start = F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)])
    ranked = ranges.where(F.col("_range").isin(list(starts))).withColumn("_rank", rank + start[F.col("_range")])
    return ranked.where((F.col("_rank") >= offset) & (F.col("_rank") < offset + size)).drop("_range", "_rank")
