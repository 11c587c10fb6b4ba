"""Ordered computations: caption ends, presentation times, frames of a caption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALLBACK_MS = 5000
PTS_RANGE = 1 << 33
FPS = 30000 / 1001


def caption_end(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows (pts_start, duration) with pts_end: start + duration, else the next start, else 5 s more."""
    following = F.lead("pts_start").over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("pts_end", F.coalesce(F.col("pts_start") + F.col("duration"), following, F.col("pts_start") + FALLBACK_MS))


def drop_empty_interval(rows: DataFrame) -> DataFrame:
    """After the ends are known, since the next start is that of any row."""
    return rows.where("pts_end > pts_start")


def pts_to_ms(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows (pts) with ms since the first known pts of the key, which wraps at 33 bits."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    gone = F.pmod(F.col("pts") - F.first("pts", ignorenulls=True).over(w), F.lit(PTS_RANGE))
    return rows.withColumn("ms", F.floor(gone / 90))


def window_of(start_ms: Column, end_ms: Column) -> tuple[Column, Column, Column]:
    """Seek position, first and last second shown of a caption."""
    start, end = start_ms / 1000.0, end_ms / 1000.0
    ws = start + 1.5
    return F.greatest(start - 6.0, F.lit(0.0)), ws, F.when(end > ws, end).otherwise(ws + 0.5)


def frame_index(start_ms: Column, end_ms: Column, k: Column, n: int) -> Column:
    """The k-th of n frames spread over the caption, counted from the seek position."""
    pre, ws, we = window_of(start_ms, end_ms)
    t = ws if n <= 1 else ws + k * (we - ws) / float(n - 1)
    return F.round(F.greatest(t - pre, F.lit(0.0)) * FPS).cast("long")


def frame_indices(start_ms: Column, end_ms: Column, n: int) -> Column:
    if n == 0:
        return F.array().cast("array<bigint>")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: frame_index(start_ms, end_ms, k, n))


def capture_seconds(start_ms: Column, end_ms: Column) -> Column:
    """How long the extraction runs from the seek position."""
    pre, _, we = window_of(start_ms, end_ms)
    return (we - pre) + 0.5


def select_expr(frames: Column) -> Column:
    r"""eq(n\,i) for each frame, joined by plus signs."""
    return F.array_join(F.transform(frames, lambda i: F.concat(F.lit("eq(n\\,"), i.cast("string"), F.lit(")"))), "+")


def middle_frame(frames: Column) -> Column:
    """The frame in the middle, 0 if there is none."""
    return F.coalesce(F.get(frames, F.floor(F.size(frames) / 2).cast("int")), F.lit(0))


def numbered(files: Column) -> Column:
    """(n, file): output files in order, counted from 0."""
    return F.transform(files, lambda f, i: F.struct(i.alias("n"), f.alias("file")))
