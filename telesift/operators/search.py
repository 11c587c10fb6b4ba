"""Caption search: conditions, counting, ordering, paging, and the rows of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import contains_folded, display_title, time_range
from ..functions.params import Page, SearchParams, checked_date
from ..sources.tables import Tables
from .paging import SHALLOW, page_of

THUMB_COUNT = 6
PAGE_SIZE = 50


def text_contains(df: DataFrame, q: str) -> DataFrame:
    return df.where(contains_folded(F.col("text"), q))


def subtitle_contains(df: DataFrame, q: str) -> DataFrame:
    return df.where(contains_folded(F.col("episode_title"), q))


def tags_all(df: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Captions that have every wanted tag: one grouping and one semi join, however many tags."""
    wanted = sorted(set(wanted))
    if not wanted:
        return df
    full = tags.where(F.col("tag").isin(wanted)).groupBy("caption_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(wanted))
    return df.join(full.select("caption_id"), "caption_id", "left_semi")


def by_thumb(df: DataFrame, thumbnails: DataFrame, state: str) -> DataFrame:
    """Captions with a chosen frame, or without one; any other state filters nothing."""
    how = {"generated": "left_semi", "pending": "left_anti"}.get(state)
    return df.join(thumbnails.select("caption_id"), "caption_id", how) if how else df


def matches(t: Tables, p: SearchParams) -> DataFrame:
    """Captions with their file's columns that meet all conditions; none if there is no condition."""
    files = t.ts_files
    if p.program_id is not None:
        files = files.where(F.col("program_id") == p.program_id)
    if p.episode is not None:
        files = files.where(F.col("episode_number") == p.episode)
    if p.subtitle.strip():
        files = subtitle_contains(files, p.subtitle.strip())
    for bound, op in ((p.date_from, ">="), (p.date_to, "<=")):
        day = checked_date(bound)
        if day:
            files = files.where(F.col("air_date") >= F.lit(day) if op == ">=" else F.col("air_date") <= F.lit(day))
    captions = t.captions
    if not p.anything():
        captions = captions.limit(0)
    if p.active_q:
        captions = text_contains(captions, p.active_q)
    captions = by_thumb(tags_all(captions, t.tags, p.tags), t.thumbnails, p.filter)
    return captions.join(files.select("ts_file_id", "filename", "program_id", "episode_number", "episode_title", "air_date", "path"), "ts_file_id")


def search_total(t: Tables, p: SearchParams) -> DataFrame:
    """The number of matches; programmes and frames are not joined, since they add or drop no row."""
    return matches(t, p).agg(F.count("*").alias("total"))


def titled(df: DataFrame, programs: DataFrame) -> DataFrame:
    """With the programme's title, or the file name where there is none."""
    p = programs.select(F.col("program_id").alias("_p"), F.col("title").alias("_title"))
    return df.join(p, F.col("program_id") == F.col("_p"), "left").withColumn("title", F.coalesce("_title", "filename")).drop("_p", "_title")


def framed(df: DataFrame, thumbnails: DataFrame, thumb_count: int = THUMB_COUNT) -> DataFrame:
    """With has_thumb and the frame to show: the chosen one, else the middle one."""
    th = thumbnails.select(F.col("caption_id").alias("_c"), "selected_frame")
    df = df.join(th, F.col("caption_id") == F.col("_c"), "left")
    return df.withColumns({"has_thumb": F.when(F.col("_c").isNotNull(), 1).otherwise(0), "preview_frame": F.coalesce("selected_frame", F.lit(thumb_count // 2))}).drop("_c", "selected_frame")


def search_order() -> list[Column]:
    return [F.col("air_date").desc_nulls_last(), F.col("episode_number").asc_nulls_first(), F.col("pts_start").asc(), F.col("caption_id").asc()]


def with_tags(df: DataFrame, tags: DataFrame) -> DataFrame:
    """With the sorted list of tags of each caption, empty without any; only tags of these captions are grouped."""
    own = tags.join(df.select("caption_id"), "caption_id", "left_semi").groupBy("caption_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    return df.join(own, "caption_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def search(t: Tables, p: SearchParams, size: int = PAGE_SIZE) -> DataFrame:
    """One page: its rows are picked first (see page_of()), and only they meet programmes, frames and tags."""
    window, rows = Page(p.page, 0, size), matches(t, p)
    if window.offset + size <= SHALLOW:
        page = page_of(rows, search_order(), window.offset, size)
    else:
        keys = rows.select("air_date", "episode_number", "pts_start", "caption_id")
        page = rows.join(F.broadcast(page_of(keys, search_order(), window.offset, size).select("caption_id")), "caption_id", "left_semi")
    page = framed(titled(page, t.programs), t.thumbnails)
    page = with_tags(page, t.tags)
    return page.select("caption_id", "ts_file_id", "text", "air_date", "episode_number", "pts_start", display_title(F.col("title"), F.col("episode_number"), F.col("episode_title")).alias("display_title"), time_range(F.col("pts_start"), F.col("pts_end")).alias("time_range"), "has_thumb", "preview_frame", F.array_join("tags", "\n").alias("tags")).orderBy(*search_order())


def contact(t: Tables, caption_id: int, thumb_count: int = THUMB_COUNT) -> DataFrame:
    """All about one caption: title, times, frames to choose from, tags."""
    one = t.captions.where(F.col("caption_id") == caption_id).join(t.ts_files.select("ts_file_id", "filename", "program_id", "episode_number", "episode_title"), "ts_file_id")
    one = with_tags(framed(titled(one, t.programs), t.thumbnails, thumb_count), t.tags)
    frames = F.array_join(F.sequence(F.lit(0), F.lit(thumb_count - 1)), ",")
    return one.select("caption_id", display_title(F.col("title"), F.col("episode_number"), F.col("episode_title")).alias("display_title"), "text", time_range(F.col("pts_start"), F.col("pts_end")).alias("time_range"), "preview_frame", frames.alias("frames"), F.array_join("tags", "\n").alias("tags"))


def locate(t: Tables, caption_id: int) -> DataFrame:
    """Path and times of one caption; no row if there is none."""
    return t.captions.where(F.col("caption_id") == caption_id).join(t.ts_files.select("ts_file_id", "path"), "ts_file_id").select("path", "pts_start", "pts_end")
