"""Programmes, episodes and tags to choose from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables


def with_captions(files: DataFrame, captions: DataFrame) -> DataFrame:
    return files.join(captions.select("ts_file_id"), "ts_file_id", "left_semi")


def index_programs(t: Tables) -> DataFrame:
    """Programmes with a caption at least, by title."""
    used = with_captions(t.ts_files, t.captions).select("program_id")
    return t.programs.join(used, "program_id", "left_semi").select("program_id", "title").orderBy("title", "program_id")


def program_files(t: Tables, program_id: int) -> DataFrame:
    return with_captions(t.ts_files.where((F.col("program_id") == program_id) & (F.col("status") == "done")), t.captions)


def all_null(files: DataFrame) -> DataFrame:
    """One row: whether no file has an episode number; true without files."""
    return files.agg(F.coalesce(F.bool_and(F.col("episode_number").isNull()), F.lit(True)).alias("all_null"))


def subtitle_first_air(files: DataFrame) -> DataFrame:
    return files.where(F.col("episode_title").isNotNull()).groupBy("episode_title").agg(F.min("air_date").alias("air_date"))


def episodes(t: Tables, program_id: int | None) -> DataFrame:
    """(kind, episode_number, episode_title, air_date): files by episode, or subtitles if no file has a number.

    Both shapes are in one plan and the switch is a scalar, so nothing is decided on the driver.
    """
    if not program_id or program_id <= 0:
        program_id = 0
    files = program_files(t, program_id)
    switch = all_null(files)
    listed = files.select(F.lit("episode").alias("kind"), "episode_number", "episode_title", "air_date")
    subtitles = subtitle_first_air(files).select(F.lit("subtitle").alias("kind"), F.lit(None).cast("int").alias("episode_number"), "episode_title", "air_date")
    both = listed.crossJoin(F.broadcast(switch)).where("not all_null").unionByName(subtitles.crossJoin(F.broadcast(switch)).where("all_null"))
    return both.drop("all_null").orderBy(F.col("episode_number").asc_nulls_first(), F.col("air_date").asc_nulls_first(), "episode_title")


def tag_options(t: Tables) -> DataFrame:
    return t.tags.select("tag").distinct().orderBy("tag")
