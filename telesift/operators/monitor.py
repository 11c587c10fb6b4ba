"""State of the ingest: counts, queues, file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import contains_folded, display_title
from ..sources.tables import STATUSES, Tables
from .search import PAGE_SIZE, titled


def status_counts(files: DataFrame) -> DataFrame:
    """One row with a counter for each status, and total."""
    counts = files.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES])
    return counts.withColumn("total", sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0])))


def summary_counts(t: Tables) -> DataFrame:
    files = t.ts_files.agg(F.count("*").alias("files"), F.count(F.when(F.col("status") == "done", 1)).alias("done"), F.count(F.when(F.col("status") == "error", 1)).alias("error"))
    return files.crossJoin(F.broadcast(t.captions.agg(F.count("*").alias("captions"))))


def recent_errors(files: DataFrame, most: int = 5) -> DataFrame:
    return files.where("status = 'error'").orderBy(F.col("ingested_at").desc_nulls_last(), F.desc("ts_file_id")).limit(most).select("ts_file_id", "filename", F.coalesce("error_msg", F.lit("(unknown)")).alias("error_msg"))


def regen_queue(files: DataFrame) -> DataFrame:
    """Files whose caption stream is made again, active ones first."""
    return files.where("pes_regen <> 0").orderBy(F.desc("pes_regen"), "filename").select("filename", "pes_regen")


def ingest_status(files: DataFrame) -> DataFrame:
    """Counts, percentage done, label, and the three lists joined by line feeds, in one row."""
    regen = regen_queue(files).agg(F.count("*").alias("regenerating"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("pes_regen")).alias("o"), "filename"))), lambda x: x["filename"]), "\n").alias("regenerating_files"))
    errors = recent_errors(files).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("ts_file_id")).alias("o"), F.concat_ws(": ", "filename", "error_msg").alias("m")))), lambda x: x["m"]), "\n").alias("recent_errors"))
    active = files.where("status = 'ingesting'").agg(F.array_join(F.sort_array(F.collect_list("filename")), "\n").alias("ingesting_files"))
    row = status_counts(files)
    for other in (regen, errors, active):
        row = row.crossJoin(F.broadcast(other))
    return row.withColumns({"pct": done_percent(), "label": status_label()})


def done_percent():
    return F.when(F.col("total") > 0, F.floor(F.col("done") * 100 / F.col("total"))).otherwise(0).cast("long")


def status_label():
    return F.when(F.col("ingesting") > 0, "ingesting").when(F.col("regenerating") > 0, "regenerating").when(F.col("pending") > 0, "pending").when(F.col("total") == 0, "empty").otherwise("done")


def with_caption_count(files: DataFrame, captions: DataFrame) -> DataFrame:
    """Counts are grouped before the join; files without captions get 0."""
    n = captions.groupBy("ts_file_id").agg(F.count("*").alias("caption_count"))
    return files.join(n, "ts_file_id", "left").withColumn("caption_count", F.coalesce("caption_count", F.lit(0)))


def filtered_files(files: DataFrame, name: str = "", status: str = "all") -> DataFrame:
    """By part of the file name and by status; "all" is any, an unknown status is none."""
    if name.strip():
        files = files.where(contains_folded(F.col("filename"), name.strip()))
    return files if status == "all" else files.where(F.col("status") == status)


def files_order():
    return [F.col("ingested_at").desc_nulls_last(), F.col("ts_file_id").desc()]


def ingest_files(t: Tables, name: str = "", status: str = "all", page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One page of files; captions are counted for the page only."""
    rows = filtered_files(t.ts_files, name, status).orderBy(*files_order()).offset(max(page, 0) * size).limit(size)
    mine = t.captions.join(F.broadcast(rows.select("ts_file_id")), "ts_file_id", "left_semi")
    out = with_caption_count(titled(rows, t.programs), mine)
    return out.select("ts_file_id", "filename", "status", "ingested_at", display_title(F.col("title"), F.col("episode_number"), F.col("episode_title")).alias("display_title"), "caption_count").orderBy(*files_order())


def ingest_file(t: Tables, ts_file_id: int) -> DataFrame:
    one = t.ts_files.where(F.col("ts_file_id") == ts_file_id)
    out = with_caption_count(titled(one, t.programs), t.captions.where(F.col("ts_file_id") == ts_file_id))
    return out.select("ts_file_id", "filename", "path", "status", "title", F.coalesce("error_msg", F.lit("(unknown)")).alias("error_msg"), "caption_count")
