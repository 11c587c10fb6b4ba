"""Whole recordings: from pending files to captions in the tables, and what a recording holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import fmt_ms_millis
from ..sources.scratch import cut, drop
from ..sources.tables import Conflict, Store, Tables
from ..sources.ts import packets_in, ranges
from . import captions, mutate, sections


def read_files(claimed: DataFrame, now: Column | None = None, language: int | str = 1) -> tuple[DataFrame, DataFrame]:
    """Outcome and captions of claimed (ts_file_id, path, length, modified): results for mutate.apply_results(), and
    (ts_file_id, pos, pts_start, pts_end, text).

    A file without length is not on disk and ends in an error; one without a caption stream is done, with no captions.
    Of each recording three parts are read: the window with the programme map, that with the event (a second one only
    where the first has none), and, of files with a caption stream, everything once for the packets of that stream.
    """
    there = claimed.where("length is not null").select("path", "length", "modified")
    info = cut(sections.file_info(there))
    epg = sections.extract_info(there, info.select("path", "services"))
    found = claimed.select("ts_file_id", "path", "length").join(epg.select("path", "title", "series_title", "episode_number", F.col("sub_title").alias("episode_title"), "air_date"), "path", "left")
    results = found.select("ts_file_id", F.when(F.col("length").isNull(), "file not found").alias("error"), "series_title", "title", "episode_number", "episode_title", "air_date", (F.current_timestamp() if now is None else now).cast("timestamp_ntz").alias("ingested_at"))
    pids = info.where("caption_pid is not null").select("path", F.col("caption_pid").alias("pid"))
    texts = captions.extract_files(there, pids, language).join(claimed.select("path", "ts_file_id"), "path").drop("path")
    return results, texts


def numbered(texts: DataFrame, old: DataFrame) -> DataFrame:
    return mutate.next_ids(texts.withColumn("_key", F.concat_ws("-", "ts_file_id", "pos")), old, "caption_id", "_key").drop("_key")


def claimed_files(files: DataFrame, on_disk: DataFrame, most: int | None) -> DataFrame:
    due = files.join(mutate.claim(files, most), "ts_file_id", "left_semi")
    return due.join(on_disk.select("path", "length", "modified"), "path", "left")


def ingest(t: Tables, on_disk: DataFrame, now: Column | None = None, most: int | None = None) -> Tables:
    """The tables after all pending files of on_disk (path, length, modified), or the first `most`, have been read."""
    claimed = cut(claimed_files(t.ts_files, on_disk, most))
    results, texts = (cut(x) for x in read_files(claimed, now))
    new = numbered(texts, t.captions)
    return mutate.apply_results(mutate.start(t, claimed.select("ts_file_id")), results, new.select(*t.captions.columns))


def ingest_next(store: Store, on_disk: DataFrame, most: int = 10_000, now: Column | None = None, language: int | str = 1, tries: int = 5) -> int:
    """Reads the next `most` pending files of a store and commits what came of them; returns how many there were.

    Two commits: the files are claimed, so that another runner takes others; then their captions, outcomes and new
    programmes appear together.  Only rows of these files are written.  Captions that a file had before are replaced.  If
    another writer commits meanwhile, ids are given again and the rest stays.
    """
    version = store.version()
    t = store.load(version)
    claimed = cut(claimed_files(t.ts_files, on_disk, most))
    n = claimed.count()
    if n:
        running = claimed.select(*t.ts_files.columns).withColumn("status", F.lit("ingesting"))
        store.commit({"ts_files": running}, {"ts_files": claimed}, version)
        results, texts = (cut(x) for x in read_files(claimed, now, language))
        for left in range(tries, 0, -1):
            version = store.version()
            programs = store.load(version).programs
            added = cut(mutate.added_programs(programs, results, store.top("programs")))
            done = mutate.with_outcome(running, programs.unionByName(added), results)
            put = {"captions": numbered(texts, store.top("captions")), "programs": added, "ts_files": done}
            try:
                store.commit(put, {"captions": claimed, "ts_files": claimed}, version)
                break
            except Conflict:
                if left == 1:
                    raise
            finally:
                drop(added)
        drop(results)
        drop(texts)
    drop(claimed)
    return n


def ingest_all(store: Store, on_disk: DataFrame, most: int = 10_000, now: Column | None = None) -> int:
    """ingest_next() until no file is pending; returns how many there were."""
    total = 0
    while n := ingest_next(store, on_disk, most, now):
        total += n
    return total


def regenerate_next(store: Store, on_disk: DataFrame, target: str) -> int:
    """Makes the caption streams that done files lack in target, the folder of captions.store_pes(), and returns how many
    files were due.  Marked first and unmarked afterwards, whatever came of it."""
    t = store.load()
    ids = t.ts_files.select("ts_file_id", "path")
    blobs = ids.join(captions.read_pes(store.spark, target).select("path"), "path", "left_semi").select("ts_file_id")
    due = cut(mutate.claim_regen(mutate.enqueue_missing_pes(t, blobs, on_disk).ts_files, None).join(ids, "ts_file_id").join(on_disk.select("path", "length"), "path"))
    n = due.count()
    if n:
        store.change(lambda t: mutate.start_regen(t, due.select("ts_file_id")))
        info = sections.file_info(due.select("path", "length"))
        pids = cut(info.where("caption_pid is not null").select("path", F.col("caption_pid").alias("pid")))
        captions.write_pes(captions.caption_units(due.select("path", "length"), pids), target)
        store.change(lambda t: mutate.finish_regen(t, due.select("ts_file_id")))
        drop(pids)
    drop(due)
    return n


def dump(epg: DataFrame, caption_rows: DataFrame) -> DataFrame:
    """(path, no, line): fields of the event of each recording, then the number of its captions and each of them.

    Both tables are used twice; they are written to the shared folder, so that the recordings are read for them once.
    """
    epg, caption_rows = cut(epg), cut(caption_rows)
    fields = ("title", "series_title", "episode_number", "sub_title", "event_start")
    head = epg.select("path", F.posexplode(F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("(none)"))) for c in fields])).alias("no", "line"))
    count = caption_rows.groupBy("path").agg(F.count("*").alias("n"))
    count = epg.select("path").join(count, "path", "left").select("path", F.lit(len(fields)).alias("no"), F.concat(F.lit("captions: "), F.coalesce("n", F.lit(0)).cast("string")).alias("line"))
    lines = caption_rows.select("path", (F.col("pos") + len(fields) + 1).alias("no"), F.concat(F.lit("["), fmt_ms_millis(F.col("pts_start")), F.lit(" - "), fmt_ms_millis(F.col("pts_end")), F.lit("] "), "text").alias("line"))
    return head.select("path", F.col("no").cast("long"), "line").unionByName(count.withColumn("no", F.col("no").cast("long"))).unionByName(lines)


def dump_files(files: DataFrame) -> DataFrame:
    """dump() of files (path, length, modified)."""
    info = cut(sections.file_info(files))
    epg = sections.extract_info(files, info.select("path", "services"))
    return dump(epg, captions.extract_files(files, info.where("caption_pid is not null").select("path", F.col("caption_pid").alias("pid"))))
