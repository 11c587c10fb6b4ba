"""What a user changes, one call each: the store is read for the rows concerned, and only these are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Conflict, Store, Tables
from . import mutate, recordings


def attempt(store: Store, change: Callable[[Tables], tuple[dict[str, DataFrame], dict[str, DataFrame]]], tries: int = 5) -> int:
    """Commits what change(tables) says is (put, gone), from the start again if another writer came first.

    Nothing is committed if it says nothing.
    """
    for left in range(tries, 0, -1):
        version = store.version()
        put, gone = change(store.load(version))
        try:
            return store.commit(put, gone, version) if put or gone else version
        except Conflict:
            if left == 1:
                raise
    return store.version()


def only(store: Store, key: str, value: int) -> DataFrame:
    return store.spark.range(1).select(F.lit(value).cast("long").alias(key))


def known(rows: DataFrame, key: str, value: int) -> DataFrame:
    """The rows of that key; an error if there is none."""
    own = rows.where(F.col(key) == value)
    if own.isEmpty():
        raise KeyError(f"no {key} {value}")
    return own


def add_tag(store: Store, caption_id: int, tag: str) -> list[str]:
    """Adds a trimmed tag to a caption, once; a blank one changes nothing.  Returns its tags, sorted."""

    def change(t: Tables):
        known(t.captions, "caption_id", caption_id)
        one = t.with_(tags=t.tags.where(F.col("caption_id") == caption_id))
        after = mutate.add_tag(one, caption_id, tag, store.spark)
        return ({}, {}) if after is one else ({"tags": after.tags}, {"tags": only(store, "caption_id", caption_id)})

    attempt(store, change)
    return tags(store, caption_id)


def delete_tag(store: Store, caption_id: int, tag: str) -> list[str]:
    """Removes a tag of a caption, if it has it.  Returns its tags, sorted."""

    def change(t: Tables):
        own = t.with_(tags=t.tags.where(F.col("caption_id") == caption_id))
        if own.tags.where(F.col("tag") == tag).isEmpty():
            return {}, {}
        return {"tags": mutate.delete_tag(own, caption_id, tag).tags}, {"tags": only(store, "caption_id", caption_id)}

    attempt(store, change)
    return tags(store, caption_id)


def tags(store: Store, caption_id: int) -> list[str]:
    return [r["tag"] for r in mutate.tags_of(store.load(), caption_id).collect()]


def select_frame(store: Store, caption_id: int, frame: int) -> int:
    """Chooses the frame of a caption, in place of an earlier choice."""

    def change(t: Tables):
        known(t.captions, "caption_id", caption_id)
        key = only(store, "caption_id", caption_id)
        return {"thumbnails": key.withColumn("selected_frame", F.lit(frame).cast("int"))}, {"thumbnails": key}

    return attempt(store, change)


def cascade(t: Tables, ids: DataFrame) -> dict[str, DataFrame]:
    """The keys that go with the captions of files."""
    captions = t.captions.join(ids, "ts_file_id", "left_semi").select("caption_id")
    return {"captions": ids, "tags": captions, "thumbnails": captions}


def clear(store: Store, file_id: int) -> int:
    """Removes the captions of a file with their tags and frames; the file stays as it is."""
    return attempt(store, lambda t: ({}, cascade(t, only(store, "ts_file_id", file_id))))


def reset(store: Store, where: Callable[[DataFrame], DataFrame]) -> int:
    """Puts the files that `where` picks back in the queue, without captions and metadata."""

    def change(t: Tables):
        files = where(t.ts_files)
        ids = files.select("ts_file_id")
        return {"ts_files": mutate.reset_files(t.with_(ts_files=files), ids, strict=False).ts_files}, {"ts_files": ids} | cascade(t, ids)

    return attempt(store, change)


def reingest(store: Store, file_id: int, on_disk: DataFrame) -> int:
    """Puts a file back in the queue and reads all that is pending; returns how many files that were."""
    known(store.load().ts_files, "ts_file_id", file_id)
    reset(store, lambda files: files.where(F.col("ts_file_id") == file_id))
    return recordings.ingest_all(store, on_disk)


def reingest_program(store: Store, program_id: int, on_disk: DataFrame) -> int:
    """The same for all files of a programme, which may have none."""
    reset(store, lambda files: files.where(F.col("program_id") == program_id))
    return recordings.ingest_all(store, on_disk)
