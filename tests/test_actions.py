"""Actions on a store: the state they lead to is that of the transforms, and only the rows concerned are written."""

import pytest
from pyspark.sql import functions as F
from test_store import captions, rows, some, store, texts  # noqa: F401
from test_transport import recording

from telesift.operators import actions, mutate
from telesift.sources import tables, ts


def state(t):
    return {k: sorted(tuple(map(str, r)) for r in getattr(t, k).collect()) for k in tables.SCHEMAS}


def written(spark, s, table, kind="put"):
    """Rows of the last folder of a table."""
    last = [p for p in s.manifest()["parts"][table] if p["kind"] == kind][-1]
    return spark.read.parquet(f"{s.path}/{table}/{kind}/_v={last['version']}/_u={last['name']}").count()


def test_tags(spark, store):  # noqa: F811
    before = store.load()
    assert actions.add_tag(store, 0, "  new ") == ["new", "x"]
    assert state(store.load()) == state(mutate.add_tag(before, 0, "new", spark)) and written(spark, store, "tags") == 2
    version = store.version()
    assert actions.add_tag(store, 0, " \t") == ["new", "x"] and store.version() == version
    assert actions.add_tag(store, 0, "new") == ["new", "x"]
    assert actions.delete_tag(store, 0, "x") == ["new"]
    version = store.version()
    assert actions.delete_tag(store, 0, "never") == ["new"] and store.version() == version
    assert actions.tags(store, 1) == ["y"] and len(store.manifest()["parts"]["captions"]) == 1
    with pytest.raises(KeyError):
        actions.add_tag(store, 77, "x")
    assert actions.delete_tag(store, 77, "x") == []


def test_frames(spark, store):  # noqa: F811
    actions.select_frame(store, 0, 4)
    actions.select_frame(store, 0, 5)
    actions.select_frame(store, 1, 2)
    assert sorted(tuple(r) for r in store.load().thumbnails.collect()) == [(0, 5), (1, 2)] and written(spark, store, "thumbnails") == 1
    with pytest.raises(KeyError):
        actions.select_frame(store, 77, 1)


def test_clear(spark, store):  # noqa: F811
    store.commit({"captions": captions(spark, 2, "c", first=2), "tags": rows(spark, "tags", (2, "z"))})
    before = store.load()
    actions.clear(store, 1)
    assert state(store.load()) == state(mutate.clear_subtitles(before, spark.createDataFrame([(1,)], "ts_file_id long")))
    assert texts(store.load()) == [(2, "c")]
    actions.clear(store, 77)
    assert texts(store.load()) == [(2, "c")]


def test_reset(spark, store):  # noqa: F811
    before = store.load()
    actions.reset(store, lambda files: files.where("ts_file_id = 1"))
    assert state(store.load()) == state(mutate.reset_files(before, spark.createDataFrame([(1,)], "ts_file_id long"))) and written(spark, store, "ts_files") == 1
    actions.reset(store, lambda files: files.where("program_id = 99"))
    assert store.load().ts_files.where("status = 'pending'").count() == 1


def test_race(spark, store):  # noqa: F811
    """Another writer between the reading and the commit: both changes stay."""
    raced = []

    def change(t):
        if not raced:
            raced.append(actions.select_frame(store, 0, 1))
        key = actions.only(store, "caption_id", 1)
        return {"tags": key.withColumn("tag", F.lit("after"))}, {"tags": key}

    actions.attempt(store, change)
    assert actions.tags(store, 1) == ["after"] and store.load().thumbnails.count() == 2


def test_reingest(spark, tmp_path):
    """A file is read again and its captions replaced; tags of the old ones go with them."""
    mount = tmp_path / "rec"
    mount.mkdir()
    path = recording(mount, "a.ts")
    where = str(tmp_path / "t")
    tables.store(tables.Tables(**{k: spark.createDataFrame([], v) for k, v in tables.SCHEMAS.items()}, raw={}), where)
    s, disk = tables.Store(spark, where), ts.listing(spark, str(mount))
    s.change(lambda t: mutate.enqueue(t, disk))
    assert actions.reingest(s, 0, disk) == 1
    first = s.load().captions.orderBy("pts_start").collect()
    assert [r.text for r in first] == ["one", "two"]
    actions.add_tag(s, first[0].caption_id, "mine")
    assert actions.reingest(s, 0, disk) == 1
    again = s.load()
    assert [r.text for r in again.captions.orderBy("pts_start").collect()] == ["one", "two"] and again.tags.count() == 0
    assert min(r.caption_id for r in again.captions.collect()) > max(r.caption_id for r in first)
    assert again.ts_files.first().path == path and again.programs.count() == 1
    assert actions.reingest_program(s, again.programs.first().program_id, disk) == 1 and s.load().captions.count() == 2
    with pytest.raises(KeyError):
        actions.reingest(s, 5, disk)
