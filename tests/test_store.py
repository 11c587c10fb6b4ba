"""The store of versions: what readers see, what is written, and what a writer that dies leaves."""

import pytest
from pyspark.sql import functions as F

from telesift.operators import mutate
from telesift.sources import tables

FILE = {"path": "/a", "filename": "a", "status": "done", "error_msg": None, "ingested_at": None, "program_id": None, "episode_number": None, "episode_title": None, "air_date": None, "pes_regen": 0}


def rows(spark, table, *values):
    return spark.createDataFrame(list(values), tables.SCHEMAS[table])


def captions(spark, file, *texts, first=0):
    return rows(spark, "captions", *[(first + i, file, i, i * 1000, i * 1000 + 500, x) for i, x in enumerate(texts)])


def some(spark):
    files = rows(spark, "ts_files", *[tuple({"ts_file_id": i, **FILE, "path": f"/{i}"}.values()) for i in (1, 2)])
    return tables.Tables(rows(spark, "programs", (0, "P", "p")), files, captions(spark, 1, "a", "b"), rows(spark, "tags", (0, "x"), (1, "y")), rows(spark, "thumbnails", (1, 3)), raw={})


def texts(t):
    return sorted((r.ts_file_id, r.text) for r in t.captions.collect())


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.store(some(spark), path)
    return tables.Store(spark, path)


def test_append_keeps_what_is_there(spark, store):
    """Captions of one more file: the others stay readable, and only the new rows are written."""
    assert store.commit({"captions": captions(spark, 2, "c", first=2)}) == 2
    assert texts(store.load()) == [(1, "a"), (1, "b"), (2, "c")]
    assert texts(store.load(1)) == [(1, "a"), (1, "b")]
    parts = store.manifest()["parts"]
    assert [len(parts[t]) for t in ("captions", "tags", "ts_files")] == [2, 1, 1]
    last = parts["captions"][-1]
    assert spark.read.parquet(f"{store.path}/captions/put/_v=2/_u={last['name']}").count() == 1
    assert store.manifest()["top"] == {"programs": 0, "ts_files": 2, "captions": 2}
    with pytest.raises(FileExistsError):
        tables.store(some(spark), store.path)


def test_replace(spark, store):
    """Captions of a file that is read again replace those before, in one version."""
    new = captions(spark, 1, "n", first=9)
    for _ in range(2):
        store.commit({"captions": new}, {"captions": new})
    assert texts(store.load()) == [(1, "n")]
    store.compact(most_parts=1)
    assert texts(store.load()) == [(1, "n")] and len(store.manifest()["parts"]["captions"]) == 1
    assert store.load().tags.count() == 2 and store.top("captions").first()[0] == 9


def test_killed_writer(spark, store):
    """A commit that dies halfway leaves the last version, and the next commit works."""
    broken = captions(spark, 2, "c").withColumn("text", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        store.commit({"tags": rows(spark, "tags", (7, "z")), "captions": broken})
    assert store.version() == 1 and store.load().tags.count() == 2
    store.commit({"tags": rows(spark, "tags", (8, "w"))})
    assert sorted(r.tag for r in store.load().tags.collect()) == ["w", "x", "y"]


def test_conflict(spark, store):
    """Of two writers that start from one version the second is told, and change() starts again."""
    store.commit({"tags": rows(spark, "tags", (8, "w"))}, based_on=1)
    with pytest.raises(tables.Conflict):
        store.commit({"tags": rows(spark, "tags", (9, "v"))}, based_on=1)
    assert store.version() == 2 and store.load().tags.count() == 3
    raced = []

    def add(t):
        if not raced:
            raced.append(store.commit({"tags": rows(spark, "tags", (5, "first"))}))
        return mutate.add_tag(t, 5, "second", spark)

    store.change(add)
    assert sorted(r.tag for r in store.load().tags.where("caption_id = 5").collect()) == ["first", "second"]


def test_marks(spark, store):
    """A step of a writer that was committed is not committed again."""
    for step in (0, 0, 1, 0, 1):
        store.commit({"tags": rows(spark, "tags", (100 + step, "m"))}, mark=("w", step))
    assert store.version() == 3 and store.load().tags.where("tag = 'm'").count() == 2


def test_changes(spark, store):
    """The mutations as differences: cascades, and tables that do not change are not written."""
    ids = spark.createDataFrame([(1,)], "ts_file_id long")
    store.change(lambda t: mutate.clear_subtitles(t, ids))
    t = store.load()
    assert (t.captions.count(), t.tags.count(), t.thumbnails.count(), t.ts_files.count()) == (0, 0, 0, 2)
    assert len(store.manifest()["parts"]["ts_files"]) == 1
    assert texts(store.load(1)) == [(1, "a"), (1, "b")]
    store.change(lambda t: mutate.delete_files(t, ids))
    assert [r.ts_file_id for r in store.load().ts_files.collect()] == [2]
    version = store.version()
    assert store.change(mutate.crash_recovery) == version
    store.change(lambda t: mutate.select_frame(t, spark.createDataFrame([(4, 2, 0), (4, 5, 1)], "caption_id long, selected_frame int, seq int")))
    assert [tuple(r) for r in store.load().thumbnails.collect()] == [(4, 5)]


def test_vacuum(spark, store):
    """Old versions and what failed commits left go, the last versions stay readable."""
    broken = captions(spark, 2, "c").withColumn("text", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        store.commit({"tags": rows(spark, "tags", (7, "z")), "captions": broken})
    for i in range(3):
        store.commit({"tags": rows(spark, "tags", (10 + i, "t"))})
    store.compact(most_parts=1)
    assert store.version() == 5 and store.load().tags.count() == 5
    assert store.vacuum(keep=2) >= 1 and store.vacuum(keep=2) == 0
    assert store.load().tags.count() == 5 and store.load(4).tags.count() == 5 and texts(store.load()) == [(1, "a"), (1, "b")]
    assert store.vacuum(keep=1) == 4 and store.load().tags.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|exist"):
        store.load(1)


def test_compact_too_late(spark, store, monkeypatch):
    """A compaction that another writer overtakes is left out."""
    store.commit({"tags": rows(spark, "tags", (8, "w"))})
    publish = store.publish

    def late(m, number):
        monkeypatch.setattr(store, "publish", publish)
        store.commit({"tags": rows(spark, "tags", (9, "v"))})
        return publish(m, number)

    monkeypatch.setattr(store, "publish", late)
    assert store.compact(most_parts=1) == 3 and store.load().tags.count() == 4


def test_empty_store(spark, tmp_path):
    s = tables.Store(spark, str(tmp_path / "none"))
    assert s.version() == 0 and s.load().captions.count() == 0
    s.commit({"programs": rows(spark, "programs")})
    assert s.load().programs.count() == 0 and s.top("programs").first()[0] == -1
