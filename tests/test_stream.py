"""Streams: growing recordings as packets, sections with state, and the three phases of ingest over failures."""

import pytest
from pyspark.sql import functions as F
from test_transport import CAPTION, event, packet, pes, recording, rows_of, sec, section, stream_parts, whole, write

from telesift.operators import captions, packets, sections
from telesift.sources import tables, ts
from telesift.streaming import ingest


def run(df, name, cp, sink="memory", **options):
    w = df.writeStream.outputMode("append").option("checkpointLocation", cp).trigger(availableNow=True)
    w = w.format("memory").queryName(name) if sink == "memory" else w.format("parquet").option("path", sink)
    w.start().awaitTermination()


def test_growing_recordings(spark, tmp_path):
    """Packets and PES of files that grow between runs, with a restart from the checkpoint each time."""
    mount = tmp_path / "rec"
    mount.mkdir()
    data = b"".join([*stream_parts()[:-2], *whole(CAPTION, pes(450000, b"last one"))])
    ends = [188 * 2 + 100, 188 * 3, 188 * 6 + 1, len(data)]
    out, pes_out = str(tmp_path / "out"), str(tmp_path / "pes")
    for i, end in enumerate(ends):
        for name in ("a.ts", "b.ts")[: i + 1]:
            with open(mount / name, "ab") as f:
                f.write(data[f.tell() : end])
        run(ingest.new_packets(spark, str(mount), packetsPerTask=2), "", str(tmp_path / "cp"), out)
        run(ingest.stream_pes(ingest.new_packets(spark, str(mount), pids=str(CAPTION))), "", str(tmp_path / "cp2"), pes_out)
    (mount / "ignored.txt").write_text("x")
    paths = [str(mount / n) for n in ("a.ts", "b.ts")]
    every = lambda df: sorted((r.path, r.pkt_no, r.pid, bytes(r.payload)) for r in df.collect())
    want = ts.scan(spark, paths)
    assert every(spark.read.parquet(out)) == every(want)
    pids = spark.createDataFrame([(p, CAPTION) for p in paths], "path string, pid int")
    got = spark.read.parquet(pes_out)
    for p in paths:
        assert rows_of(got.where(F.col("path") == p)) == rows_of(packets.demux_pes(want, pids).where(F.col("path") == p))


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset(name)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_section_stream(spark, tmp_path, rocks):
    """Sections over several packets, PIDs and recordings, one batch of few packets at a time: the rows of sections()."""
    long = section(0x4E, 1, event(b"\x1b\x28\x42long" + b"x" * 180))
    parts = [packet(0x12, b"\0" + long[:183], pusi=True), packet(0x12, bytes([len(long) - 183]) + long[183:] + section(0x50, 1, b""), pusi=True)]
    paths = [write(tmp_path, f"{n}.ts", [packet(0x12, b"orphan"), *parts, *sec(0x13, section(0x50, n, b"abc" * 100)), *sec(0x12, long)]) for n in (1, 2)]
    src = tmp_path / "in"
    rows = ts.scan(spark, paths).orderBy("pkt_no", "path").collect()
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], ts.SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(ts.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    run(ingest.stream_sections(stream), "sections", str(tmp_path / "cp"))
    every = lambda df: sorted((r.path, r.pid, r.pkt_no, bytes(r.section)) for r in df.collect())
    want = every(sections.sections(ts.scan(spark, paths)))
    assert every(spark.table("sections")) == want and len(want) == 8


def test_idle_section(spark, tmp_path, rocks):
    """A section that nothing more comes for is given up: its end, long after, makes no section."""
    long = section(0x4E, 1, b"x" * 300)
    first = [packet(0x12, b"\0" + long[:183], pusi=True)]
    rest = [packet(0x12, long[183:])]
    path = write(tmp_path, "i.ts", first + rest)
    rows = ts.scan(spark, [path]).orderBy("pkt_no").collect()
    src = tmp_path / "in"
    for i, part in enumerate((rows[:1], [rows[0].__class__(**{**rows[0].asDict(), "path": "other"})], rows[1:])):
        spark.createDataFrame(part, ts.SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(ts.SCHEMA).parquet(str(src))
        run(ingest.stream_sections(stream, idle_ms=1), f"idle{i}", str(tmp_path / "cp"), str(tmp_path / "out"))
    assert spark.read.schema(ingest.SECTION_ROWS).parquet(str(tmp_path / "out")).count() == 0


class Killed(Exception):
    pass


def test_three_phases(spark, tmp_path):
    """From a listing to captions, killed ahead of each phase and started again: each recording once, whole."""
    mount, where, cp, streams = tmp_path / "rec", str(tmp_path / "t"), str(tmp_path / "cp"), str(tmp_path / "streams")
    mount.mkdir()
    path = recording(mount, "a.ts")
    tables.store(tables.Tables(**{k: spark.createDataFrame([], v) for k, v in tables.SCHEMAS.items()}, raw={}), where)
    calls, kills = [], ["enqueue", "regenerate", "ingest"]

    def before(phase, batch_id):
        calls.append((phase, batch_id))
        if kills and kills[0] == phase:
            kills.pop(0)
            raise Killed

    def go():
        ingest.ingest_stream(spark, str(mount), where, cp, streams, before=before).awaitTermination()

    while kills:
        with pytest.raises(Exception, match="Killed"):
            go()
    go()
    second = recording(mount, "b.ts")
    kills.append("ingest")
    with pytest.raises(Exception, match="Killed"):
        go()
    go()
    assert [c for c in calls if c[0] == "enqueue"] == [("enqueue", 0)] * 4 + [("enqueue", 1)] * 2
    t = tables.load(spark, where)
    assert sorted((r.path, r.status) for r in t.ts_files.collect()) == [(path, "done"), (second, "done")]
    assert sorted((r.ts_file_id, r.text) for r in t.captions.collect()) == [(i, x) for i in (0, 1) for x in ("one", "two")]
    assert t.captions.select("caption_id").distinct().count() == 4 and t.programs.count() == 1
    # the second batch found the first recording without a stored stream and made it
    assert captions.decode_events(captions.managed(captions.read_pes(spark, streams))).count() == 2
