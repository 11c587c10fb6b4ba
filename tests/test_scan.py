"""What is read of a recording: ranges by table, by option and by condition, and the second scan only where it is needed."""

import builtins
import re
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from test_transport import CAPTION, NAMED, PMT, VIDEO, event, packet, pat, pes, pmt, sec, section, statement, stream_parts, whole, write

from telesift.operators import packets, recordings, sections
from telesift.plans import catalog, streams
from telesift.sources import ts


def rows(df):
    return sorted((r.path, r.pkt_no, r.pid, r.pusi, r.afc, bytes(r.payload)) for r in df.collect())


def test_ranges(spark, tmp_path):
    path = write(tmp_path, "a.ts", stream_parts() * 7 + [b"cut off"])
    files = ts.listing(spark, str(tmp_path))
    want = rows(ts.scan(spark, [path]))
    for per in (1, 5, 1000):
        assert rows(ts.packets_in(ts.ranges(files, per_range=per))) == want
    own = files.withColumn("pids", F.array(F.lit(VIDEO)))
    assert rows(ts.packets_in(ts.ranges(own))) == [r for r in want if r[2] == VIDEO]
    assert rows(ts.packets_in(ts.ranges(files.withColumn("pids", F.lit(None).cast("array<int>")), most=9))) == [r for r in want if r[1] < 9]
    assert ts.packets_in(ts.ranges(files.limit(0))).isEmpty()
    write(tmp_path, "empty.ts", [b""])
    assert ts.ranges(ts.listing(spark, str(tmp_path)).where("length = 0")).isEmpty()


@pytest.mark.parametrize("size", [0, 187, 188, 500_000, 500_001, 1_000_000, 123_456_789_012_345])
def test_late_start(spark, size):
    got = ts.ranges(spark.createDataFrame([("p", size)], "path string, length long"), 20, 600_000, 10**12).collect()
    first, last = ts.start_packet(size, 20), size // ts.PACKET
    assert [(r.first, r["count"]) for r in got] == ([(first, min(last - first, 600_000))] if last > first else [])


def test_conditions(spark, tmp_path):
    path, other = (write(tmp_path, n, stream_parts() * 3) for n in ("a.ts", "b.ts"))
    every = ts.scan(spark, [path, other])
    for where in ("pkt_no < 7", "pkt_no >= 3 and pkt_no <= 9 and pid = 304", "pkt_no > 4", "pkt_no = 5", f"pid in (1, {VIDEO})", f"path = '{path}' and pid = {CAPTION} and pid = 5", f"path like '%b.ts' and pkt_no < 4", "pkt_no < 9 and pkt_no < 4", "pid > 300"):
        assert rows(ts.scan(spark, [path, other], once=True).where(where)) == rows(every.where(where)), where
    assert rows(ts.scan(spark, [path, other], firstPacket=3, endPacket=6, pids=str(CAPTION))) == rows(every.where(f"pkt_no between 3 and 5 and pid = {CAPTION}"))


def test_condition_to_bytes(tmp_path, monkeypatch):
    """Bytes that are read under conditions, counted."""
    path = write(tmp_path, "a.ts", [packet(VIDEO, b"v")] * 60_000)
    done = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            done.append(n)
            return self.f.read(n)

    plain = builtins.open
    monkeypatch.setattr(builtins, "open", lambda p, *a, **k: Counted(plain(p, *a, **k)) if p == path else plain(p, *a, **k))

    def bytes_read(*filters):
        done.clear()
        reader = ts.FilteringReader({"paths": path})
        left = list(reader.pushFilters(list(filters)))
        n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        return sum(done) // ts.PACKET, n, left

    no, pid = ("pkt_no",), ("pid",)
    assert bytes_read() == (60_000, 60_000, [])
    assert bytes_read(LessThan(no, 50_000), IsNotNull(no)) == (50_000, 50_000, [])
    assert bytes_read(GreaterThan(no, 9), LessThanOrEqual(no, 20)) == (11, 11, [])
    assert bytes_read(GreaterThanOrEqual(no, 59_999)) == (1, 1, [])
    assert bytes_read(EqualTo(no, 7), In(pid, (VIDEO, 2))) == (1, 1, [])
    assert bytes_read(EqualTo(pid, 2)) == (60_000, 0, [])
    assert bytes_read(EqualTo(("path",), "elsewhere")) == (0, 0, [])
    odd = StringStartsWith(("path",), "x")
    assert bytes_read(odd)[2] == [odd]


def planned(df):
    return {r.path: r.n for r in df.groupBy("path").agg(F.sum("count").alias("n")).collect()}


def test_second_scan(spark, tmp_path):
    """Only files in which the late scan finds no titled event are read again."""
    filler = [packet(0x1F0, b"x" * 150)] * 3000
    early, late = (section(0x4E, 1, event(b"\x1b\x28\x42" + t)) for t in (b"early", b"late"))
    both = write(tmp_path, "both.ts", [*sec(0x12, early), *filler, *sec(0x12, late)])
    one = write(tmp_path, "one.ts", [*sec(0x12, early), *filler])
    none = write(tmp_path, "none.ts", filler)
    files = ts.listing(spark, str(tmp_path))
    services = spark.createDataFrame([(p, []) for p in (both, one, none)], "path string, services array<int>")
    first = planned(sections.late_ranges(files))
    assert all(2300 < n < 2500 for n in first.values()) and len(first) == 3
    found = sections.event_info(ts.packets_in(sections.late_ranges(files)), services)
    assert planned(sections.early_ranges(files, found)) == {one: 3001, none: 3000}


def test_file_info(spark, tmp_path):
    """The programme map from tables of ranges is that of whole packets, and its window ends the scan."""
    head = sec(0, pat((0, 0x10), (1024, PMT), (1025, PMT + 1)))
    maps = sec(PMT, pmt(1024, (0x1B, VIDEO, b""))) + sec(PMT + 1, pmt(1025, (0x06, CAPTION, NAMED)))
    write(tmp_path, "a.ts", head + maps)
    write(tmp_path, "late.ts", [packet(VIDEO, b"v")] * 30 + head + maps)
    write(tmp_path, "none.ts", [b"x" * 400])
    files = ts.listing(spark, str(tmp_path))
    by_path = lambda df: {r.path.rsplit("/")[-1]: (r.services, r.caption_pid) for r in df.collect()}
    assert by_path(sections.file_info(files)) == {"a.ts": ([1025], CAPTION), "late.ts": ([1025], CAPTION), "none.ts": ([], None)}
    assert by_path(sections.file_info(files, most=20))["late.ts"] == ([], None)
    whole_scan = sections.programme_info(ts.scan(spark, [r.path for r in files.collect()]))
    assert by_path(whole_scan) == {k: v for k, v in by_path(sections.file_info(files)).items() if k != "none.ts"}


def test_read_files(spark, tmp_path):
    """Outcome of a file with captions, one without a stream, and one that is gone."""
    parts = sec(0, pat((1, PMT))) + sec(PMT, pmt(1, (0x06, CAPTION, NAMED))) + sec(0x12, section(0x4E, 1, event(b"\x1b\x28\x42AB #7 part")))
    good = write(tmp_path, "good.ts", parts + whole(CAPTION, pes(90000, statement(b"\x1b\x28\x42\x0fone"))))
    silent = write(tmp_path, "silent.ts", sec(0, pat((1, PMT))))
    disk = ts.listing(spark, str(tmp_path))
    claimed = spark.createDataFrame([(1, good), (2, silent), (3, "/gone.ts")], "ts_file_id long, path string").join(disk, "path", "left")
    results, texts = recordings.read_files(claimed, F.lit("2024-01-01 00:00:00"))
    got = {r.ts_file_id: (r.error, r.title, r.episode_number) for r in results.collect()}
    assert got == {1: (None, "AB #7 part", 7), 2: (None, "(unknown)", None), 3: ("file not found", None, None)}
    assert [(r.ts_file_id, r.text) for r in texts.collect()] == [(1, "one")]


def test_sections_over_batches(spark, tmp_path):
    """Many sections of two PIDs, over several Arrow batches: each PID has its own assembler."""
    body = [section(0x4E, i, struct.pack(">I", i) * 60) for i in range(300)]
    parts = [p for i, x in enumerate(body) for p in sec(0x12 if i % 2 else 0x13, x)]
    path = write(tmp_path, "s.ts", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sections.sections(ts.scan(spark, [path])).orderBy("pkt_no").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [bytes(r.section) for r in got] == body and [r.pid for r in got[:2]] == [0x13, 0x12]


def test_short_recordings_together():
    """Many short recordings share a batch, and none is made before it is wanted: before, each made a batch of its own."""
    raw = [stream_parts() * (1 + i % 3) for i in range(2000)]
    files = [(str(i), b"".join(x) + b"cut off"[: i % 7]) for i, x in enumerate(raw)]
    taken = []

    def one_by_one():
        for f in files:
            taken.append(f[0])
            yield f

    got = ts.parse_files(one_by_one())
    first = next(got)
    most = ts.CHUNK + max(len(c) for _, c in files) // ts.PACKET
    assert 1000 < first.num_rows <= most and len(taken) * min(len(c) for _, c in files) // ts.PACKET <= most
    batches = [first, *got]
    assert len(batches) < 20
    one = [r for path, content in files for r in ts.parse(path, 0, content).to_pylist()]
    assert [r for b in batches for r in b.to_pylist()] == one


def test_long_recording_in_parts(monkeypatch):
    """A recording longer than a batch, with others around it."""
    monkeypatch.setattr(ts, "CHUNK", 7)
    files = [("a", b"".join(stream_parts())), ("b", b"".join(stream_parts() * 5)), ("c", b""), ("d", b"".join(stream_parts()))]
    batches = list(ts.parse_files(files))
    assert max(b.num_rows for b in batches) <= 7
    assert [r for b in batches for r in b.to_pylist()] == [r for path, content in files for r in ts.parse(path, 0, content).to_pylist()]


def test_only_wanted_pids_move(spark, tmp_path):
    """Of all packets only those of a PID that some recording has as its caption stream are shuffled to the join."""
    path = write(tmp_path, "a.ts", stream_parts())
    scan = ts.scan(spark, [path])
    plan = packets.demux_pes(scan, sections.caption_pids(scan))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "broadcast" in plan
    wanted = spark.createDataFrame([("other", CAPTION), ("more", CAPTION)], "path string, pid int")
    assert rows(packets.of_pids(scan, wanted)) == rows(scan.where(F.col("pid") == CAPTION)) != []


def test_dump_reads_once(spark, tmp_path):
    """A dump uses events and captions twice; neither is made again from packets."""
    write(tmp_path, "a.ts", stream_parts())
    lines = recordings.dump_files(ts.listing(spark, str(tmp_path)))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan and lines.count() > 5


@pytest.mark.parametrize("name", ["b3_scan_psi", "b5_demux_caption_pes", "b6_scan_eit", "b8_extract_epg", "b11_second_language", "b12_extract_captions", "f14_require_captions", "w4_row_order_stable"])
def test_recordings_made_once(spark, sf, name, monkeypatch):
    """A query that reads packets more than once does not make the recordings again for each time."""
    made = []
    monkeypatch.setattr(streams, "packets_of", lambda t, plain=streams.packets_of: made.append(1) or plain(t))
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert made == [1] and not re.search(r"MapInArrow run\(doc_id", plan)


def test_packets_lie_by_path_once(spark, tmp_path):
    """Where the list of caption streams is too large to broadcast, packets are shuffled once: before, by path and PID for the join
    and by path again for the units."""
    path = write(tmp_path, "a.ts", stream_parts())
    scan = ts.scan(spark, [path])
    pids = spark.createDataFrame([(path, CAPTION), (path, None), ("other", CAPTION)], "path string, pid int")
    want = packets.demux_pes(scan, pids).orderBy("pkt_no").collect()
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pes = packets.demux_pes(scan, pids)
        plan = pes._jdf.queryExecution().executedPlan().toString()
        got = pes.orderBy("pkt_no").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    moved = [re.sub(r"#\d+", "", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", plan)]
    assert sorted(moved) == ["path", "path", "pid"]  # packets, streams, and the list of PIDs
    assert got == want != []


def test_scattered_packets_grow_in_number(spark, sf):
    """Packets in any order lie in as many partitions as Spark shuffles to: before, in seven, which grew with the input."""
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = catalog.QUERIES["w4_row_order_stable"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert set(re.findall(r"Exchange hashpartitioning\(xxhash64\(pkt_no#\d+L, path#\d+, 42\), (\d+)\), REPARTITION", plan)) == {"13"}


def lines_of(docs, rows):
    """Arrow batches of so many lines of documents (doc_id, source, lang, lines)."""
    flat = [{"doc_id": i, "source": source, "lang": lang, "k": k, "line": line} for i, source, lang, lines in docs for k, line in enumerate(lines)]
    return [pa.RecordBatch.from_pylist(flat[a : a + rows]) for a in range(0, len(flat), rows)]


def test_recording_tables_shared():
    """The tables that recordings share are made once, and differ with the service and the caption stream."""
    streams.tables_of.cache_clear()
    raw = list(streams.parts_of(lines_of([(i, "web", "en", ["a line"]) for i in range(240)], 1000)))
    assert streams.tables_of.cache_info().misses <= 8 * 4 and len(raw) == 240
    for i, (path, first, content) in enumerate(raw):
        got = ts.parse(path, first, content).to_pylist()
        assert path == str(i) and [p["pid"] for p in got[:6]] == [0, PMT, 0x12, 0x12, 0x12, VIDEO]
        assert int.from_bytes(got[0]["payload"][13:15]) == 1024 + i % 8
        named = [pid for pid, yes in sections.map_streams(got[1]["payload"][1:]) if yes]
        assert named == ([] if i % 10 == 9 else [304 + i % 3])


def test_recordings_from_lines(monkeypatch):
    """A recording comes from lines, over several input batches: before, all of its document and others came in one."""
    docs = [(7, "web", "en", ["line %d" % k for k in range(500)]), (9, "web", "en", ["", "b"]), (12, "books", "de", [""]), (12, "books", "de", ["", "\u00e9", ""])]
    whole_batch = [r for b in ts.parse_parts(streams.parts_of(lines_of(docs, 10_000))) for r in b.to_pylist()]
    numbers = [[r["pkt_no"] for r in whole_batch if r["path"] == p] for p in ("7", "9")]
    assert all(n == list(range(len(n))) and n for n in numbers)
    assert [r["pkt_no"] for r in whole_batch if r["path"] == "12"].count(0) == 2
    monkeypatch.setattr(ts, "CHUNK", 20)
    monkeypatch.setattr(streams, "PART", 10 * ts.PACKET)
    taken = []
    got = ts.parse_parts(streams.parts_of(taken.append(1) or b for b in lines_of(docs, 10)))
    first = next(got)
    assert len(taken) <= 3 and first.num_rows <= 20
    assert first.to_pylist() + [r for b in got for r in b.to_pylist()] == whole_batch
