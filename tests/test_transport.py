"""Recordings built in the test: packets, programme map, caption PES, event information, and the stream form."""

import struct

import pytest
from pyspark.sql import functions as F

from telesift.operators import captions, packets, sections
from telesift.sources import ts
from telesift.streaming import ingest

CAPTION, VIDEO, PMT = 0x130, 0x111, 0x1F0


def packet(pid, payload, pusi=False, afc=1, sync=0x47):
    body = bytes(payload)
    if afc == 1 and len(body) < 184:
        afc = 3
    if afc == 3:
        pad = 184 - len(body) - 1
        body = bytes([pad]) + (b"\0" + b"\xff" * (pad - 1) if pad else b"") + body
    assert len(body) <= 184
    return bytes([sync, (0x40 if pusi else 0) | pid >> 8, pid & 255, afc << 4]) + body.ljust(184, b"\xff")


def section(table, ext, body, number=0):
    n = len(body) + 9
    return bytes([table, 0xB0 | n >> 8, n & 255]) + struct.pack(">H", ext) + bytes([0xC1, number, 0]) + body + b"\0\0\0\0"


def pat(*programs):
    return section(0, 1, b"".join(struct.pack(">HH", s, 0xE000 | p) for s, p in programs))


def pmt(service, *streams):
    es = b"".join(bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0, len(d)]) + d for kind, pid, d in streams)
    return section(2, service, b"\xe1\x00\xf0\x00" + es)


NAMED = bytes([0xFD, 3, 0x00, 0x08, 0x3D])


def pes(pts, payload, declared=True):
    head = b"\x00\x00\x01\xbd"
    t = bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1]) if pts is not None else b""
    rest = bytes([0x80, 0x80 if pts is not None else 0, len(t)]) + t + payload
    return head + struct.pack(">H", len(rest) if declared else 0) + rest


def whole(pid, data):
    return [packet(pid, data[i : i + 184], pusi=i == 0) for i in range(0, len(data), 184)]


def sec(pid, data):
    return whole(pid, b"\0" + data)


def write(tmp_path, name, parts):
    path = tmp_path / name
    path.write_bytes(b"".join(parts))
    return str(path)


def info(spark, tmp_path, parts):
    p = write(tmp_path, "a.ts", parts)
    rows = sections.programme_info(ts.scan(spark, [p])).collect()
    return (rows[0]["services"], rows[0]["caption_pid"]) if rows else ([], None)


def test_programme_map(spark, tmp_path):
    head = sec(0, pat((0, 0x10), (1024, PMT)))
    assert info(spark, tmp_path, head + sec(PMT, pmt(1024, (0x1B, VIDEO, b""), (0x06, CAPTION, NAMED)))) == ([1024], CAPTION)
    assert info(spark, tmp_path, head + sec(PMT, pmt(1024, (0x06, CAPTION, b"")))) == ([1024], CAPTION)
    assert info(spark, tmp_path, head + sec(PMT, pmt(1024, (0x06, 0x140, b""), (0x06, CAPTION, NAMED)))) == ([1024], CAPTION)
    assert info(spark, tmp_path, head + sec(PMT, pmt(1024, (0x1B, VIDEO, b"")))) == ([], None)
    assert info(spark, tmp_path, [b""]) == ([], None)
    assert info(spark, tmp_path, [b"garbage" * 100]) == ([], None)


def test_long_section(spark, tmp_path):
    streams = [(0x1B, 0x200 + i, b"\x52\x01\x00" * 4) for i in range(20)]
    parts = sec(0, pat((7, PMT))) + sec(PMT, pmt(7, *streams, (0x06, CAPTION, NAMED)))
    assert len(parts) > 2
    assert info(spark, tmp_path, parts) == ([7], CAPTION)


def stream_parts():
    return [
        packet(CAPTION, b"orphan"),
        *whole(CAPTION, pes(180000, b"x" * 300)),
        packet(VIDEO, b"v", pusi=True),
        packet(CAPTION, b"", afc=2),
        *whole(CAPTION, pes(None, b"no time")),
        *whole(CAPTION, pes(270000, b"second")),
        packet(CAPTION, b"lost sync", pusi=True, sync=0x48),
        *whole(CAPTION, pes(450000, b"y" * 200, declared=False)),
    ]


def rows_of(df):
    return [(r.pts_ms, bytes(r.payload)) for r in df.orderBy("pkt_no").collect()]


def demuxed(spark, path, **options):
    pids = spark.createDataFrame([(path, CAPTION)], "path string, pid int")
    return rows_of(packets.demux_pes(ts.scan(spark, [path], **options), pids))


def test_pes(spark, tmp_path):
    path = write(tmp_path, "b.ts", stream_parts())
    got = demuxed(spark, path)
    assert [g[0] for g in got] == [0, 1000, 3000]
    assert got[0][1] == b"x" * 300 and got[1][1] == b"second" and got[2][1].startswith(b"y" * 200)
    # units that lie across partitions
    assert demuxed(spark, path, packetsPerTask=1) == got
    other = spark.createDataFrame([(path, 0x1FF)], "path string, pid int")
    assert packets.demux_pes(ts.scan(spark, [path]), other).isEmpty()


def test_wrapped_time(spark, tmp_path):
    path = write(tmp_path, "w.ts", [*whole(CAPTION, pes(2**33 - 90, b"a")), *whole(CAPTION, pes(90, b"b"))])
    assert [g[0] for g in demuxed(spark, path)] == [0, 2]


def test_binary_file_rows(spark, tmp_path):
    path = write(tmp_path, "c.ts", stream_parts())
    files = spark.read.format("binaryFile").load(path).withColumn("path", F.lit(path))
    a, b = ts.packets_of(files).orderBy("pkt_no").collect(), ts.scan(spark, [path]).orderBy("pkt_no").collect()
    assert a == b
    assert [r.path for r in ts.listing(spark, str(tmp_path)).collect()] == [path]


def test_start_packet():
    assert ts.start_packet(500_000, 20) == 0
    assert ts.start_packet(1_000_000, 20) == 200_000 // 188


def test_stream_equals_batch(spark, tmp_path):
    path = write(tmp_path, "d.ts", [*stream_parts()[:-2], *whole(CAPTION, pes(450000, b"last one"))])
    want = demuxed(spark, path)
    src = tmp_path / "in"
    rows = ts.scan(spark, [path]).where(F.col("pid") == CAPTION).orderBy("pkt_no").collect()
    for i in range(0, len(rows), 2):
        spark.createDataFrame(rows[i : i + 2], ts.SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(ts.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = ingest.stream_pes(stream).writeStream.format("memory").queryName("pes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows_of(spark.table("pes")) == want


def test_poll(spark, tmp_path):
    mount, cp = tmp_path / "rec", str(tmp_path / "cp")
    mount.mkdir()
    seen, order = [], []

    def run():
        stream = ingest.new_files(spark, str(mount))
        phase = lambda name: lambda df, i: order.append(name)
        ingest.run_phases(stream, cp, lambda df, i: seen.append(sorted(r.path for r in df.collect())), phase("regenerate"), phase("ingest")).awaitTermination()

    write(mount, "one.ts", [b"1"])
    run()
    write(mount, "two.ts", [b"2"])
    run()
    assert seen == [[str(mount / "one.ts")], [str(mount / "two.ts")]]
    assert order == ["regenerate", "ingest"] * 2


def event(title, extra=b""):
    short = bytes([0x4D, len(title) + 5]) + b"jpn" + bytes([len(title)]) + title + b"\0"
    loop = short + extra
    return b"\0\0\0\0\0\x4e" + b"\0\x01" + struct.pack(">H", 51544) + b"\x12\x00\x00" + b"\x00\x30\x00" + struct.pack(">H", len(loop)) + loop


def test_event(spark, tmp_path):
    ascii_title = b"\x1b\x28\x42AB #7 part\x5b1\x5d"
    series = bytes([0xD5, 9, 0, 1, 0, 0, 0, 0x00, 0x50, 0x0C, 0])
    data = section(0x4E, 1024, event(ascii_title, series))
    other, following = section(0x4E, 99, event(b"\x1b\x28\x42other")), section(0x4E, 1024, event(b"\x1b\x28\x42next"), number=1)
    parts = sec(0x12, other) + sec(0x12, following) + sec(0x12, data)
    path = write(tmp_path, "e.ts", parts)
    p = ts.scan(spark, [path])
    known = spark.createDataFrame([(path, [1024])], "path string, services array<int>")
    r = sections.with_series(sections.event_info(p, known)).first()
    assert (r.title, r.episode_number, r.last_episode, str(r.event_start)) == ("AB #7 part[1]", 5, 12, "2000-01-01 12:00:00")
    assert (r.series_title, r.sub_title) == ("AB", "part")
    anything = spark.createDataFrame([(path, [])], "path string, services array<int>")
    assert sections.event_info(p, anything).first().title == "other"
    files = ts.listing(spark, str(tmp_path))
    none = sections.event_info(p.limit(0), known)
    assert sections.recording_info(files, none, sections.event_info(p, known)).first().title == "AB #7 part[1]"
    assert sections.recording_info(files, none, none).first().title == "(unknown)"


def test_tail_of_section(spark, tmp_path):
    data = section(0x4E, 1, event(b"\x1b\x28\x42long" + b"x" * 180))
    first, tail = data[:183], data[183:]
    parts = [packet(0x12, b"\0" + first, pusi=True), packet(0x12, bytes([len(tail)]) + tail + section(0x50, 1, b""), pusi=True)]
    path = write(tmp_path, "f.ts", parts)
    s = sections.sections(ts.scan(spark, [path]), [0x12]).orderBy("pkt_no").collect()
    assert bytes(s[0].section) == data


def statement(text):
    unit = b"\x1f\x20" + len(text).to_bytes(3, "big") + text
    body = b"\x3f" + len(unit).to_bytes(3, "big") + unit
    return b"\x80\xff\xf0" + b"\x04\0\0" + struct.pack(">H", len(body)) + body


def test_captions(spark, tmp_path):
    parts = sec(0, pat((1, PMT))) + sec(PMT, pmt(1, (0x06, CAPTION, NAMED)))
    for pts, text in ((90000, b"\x1b\x28\x42\x0fone"), (270000, b"\x9b\x37\x20\x53\x1b\x28\x42\x0ftwo"), (450000, b"\x0c")):
        parts += whole(CAPTION, pes(pts, statement(text)))
    path = write(tmp_path, "g.ts", parts)
    got = captions.extract(ts.scan(spark, [path])).orderBy("pts_start").collect()
    assert [(r.pts_start, r.pts_end, r.text) for r in got] == [(0, 2000, "one"), (2000, 7000, "two")]
    stored = captions.store_pes(ts.scan(spark, [path]), str(tmp_path / "pes"))
    assert stored.count() == 3


def recording(tmp_path, name):
    data = section(0x4E, 1, event(b"\x1b\x28\x42AB #7 part"))
    parts = sec(0, pat((1, PMT))) + sec(PMT, pmt(1, (0x06, CAPTION, NAMED))) + sec(0x12, data)
    for pts, text in ((90000, b"\x1b\x28\x42\x0fone"), (270000, b"\x1b\x28\x42\x0ftwo")):
        parts += whole(CAPTION, pes(pts, statement(text)))
    return write(tmp_path, name, parts)


def test_regenerate(spark, tmp_path):
    """Streams are stored anew without repeats; a recording without one says so and changes nothing."""
    good = recording(tmp_path, "h.ts")
    none = write(tmp_path, "i.ts", sec(0, pat((1, PMT))))
    target = str(tmp_path / "blobs")
    for _ in range(2):
        got = captions.regenerate(ts.scan(spark, [good, none]), target)
        assert {r.path: r.made for r in got.collect()} == {good: True, none: False}
        assert captions.read_pes(spark, target).count() == 2
    assert captions.store_pes(ts.scan(spark, [none]), target).count() == 2


def test_extract_info(spark, tmp_path):
    """The event after the late start wins; where there is none, one from the start; else the file's time."""
    filler = [packet(0x1F0, b"x" * 150)] * 3000
    early, late = (section(0x4E, 1, event(b"\x1b\x28\x42" + t)) for t in (b"early", b"late #2"))
    both = write(tmp_path, "both.ts", [*sec(0x12, early), *filler, *sec(0x12, late)])
    one = write(tmp_path, "one.ts", [*sec(0x12, early), *filler])
    unknown = write(tmp_path, "none.ts", filler)
    services = spark.createDataFrame([(p, []) for p in (both, one, unknown)], "path string, services array<int>")
    got = {r.path: r for r in sections.extract_info(ts.listing(spark, str(tmp_path)), services).collect()}
    assert {p: got[p].title for p in got} == {both: "late #2", one: "early", unknown: "(unknown)"}
    assert got[both].episode_number == 2 and got[unknown].air_date is not None


def test_batch_and_stream_at_the_edge(spark, tmp_path):
    """Units whose first packet ends before the time, without a start code, or without payload: batch and stream agree."""
    short = pes(90000, b"late time")
    parts = [packet(CAPTION, short[:11], pusi=True), packet(CAPTION, short[11:])]
    odd = bytes([9, 9, 9]) + pes(180000, b"no start code")[3:]
    parts += [*whole(CAPTION, odd), *whole(CAPTION, pes(270000, b"")), *whole(CAPTION, pes(360000, b"good"))]
    path = write(tmp_path, "j.ts", parts)
    want = demuxed(spark, path)
    assert [g[0] for g in want] == [0, 2000]
    src = tmp_path / "in"
    spark.createDataFrame(ts.scan(spark, [path]).where(F.col("pid") == CAPTION).collect(), ts.SCHEMA).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(ts.SCHEMA).parquet(str(src))
    q = ingest.stream_pes(stream).writeStream.format("memory").queryName("edge").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows_of(spark.table("edge")) == want


def empty_tables(spark):
    from telesift.sources import tables

    return tables.Tables(**{k: spark.createDataFrame([], v) for k, v in tables.SCHEMAS.items()}, raw={})


def test_command_line(spark, tmp_path, capsys):
    """A folder into tables, in several batches, a file queued again, and a dump."""
    from telesift.__main__ import main
    from telesift.sources import tables

    mount = tmp_path / "rec"
    mount.mkdir()
    path = recording(mount, "k.ts")
    more = [recording(mount, f"k{i}.ts") for i in range(2)]
    where, streams = str(tmp_path / "tables"), str(tmp_path / "streams")
    tables.store(empty_tables(spark), where)
    main(["ingest", str(mount), where, "--batch", "2", "--streams", streams])
    t = tables.load(spark, where)
    files = {r.path: r for r in t.ts_files.collect()}
    f = files[path]
    assert set(files) == {path, *more} and {r.status for r in files.values()} == {"done"}
    assert (f.episode_number, f.episode_title) == (7, "part") and [r.title for r in t.programs.collect()] == ["AB"]
    captions_of = lambda t: sorted((r.ts_file_id, r.pts_start, r.text) for r in t.captions.collect())
    want = sorted((r.ts_file_id, at, text) for r in files.values() for at, text in ((0, "one"), (2000, "two")))
    assert captions_of(t) == want and t.captions.select("caption_id").distinct().count() == 6
    main(["ingest", str(mount), where, "--streams", streams])
    assert captions.read_pes(spark, streams).count() == 6 and captions_of(tables.load(spark, where)) == want
    main(["reingest", path, where])
    again = tables.load(spark, where)
    assert again.ts_files.where("status = 'pending'").first().path == path and again.captions.count() == 4
    main(["ingest", str(mount), where])
    assert captions_of(tables.load(spark, where)) == want
    with pytest.raises(KeyError):
        main(["reingest", "/nowhere.ts", where])
    capsys.readouterr()
    main(["dump", str(mount)])
    out = capsys.readouterr().out
    assert "title: AB #7 part" in out and "captions: 2" in out and "[00:00:02.000 - 00:00:07.000] two" in out


def test_composite():
    import numpy as np

    tile = np.full((2, 2, 4), 100, dtype=np.uint8)
    tile[..., 3] = [[255, 0], [128, 255]]
    out = captions.composite([(1, 1, tile)], 2, 3)
    assert out[1, 1].tolist() == [100, 100, 100, 255] and out[2, 1].tolist() == [50, 50, 50, 128]
    assert not out[0].any()


def test_header(spark):
    df = spark.createDataFrame([(0x41, 0x30, 0x30, 10), (0x1F, 0xFF, 0x20, 0), (0, 0, 0x30, 183)], "a int, b int, c int, d int")
    got = [tuple(r["h"]) for r in df.select(packets.header(*map(F.col, "abcd")).alias("h")).collect()]
    assert got == [(0x130, True, 3, 15), (0x1FFF, False, 2, None), (0, False, 3, None)]


@pytest.mark.parametrize("n, want", [(0, b"rest"), (5, b"rest")])
def test_payload(spark, n, want):
    raw = bytes(8) + bytes([n]) + bytes(n) + b"rest"
    df = spark.createDataFrame([(bytearray(raw), bytearray(raw[: 9 + n])), (bytearray(b"abc"), bytearray(b""))], "a binary, b binary")
    r = df.select(packets.pes_payload(F.col("a")).alias("a"), packets.pes_payload(F.col("b")).alias("b")).collect()
    assert bytes(r[0]["a"]) == want and bytes(r[0]["b"]) == b"" and not bytes(r[1]["a"])
