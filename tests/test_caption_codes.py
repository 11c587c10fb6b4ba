"""The caption interpreter on golden bytes: screens, waits, repeats, sizes, drawn signs, and languages."""

import random
import struct

import pytest
from test_transport import CAPTION, NAMED, PMT, pat, pes, pmt, rows_of, sec, whole, write

from telesift.functions.b24 import Decoder, decode, extra_table
from telesift.operators import captions, packets
from telesift.sources import ts
from telesift.streaming import ingest

LATIN = b"\x1b\x28\x42\x0f"


def shown(body):
    return captions.screens(LATIN + body, extra_table())


@pytest.mark.parametrize(
    "body, want",
    [
        (b"one", [(0, None, "one")]),
        (b"one\x9d\x20\x54", [(0, 2000, "one")]),
        (b"\x9d\x20\x45one", [(0, 500, "one")]),
        (b"one\x9d\x20\x54\x0ctwo", [(0, 2000, "one"), (2000, None, "two")]),
        (b"one\x9d\x20\x54\x9d\x20\x4a\x0ctwo\x9d\x20\x41", [(0, 3000, "one"), (3000, 100, "two")]),
        (b"\x0cone\x0c\x0ctwo\x0c", [(0, None, "one"), (0, None, "two")]),
        (b"\x0c", []),
        (b"one\x9d\x28\x40two", [(0, None, "onetwo")]),
        (b"a\x98\x43bc", [(0, None, "abbbc")]),
        (b"\x98\x40bc", [(0, None, "bc")]),
        (b"a\x88ruby\x8ab", [(0, None, "ab")]),
        (b"a\x88ruby\x0cb", [(0, None, "a"), (0, None, "b")]),
        (b"a\x90\x20\x44b\x90\x51c", [(0, None, "abc")]),
        (b"\x9b7 Sa\x9b170;30 _b", [(0, None, "ab")]),
        (b"a\x1c\x41\x42b\x16\x43c\x8b\x60d", [(0, None, "abcd")]),
        (b"a\x95\x40\x60ignored\x95\x4fb", [(0, None, "ab")]),
        (b"a\x0db", [(0, None, "a\nb")]),
        (b"a\x19\x22b", [(0, None, "a\u3042b")]),
        (b"a\x1d\x22b", [(0, None, "a\u30a2b")]),
        (b"\x1b\x28\x20\x41\x21\x1b\x28\x42x", [(0, None, "\u3013x")]),
        (b"\x1b\x24\x28\x20\x40\x21\x22\x1b\x28\x42x", [(0, None, "\u3013x")]),
        (b"\x1b\x24\x42\x23\x41\x89\x23\x41\x8a\x23\x41", [(0, None, "\uff21A\uff21")]),
        (b"\x9d", []),
        (b"a\x98", [(0, None, "a")]),
        (b"a\x9b", [(0, None, "a")]),
    ],
)
def test_screens(body, want):
    if want is not None:
        assert shown(body) == want


def group(number, body):
    return b"\x80\xff\xf0" + bytes([number << 2, 0, 0]) + struct.pack(">H", len(body)) + body


def said(text, number=1, timed=False):
    unit = b"\x1f\x20" + len(LATIN + text).to_bytes(3, "big") + LATIN + text
    return group(number, (b"\x7f" + bytes(5) if timed else b"\x3f") + len(unit).to_bytes(3, "big") + unit)


def management(*codes, number=0, offset=False, condition=False):
    out = b"\xbf" + bytes(5) if offset else b"\x3f"
    out += bytes([len(codes)])
    for i, code in enumerate(codes):
        out += bytes([i << 5 | (0x0C if condition else 0x0A)]) + (b"\x00" if condition else b"") + code.encode() + b"\x80"
    return group(number, out + b"\0\0\0")


def test_management():
    for more in ({}, {"offset": True}, {"condition": True}, {"number": 0x20}):
        assert captions.announced(management("jpn", "eng", **more)) == [(1, "jpn", 0), (2, "eng", 0)]
    assert captions.announced(said(b"x")) is None and captions.announced(b"") is None
    assert captions.announced(management()) is None
    for cut_off in range(len(management("jpn", "eng"))):
        captions.announced(management("jpn", "eng")[:cut_off])


def units(*parts):
    return [p for i, x in enumerate(parts) for p in whole(CAPTION, pes(90000 * (i + 1), x))]


def bilingual(tmp_path, name="bi.ts"):
    """Two languages; the second management group, of group B, exchanges them."""
    parts = units(management("jpn", "eng"), said(b"ichi"), said(b"one", 2), said(b"ni", 0x21), said(b"three", 3), management("eng", "jpn", number=0x20), said(b"two", 0x21, timed=True), said(b"san", 0x22))
    return write(tmp_path, name, sec(0, pat((1, PMT))) + sec(PMT, pmt(1, (0x06, CAPTION, NAMED))) + parts)


WANT = {1: [(1000, "ichi"), (3000, "ni"), (6000, "two")], 2: [(2000, "one"), (7000, "san")], "jpn": [(1000, "ichi"), (3000, "ni"), (7000, "san")], "eng": [(2000, "one"), (6000, "two")], "por": []}


@pytest.mark.parametrize("language", WANT)
def test_language(spark, tmp_path, language):
    got = captions.extract(ts.scan(spark, [bilingual(tmp_path)]), language)
    assert [(r.pts_start, r.text) for r in got.orderBy("pos").collect()] == WANT[language]


def test_ends(spark, tmp_path):
    """An end is start plus wait where there is one, else the next start, else five seconds."""
    parts = units(management("jpn"), said(b"a\x9d\x20\x45"), said(b"b\x9d\x20\x45\x0cc"), said(b"d"))
    path = write(tmp_path, "ends.ts", sec(0, pat((1, PMT))) + sec(PMT, pmt(1, (0x06, CAPTION, NAMED))) + parts)
    got = captions.extract(ts.scan(spark, [path])).orderBy("pos").collect()
    assert [(r.pts_start, r.pts_end, r.text) for r in got] == [(1000, 1500, "a"), (2000, 2500, "b"), (2500, 3000, "c"), (3000, 8000, "d")]


def test_utf8(spark):
    """Languages announced with the other coding are UTF-8 text."""
    body = management("por")
    body = body[:-4] + bytes([0x84]) + body[-3:]
    assert captions.announced(body) == [(1, "por", 1)]
    unit = b"\x1f\x20" + len("n\u00e3o".encode()).to_bytes(3, "big") + "n\u00e3o".encode()
    assert captions.statement(b"\x3f" + len(unit).to_bytes(3, "big") + unit, {}, 1) == [(0, None, "n\u00e3o")]


def test_language_in_stream(spark, tmp_path):
    """One row of packets a batch: languages are carried in the state, and the events are those of the batch."""
    path = bilingual(tmp_path, "stream.ts")
    own = ts.scan(spark, [path], pids=str(CAPTION))
    pids = spark.createDataFrame([(path, CAPTION)], "path string, pid int")
    want = captions.managed(packets.demux_pes(own, pids))
    src = tmp_path / "in"
    rows = own.orderBy("pkt_no").collect()
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], ts.SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(ts.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = ingest.stream_pes(stream).writeStream.format("memory").queryName("languages").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("languages")
    assert rows_of(got) == rows_of(want)
    for language in ("jpn", "eng", 1):
        events = [sorted((r.pts_start, r.text) for r in captions.decode_events(x, language).collect()) for x in (got, want)]
        assert events[0] == events[1] == WANT[language]


def test_plain_runs(monkeypatch):
    """Signs that stand for themselves are taken in runs, not one by one; the same text as by single signs."""
    rng = random.Random(5)
    some = [b"\x1b\x28\x42\x0f", b"\x0e", b"\x0f", b"\x1b\x28\x30", b"\x1b\x28\x20\x42", b"\x19", b"\x1d", b"\x98\x45", b"\x88", b"\x89", b"\x8a", b"\x0c", b"\x9d\x20\x45", b"\x0d", b"\x1b\x7c", b"\xb4\xc1", b"A few words", b" ", b"~!", b"\x30\x21"]
    bodies = [b"".join(rng.choices(some, k=25)) for _ in range(3000)]
    got = [(captions.screens(b, extra_table()), decode(b)) for b in bodies]
    monkeypatch.setattr(captions.CaptionCodes, "plain", lambda *_: "")
    monkeypatch.setattr(Decoder, "plain", lambda *_: "")
    assert got == [(captions.screens(b, extra_table()), decode(b)) for b in bodies]


def test_plain_runs_are_not_signs(monkeypatch):
    monkeypatch.setattr(Decoder, "sign", lambda *_: 1 / 0)
    assert captions.screens(b"\x1b\x28\x42\x0fmany plain signs", extra_table()) == [(0, None, "many plain signs")]
