"""From caption PES to caption rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.b24 import Decoder, extra_table
from ..sources.scratch import cut, drop
from ..sources.tables import Store
from ..sources.ts import packets_in, ranges
from .packets import byte, demux_pes
from .sections import caption_pids
from .timeline import caption_end, drop_empty_interval

#: Control codes of caption text, and how many parameter bytes follow those that have some.
CLEAR, SHIFT_2, SHIFT_3, ESCAPE = 0x0C, 0x19, 0x1D, 0x1B
SMALL, MEDIUM, NORMAL, SIZE, COLOUR, MACRO, REPEAT, CONTROL, TIME = 0x88, 0x89, 0x8A, 0x8B, 0x90, 0x95, 0x98, 0x9B, 0x9D
PARAMETERS = {0x16: 1, 0x1C: 2, 0x8B: 1, 0x91: 1, 0x93: 1, 0x94: 1, 0x97: 1}
#: What stands for a sign that the stream draws itself.
DRAWN = "\u3013"
#: Group ids of the second of two groups that alternate are by so much larger.
GROUP_B = 0x20
LANGUAGE = "struct<id: int, code: string, coding: int>"
EVENT = pa.schema([("path", pa.string()), ("pkt_no", pa.int64()), ("pts_start", pa.int64()), ("i", pa.int32()), ("duration", pa.int64()), ("text", pa.string()), ("language", pa.string())])


class CaptionCodes(Decoder):
    """The text codes of captions: beyond those of event texts, single shifts and sets of drawn signs."""

    def __init__(self, table: dict[int, str]):
        super().__init__(table)
        self.drawn: list[int] = [0, 0, 0, 0]
        self.single: int | None = None

    def escape(self, data: bytes, i: int) -> int:
        """A drawn set is named by 0x20 before its final byte; set 0 has two-byte codes, the others one-byte codes."""
        wide = i < len(data) and data[i] == 0x24
        at = i + wide
        if at + 2 < len(data) and 0x28 <= data[at] <= 0x2B and data[at + 1] == 0x20:
            self.drawn[data[at] - 0x28] = 2 if wide else 1
            return at + 3
        named = data[at] - 0x28 if at < len(data) and 0x28 <= data[at] <= 0x2B else 0 if wide else -1
        if named >= 0:
            self.drawn[named] = 0
        return super().escape(data, i)

    def plain(self, data: bytes, i: int) -> str:
        return super().plain(data, i) if self.single is None and not self.drawn[self.left] else ""

    def sign(self, data: bytes, i: int) -> tuple[str, int]:
        right = bool(data[i] & 0x80)
        used = self.single if self.single is not None else self.right if right else self.left
        left, right_set, self.single = self.left, self.right, None
        try:
            self.left = self.right = used
            if self.drawn[used]:
                return DRAWN, self.drawn[used]
            return super().sign(data, i)
        finally:
            self.left, self.right = left, right_set


def screens(data: bytes, table: dict[int, str]) -> list[tuple[int, int | None, str]]:
    """(start, duration, text) in milliseconds of the screens of a statement body, from its presentation time on.

    A clear ends a screen.  Waits within a screen add up to its duration, null without any, and the next screen starts
    when they are over.  A repeat code repeats the sign after it; small signs are ruby and left out; full-width letters
    and digits of medium size become half-width ones, kana stay.  Sets and shifts hold over clears, within one statement.
    Positions and colours are passed over.
    """
    codes, out = CaptionCodes(table), []
    text: list[str] = []
    start, wait, times, small, medium = 0, None, 1, False, False

    def close() -> None:
        nonlocal start, wait
        shown = "".join(text).strip()
        if shown:
            out.append((start, wait, shown))
        start, wait = start + (wait or 0), None
        text.clear()

    i = 0
    while i < len(data):
        b = data[i]
        step = 1 + PARAMETERS.get(b, 0)
        if b == ESCAPE:
            i = codes.escape(data, i + 1)
            continue
        if times == 1 and (run := codes.plain(data, i)):
            if not small:
                text.append(run)
            i += len(run)
            continue
        if b == CLEAR:
            close()
            small = medium = False
        elif b == TIME:
            kind = data[i + 1] if i + 1 < len(data) else 0
            step = 3
            if kind == 0x20 and i + 2 < len(data):
                wait = (wait or 0) + (data[i + 2] & 0x3F) * 100
            elif kind == 0x29:  # a time of day, up to its final byte
                while i + step <= len(data) and not 0x40 <= data[i + step - 1] <= 0x43:
                    step += 1
        elif b == REPEAT:
            times, step = max(1, data[i + 1] & 0x3F) if i + 1 < len(data) else 1, 2
        elif b in (SMALL, MEDIUM, NORMAL, SIZE):
            small, medium = b == SMALL, b == MEDIUM
        elif b == COLOUR:
            step = 3 if data[i + 1 : i + 2] == b"\x20" else 2
        elif b == CONTROL:
            while i + step < len(data) and not 0x40 <= data[i + step] <= 0x7E:
                step += 1
            step += 1
        elif b == MACRO:  # a definition, up to the code that ends it
            end = data.find(b"\x95\x4f", i + 1)
            step = (end if end >= 0 else len(data)) + 2 - i
        elif b in (0x0A, 0x0D):
            text.append("\n")
        elif b in (0x0E, 0x0F):
            codes.left = 1 if b == 0x0E else 0
        elif b in (SHIFT_2, SHIFT_3):
            codes.single = 2 if b == SHIFT_2 else 3
        elif b == 0x20 or 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFE:
            sign, step = (" ", 1) if b == 0x20 else codes.sign(data, i)
            if medium:
                sign = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else " " if c == "\u3000" else c for c in sign)
            if not small:
                text.append(sign * times)
            times = 1
        i += step
    close()
    return out


def data_group(payload: bytes) -> tuple[int, bytes] | None:
    """Id and body of the data group of a caption PES payload."""
    if len(payload) < 3 or payload[0] not in (0x80, 0x81):
        return None
    at = 3 + (payload[2] & 15)
    if len(payload) < at + 5:
        return None
    size = payload[at + 3] << 8 | payload[at + 4]
    return payload[at] >> 2 & 0x3F, payload[at + 5 : at + 5 + size]


def languages(body: bytes) -> list[tuple[int, str, int]]:
    """(id, ISO code, character coding) of the languages that a management group announces; ids count from 1."""
    if not body:
        return []
    i = 1 + (5 if body[0] >> 6 == 2 else 0)
    out = []
    for _ in range(body[i] if i < len(body) else 0):
        i += 1
        if i >= len(body):
            break
        number, mode = (body[i] >> 5) + 1, body[i] & 15
        i += mode in (0x0C, 0x0D, 0x0E)  # a display condition
        if i + 4 >= len(body):
            break
        out.append((number, body[i + 1 : i + 4].decode("ascii", "replace").lower(), body[i + 4] >> 2 & 3))
        i += 4
    return out


def statement(body: bytes, table: dict[int, str], coding: int = 0) -> list[tuple[int, int | None, str]]:
    """Screens of the statement data units of a group's body; coding 1 is UTF-8 text."""
    if not body:
        return []
    i = 1 + (5 if body[0] >> 6 in (1, 2) else 0)
    if len(body) < i + 3:
        return []
    end = min(i + 3 + int.from_bytes(body[i : i + 3], "big"), len(body))
    i += 3
    text = bytearray()
    while i + 5 <= end and body[i] == 0x1F:
        n = int.from_bytes(body[i + 2 : i + 5], "big")
        if body[i + 1] == 0x20:
            text += body[i + 5 : min(i + 5 + n, end)]
        i += 5 + n
    if coding == 1:
        shown = "".join(c for c in text.decode("utf-8", "replace") if c == "\n" or c >= " ").strip()
        return [(0, None, shown)] if shown else []
    return screens(bytes(text), table)


def managed(pes: DataFrame) -> DataFrame:
    """pes (path, pkt_no, pts_ms, payload) with the languages that the last management group before each row announces.

    Null before the first.  Both groups that alternate count.  Carried on in the order of pkt_no within a path.
    """
    read = F.pandas_udf(lambda ps: ps.map(lambda p: None if p is None else announced(bytes(p))), f"array<{LANGUAGE}>")
    group = F.when(group_id(F.col("payload")) % GROUP_B == 0, F.col("payload"))  # others do not go to Python
    w = Window.partitionBy("path").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pes.withColumn("languages", F.last(read(group), ignorenulls=True).over(w))


def group_id(payload: Column) -> Column:
    """Id of the data group of a caption PES payload, as data_group() has it; null without one."""
    at = 3 + byte(payload, 2).bitwiseAND(F.lit(15))
    whole = F.substring(payload, 1, 1).isin(b"\x80", b"\x81") & (F.octet_length(payload) >= at + 5)
    return F.when(whole, F.shiftright(byte(payload, at), 2))


def announced(payload: bytes) -> list[tuple[int, str, int]] | None:
    """The languages of a management group; None for other payloads."""
    group = data_group(payload)
    return languages(group[1]) or None if group and group[0] & ~GROUP_B == 0 else None


def decode_events(pes: DataFrame, language: int | str = 1) -> DataFrame:
    """(path, pos, pts_start, duration, text, language) of PES rows (path, pkt_no, pts_ms, payload[, languages]).

    One language is decoded: by its number, or by its ISO code as the management data in force announces it, from
    `languages` of each row (see managed(); a stream of stream_pes() has it).  Without that, a number is enough to tell
    statements apart, and a code finds none.  Each screen of a statement is an event.
    """
    number = group_id(F.col("payload")) % GROUP_B
    one = F.get(F.filter("languages", lambda x: x["id"] == F.col("number")), F.lit(0)) if "languages" in pes.columns else F.lit(None).cast(LANGUAGE)
    own = pes.withColumn("number", number).where(F.col("number").between(1, 8)).withColumn("one", one)
    own = own.where(F.col("number") == language if isinstance(language, int) else F.col("one.code") == language)

    def run(batches):
        table = extra_table()
        for b in batches:
            out = [[] for _ in EVENT]
            for row in zip(*b.columns, strict=True):
                path, no, pts, payload, coding, code = (x.as_py() for x in row)
                for i, (at, wait, text) in enumerate(statement(data_group(payload)[1], table, coding)):
                    for values, value in zip(out, (path, no, pts + at, i, wait, text, code), strict=True):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, EVENT, strict=True)], schema=EVENT)

    rows = own.select("path", "pkt_no", "pts_ms", "payload", F.coalesce("one.coding", F.lit(0)).alias("coding"), F.col("one.code").alias("code"))
    rows = rows.mapInArrow(run, "path string, pkt_no long, pts_start long, i int, duration long, text string, language string")
    return rows.select("path", (F.col("pkt_no") * 1000 + F.col("i")).alias("pos"), "pts_start", "duration", "text", "language")


def to_captions(events: DataFrame) -> DataFrame:
    """Caption rows from decoded events (path, pos, pts_start, duration, text): trimmed, not empty, with ends."""
    from ..functions.exprs import trim_u

    e = events.withColumn("text", trim_u(F.col("text"))).where("text <> ''")
    return drop_empty_interval(caption_end(e, "path", "pos")).select("path", "pos", "pts_start", "pts_end", "text")


def extract(packets: DataFrame, language: int | str = 1, pids: DataFrame | None = None) -> DataFrame:
    """Captions of recordings in one language, from their packets; pids (path, pid): their caption streams, where known."""
    return to_captions(decode_events(managed(demux_pes(packets, caption_pids(packets) if pids is None else pids)), language))


def caption_units(files: DataFrame, pids: DataFrame) -> DataFrame:
    """demux_pes() of files (path, length) whose caption stream is known: pids (path, pid).

    Only packets of that stream are taken from the bytes, which are read once; files without one are not read.
    """
    own = files.join(pids, "path").withColumn("pids", F.array(F.col("pid").cast("int")))
    return demux_pes(packets_in(ranges(own)), pids)


def extract_files(files: DataFrame, pids: DataFrame, language: int | str = 1) -> DataFrame:
    """Captions in one language of the files that caption_units() takes."""
    return to_captions(decode_events(managed(caption_units(files, pids)), language))


def streams(spark: SparkSession, target: str) -> Store:
    """The store of caption PES at target."""
    return Store(spark, target, {"pes": "path string, pkt_no long, pts_ms long, payload binary"}, {"pes": "path"})


def write_pes(units: DataFrame, target: str) -> None:
    """One commit with the caption PES of some recordings; what was stored for these before counts no longer."""
    units = cut(units)
    streams(units.sparkSession, target).commit({"pes": units}, {"pes": units})
    drop(units)


def read_pes(spark: SparkSession, target: str) -> DataFrame:
    """(path, pkt_no, pts_ms, payload) of the stored caption PES."""
    return streams(spark, target).rows("pes")


def store_pes(packets: DataFrame, target: str) -> DataFrame:
    """Stores the caption PES of recordings and returns all that is stored there.

    A recording that has some replaces what was stored for it; one without any leaves what is there.
    """
    write_pes(demux_pes(packets, caption_pids(packets)), target)
    return read_pes(packets.sparkSession, target)


def regenerate(packets: DataFrame, target: str) -> DataFrame:
    """(path, made) for each recording of packets: whether it has a caption stream, which is then stored anew."""
    made = cut(demux_pes(packets, caption_pids(packets)))
    write_pes(made, target)
    has = made.select("path").distinct().withColumn("made", F.lit(True))
    return packets.select("path").distinct().join(has, "path", "left").select("path", F.coalesce("made", F.lit(False)).alias("made"))


def composite(tiles: list[tuple[int, int, np.ndarray]], width: int, height: int) -> np.ndarray:
    """Tiles (x, y, RGBA array) laid over each other on a clear canvas, cut at its edges; integer source-over blending."""
    canvas = np.zeros((height, width, 4), dtype=np.uint32)
    for x, y, tile in tiles:
        x, y = max(x, 0), max(y, 0)
        view = canvas[y : y + tile.shape[0], x : x + tile.shape[1]]
        t = tile[: view.shape[0], : view.shape[1]].astype(np.uint32)
        a = t[..., 3:]
        mixed = (t * a + view * (255 - a)) // 255
        mixed[..., 3:] = np.minimum(a + view[..., 3:] * (255 - a) // 255, 255)
        view[:] = np.where(a == 255, t, np.where(a == 0, view, mixed))
    return canvas.astype(np.uint8)
