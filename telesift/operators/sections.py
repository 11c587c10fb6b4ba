"""Tables of a transport stream: programme map and event information, one group of packets per recording."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.b24 import Decoder, extra_table
from ..sources.scratch import cut
from ..sources.ts import EIT_FALLBACK, EIT_PACKETS, PSI_PACKETS, START_PERCENT, packets_in, ranges
from .packets import of_pids

PAT_PID, EIT_PID = 0, 0x12
SECTION = pa.schema([("path", pa.string()), ("pid", pa.int32()), ("pkt_no", pa.int64()), ("section", pa.binary())])
EPG = "path string, event_start timestamp_ntz, title string, episode_number int, last_episode int, series_name string, detail string"


def u16(d: bytes, i: int) -> int:
    return d[i] << 8 | d[i + 1]


class Assembler:
    """Puts the sections of one PID together: a start flag ends the last section with its pointer bytes and begins one."""

    def __init__(self):
        self.held = b""

    def _done(self) -> bytes | None:
        if len(self.held) >= 3:
            n = 3 + (u16(self.held, 1) & 0xFFF)
            if len(self.held) >= n:
                out, self.held = self.held[:n], b""
                return out
        return None

    def feed(self, pusi: bool, payload: bytes) -> list[bytes]:
        out = []
        if pusi:
            at = 1 + payload[0]
            if self.held:
                self.held += payload[1:at]
                out.append(self._done())
            self.held = payload[at:]
        elif self.held:
            self.held += payload
        else:
            return []
        out.append(self._done())
        return [s for s in out if s is not None]


def sections(packets: DataFrame, pids: list[int] | None = None) -> DataFrame:
    """(path, pid, pkt_no, section): the complete sections of each PID, in order.

    The packets of a PID of a recording are sorted by Spark and go through one assembler, a batch at a time.
    """
    if pids:
        packets = packets.where(F.col("pid").isin(pids))

    def run(batches):
        last, a = None, Assembler()
        for batch in batches:
            out = []
            for path, pid, no, pusi, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, pid) != last:
                    last, a = (path, pid), Assembler()
                out += [(path, pid, no, s) for s in a.feed(pusi, payload)]
            yield pa.RecordBatch.from_pylist([dict(zip(SECTION.names, r, strict=True)) for r in out], schema=SECTION)

    rows = packets.select("path", "pid", "pkt_no", "pusi", "payload").repartition("path", "pid").sortWithinPartitions("path", "pid", "pkt_no")
    return rows.mapInArrow(run, "path string, pid int, pkt_no long, section binary")


def descriptors(d: bytes, a: int, b: int):
    while a + 2 <= b and a + 2 + d[a + 1] <= b:
        yield d[a], d[a + 2 : a + 2 + d[a + 1]]
        a += 2 + d[a + 1]


def map_streams(section: bytes) -> list[tuple[int, bool]]:
    """(pid, named as captions) of the private streams of a programme map."""
    out = []
    if len(section) < 12:
        return out
    end = len(section) - 4
    at = 12 + (u16(section, 10) & 0xFFF)
    while at + 5 <= end:
        n = u16(section, at + 3) & 0xFFF
        if section[at] == 0x06:
            named = any(tag == 0xFD and len(d) >= 2 and u16(d, 0) in (0x0008, 0x0012) for tag, d in descriptors(section, at + 5, min(at + 5 + n, end)))
            out.append((u16(section, at + 1) & 0x1FFF, named))
        at += 5 + n
    return out


def associations(packets: DataFrame) -> DataFrame:
    """(path, pid, service, pat_no): the programme maps that the association table of each recording names."""

    def maps(batches):
        for b in batches:
            out = []
            for path, no, s in zip(b["path"], b["pkt_no"], b["section"], strict=True):
                s = bytes(s)
                out += [(path, no, u16(s, i), u16(s, i + 2) & 0x1FFF) for i in range(8, len(s) - 7, 4) if u16(s, i)]
            yield pd.DataFrame(out, columns=["path", "pat_no", "service", "pid"])

    found = sections(packets, [PAT_PID]).mapInPandas(maps, "path string, pat_no long, service int, pid int")
    return found.groupBy("path", "pid").agg(F.max_by("service", "pat_no").alias("service"), F.min("pat_no").alias("pat_no"))


def programme_info(packets: DataFrame, most: int = PSI_PACKETS) -> DataFrame:
    """(path, services, caption_pid) from the first `most` packets of each recording.

    The association table names the maps; of the private streams in the maps, those that a descriptor names as
    captions win over the others, and the first of them is the caption stream.  Recordings with neither have an
    empty list and null.
    """
    return with_streams(packets.select("path").distinct(), head_streams(packets, most))


def head_streams(packets: DataFrame, most: int = PSI_PACKETS) -> DataFrame:
    """private_streams() of the first `most` packets.  What the association tables name is written to the shared folder,
    for it is used more than once, and packets may be costly to make."""
    head = packets.where(F.col("pkt_no") < most)
    return private_streams(cut(associations(head)), head)


def file_info(files: DataFrame, most: int = PSI_PACKETS) -> DataFrame:
    """programme_info of files (path, length), which are read no further than its window: once for the association table,
    and once for the maps that it names."""
    found = cut(associations(packets_in(ranges(files.select("path", "length", F.array(F.lit(PAT_PID)).alias("pids")), most=most))))
    maps = files.select("path", "length").join(found.groupBy("path").agg(F.collect_set("pid").alias("pids")), "path")
    return with_streams(files.select("path"), private_streams(found, packets_in(ranges(maps, most=most))))


def private_streams(found: DataFrame, packets: DataFrame) -> DataFrame:
    """Services and streams of the recordings that have any, from the maps that associations() found and packets that have
    these maps."""
    own = of_pids(packets, found).join(found.select("path", "pid", "pat_no"), ["path", "pid"]).where("pkt_no > pat_no").drop("pat_no")
    first = sections(own).groupBy("path", "pid").agg(F.min(F.struct("pkt_no", "section")).alias("f")).join(found, ["path", "pid"])

    def streams(batches):
        for b in batches:
            out = [(path, f["pkt_no"], service, i, pid, named) for path, service, f in zip(b["path"], b["service"], b["f"], strict=True) for i, (pid, named) in enumerate(map_streams(bytes(f["section"])))]
            yield pd.DataFrame(out, columns=["path", "no", "service", "i", "pid", "named"])

    es = first.select("path", "service", "f").mapInPandas(streams, "path string, no long, service int, i int, pid int, named boolean")
    # a service with one named stream is a caption service; its other streams do not make it a fallback
    w = Window.partitionBy("path", "service")
    es = es.withColumn("arib", F.max("named").over(w))
    order = F.struct("no", "i")
    return es.groupBy("path").agg(
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("arib"), F.struct("no", "service")))), lambda x: x["service"])).alias("a"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(~F.col("arib"), F.struct("no", "service")))), lambda x: x["service"])).alias("b"),
        F.min_by("pid", F.when(F.col("named"), order)).alias("pa"),
        F.min_by("pid", F.when(~F.col("named"), order)).alias("pb"),
    )


def with_streams(paths: DataFrame, got: DataFrame) -> DataFrame:
    """programme_info of paths, from private_streams()."""
    return paths.join(got, "path", "left").select("path", F.when(F.size("a") > 0, F.col("a")).otherwise(F.coalesce("b", F.array().cast("array<int>"))).alias("services"), F.coalesce("pa", "pb").alias("caption_pid"))


def caption_pids(packets: DataFrame) -> DataFrame:
    """(path, pid) of the recordings with a caption stream, written to the shared folder: it chooses packets, then joins them."""
    return cut(head_streams(packets).select("path", F.coalesce("pa", "pb").alias("pid")).where("pid is not null"))


def present_event(section: bytes) -> bool:
    return len(section) >= 8 and section[0] == 0x4E and bool(section[1] & 0x80) and section[6] == 0


def parse_event(section: bytes, table: dict[int, str]) -> dict | None:
    """Fields of the first event that has a title."""
    end = len(section) - 4
    at, out = 14, {}
    while len(section) >= 18 and at + 12 <= end:
        n = u16(section, at + 10) & 0xFFF
        out["start"] = section[at + 2 : at + 7]
        stop = min(at + 12 + n, end)
        for tag, d in descriptors(section, at + 12, stop):
            text = lambda a, d=d: Decoder(table).decode(d[a + 1 : a + 1 + d[a]]) if a < len(d) and a + 1 + d[a] <= len(d) else None
            if tag == 0x4D and len(d) >= 4:
                title = text(3)
                if title is not None:
                    out["title"] = title
            elif tag == 0xD5 and len(d) >= 9:
                out["episode"] = (d[5] << 4 | d[6] >> 4) or out.get("episode")
                out["last"] = ((d[6] & 15) << 8 | d[7]) or out.get("last")
                out["series"] = text(8) or out.get("series")
            elif tag == 0x4E and len(d) >= 5:
                out["detail"] = text(5 + d[4]) or out.get("detail")
        at = stop
        if without_icons(out.get("title") or ""):
            return out
    return None


def without_icons(title: str) -> str:
    return "".join(c for c in title if not 0x1F100 <= ord(c) <= 0x1F2FF)


def start_time(b: bytes):
    """Modified Julian day and BCD time; None where either is invalid."""
    day, parts = u16(b, 0), [(x >> 4, x & 15) for x in b[2:5]]
    if day == 0xFFFF or any(h > 9 or v > 9 for h, v in parts):
        return None
    h, m, s = (10 * x + y for x, y in parts)
    return pd.Timestamp("1858-11-17") + pd.Timedelta(days=day, hours=h, minutes=m, seconds=s) if h < 24 and m < 60 and s < 60 else None


def event_info(packets: DataFrame, info: DataFrame) -> DataFrame:
    """The present event of each recording: the first complete section of its services (any, if none is known)."""
    table = extra_table()
    s = sections(packets, [EIT_PID]).join(info.select("path", "services"), "path", "left")

    def run(batches):
        for b in batches:
            out = []
            for path, no, raw, services in zip(b["path"], b["pkt_no"], b["section"], b["services"], strict=True):
                raw = bytes(raw)
                if present_event(raw) and (services is None or not len(services) or u16(raw, 3) in set(services)):
                    e = parse_event(raw, table) or {}
                    out.append((path, no, start_time(e["start"]) if e else None, without_icons(e["title"]) if e else None, e.get("episode"), e.get("last"), e.get("series"), e.get("detail")))
            rows = pd.DataFrame(out, columns=["path", "pkt_no", "event_start", "title", "episode_number", "last_episode", "series_name", "detail"])
            yield rows.astype({"episode_number": "Int32", "last_episode": "Int32", "event_start": "datetime64[us]"})

    fields = EPG.split(", ")
    found = s.mapInPandas(run, ", ".join([fields[0], "pkt_no long", *fields[1:]]))
    names = [f.split()[0] for f in fields[1:]]
    one = found.groupBy("path").agg(F.min_by(F.struct(*names), "pkt_no").alias("e"))
    return one.select("path", *[F.col(f"e.{n}").alias(n) for n in names])


def with_series(epg: DataFrame) -> DataFrame:
    """With series, subtitle and, where the descriptor has none, the episode from the title."""
    e = epg.withColumn("_s", X.series_episode(X.strip_flags(F.col("title"))))
    return e.withColumns({"series_title": F.col("_s.series"), "sub_title": F.col("_s.subtitle"), "episode_number": F.coalesce("episode_number", "_s.episode")}).drop("_s")


def extract_info(files: DataFrame, services: DataFrame) -> DataFrame:
    """Event, series and air date of each recording of files (path, length, modified), in the windows of a scan.

    services: (path, services) of programme_info.  Files above LARGE bytes are read from START_PERCENT of their length on,
    EIT_PACKETS at most.  Only those in which that finds no titled event are read again, EIT_FALLBACK packets from the
    start; what neither finds gets the file's time.  The first result is written to the shared folder, for the second
    scan takes its files from it.
    """
    late = cut(event_info(packets_in(late_ranges(files)), services))
    early = event_info(packets_in(early_ranges(files, late)), services)
    return with_series(recording_info(files, late, early))


def late_ranges(files: DataFrame) -> DataFrame:
    return ranges(files.select("path", "length", F.array(F.lit(EIT_PID)).alias("pids")), START_PERCENT, EIT_PACKETS)


def early_ranges(files: DataFrame, late: DataFrame) -> DataFrame:
    """What is left to read after the late scan: the start of the files without a titled event."""
    missing = files.join(late.where("title is not null").select("path"), "path", "left_anti")
    return ranges(missing.select("path", "length", F.array(F.lit(EIT_PID)).alias("pids")), 0, EIT_FALLBACK)


def recording_info(files: DataFrame, late: DataFrame, early: DataFrame) -> DataFrame:
    """Event of each file from a scan that starts late, else from one from the start, else unknown at the file's time."""
    fields = [c for c in late.columns if c != "path"]
    j = files.select("path", "modified").join(late.select("path", F.struct(*fields).alias("l")), "path", "left").join(early.select("path", F.struct(*fields).alias("e")), "path", "left")
    best = F.when(F.col("l.title").isNotNull(), F.col("l")).when(F.col("e.title").isNotNull(), F.col("e"))
    j = j.withColumn("b", best).select("path", "modified", *[F.col(f"b.{c}").alias(c) for c in fields])
    shifted = F.to_timestamp_ntz(F.date_format(F.col("modified") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd HH:mm:ss"))
    return j.withColumns({"title": F.coalesce("title", F.lit("(unknown)")), "event_start": F.when(F.col("title").isNull(), shifted).otherwise(F.col("event_start"))}).withColumn("air_date", F.to_date("event_start")).drop("modified")
