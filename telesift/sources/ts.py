"""Transport-stream recordings as rows of packets."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

PACKET = 188
SCHEMA = "path string, pkt_no long, pid int, pusi boolean, afc int, payload binary"
FIELDS = pa.schema([("path", pa.string()), ("pkt_no", pa.int64()), ("pid", pa.int32()), ("pusi", pa.bool_()), ("afc", pa.int32()), ("payload", pa.binary())])
#: Windows of a recording: packets with the programme map, with events from a late start, and from the beginning.
PSI_PACKETS, EIT_PACKETS, EIT_FALLBACK, LARGE, START_PERCENT = 50_000, 600_000, 300_000, 500_000, 20
#: Packets that are read at once, and those of one task's range.
CHUNK, PER_RANGE = 20_000, 200_000


def listing(spark: SparkSession, mount: str, pattern: str = "*.ts") -> DataFrame:
    """(path, length, modified) of the recordings below a folder; their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(mount)
    return files.selectExpr("regexp_replace(path, '^file:', '') AS path", "length", "modificationTime AS modified")


def parse(path: str, first: int, raw: bytes, pids: Iterable[int] | None = None) -> pa.RecordBatch:
    """Packets of a run of bytes that starts at packet `first`, of all PIDs or of those given.

    What lacks the sync byte or a payload is left out.  Payloads are cut out of the packets that stay, in one piece.
    """
    return parse_runs([(path, first, raw)], pids)


def parse_runs(runs: list[tuple[str, int, bytes]], pids: Iterable[int] | None = None) -> pa.RecordBatch:
    """parse() of some runs (path, first, raw) in one batch: short recordings cost no batch each."""
    counts = np.array([len(raw) // PACKET for _, _, raw in runs], np.int64)
    n = int(counts.sum())
    own = np.repeat(np.arange(len(runs)), counts)
    number = np.arange(n) + np.repeat(np.array([first for _, first, _ in runs], np.int64) - (np.cumsum(counts) - counts), counts)
    raw = runs[0][2] if len(runs) == 1 else b"".join(r if len(r) % PACKET == 0 else r[: len(r) // PACKET * PACKET] for _, _, r in runs)
    p = np.frombuffer(raw, dtype=np.uint8, count=n * PACKET).reshape(n, PACKET)
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    keep = p[:, 0] == 0x47
    if pids is not None:
        keep &= np.isin(pid, np.fromiter(pids, np.int32))
    at = np.flatnonzero(keep)
    p, pid = p[at], pid[at]
    afc = p[:, 3].astype(np.int32) >> 4 & 3
    start = np.where(afc == 3, 5 + p[:, 4].astype(np.int32), 4)
    held = np.flatnonzero((afc != 2) & (start < PACKET))
    at, p, pid, afc, start = at[held], p[held], pid[held], afc[held], start[held]
    ends = np.zeros(len(at) + 1, np.int32)
    np.cumsum(PACKET - start, out=ends[1:])
    body = p[np.arange(PACKET) >= start[:, None]]
    payload = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    paths = pa.array([path for path, _, _ in runs], pa.string()).take(pa.array(own[at]))
    columns = [paths, pa.array(number[at]), pa.array(pid, pa.int32()), pa.array((p[:, 1] & 0x40) != 0), pa.array(afc, pa.int32()), payload]
    return pa.RecordBatch.from_arrays(columns, schema=FIELDS)


def parse_parts(parts: Iterable[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The packets of parts (path, number of the first packet, bytes) of recordings, some thousand at a time.

    Besides the part at hand no more than CHUNK packets wait.
    """
    runs, n = [], 0
    for path, first, raw in parts:
        if n and n + len(raw) > CHUNK * PACKET:
            yield parse_runs(runs)
            runs, n = [], 0
        runs.append((path, first, raw))
        n += len(raw)
    if runs:
        yield parse_runs(runs)


def parse_files(files: Iterable[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """The packets of whole recordings (path, content), some thousand at a time, of one recording or of many.

    Besides the recording at hand no more than CHUNK packets wait, so memory does not grow with the number of recordings.
    """
    return parse_parts((path, a // PACKET, content[a : a + CHUNK * PACKET]) for path, content in files for a in range(0, len(content), CHUNK * PACKET))


def read_range(path: str, first: int, count: int, pids: Iterable[int] | None = None) -> Iterator[pa.RecordBatch]:
    """The packets of `count` places from `first` on, some thousand at a time."""
    with open(path, "rb") as f:
        f.seek(first * PACKET)
        for done in range(0, count, CHUNK):
            n = min(CHUNK, count - done)
            raw = f.read(n * PACKET)
            yield parse(path, first + done, raw, pids)
            if len(raw) < n * PACKET:
                return


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class PacketReader(DataSourceReader):
    """Byte ranges aligned to packets, so that one recording is read by many tasks."""

    def __init__(self, options):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.per_task = int(options.get("packetsPerTask", PER_RANGE))
        self.most = int(options.get("maxPackets", 0))
        self.start = options.get("startPercent", "0")
        self.low, self.high = int(options.get("firstPacket", 0)), int(options["endPacket"]) if "endPacket" in options else None
        self.pids = {int(x) for x in options["pids"].split(",")} if options.get("pids") else None

    def partitions(self):
        out = []
        for path in self.paths:
            size = os.path.getsize(path)
            first, last = start_packet(size, int(self.start)), size // PACKET
            if self.most:
                last = min(last, first + self.most)
            first, last = max(first, self.low), last if self.high is None else min(last, self.high)
            out += [Range(path, a, min(self.per_task, last - a)) for a in range(first, last, self.per_task)]
        return out

    def read(self, partition):
        if partition is not None:
            yield from read_range(partition.path, partition.first, partition.count, self.pids)


class FilteringReader(PacketReader):
    """Conditions on pkt_no become byte ranges, those on path choose files, and those on pid are tested before a payload
    is touched."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.takes(f):
                yield f

    def takes(self, f: Filter) -> bool:
        """Whether a condition is met by what is read; then Spark does not test it again."""
        column, value = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            return column is not None  # no column is ever null
        values = [value] if isinstance(f, EqualTo) else list(value) if isinstance(f, In) else None
        if column == "pid" and values is not None:
            self.pids = set(values) if self.pids is None else self.pids & set(values)
        elif column == "path" and values is not None:
            self.paths = [p for p in self.paths if p in set(values)]
        elif column == "pkt_no" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo, GreaterThan, GreaterThanOrEqual)):
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                high = value + (not isinstance(f, LessThan))
                self.high = high if self.high is None else min(self.high, high)
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
        else:
            return False
        return True


def start_packet(size: int, percent: int) -> int:
    """Where a scan starts: small files from their first packet, others at a percentage, rounded down to a packet."""
    return size * percent // 100 // PACKET if size > LARGE else 0


class PacketSource(DataSource):
    """Format `ts_packets`: options paths (one a line), packetsPerTask, maxPackets, startPercent, firstPacket, endPacket, pids.

    Recordings are on a mount that every executor has.  For files in another store, packets_of() takes binaryFile rows;
    for lists of files that are long or come from another job, packets_in() takes them as a table.
    """

    @classmethod
    def name(cls):
        return "ts_packets"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PacketReader(self.options)


class FilteredSource(PacketSource):
    """Format `ts_packets_once`: takes over the conditions of the query.

    Spark keeps one reader for each load(), so a table of this format must stand only once in a query.
    """

    @classmethod
    def name(cls):
        return "ts_packets_once"

    def reader(self, schema):
        return FilteringReader(self.options)


def scan(spark: SparkSession, paths: list[str], once: bool = False, **options) -> DataFrame:
    """Packets of recordings that the caller names.

    once: the conditions of the query reach the bytes; for a table that is used once (see FilteredSource).
    """
    if once:  # Python sources get conditions only in sessions that allow it
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = FilteredSource if once else PacketSource
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("paths", "\n".join(paths)).options(**options).load()


def ranges(files: DataFrame, percent: int = 0, most: int | None = None, per_range: int = PER_RANGE) -> DataFrame:
    """(path, first, count, pids): the byte ranges to read of files (path, length), and of which PIDs.

    Files above LARGE bytes start at `percent` of their length.  A column pids (array<int>) of files limits the PIDs of
    each file; null or no such column means all.
    """
    large = F.col("length") > LARGE
    first = F.when(large, F.floor(F.col("length") * percent / 100 / PACKET)).otherwise(0).cast("long")
    last = F.floor(F.col("length") / PACKET).cast("long")
    pids: Column = F.col("pids") if "pids" in files.columns else F.lit(None).cast("array<int>")
    f = files.select("path", first.alias("_first"), last.alias("_last"), pids.alias("pids"))
    if most is not None:
        f = f.withColumn("_last", F.least("_last", F.col("_first") + most))
    f = f.where("_first < _last").withColumn("first", F.explode(F.sequence(F.col("_first"), F.col("_last") - 1, F.lit(per_range).cast("long"))))
    return f.select("path", "first", F.least(F.col("_last") - F.col("first"), F.lit(per_range)).cast("long").alias("count"), "pids")


def packets_in(pieces: DataFrame, tasks: int | None = None) -> DataFrame:
    """The packets of ranges(), which is a table like any other: it may be the result of an earlier scan.

    The rows are dealt out evenly, whatever file they belong to, and each is read where it lands.
    """

    def run(batches):
        for batch in batches:
            for path, first, count, pids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                yield from read_range(path, first, count, pids)

    tasks = tasks or max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.sparkSession.sparkContext.defaultParallelism)
    return pieces.select("path", "first", "count", "pids").repartition(tasks, "path", "first").mapInArrow(run, SCHEMA)


def packets_of(files: DataFrame) -> DataFrame:
    """Packets of binaryFile rows (path, content), for stores that only Spark reads; one file is one row there."""

    def run(batches):
        for batch in batches:
            yield from parse_files((path.as_py(), content.as_py()) for path, content in zip(batch.column(0), batch.column(1), strict=True))

    return files.select("path", "content").mapInArrow(run, SCHEMA)
