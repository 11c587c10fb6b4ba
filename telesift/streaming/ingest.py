"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

import os
from collections.abc import Callable
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import mutate, recordings
from ..operators.captions import announced
from ..operators.sections import Assembler
from ..operators.timeline import PTS_RANGE
from ..sources.tables import Store
from ..sources.ts import PACKET, SCHEMA, Range, listing, read_range

PES_STATE = "held binary, total int, pts long, epoch long, first_no long, management binary"
PES_ROWS = "path string, pkt_no long, pts_ms long, payload binary, languages array<struct<id: int, code: string, coding: int>>"
SECTION_ROWS = "path string, pid int, pkt_no long, section binary"


def new_files(spark: SparkSession, mount: str, pattern: str = "*.ts") -> DataFrame:
    """A stream of (path, length, modified) of recordings as they appear; the checkpoint knows which were seen."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(mount)
    return s.select(F.regexp_replace("path", "^file:", "").alias("path"), "length", F.col("modificationTime").alias("modified"))


def run_phases(stream: DataFrame, checkpoint: str, enqueue: Callable, regenerate: Callable, ingest: Callable, once: bool = True, every: str = "60 seconds"):
    """Starts a query that hands each batch to the three phases, one after the other.

    Batches never overlap, so a tick that comes while one runs is skipped.  Each phase takes (batch, batch_id) and
    must be repeatable, since a batch is given again after a failure.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        for phase in (enqueue, regenerate, ingest):
            phase(df, batch_id)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def _time(raw: bytes) -> int | None:
    if len(raw) < 14 or not raw[7] >> 6:
        return None
    a = raw[9:14]
    return (a[0] >> 1 & 7) << 30 | a[1] << 22 | a[2] >> 1 << 15 | a[3] << 7 | a[4] >> 1


def stream_pes(packets: DataFrame, idle: str | None = None) -> DataFrame:
    """PES rows from a stream of caption packets, keyed by path; the same rows as demux_pes() and then captions.managed()
    give for a batch, so that captions.decode_events() takes them.

    The state of a recording is the unit that is being put together, its time, the first time seen, and the last
    management data, whose languages each later row carries.  A unit goes out when its declared length is there or the next one starts.  A unit of no declared length at the end of a
    recording waits for the next start, or, with idle, until no packet came for that long.
    """

    def run(key, batches, state):
        held, total, pts, epoch, no, management = state.get if state.exists else (b"", 0, None, None, -1, b"")
        held, management, out = bytes(held), bytes(management), []
        known = announced(management)

        def flush():
            nonlocal held, management, known
            if len(held) > 9 and pts is not None:
                payload = held[9 + held[8] :]
                if payload:
                    if now := announced(payload):
                        management, known = payload, now
                    rows = None if known is None else [{"id": i, "code": c, "coding": t} for i, c, t in known]
                    out.append((key[0], no, (pts - epoch) % PTS_RANGE // 90, payload, rows))
            held = b""

        if state.hasTimedOut:
            flush()
        else:
            for batch in batches:
                for row in batch.sort_values("pkt_no").itertuples():
                    data = bytes(row.payload)
                    if row.pusi:
                        flush()
                        if len(data) < 9:
                            continue
                        n = data[4] << 8 | data[5]
                        total, no, pts = (n + 6 if n else 0), row.pkt_no, _time(data)
                        epoch = pts if epoch is None else epoch
                        held = data
                    elif held:
                        held += data
                    if held and total and len(held) >= total:
                        held = held[:total]
                        flush()
        state.update((held, total, pts, epoch, no, management))
        if idle and held:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["path", "pkt_no", "pts_ms", "payload", "languages"])

    timeout = "ProcessingTimeTimeout" if idle else "NoTimeout"
    return packets.groupBy("path").applyInPandasWithState(run, PES_ROWS, PES_STATE, "append", timeout)


class PacketStreamReader(DataSourceStreamReader):
    """Packets of recordings as they are written.  The offset is the number of whole packets by recording.

    A batch has the packets that came to each recording since the last one, in ranges of packetsPerTask.  A recording that
    is gone is read no further.  Each recording that the folder holds has an entry in the offset: move finished ones away.
    """

    def __init__(self, options):
        self.mount, self.pattern = options["path"], options.get("pattern", "*.ts")
        self.per_task = int(options.get("packetsPerTask", 200_000))
        self.pids = [int(x) for x in options["pids"].split(",")] if options.get("pids") else None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for folder, _, names in os.walk(self.mount):
            for name in names:
                if fnmatch(name, self.pattern):
                    path = os.path.join(folder, name)
                    out[path] = os.path.getsize(path) // PACKET
        return out

    def partitions(self, start: dict, end: dict):
        out = []
        for path, last in sorted(end.items()):
            out += [Range(path, a, min(self.per_task, last - a)) for a in range(start.get(path, 0), last, self.per_task)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        if partition.count:
            yield from read_range(partition.path, partition.first, partition.count, self.pids)


class PacketStream(DataSource):
    """Format `ts_packet_stream`: options path (a folder on a mount that all executors have), pattern, packetsPerTask, pids."""

    @classmethod
    def name(cls):
        return "ts_packet_stream"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return PacketStreamReader(self.options)


def new_packets(spark: SparkSession, mount: str, **options) -> DataFrame:
    """A stream of packets of all recordings below mount, which may still be growing."""
    spark.dataSource.register(PacketStream)
    return spark.readStream.format("ts_packet_stream").option("path", mount).options(**options).load()


class Sections(StatefulProcessor):
    """Puts the sections of one PID of one recording together; its state is the section that has begun."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held binary, until long")

    def handleInputRows(self, key, rows, timerValues):
        a = Assembler()
        before = self.held.get() if self.held.exists() else (b"", 0)
        a.held = bytes(before[0])
        out = []
        for batch in rows:
            for r in batch.sort_values("pkt_no").itertuples():
                out += [(key[0], key[1], r.pkt_no, s) for s in a.feed(r.pusi, bytes(r.payload))]
        if before[1]:
            self.handle.deleteTimer(before[1])
        if a.held:
            until = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(until)
            self.held.update((a.held, until))
        elif self.held.exists():
            self.held.clear()
        yield pd.DataFrame(out, columns=["path", "pid", "pkt_no", "section"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        yield pd.DataFrame(columns=["path", "pid", "pkt_no", "section"])

    def close(self) -> None:
        pass


def stream_sections(packets: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """Sections from a stream of packets, the same rows as sections.sections() gives for a batch.

    State is kept by (path, pid) only while a section is incomplete; one that no packet came for in idle_ms is given up.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).  A run that ends when all is read needs
    spark.sql.streaming.noDataMicroBatches.enabled off, for timers ask for one more batch each time.
    """
    return packets.groupBy("path", "pid").transformWithStateInPandas(Sections(idle_ms), SECTION_ROWS, "append", "processingTime")


def ingest_stream(spark: SparkSession, mount: str, tables: str, checkpoint: str, streams: str, once: bool = True, name: str = "ingest", before: Callable[[str, int], None] = lambda phase, batch_id: None):
    """Polls a folder and keeps a store of tables up with it, in three phases a batch: new recordings are queued, missing
    caption streams are made again in `streams`, pending recordings are read until none is left.

    A batch is given again after a failure.  Queueing is committed under the batch's number, so it happens once; the
    other two take what the store says is due, after what a dead run had claimed is set back.  One runner a store.
    before(phase, batch_id) is called ahead of each phase.
    """
    store = Store(spark, tables)

    def enqueue(batch: DataFrame, batch_id: int) -> None:
        before("enqueue", batch_id)
        version = store.version()
        t = store.load(version)
        store.advance(t, mutate.enqueue(mutate.crash_recovery(t), listing(spark, mount)), version, (name, batch_id))

    def regenerate(batch: DataFrame, batch_id: int) -> None:
        before("regenerate", batch_id)
        store.change(mutate.crash_recovery)
        recordings.regenerate_next(store, listing(spark, mount), streams)

    def ingest(batch: DataFrame, batch_id: int) -> None:
        before("ingest", batch_id)
        recordings.ingest_all(store, listing(spark, mount))
        store.compact()

    return run_phases(new_files(spark, mount), checkpoint, enqueue, regenerate, ingest, once)
