"""Transport packets, sections and PES, from the rows of the packet source.

A packet row is (path, pkt_no, pid, pusi, afc, payload).  Files are the unit of order: everything is keyed by path and
ordered by pkt_no, never by how rows lie in partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import parse_pts
from .timeline import pts_to_ms

PACKET = 188


def byte(x: Column, i: int | Column) -> Column:
    """The byte at offset i (from 0) of a binary as an integer; null beyond its end."""
    at = F.lit(i + 1) if isinstance(i, int) else i + 1
    return F.conv(F.nullif(F.hex(F.substring(x, at, F.lit(1))), F.lit("")), 16, 10).cast("int")


def header(b1: Column, b2: Column, b3: Column, b4: Column) -> Column:
    """struct(pid, pusi, afc, payload_start) from bytes 1 to 4; no payload_start if the packet carries none."""
    afc = F.shiftright(b3, 4).bitwiseAND(F.lit(3))
    start = F.when(afc == 2, None).when(afc == 3, F.when(5 + b4 < PACKET, 5 + b4)).otherwise(4)
    return F.struct(F.shiftleft(b1.bitwiseAND(F.lit(31)), 8).bitwiseOR(b2).alias("pid"), (b1.bitwiseAND(F.lit(64)) != 0).alias("pusi"), afc.alias("afc"), start.cast("int").alias("payload_start"))


def of_pids(packets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The packets whose PID stands in wanted (pid) for any recording, so that a join on path moves no others.

    A PID has 13 bits, so the list that goes to all tasks has 8,192 rows at most.
    """
    return packets.join(F.broadcast(wanted.select("pid").distinct()), "pid", "left_semi").select(*packets.columns)


def demux_pes(packets: DataFrame, caption_pids: DataFrame) -> DataFrame:
    """(path, pkt_no, pts_ms, payload): the PES of each file's caption stream, in packet order.

    A packet that starts a unit starts an island; what follows belongs to it.  The declared length cuts it (0: none).
    Packets before the first start, starts with fewer than nine bytes, and PES without a time or payload are dropped.
    The time must lie in the first packet of a unit, 14 bytes long at least; the first time of all is time 0, whether or
    not its unit has a payload.  PIDs are compared after a join on path alone: packets are shuffled by path once, for that
    join and for all that follows, whatever the size of caption_pids.
    """
    streams = caption_pids.select("path", F.array("pid").alias("_pids"))
    own = of_pids(packets, caption_pids).where("payload is not null").join(streams, "path").where(F.array_contains("_pids", F.col("pid"))).drop("_pids")
    w = Window.partitionBy("path").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("island", F.sum(F.col("pusi").cast("int")).over(w)).where("island > 0")
    raw = F.expr("listagg(payload) WITHIN GROUP (ORDER BY pkt_no)")
    p = own.groupBy("path", "island").agg(F.min("pkt_no").alias("pkt_no"), F.min_by("payload", "pkt_no").alias("first"), raw.alias("raw")).where(F.octet_length("first") >= 9)
    declared = byte(F.col("raw"), 4) * 256 + byte(F.col("raw"), 5)
    p = p.withColumn("raw", F.when(declared > 0, F.substring("raw", F.lit(1), (declared + 6).cast("int"))).otherwise(F.col("raw")))
    has_pts = (F.shiftright(byte(F.col("first"), 7), 6) != 0) & (F.octet_length("first") >= 14)
    p = p.withColumn("pts", F.when(has_pts, parse_pts(*[byte(F.col("first"), 9 + i) for i in range(5)])))
    p = p.withColumn("payload", pes_payload(F.col("raw")))
    p = pts_to_ms(p, ["path"], ["pkt_no"])
    return p.where((F.octet_length("payload") > 0) & F.col("pts").isNotNull()).select("path", "pkt_no", F.col("ms").alias("pts_ms"), "payload")


def pes_payload(raw: Column) -> Column:
    """What follows the PES header; empty if nothing does."""
    start = byte(raw, 8) + 9
    return F.when(F.octet_length(raw) > start, F.substring(raw, start + 1, F.octet_length(raw) - start)).otherwise(F.unhex(F.lit("")))
