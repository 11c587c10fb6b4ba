"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Between two words: every ASCII character that is no digit and no lower-case letter.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Word bytes of lower-cased UTF-8.  Every byte of a non-ASCII character is one, so byte runs are words.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(fold_ascii(text), NOT_WORD), "")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for an intermediate table, in the shared one of spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; on a cluster it is an error, for executors would not
    see each other's files.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/telesift-scratch"
    return f"{top}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.  The lineage ends there, and a lost executor costs nothing."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame | None) -> None:
    """Remove a table that cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Mark df for broadcast if its rows were measured to hold most_bytes or less; else leave the join to Spark."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long") + 16).alias("n")).first()["n"]
    return F.broadcast(df) if (size or 0) <= most_bytes else df


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, new: tuple[str, ...] = ()) -> DataFrame:
    """df with one more column `_row` that holds all columns but those named in new, whatever they are called.

    What an operator adds then clashes with nothing: it selects what it reads, and `_row.*` at its end.
    """
    return df.select(F.struct(*[quoted(c) for c in df.columns if c not in new]).alias("_row"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(lengths: np.ndarray, most_bytes: int):
    """Ranges [a, b) of rows that hold about most_bytes together, one row at least."""
    a, total = 0, 0
    for b, n in enumerate(lengths.tolist()):
        if b > a and total + n > most_bytes:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Texts with a line feed after each: start offsets (one more than texts), the bytes as an array, and as bytes."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    raw = b"\n".join([*texts, b""])
    return starts, np.frombuffer(raw, dtype=np.uint8), raw


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = WORD_BYTE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from its bytes alone, the same in every process."""
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    length = end - begin
    out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(-length, kind="stable")
    begin, length, acc = begin[order], length[order], out[order]
    live, at = len(begin), 0
    negative = -length
    while live:
        with np.errstate(over="ignore"):
            acc[:live] = (acc[:live] ^ data[begin[:live] + at]) * np.uint64(0x100000001B3)
        at += 1
        live = int(np.searchsorted(negative, -at, side="left")) if at < int(length[0]) else 0
    out[order] = acc
    return mix64(out)
