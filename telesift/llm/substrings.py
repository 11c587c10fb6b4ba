"""Removal of byte strings that occur earlier in the corpus: shards are suffix-sorted by external induced sorting."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .common import cut, joined, mix64, quoted, shared, slices, unused

#: Bytes of the k-grams by which windows find their shard.
GRAM = 24
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Multipliers of the hashes of whole runs.
RUN_BASE, RUN_BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


#: By base: its powers from the first on, as far as any block has needed them.
POWERS: dict[int, np.ndarray] = {}
#: A random 64-bit value for each byte, by salt.
VALUES = {salt: mix64(np.arange(256, dtype=np.uint64) + np.uint64(salt)) for salt in (1, 7, 29)}


def powers(base: int, n: int) -> np.ndarray:
    """base, base^2, ... base^n modulo 2^64."""
    if len(POWERS.get(base, ())) < n:
        with np.errstate(over="ignore"):
            POWERS[base] = np.cumprod(np.full(max(n, 1 << 20), base, dtype=np.uint64), dtype=np.uint64)
    return POWERS[base][:n]


def power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def rolled(data: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of each run of n bytes, by doubling."""
    with np.errstate(over="ignore"):
        step = VALUES[1][data]
        out, have, size = None, 0, 1
        while True:
            if n & size:
                if out is None:
                    out, have = step, size
                else:
                    m = max(0, min(len(step), len(out) - size))
                    out = step[:m] * power(base, have) + out[size : size + m]
                    have += size
            if have == n:
                return mix64(out)
            step = step[:-size] * power(base, size) + step[size:] if len(step) > size else step[:0]
            size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width and len(x) > width - size else x


def cut_runs(texts: list[bytes], length: int, k: int, hashed: bool = False) -> tuple[np.ndarray, ...]:
    """The windows of `length` bytes of texts, in runs that share the place of their least gram of k bytes.

    Arrays by run: number of the text, first byte, windows, hash of the gram, and, if hashed, two hashes of all bytes of
    the run.  Equal windows have equal grams wherever they stand.
    """
    width = length - k + 1
    starts, data, _ = joined(texts)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * (6 if hashed else 4)
    gram = rolled(data, k, BASE)
    bits = np.uint64(len(gram).bit_length())
    # the least hash, by its upper bits, and of equal ones the first
    least = sliding_min((gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64), width)
    v = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.zeros(len(v) + 2, dtype=np.int32)
    whole = np.flatnonzero(np.diff(starts) - 1 >= length)
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, starts[whole + 1] - 1 - length + 1, -1)
    valid = np.cumsum(edge)[: len(v)] > 0
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | ~valid[:-1]
    new[starts[whole]] = True
    begin = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new | ~valid), len(v))
    n = stop[np.searchsorted(stop, begin, side="right")] - begin
    hashes: list[np.ndarray] = []
    row = np.searchsorted(starts, begin, side="right") - 1
    if not hashed:
        return row, begin - starts[row], n, gram[v[begin]].view(np.int64)
    with np.errstate(over="ignore"):
        for base, salt in ((RUN_BASE, 7), (RUN_BASE_2, 29)):
            # hash of a byte range from running sums of byte * base^place
            p, q = powers(int(base), len(data)), powers(pow(int(base), -1, 1 << 64), len(data))
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(VALUES[salt][data] * p, dtype=np.uint64)])
            hashes.append(mix64((total[begin + n + length - 1] - total[begin]) * q[begin] + n.astype(np.uint64)).view(np.int64))
    return row, begin - starts[row], n, gram[v[begin]].view(np.int64), *hashes


def runs(docs: DataFrame, length: int, block: int = 1 << 20) -> DataFrame:
    """(v, doc_id, at, h, g): runs of windows of each text, v the hash of their gram, by which shards are dealt out.

    at is 256 * first byte + windows of the run, which has length - GRAM + 1 at most.  h and g are independent 64-bit
    hashes of all bytes of the run.
    """

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            ids = batch["doc_id"].to_numpy()
            for a, b in slices(np.array([len(t) for t in texts]), block):
                row, place, n, v, h, g = cut_runs(texts[a:b], length, GRAM, hashed=True)
                if len(row):
                    yield pd.DataFrame({"v": v, "doc_id": ids[a:b][row], "at": place * 256 + n, "h": h, "g": g})

    return docs.select("doc_id", "text").mapInPandas(run, "v long, doc_id long, at long, h long, g long")


def grams(docs: DataFrame, length: int, block: int = 1 << 20) -> DataFrame:
    """(v): the gram of each run, and nothing else of it."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            for a, b in slices(np.array([len(t) for t in texts]), block):
                v = cut_runs(texts[a:b], length, GRAM)[3]
                if len(v):
                    yield pd.DataFrame({"v": v})

    return docs.select("text").mapInPandas(run, "v long")


def dealt_again(pieces: DataFrame, length: int, most_bytes: int) -> DataFrame:
    """pieces (v, doc_id, at, piece) with no group of one v above most_bytes, as far as longer grams can tell.

    The pieces of a larger group are cut into runs once more, by grams of 60 and then of 90 bytes.  Equal windows have
    the same longer grams too, so they still meet.
    """
    for k in (3 * length // 5, 9 * length // 10):
        pieces = cut(pieces)
        size = pieces.groupBy("v").agg(F.sum(F.octet_length("piece")).alias("bytes")).where(F.col("bytes") > most_bytes).select("v")
        size = cut(size)
        if size.isEmpty():
            break

        def again(batches, k=k):
            for batch in batches:
                raw = [bytes(x) for x in batch["piece"]]
                row, place, n, v = cut_runs(raw, length, k)
                if len(row):
                    with np.errstate(over="ignore"):
                        old = batch["v"].to_numpy()[row].view(np.uint64)
                        key = mix64(old * BASE + v.view(np.uint64)).view(np.int64)
                    at = (batch["at"].to_numpy()[row] >> 8) + place
                    part = [raw[r][a : a + c + length - 1] for r, a, c in zip(row.tolist(), place.tolist(), n.tolist(), strict=True)]
                    yield pd.DataFrame({"v": key, "doc_id": batch["doc_id"].to_numpy()[row], "at": at * 256 + n, "piece": part})

        large = pieces.join(shared(size), "v", "left_semi").mapInPandas(again, "v long, doc_id long, at long, piece binary")
        pieces = pieces.join(shared(size), "v", "left_anti").unionByName(large)
    return pieces


class Shard:
    """Pieces of texts, one after the other with a mark after each; beyond `memory` bytes they are on disk."""

    def __init__(self, length: int, memory: int):
        self.length, self.memory, self.size = length, memory, 0
        self.raw = tempfile.SpooledTemporaryFile(max_size=memory)
        self.doc: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.count: list[np.ndarray] = []

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.size += self.raw.write(b"\n".join([*rows["piece"], b""]))
            self.doc.append(rows["doc_id"].to_numpy())
            self.place.append(rows["at"].to_numpy() >> 8)
            self.count.append(rows["at"].to_numpy() & 255)

    def late(self) -> Iterator[pd.DataFrame]:
        """(doc_id, lo, hi) of windows that are equal to an earlier one of the shard.

        The shard's suffixes are sorted with common prefixes.  Windows that share `length` bytes stand together there;
        all but the first in the corpus are late.
        """
        if not self.size:
            return
        doc, place, count = (np.concatenate(x) for x in (self.doc, self.place, self.count))
        begin = np.concatenate([[0], np.cumsum(count + self.length)[:-1]])
        text = suffixes.room(self.size + suffixes.PAD, np.uint16, self.memory)
        self.raw.seek(0)
        at = 0
        while block := self.raw.read(1 << 20):
            text[at : at + len(block)] = np.frombuffer(block, np.uint8).astype(np.uint16) + 1
            at += len(block)
        # the mark after a piece is smaller than all bytes, and no window reaches it
        text[begin + count + self.length - 1] = 0
        held: list[np.ndarray] = []
        group = 0
        for block in suffixes.suffixes(text, self.size, 257, self.length, self.length, self.memory):
            where = block >> 8
            ids = group + np.cumsum((block & 255) < self.length)
            group = int(ids[-1]) if len(ids) else group
            row = np.searchsorted(begin, where, side="right") - 1
            good = where - begin[row] < count[row]
            held.append(np.stack([ids[good], doc[row[good]], place[row[good]] + where[good] - begin[row[good]]]))
            if sum(x.shape[1] for x in held) > suffixes.BLOCK:
                x = np.concatenate(held, axis=1)
                yield self.spans(x)
                # of the group that may go on, its first window so far is enough
                x = x[:, x[0] == group]
                held = [x[:, np.lexsort((x[2], x[1]))[:1]]]
        if held:
            yield self.spans(np.concatenate(held, axis=1))

    def spans(self, x: np.ndarray) -> pd.DataFrame:
        """Late windows of whole groups (group, doc_id, place), joined where they follow each other."""
        x = x[:, np.lexsort((x[2], x[1], x[0]))]
        x = x[:, 1:][:, x[0, 1:] == x[0, :-1]]
        d, p = x[1:, np.lexsort((x[2], x[1]))]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
        end = np.append(new[1:], len(d))[: len(new)] - 1
        return pd.DataFrame({"doc_id": d[new], "lo": p[new], "hi": p[end] + self.length})


def repeated_windows(pieces: DataFrame, length: int, shard_bytes: int = 1 << 20, memory: int = 1 << 23) -> DataFrame:
    """(doc_id, lo, hi) of windows of pieces (v, doc_id, at, piece) that stand earlier in another piece of the same v.

    Pieces come sorted by v within tasks, and the groups of v are gathered to shards of some megabytes.  A group is
    never cut, so a shard may become as large as the largest group; its text, tuples and names then go to files in the
    task's own temporary folder, which no other task reads.
    """

    def run(batches):
        shard, last = Shard(length, memory), None
        for batch in batches:
            v = batch["v"].to_numpy()
            if not len(v):
                continue
            sizes = np.concatenate([[0], np.cumsum(batch["piece"].map(len).to_numpy())])
            a = 0
            for x in np.flatnonzero(np.concatenate([[last is not None and v[0] != last], v[1:] != v[:-1]])).tolist():
                if shard.size + sizes[x] - sizes[a] > shard_bytes:
                    shard.add(batch.iloc[a:x])
                    yield from shard.late()
                    shard, a = Shard(length, memory), x
            shard.add(batch.iloc[a:])
            last = v[-1]
        yield from shard.late()

    return pieces.repartition("v").sortWithinPartitions("v").mapInPandas(run, "doc_id long, lo long, hi long")


def repeats(docs: DataFrame, length: int = 100, most_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, spans): the byte ranges, joined and sorted, covered by a string of `length` bytes that starts earlier.

    docs: unique non-null doc_id, text.
    """
    if not GRAM < length <= GRAM + 254:
        raise ValueError(f"length must be {GRAM + 1} to {GRAM + 254}")
    windows_of = F.col("at").bitwiseAND(F.lit(255))
    first_of = F.shiftright("at", 8)
    occ = runs(docs, length)
    # both sides of the joins are plain shuffles, so that Spark splits the rows of a frequent gram
    again = cut(grams(docs, length).groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v"))
    occ = cut(occ.join(again, "v", "left_semi"))
    seg = occ.groupBy("v", "h", "g").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count("*").alias("c"))
    seg = cut(seg.select("v", "h", "g", F.col("f.doc_id").alias("fd"), F.col("f.at").alias("fa"), "c"))
    # all but the first of equal runs go whole; runs count as equal if 192 bits of hashes agree
    copied = seg.where("c > 1").select("v", "h", "g", "fd", "fa")
    whole = occ.join(copied, ["v", "h", "g"]).where("doc_id <> fd or at <> fa").select("doc_id", first_of.alias("lo"), (first_of + windows_of + length - 1).alias("hi"))
    # different runs of one v may share some windows: their suffixes are sorted
    several = cut(seg.groupBy("v").agg(F.count("*").alias("k")).where("k > 1").select("v"))
    asked = seg.join(several, "v", "left_semi").groupBy("fd").agg(F.collect_list(F.struct("v", F.col("fa").alias("at"))).alias("asked"))

    def pieces(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, want in zip(batch["doc_id"], batch["text"], batch["asked"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for w in want:
                    lo, n = w["at"] >> 8, w["at"] & 255
                    out.append((w["v"], doc_id, w["at"], raw[lo : lo + n + length - 1]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["v", "doc_id", "at", "piece"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["v", "doc_id", "at", "piece"])

    found = docs.join(asked, docs["doc_id"] == asked["fd"]).select("doc_id", "text", "asked").mapInPandas(pieces, "v long, doc_id long, at long, piece binary")
    partly = repeated_windows(dealt_again(found, length, most_bytes), length)
    return whole.unionByName(partly).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with kept: the bytes that stay, n_bytes, and spans: array of (lo, hi), the maximal removed byte ranges.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller doc_id,
    or before in the same one.  Strings are judged on the input, and never cross documents.  A null text is empty.
    Rows with a null doc_id, or that share a doc_id, repeated rows among them, have no place in the order: they are left
    whole, and nothing is removed because of them.  Very long texts are worked on whole, in one task.  Columns of docs
    that have one of the new names are replaced, all others stay.
    """
    new = ("kept", "n_bytes", "spans")
    kept = [quoted(c) for c in docs.columns if c not in new]
    once = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c"))
    twice = once.where("c > 1").select("doc_id")
    base = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    if not twice.isEmpty():
        base = base.join(twice, "doc_id", "left_anti")
    d_, spans_, cut_ = unused(docs, "_d", "_spans", "_cut")
    found = repeats(base, length).select(F.col("doc_id").alias(d_), F.col("spans").alias(spans_))

    @F.pandas_udf("kept binary, spans array<struct<lo:long,hi:long>>")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        left, joint = [], []
        for text, ranges in zip(texts, spans, strict=True):
            if ranges is None:
                left.append(None)
                joint.append(None)
                continue
            raw, at, out, union = text.encode("utf-8", "surrogatepass"), 0, [], []
            for s in ranges:
                if union and s["lo"] <= union[-1]["hi"]:
                    union[-1]["hi"] = max(union[-1]["hi"], s["hi"])
                else:
                    union.append({"lo": s["lo"], "hi": s["hi"]})
            for s in union:
                out.append(raw[at : s["lo"]])
                at = s["hi"]
            left.append(b"".join([*out, raw[at:]]))
            joint.append(union)
        return pd.DataFrame({"kept": left, "spans": joint})

    # the same rows as above, so that the texts that were shuffled by doc_id there serve here as well
    there = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    d = docs.select(*kept).where(there).join(found, F.col("doc_id") == F.col(d_), "left")
    rest = docs.select(*kept).where(~there).select("*", F.lit(None).cast("long").alias(d_), F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias(spans_))
    hit = F.col(spans_).isNotNull()
    d = d.unionByName(rest).withColumn(cut_, cut_out(F.when(hit, F.col("text")), spans_))
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return d.select(*kept, F.when(hit, F.col(cut_)["kept"]).otherwise(raw).alias("kept"), F.octet_length(raw).cast("long").alias("n_bytes"), F.when(hit, F.col(cut_)["spans"]).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("spans"))
