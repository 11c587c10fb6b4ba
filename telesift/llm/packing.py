"""Lexical retrieval packing: windows of tokens filled with the documents that BM25 finds nearest to a first one."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, mix64

#: Pre-tokens of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: BM25.
K1, B = 1.2, 0.75
PIECE = "uid long, doc_id long, start long, length long, doc_tokens long, ids binary"
DONE = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts by the tokenizer file at path, without special tokens added.

    A plain byte-level BPE whose merges come in the order of their ids gives the same ids by rank, and is run that way,
    which is faster by far; texts that hold an added token, and all other tokenizers, go through the file's own library.
    """
    from tokenizers import Tokenizer

    whole: list[Tokenizer] = []
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})

    def slow(texts: list[str]) -> list[list[int]]:
        own = whole[0] if whole else whole.append(Tokenizer.from_file(path)) or whole[0]
        return [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]

    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return slow
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(set(made)) or len(made) + 256 != len(vocab):
        return slow
    import tiktoken

    of = byte_of()
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items()}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow([t])[0] if any(a in t for a in added) else fast.encode_ordinary(t) for t in texts]

    return encode


def pieces(docs: DataFrame, tokenizer: str, window: int, end: int) -> DataFrame:
    """(uid, doc_id, start, length, doc_tokens, ids): the windows that documents fill by themselves, and what is left.

    ids are narrow(): read them with ids_of().  uid is a number of the piece, by task and order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(keys, texts, strict=True):
                ids = np.array(array("I", encode([(text or b"").decode("utf-8", "replace")])[0] + [end]), dtype="<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((uid, doc, at, len(part), len(ids), narrow(part)))
                    uid += 1
                held += len(ids)
                if held > 2_000_000:
                    yield table(rows, PIECE)
                    rows, held = [], 0
            if rows:
                yield table(rows, PIECE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def narrow(ids: np.ndarray) -> bytes:
    """ids as little-endian unsigned integers of 16 bits where that is enough, else of 32."""
    return (ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids).tobytes()


def ids_of(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, "<u2").astype("<u4") if len(data) == 2 * length else np.frombuffer(data, "<u4")


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_pydict({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


class Stats(NamedTuple):
    """Of all pieces in the index: their number, mean length, and how many hold each id.  Its size is the vocabulary's."""

    n: int
    mean: float
    held: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.held + 0.5) / (self.held + 0.5))


def statistics(rest: DataFrame) -> Stats:
    """Counts over all pieces of rest; tasks send sums by id, and the last shuffle a row for each id that occurs."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.unique(ids_of(ids, length))
                if own[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(own[-1]) + 1 - len(total), np.int64)])
                total[own] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    got = rest.select("ids", "length").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    size = rest.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    held = np.zeros(int(max(got.column("id").to_pylist(), default=0)) + 1, np.int64)
    held[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return Stats(size["n"], size["mean"] or 1.0, held)


def sketched(rest: DataFrame, stats: Stats) -> DataFrame:
    """rest with a column `sketch`: of the ids of a piece the one of least hash, with rare ids the likelier to be it.

    (-log of a random number / weight: pieces have equal sketches with the weighted Jaccard similarity of their ids.)
    """
    weights = stats.idf()
    with np.errstate(over="ignore"):
        random = mix64(np.arange(1, len(weights) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rank = -np.log((random.astype(np.float64) + 1) / 2**64) / weights

    def run(batches):
        for batch in batches:
            out = []
            for ids, length in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ids", "length")), strict=True):
                own = ids_of(ids, length)
                out.append(int(own[rank[own].argmin()]))
            yield batch.append_column("sketch", pa.array(out, pa.int64()))

    return rest.mapInArrow(run, f"{PIECE}, sketch long")


class Shard:
    """A BM25 inverted index of pieces, from which pieces are taken until none is left."""

    def __init__(self, ids: list[np.ndarray], stats: Stats, idf: np.ndarray):
        self.left = np.array([len(x) for x in ids], np.int64)
        self.terms, self.tf = zip(*(np.unique(x, return_counts=True) for x in ids), strict=True)
        term = np.concatenate(self.terms)
        doc = np.repeat(np.arange(len(ids)), [len(t) for t in self.terms])
        tf = np.concatenate(self.tf)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.left[doc] / stats.mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.bounds = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def compact(self) -> None:
        """Without the postings of used pieces."""
        kept = self.left[self.doc] > 0
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])
        self.doc, self.weight, self.bounds = self.doc[kept], self.weight[kept], before[self.bounds]

    def ranked(self, seed: int) -> np.ndarray:
        """The unused pieces but the seed, nearest first; of equal scores the first piece."""
        terms = self.terms[seed]
        lo, hi = self.bounds[terms], self.bounds[terms + 1]
        n = hi - lo
        at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        scores = np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.left))
        free = np.flatnonzero(self.left > 0)
        free = free[free != seed]
        return free[np.argsort(-scores[free], kind="stable")]

    def windows(self, window: int, last: bool) -> Iterator[list[tuple[int, int]]]:
        """Windows as (piece, tokens) in order.  Seeds are the unused pieces, in order.

        Neighbours are taken whole while they fit; the room that is left is filled by the first tokens of the nearest one
        that remains, which stays in the index with its rest.  Only a window for which all pieces do not suffice is
        short: it is made if `last`, else its pieces are left for the next shard.
        """
        indexed = len(self.left)
        for seed in range(len(self.left)):
            if (unused := int((self.left > 0).sum())) < 0.75 * indexed:
                self.compact()
                indexed = unused
            while self.left[seed] > 0:
                if not last and self.left.sum() < window:
                    return
                room = window - int(self.left[seed])
                took = [(seed, int(self.left[seed]))]
                if room:
                    near = self.ranked(seed)
                    sizes = self.left[near]
                    least = sizes.min(initial=window)
                    split = None
                    for i, n in zip(near.tolist(), sizes.tolist(), strict=True):
                        if n <= room:
                            took.append((i, n))
                            room -= n
                        elif split is None:
                            split = i
                        if room < least and (split is not None or not room):
                            break
                    if room and split is not None:
                        took.append((split, room))
                yield took
                for i, n in took:
                    self.left[i] -= n


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end: int = 0, shard: int = 1024) -> DataFrame:
    """The pieces of the texts of docs (doc_id, text) in sequences of `window` tokens: doc_id, start, length, doc_tokens,
    ids (little-endian unsigned 32-bit integers), sequence_id and offset (its place there, from 0 on without gaps).

    A document's tokens are its ids and `end`.  Documents fill as many windows as they can by themselves; the rest of
    each, shorter than a window, is a piece to be packed.  Pieces are sorted by a sketch of their ids, so that those with
    rare ids in common stand together, and `shard` neighbours in that order make one BM25 index, with the frequencies of
    ids and the mean length of all pieces.  What a shard can't fill a window with goes on to the next of the same task,
    so each task has one short sequence at most.  A task holds one shard at a time.  A sketch that very many pieces have is
    divided among tasks like any other stretch of the order.

    Null and empty texts are one token, `end`.  A null doc_id stays null, repeated rows are packed each for itself, an
    empty table gives no pieces, and long texts are used whole.  Other columns of docs are not read.
    """
    every = cut(pieces(docs, tokenizer, window, end))
    rest = every.where(F.col("length") < window)
    stats = statistics(rest)
    idf = stats.idf()
    near = cut(sketched(rest, stats))

    def run(batches):
        number = TaskContext.get().partitionId() << 33

        def packed(rows: list[tuple], last: bool) -> list[tuple]:
            """Rows of DONE; rows is left with what is to be packed with the next shard."""
            nonlocal number
            index = Shard([r[4] for r in rows], stats, idf)
            used, out = np.zeros(len(rows), np.int64), []
            for took in index.windows(window, last):
                offset = 0
                for i, n in took:
                    doc, start, _, total, ids = rows[i]
                    at = int(used[i])
                    out.append((doc, start + at, n, total, ids[at : at + n].tobytes(), 2 * number, offset))
                    used[i] += n
                    offset += n
                number += 1
            rows[:] = [(doc, start + int(u), length - int(u), total, ids[int(u) :]) for (doc, start, length, total, ids), u in zip(rows, used, strict=True) if u < length]
            return out

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, start, length, total, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids")), strict=True):
                rows.append((doc, start, length, total, ids_of(ids, length)))
                held += length
                if len(rows) >= shard and held >= window:
                    yield table(packed(rows, False), DONE)
                    held = sum(r[2] for r in rows)
        if rows:
            yield table(packed(rows, True), DONE)

    order = near.repartitionByRange("sketch", "uid").sortWithinPartitions("sketch", "uid").drop("sketch", "uid")

    def alone(batches):
        for batch in batches:
            wide = [ids_of(x, window).tobytes() for x in batch.column(4).to_pylist()]
            yield batch.set_column(4, "ids", pa.array(wide, pa.binary()))

    full = every.where(F.col("length") == window).select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return order.mapInArrow(run, DONE).unionByName(full.mapInArrow(alone, DONE))
