"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, cut, joined, mix64, packed, shared, slices, word_bounds, word_hashes
from .components import components

#: Words of a k-mer.
K = 3
#: Texts of up to so many words have sketches of single words as well.
SHORT = 60


def kmers(w: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each run of k words labelled with its occurrence number, in text order; a shorter text is one run."""
    if not len(w):
        return np.zeros(0, dtype=np.uint64)
    k = min(k, len(w))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - k + 1, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
        h = mix64(h)
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        at = np.flatnonzero(new)
        nth = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
        label = np.zeros(len(s), dtype=np.uint64)
        label[order] = nth.astype(np.uint64)
        h = mix64(h + label * np.uint64(0xD1B54A32D192ED03))
    return h


def sketches(h: np.ndarray, count: int, picks: int) -> np.ndarray:
    """`count` Order MinHashes: of each random order, the `picks` least labelled k-mers, combined in text order."""
    seeds = mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.zeros(count, dtype=np.uint64)
    step = max(1, (1 << 21) // max(len(h), 1))
    picks = min(picks, len(h))
    with np.errstate(over="ignore"):
        for a in range(0, count, step):
            s = seeds[a : a + step, None]
            x = (h[None, :] ^ (s >> np.uint64(7))) * s
            x ^= x >> np.uint64(29)
            least = np.sort(np.argpartition(x, picks - 1, axis=1)[:, :picks], axis=1) if picks < len(h) else np.broadcast_to(np.arange(len(h)), x.shape)
            for i in range(picks):
                out[a : a + step] = mix64(out[a : a + step] * np.uint64(0x9E3779B97F4A7C15) + h[least[:, i]] + np.uint64(i))
    return out


def signature(w: np.ndarray, count: int, picks: int) -> np.ndarray:
    """The sketches of a text: `count` of k-mers of K words; for a short text, where few edits hit every k-mer, half as many of single words after them."""
    if not len(w):
        return np.zeros(0, dtype=np.uint64)
    out = sketches(kmers(w, K), count, picks)
    return np.concatenate([out, sketches(kmers(w, 1), count // 2, picks + 1)]) if len(w) <= SHORT else out


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1.

    Equal ends are cut off, then a bound by common words may end it.  What is left is aligned within the band of
    `most` diagonals on either side: one row of the band is a pair of bit vectors (Hyyro 2003) that moves along the
    main diagonal, so a row costs a few operations on integers of 2 * most + 1 bits.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    low = min(n, m)
    diff = np.flatnonzero(a[:low] != b[:low])
    head = int(diff[0]) if len(diff) else low
    a, b = a[head:], b[head:]
    low = min(len(a), len(b))
    diff = np.flatnonzero(a[len(a) - low :][::-1] != b[len(b) - low :][::-1])
    tail = int(diff[0]) if len(diff) else low
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not m:
        return n if n <= most else most + 1
    x, y = a.tolist(), b.tolist()
    # an alignment keeps at most the words that both have
    if n - sum((Counter(x) & Counter(y)).values()) > most:
        return most + 1
    most_here = min(most, n)
    if not most_here:
        return most + 1
    places: dict[int, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    # bit j of a vector is the cell of diagonal j - most; words of x enter the band at its upper end
    width = 2 * most_here + 1
    full = (1 << width) - 1
    up, down = full << most_here & full, 0
    middle, edge = 1 << (width - 1), 1 << (width - 2)
    # the band starts above the matrix: its last bit is row `most`, reached from the first column by that many edits
    dist = most_here
    stop = n - most_here
    for j, w in enumerate(y):
        at = places.get(w, 0)
        shift = j - most_here
        here = (at >> shift if shift >= 0 else at << -shift) & full
        # cells above the matrix match nothing
        zero = ((((here & up) + up) ^ up) | here | down) & full
        plus = down | (~(zero | up) & full)
        minus = zero & up
        if j < stop:
            dist += not zero & middle
        else:
            dist += bool(plus & edge) - bool(minus & edge)
            edge >>= 1
        # each column of the last row takes one edit back at most
        if dist - (m - max(stop, j + 1)) > most:
            return most + 1
        up = minus | (~((zero >> 1) | plus) & full)
        down = (zero >> 1) & plus
    return dist if dist <= most else most + 1


def hashed_words(docs: DataFrame, schema: str, make, block: int = 4 << 20) -> DataFrame:
    """make(doc_id, 64-bit word hashes) for each text; A-Z case and what is between words do not count."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace").translate(FOLD) for t in batch["text"]]
            ids = batch["doc_id"].to_numpy()
            for a, b in slices(np.array([len(t) for t in texts]), block):
                starts, data, _ = joined(texts[a:b])
                begin, end = word_bounds(data)
                w = word_hashes(data, begin, end)
                first = np.searchsorted(begin, starts)
                yield pd.DataFrame([make(ids[a + i], w[first[i] : first[i + 1]]) for i in range(b - a)], columns=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def sketch_table(docs: DataFrame, count: int, picks: int) -> DataFrame:
    """(doc_id, key: a digest of all words, sketch).  Only this leaves the scan, not the texts."""

    def make(doc_id, w):
        return doc_id, hashlib.blake2b(w.tobytes(), digest_size=16).digest(), signature(w, count, picks).astype(np.int64)

    return hashed_words(docs, "doc_id long, key binary, sketch array<long>", make)


def word_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, words): the digest, and 32-bit word hashes as bytes, for alignment."""

    def make(doc_id, w):
        return doc_id, hashlib.blake2b(w.tobytes(), digest_size=16).digest(), (w >> np.uint64(16)).astype("<u4").tobytes()

    return hashed_words(docs, "doc_id long, key binary, words binary", make)


def alike(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance is at most `most`: by the alignment with one gap if that suffices, else by the band."""
    if len(a) < len(b):
        a, b = b, a
    gap = len(a) - len(b)
    if gap > most:
        return False
    before = np.concatenate([[0], np.cumsum(a[: len(b)] != b)])
    after = np.concatenate([[0], np.cumsum(a[gap:] != b)])
    return bool(gap + (before + after[-1] - after).min() <= most) or edits_within(a, b, most) <= most


def verify(pairs: DataFrame, text: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those of edit similarity `similarity` or more: 1 - edits / words of the longer."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch["wa"], batch["wb"], strict=True):
                u, v = np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4")
                good.append(alike(u, v, int((1 - similarity) * max(len(u), len(v)) + 1e-9)))
            yield batch[["a", "b"]][good]

    left = text.select(F.col("rep").alias("a"), F.col("words").alias("wa"))
    right = text.select(F.col("rep").alias("b"), F.col("words").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInPandas(run, "a long, b long")


def across(large: DataFrame, classes: DataFrame, text: DataFrame, sketch: DataFrame, similarity: float, block: int = 1000, block_bytes: int = 32 << 20) -> DataFrame:
    """Links (a, b) that join the classes which meet in a bucket, so that no further link within a bucket would join two.

    large is (bucket, rep, i: the sketch of the bucket), classes (id, component) what is known.  Buckets within one class
    are left out.  The members of each other one are dealt into blocks, and each pair of blocks is a group of its own,
    in which every pair of members is compared that no earlier sketch brings together and whose classes are still apart.
    Before the alignment, pairs are ruled out by length and by an upper bound of their common words.
    """
    # one row a document, with its buckets, learns the class
    named = large.groupBy("rep").agg(F.collect_list(F.struct("bucket", "i")).alias("at")).join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = cut(named.select("rep", F.coalesce("component", "rep").alias("class"), F.inline("at")))
    mixed = named.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("bucket")
    rows = cut(named.join(mixed, "bucket"))
    size = rows.join(text.select("rep", F.octet_length("words").alias("bytes")), "rep").groupBy("bucket")
    size = size.agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("nb"))
    rows = rows.join(size, "bucket").withColumn("blk", F.pmod(F.xxhash64("rep", "bucket"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.join(text, "rep").join(sketch, "rep")
    rows = rows.select("bucket", F.least("blk", "o").alias("p"), F.greatest("blk", "o").alias("q"), "blk", "i", "rep", "class", "words", F.slice("sketch", F.lit(1), F.col("i")).alias("before"))

    def tile(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rep")
        ids, blk, label = g["rep"].to_numpy(), g["blk"].to_numpy(), np.unique(g["class"], return_inverse=True)[1]
        lower, upper = g["p"].iloc[0], g["q"].iloc[0]
        before = np.array([np.asarray(x, dtype=np.int64) for x in g["before"]]).reshape(len(g), -1)
        words = [np.frombuffer(x, dtype="<u4") for x in g["words"]]
        length = np.array([len(w) for w in words])
        most = ((1 - similarity) * length + 1e-9).astype(np.int64)
        # words counted by a small hash: two texts have no more words in common than the counts have
        counts = np.stack([np.bincount(w % 2048, minlength=2048) for w in words]).astype(np.int32)
        left = np.flatnonzero(blk == lower)
        right = np.flatnonzero(blk == upper)
        out = []
        for r in left:
            c = right[right > r] if lower == upper else right
            c = c[label[c] != label[r]]
            longer = np.maximum(length[c], length[r])
            c = c[longer - np.minimum(length[c], length[r]) <= np.maximum(most[c], most[r])]
            c = c[~(before[c] == before[r]).any(axis=1)]
            if not len(c):
                continue
            common = np.concatenate([np.minimum(counts[c[a : a + 500]], counts[r]).sum(axis=1) for a in range(0, len(c), 500)])
            may = np.maximum(length[c], length[r]) - common <= np.maximum(most[c], most[r])
            for x in c[may][np.argsort(-common[may], kind="stable")]:
                if label[x] != label[r] and alike(words[r], words[x], int(max(most[r], most[x]))):
                    out.append((min(ids[r], ids[x]), max(ids[r], ids[x])))
                    label[label == label[x]] = label[r]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return rows.groupBy("bucket", "p", "q").applyInPandas(tile, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, count: int = 40, picks: int = 2, few_members: int = 40) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of the near-duplicate class of each document.

    1. Documents whose words are the same are one class; its smallest doc_id stands for it in what follows.
    2. Documents that share one of `count` Order MinHashes (of `picks` labelled k-mers of three words; short texts have
       more, of single words) are candidates.
       In a bucket of up to `few_members` documents every pair is compared.  In a larger one, which is mostly a group of
       near copies, the member in the middle (its buckets hold the most documents) is compared with all others.  Then
       the large buckets whose members are not one class by now are finished by blocks: every pair is compared whose
       classes are still apart (see across).  So the classes are those that comparing all candidates would give.
    3. A candidate pair is linked if a banded alignment of its words finds an edit similarity of `similarity` or more.
    4. Classes are the connected components of the links.

    Null and empty texts have no words: all of them are one class.  Texts of fewer than three words are one k-mer.  Rows
    that share a doc_id share a class; if their texts differ, the links of each of them count.  Very long texts are
    sketched and aligned whole.  Rows with a null doc_id are not judged: they come back with a null class.
    """
    all_rows = docs.where("doc_id is not null")
    rows = cut(sketch_table(all_rows, count, picks))
    # rep numbers the different texts: one doc_id may have several
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "sketch")).alias("f")).select("key", F.col("f.doc_id").alias("doc_id"), F.col("f.sketch").alias("sketch"))
    first = cut(first.withColumn("rep", F.monotonically_increasing_id()))
    copies = rows.select("doc_id", "key").join(first.select("key", F.col("doc_id").alias("b")), "key").select(F.col("doc_id").alias("a"), "b")
    bucket = first.select("rep", F.posexplode("sketch").alias("i", "s")).select(F.xxhash64("i", "s").alias("bucket"), "rep", "i")
    # the middle of a group shares the most buckets with the most others
    weight = bucket.join(bucket.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "bucket").groupBy("rep").agg(F.sum("c").alias("weight"))
    bucket = cut(bucket.join(weight, "rep"))
    middle = F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("head")
    size = bucket.groupBy("bucket").agg(F.count("*").alias("c"), middle).where("c > 1")
    members = cut(bucket.join(size, "bucket"))
    # the texts are read again, but only those of documents that share a bucket with another
    named = cut(first.select("rep", "key", "doc_id").join(members.select("rep").distinct(), "rep"))
    wanted = all_rows.join(shared(cut(named.select(F.col("doc_id").alias("_w")).distinct())), F.col("doc_id") == F.col("_w"), "left_semi")
    text = cut(word_table(wanted).join(named.select("key", "rep"), "key").groupBy("rep").agg(F.min("words").alias("words")))
    few = members.where(F.col("c") <= few_members).select("bucket", F.col("rep").alias("b"))
    pairs = few.join(few.withColumnRenamed("b", "a"), "bucket").where("a < b").select("a", "b")
    many = members.where(F.col("c") > few_members)
    pairs = pairs.unionByName(many.where("rep <> head").select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b")))
    good = cut(verify(cut(pairs.distinct()), text, similarity))
    sketch = first.select("rep", "sketch")
    more = cut(across(many.select("bucket", "rep", "i"), components(good), text, sketch, similarity))
    ids = named.select(F.col("rep").alias("a"), F.col("doc_id").alias("da")), named.select(F.col("rep").alias("b"), F.col("doc_id").alias("db"))
    links = good.unionByName(more).join(ids[0], "a").join(ids[1], "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    classes = components(copies.unionByName(links)).select(F.col("id").alias("_id"), "component")
    out = docs.select("doc_id").distinct().join(classes, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without near duplicates: of each class the document with the smallest doc_id, with all rows that have it.

    Null, empty and wordless texts are one class, so one document of them stays.  Rows with a null doc_id are not judged
    and stay.  Rows that share a doc_id stay or go together.  All columns stay, whatever their names.
    """
    away = near_duplicates(docs.select("doc_id", "text"), similarity).where("class_id <> doc_id").select(F.col("doc_id").alias("_d"))
    return packed(docs).join(away, F.col("_row.doc_id") == F.col("_d"), "left_anti").select("_row.*")
