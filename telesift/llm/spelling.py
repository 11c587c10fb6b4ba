"""Spelling variants: words one edit apart, found in a positional q-gram index, grouped under their frequent forms."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import merge
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, cut, drop, shared

RUN = re.compile("[a-zÀ-ÿ]+")
#: Gram counts are kept by hash in so many slots, whatever the alphabet.
SLOTS = 1 << 18
#: Words of one key that a task indexes at once.
MOST = 4096


def word_counts(docs: DataFrame, noise: int = 97, least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of the texts of docs (doc_id, text) with least_length code points and `least` occurrences.

    A run of letters in a document loses the code point h % length if noise divides h, the crc32 of
    `<doc_id>:<lower-cased run>`.  Null texts have no runs, a null doc_id counts as an empty one.  Texts are read whole;
    a task holds the counts of 200,000 words at most and adds them up with those of others in a shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        seen: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text is None:
                    continue
                start = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(RUN.findall(text.translate(FOLD).decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        seen[word] += n
                if len(seen) >= 200_000:
                    yield flush()
        yield flush()

    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is replaced, or one inserted into a, to make b of it."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return len(b) == n + 1 and a[i:] == b[i + 1 :] or len(b) == n and i < n and a[i + 1 :] == b[i + 1 :]


def grams(word: str, q: int) -> list[str]:
    """The q-grams of the padded word; the place in the list is the position.  Words of n code points have n + q - 1."""
    full = "\0" * (q - 1) + word + "\1" * (q - 1)
    return [full[i : i + q] for i in range(len(word) + q - 1)]


def slot(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % SLOTS


def key(gram: str, length: int, position: int) -> int:
    """A list of the distributed index: words of that length with the gram at that position.

    32 bits; lists that meet in one key cost time, not results.
    """
    return zlib.crc32(b"%d,%d," % (length, position) + gram.encode("utf-8", "surrogatepass"))


class Index:
    """The words of one key by gram and position, as ascending lists of word numbers."""

    def __init__(self, words: list[str], q: int):
        self.words, self.q = words, q
        self.lists: dict[tuple[str, int], list[int]] = {}
        self.either: dict[tuple[str, int], list[int]] = {}
        for i, word in enumerate(words):
            for at in zip(grams(word, q), range(len(word) + q - 1), strict=True):
                self.lists.setdefault(at, []).append(i)

    def at_or_behind(self, gram: str, position: int) -> list[int] | None:
        """Words with the gram at the position or the next one."""
        here, behind = self.lists.get((gram, position)), self.lists.get((gram, position + 1))
        if not here or not behind:
            return here or behind
        if (gram, position) not in self.either:
            self.either[gram, position] = sorted({*here, *behind})
        return self.either[gram, position]

    def near(self, word: str, longer: int) -> Iterator[str]:
        """Words of the index one edit from word: as long as it, or by one code point longer.

        Such words share all grams of the longer one but q, at positions that differ by 0 or, behind an insertion, 1.  So
        they stand in `need` of the lists of word's grams, and in one at least of any (number of grams - need + 1): the
        shortest of them are merged by a heap, the others are only probed.
        """
        mine = grams(word, self.q)
        need = len(word) + longer - 1
        few = len(mine) - need + 1
        lists, get = [], self.at_or_behind if longer else lambda g, at: self.lists.get((g, at))
        for at, g in enumerate(mine):
            if x := get(g, at):
                lists.append(x)
            elif at - len(lists) + 1 == few:
                return
        lists.sort(key=len)
        few -= len(mine) - len(lists)
        rest = lists[few:]
        for i, hits in groupby(merge(*lists[:few]) if few > 1 else lists[0]):
            n = len(list(hits)) if few > 1 else 1
            spare = n + len(rest) - need
            for x in rest:
                if spare < 0 or n >= need:
                    break
                at = bisect_left(x, i)
                if at < len(x) and x[at] == i:
                    n += 1
                else:
                    spare -= 1
            if n >= need and one_edit(word, self.words[i]):
                yield self.words[i]


def prefixes(counts: np.ndarray, q: int) -> Callable[[str], tuple[list[int], list[int]]]:
    """A function of a word: the keys of its rarest grams under which it is indexed, and those it looks up for words that
    are longer by one code point.

    Of two words that share all but q grams of the longer one, the first shared gram in order of rarity is among the
    q + 1 first of the longer word and the q first of the shorter, or q + 1 for equal lengths.
    """
    rarity: dict[str, tuple[int, str]] = {}

    def rare(gram: str) -> tuple[int, str]:
        if len(rarity) > 200_000:
            rarity.clear()
        if gram not in rarity:
            rarity[gram] = int(counts[slot(gram)]), gram
        return rarity[gram]

    @lru_cache(maxsize=50_000)
    def keys(word: str) -> tuple[list[int], list[int]]:
        first = sorted(((rare(g), p) for p, g in enumerate(grams(word, q))))[: q + 1]
        n = len(word)
        return [key(g, n, p) for (_, g), p in first], [key(g, n + 1, p + s) for (_, g), p in first[:q] for s in (0, 1)]

    return keys


def gram_counts(words: DataFrame, q: int) -> np.ndarray:
    """Grams of all words by slot; tasks send sums for at most SLOTS slots, and so does the last shuffle."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount([slot(g) for w in batch.column(0).to_pylist() for g in grams(w, q)], minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    got = words.select("word").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def near_pairs(words: DataFrame, q: int = 3, most: int = MOST) -> DataFrame:
    """(word, other, n): each two words of `words` (word, n) that are one edit apart, both ways, with n of the other.

    Each word is indexed under the keys (gram, length, position) of its q + 1 rarest grams, and looks itself up under
    these and under those of words longer by one.  Rows of a key meet in one task, sorted, so that it holds the words of
    one key at a time; keys with more than `most` words are dealt out in blocks, and lookups go to all blocks.  A pair is
    reported under the smallest key that both have.  No pair of two words that share a key is made but those which stand
    in one of the merged lists.
    """
    words = words.where(F.char_length("word") >= 2)
    counts = gram_counts(words, q)

    def post(batches):
        keys = prefixes(counts, q)
        for batch in batches:
            out: list[tuple[int, bool, str, int]] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, longer = keys(word)
                out += [(k, False, word, n) for k in sorted(set(own))] + [(k, True, word, n) for k in sorted(set(longer))]
            k, ask, w, n = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64()), "ask": pa.array(ask, pa.bool_()), "word": pa.array(w, pa.string()), "n": pa.array(n, pa.int64())})

    rows = cut(words.select("word", "n").mapInArrow(post, "k long, ask boolean, word string, n long"))
    large = rows.where("not ask").groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > most).select("k", F.ceil(F.col("c") / most).cast("int").alias("blocks"))
    dealt = rows.join(shared(large), "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.select("k", "ask", "word", "n", F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # a word stands in a block of its own and asks in the others
    dealt = dealt.select("k", "block", F.col("ask").alias("longer"), (F.col("ask") | (F.col("own") != F.col("block"))).alias("ask"), "word", "n")
    met = dealt.repartition("k", "block").sortWithinPartitions("k", "block", "ask", "word")

    def find(batches):
        keys = prefixes(counts, q)

        def stream():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple[str, str, int]] = []
        for (k, _), group in groupby(stream(), key=itemgetter(0, 1)):
            index, held, asked = None, {}, []
            for _, _, longer, ask, word, n in group:
                if not ask:
                    held[word] = n
                    asked.append((word, n))
                    continue
                if not held:
                    continue
                if index is None:
                    index = Index(list(held), q)
                found(index, held, keys, k, word, n, longer, out)
                if len(out) >= 20_000:
                    yield pairs(out)
            if len(asked) > 1:
                index = index or Index(list(held), q)
                for word, n in asked:
                    found(index, held, keys, k, word, n, False, out)
                    if len(out) >= 20_000:
                        yield pairs(out)
        yield pairs(out)

    def found(index, held, keys, k, word, n, longer, out):
        for other in index.near(word, int(longer)):
            # of two words of one length the smaller asks
            if (longer or word < other) and min(set(keys(word)[longer]) & set(keys(other)[0])) == k:
                out += [(word, other, held[other]), (other, word, n)]

    def pairs(out):
        w, o, n = zip(*out, strict=True) if out else ((),) * 3
        batch = pa.RecordBatch.from_pydict({"word": pa.array(w, pa.string()), "other": pa.array(o, pa.string()), "n": pa.array(n, pa.int64())})
        out.clear()
        return batch

    return met.mapInArrow(find, "word string, other string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last word that is reached, by doubling the steps until none goes on."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = cut(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_went")))
        drop(now)
        if not new.where("_went").limit(1).count():
            return new.select("word", "root")
        now = new


def variants(words: DataFrame, q: int = 3, ratio: float = 2, most: int = MOST) -> DataFrame:
    """words (word, n; no word twice) with form, root, n_near and form_n.

    n_near counts the words one edit apart.  form is the one of largest n (ties: the smallest), if that is ratio times
    the word's own n or more; else form and form_n are null.  root: from the word, forms are followed to the last.  As n
    grows by ratio > 1 with each step, no chain is a circle.  An empty table gives no rows; long words are used whole;
    words of less than two code points, which may share no gram with their neighbours, are compared with none; rows with a
    null word are left out.
    """
    words = cut(words.where("word is not null").select("word", "n"))
    best = near_pairs(words, q, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("_best"))
    close = F.col("_best.n") * -1 >= F.col("n") * ratio
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(close, F.col("_best.other")).alias("form"), F.when(close, -F.col("_best.n")).alias("form_n"))
    out = cut(out)
    drop(words)
    ends = roots(out.where("form is not null").select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
