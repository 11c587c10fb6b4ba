"""Line dedup: overlapping documents are aligned pairwise, and what they share goes from the later one."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, shared

#: What is cut from the ends of a line before it is compared.
BLANK = " \t\r\f\v\u00a0\u3000"


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, in which the second increases (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two lists: equal ends, then lines that occur once in both, then the same between those."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once: dict = {}
        for x in range(i, j):
            once[a[x]] = -1 if a[x] in once else x
        there: dict = {}
        for y in range(k, m):
            there[b[y]] = -1 if b[y] in there else y
        anchors = increasing(sorted((x, there[h]) for h, x in once.items() if x >= 0 and there.get(h, -1) >= 0))
        if not anchors:
            continue
        left, right = i, k
        for x, y in anchors:
            out.append((x, y))
            todo.append((left, x, right, y))
            left, right = x + 1, y + 1
        todo.append((left, j, right, m))
    return sorted(out)


def least_runs(lines: list, words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the shortest runs of lines with `least` words: from each line on, and up to each line."""
    out = []
    for step in (1, -1):
        for i in range(len(lines)):
            j, total = i, 0
            while 0 <= j < len(lines) and total < least:
                total += words[j]
                j += step
            if total >= least:
                out.append((i, j) if step > 0 else (j + 1, i + 1))
    return out


def common_runs(a: list, b: list, words: list[int], least: int) -> set[int]:
    """Places in b that lie in runs of lines which stand in a as well, consecutive in both, with `least` words or more.

    Each such run consists of least_runs() of its own lines, so it is enough to look these up; they have `least` lines at
    most, and the time grows with the number of lines, however often they repeat.
    """
    weight = dict(zip(b, words, strict=True))
    # lines that b lacks end a run: they stand apart, with a weight that nothing in b has
    there = {tuple(a[i:j]) for i, j in least_runs(a, [weight.get(x, least) for x in a], least)}
    out: set[int] = set()
    for i, j in least_runs(b, words, least):
        if tuple(b[i:j]) in there:
            out.update(range(i, j))
    return out


def shared_lines(a: list, b: list, words: list[int], least: int) -> list[int]:
    """Places in b of the lines that are deleted: blocks of `least` words or more that are aligned with a.

    The patience diff aligns what stands in the same order in both.  What it leaves, blocks in another order and blocks
    of lines that are not unique, is aligned with any equal run of a.
    """
    out: set[int] = set()
    run: list[tuple[int, int]] = []
    for x, y in [*patience(a, b), (-9, -9)]:
        if run and (x, y) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[v] for _, v in run) >= least:
                out.update(v for _, v in run)
            run = []
        run.append((x, y))
    if len(out) < len(b):
        out |= common_runs(a, b, words, least)
    return sorted(out)


def windows(h: Column, n: Column, least_words: int) -> Column:
    """Hashes of the shortest runs of consecutive lines with least_words words: from each line on, and up to each line.

    h, n: hashes and word counts of the lines.  A block of least_words words is covered by such runs of its own lines.
    """

    def run(step: int, i: Column) -> Column:
        """The run that starts (step 1) or ends (step -1) at line i; every line has a word at least."""
        total, out = F.lit(0), []
        for k in range(least_words):
            total = total + F.get(n, i + step * k)
            out.append((total >= least_words, k + 1))
        found = F.lit(None).cast("long")
        for enough, size in reversed(out):
            first = i if step > 0 else i - (size - 1)
            found = F.when(enough, F.xxhash64(F.slice(h, first + 1, size))).otherwise(found)
        return found

    # a run of one line is found from its line on
    ends = F.transform(n, lambda c, i: F.when(c < least_words, run(-1, i)))
    both = F.concat(F.transform(n, lambda c, i: run(1, i)), ends)
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull()))


def removals(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """(doc_id, lines): the places of the lines to delete from each document, blank lines not counted.

    Documents overlap if they share a run of consecutive lines with least_words words, the least that may be removed.
    The first document with a run (smallest doc_id) owns it, so a run that n documents share makes n - 1 pairs, never
    n * n, and none is left out for how frequent it is.  Each block that two documents share consists of such runs, and
    each of them has an owner that is no later than the earlier of the two.  Pairs of an owner and a later document are
    aligned by patience diff on the hashes of all their lines, which are a small part of the texts.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    hashes = F.transform(lines, lambda x: F.unhex(F.substring(F.md5(x), 1, 24)))
    per_doc = docs.where("doc_id is not null and text is not null").select("doc_id", hashes.alias("h"), F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("n"))
    twice = per_doc.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    per_doc = cut(per_doc.join(shared(twice), "doc_id", "left_anti"))
    seen = per_doc.select("doc_id", F.explode(windows(F.col("h"), F.col("n"), least_words)).alias("w"))
    # both sides of the joins are plain shuffles, so that Spark splits the rows of a frequent run or of one owner
    owners = cut(seen.groupBy("w").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("w", "owner"))
    pairs = cut(seen.join(owners, "w").where("owner < doc_id").select("owner", "doc_id").distinct())
    first = per_doc.select(F.col("doc_id").alias("owner"), F.col("h").alias("a"))
    both = pairs.join(first, "owner").join(per_doc.select("doc_id", F.col("h").alias("b"), "n"), "doc_id").select("doc_id", "a", "b", "n")

    def align(batches):
        for batch in batches:
            found = []
            for a, b, n in zip(batch["a"], batch["b"], batch["n"], strict=True):
                found.append(shared_lines([bytes(x) for x in a], [bytes(x) for x in b], list(n), least_words))
            out = pd.DataFrame({"doc_id": batch["doc_id"], "line": found})
            yield out[out["line"].map(len) > 0]

    got = both.mapInPandas(align, "doc_id long, line array<int>").select("doc_id", F.explode("line").alias("line"))
    return got.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """docs with text cut down, n_lines and n_removed (lines that are not blank).

    Deletes from the later of two overlapping documents every common block of `least_words` words or more: lines that are
    consecutive in both, wherever they stand and however often.
    The first document keeps its lines, so each text stays somewhere; a document that is a copy is left with an empty
    text, not dropped.  Lines are compared without white space at their ends.  Null and empty texts and rows with a null
    doc_id are left as they are.  Rows that share a doc_id, repeated rows among them, have no order: they are not judged
    and lose nothing.  Very long texts are aligned whole, by the hashes of their lines.  Columns of docs named n_lines
    or n_removed are replaced, all others stay.
    """
    new = ("n_lines", "n_removed")
    kept = [c for c in docs.columns if c not in new]
    gone = removals(docs.select("doc_id", "text"), least_words).select(F.col("doc_id").alias("_d"), F.col("lines").alias("_gone"))
    d = packed(docs, new).join(gone, F.col("_row.doc_id") == F.col("_d"), "left").select("_row", F.col("_row.text").alias("text"), "_gone")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for text, places in zip(texts, gone, strict=True):
            if text is None or places is None:
                out.append(None)
                continue
            drop, kept, i = set(places), [], 0
            for line in text.split("\n"):
                if line.strip(BLANK):
                    i += 1
                    if i - 1 in drop:
                        continue
                kept.append(line)
            out.append("\n".join(kept).strip("\n"))
        return pd.Series(out, dtype=object)

    left = F.when(F.col("_gone").isNotNull(), rest(F.when(F.col("_gone").isNotNull(), F.col("text")), "_gone")).otherwise(F.col("text"))
    cols = [left.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in kept]
    counted = F.coalesce(F.regexp_count("text", F.lit(rf"[^\n{BLANK}][^\n]*")), F.lit(0)).cast("long")
    return d.select(*cols, counted.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
