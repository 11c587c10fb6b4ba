"""License scans: exact phrases, and fuzzy search for short notices."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, joined, slices, word_bounds

#: Label of each phrase whose words must stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and texts of each short notice that is searched with errors.  What stands in brackets tells one license from
#: another and admits no edit; behind a text that ends with it no word goes on.
NOTICES: dict[str, str | tuple[str, ...]] = {
    "bsd": "redistribution and use in source and binary forms",
    "mit": "permission is hereby granted, free of charge, to any person obtaining a copy",
    "apache": "licensed under the apache license, version 2.0",
    "gpl": "under the terms of the gnu general public license",
    "mpl": "this source code form is subject to the terms of the [mozilla] public license",
    "reserved": "all [r]ights [r]eserved",
    "lgpl": ("under the terms of the gnu [lesser] general public license", "under the terms of the gnu [library] general public license"),
    "agpl": "under the terms of the gnu [affero] general public license",
    "isc": "permission to use, copy, modify, and/or distribute this software for any purpose",
    "zlib": "this software is provided 'as-is', without any express or implied warranty",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: The six licenses of one family: label, short name, and what their long names add.
CREATIVE_COMMONS = {
    "cc-by": ("by", ""),
    "cc-by-sa": ("by-sa", "sharealike"),
    "cc-by-nd": ("by-nd", "noderivatives"),
    "cc-by-nc": ("by-nc", "noncommercial"),
    "cc-by-nc-sa": ("by-nc-sa", "noncommercial sharealike"),
    "cc-by-nc-nd": ("by-nc-nd", "noncommercial noderivatives"),
}
for _label, (_short, _added) in CREATIVE_COMMONS.items():
    _long = [f"creative commons [{mark.join(['attribution', *_added.split()])}]" for mark in ("-", " ")]
    NOTICES[_label] = tuple(dict.fromkeys([f"licensed under [cc {_short}]", *_long]))
#: A notice may have one edit for this many of its characters.
CHARS_PER_EDIT = 10
#: Parts without edits that are as long serve as seeds.
LEAST_SEED = 5
#: White space, and what stands at the margin of a wrapped comment.
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
MARGIN = np.isin(np.arange(256), list(b" \t\n\v\f\r*#/|;>%"))
SPLIT = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLLOWED = rb"(?![0-9a-z\x80-\xff])"


def segments(notice: str) -> list[tuple[str, bool]]:
    """A notice as (text, whether it must stand as it is)."""
    return [(x[1:-1], True) if x[0] == "[" else (x, False) for x in re.findall(r"\[[^\]]*\]|[^\[]+", notice)]


def seeds(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """Pieces of a notice and where they start, of which one at least stands whole in any match.

    A long part that admits no edit is such a piece by itself.  Else the notice is split into edits + 1 pieces: with at
    most `edits` edits one is left whole.
    """
    at = 0
    for text, exact in segments(notice):
        if exact and len(text) >= LEAST_SEED:
            return [(at, text.encode())]
        at += len(text.encode())
    raw = "".join(x for x, _ in segments(notice)).encode()
    cuts = np.linspace(0, len(raw), edits + 2).astype(int)
    return [(int(a), raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def rule_of(notice: str, edits: int) -> regex.Pattern:
    """Fewest errors first; `edits` is the most for each part, the caller holds the sum to it.

    A notice that ends with a part without edits is no match where a word goes on behind it, nor where another part of a
    license's name follows.
    """
    parts = segments(notice)
    body = "".join(regex.escape(x) if exact else f"(?:{regex.escape(x)}){{e<={edits}}}" for x, exact in parts)
    return regex.compile("(?b)" + body + (r"(?![-\w])(?!\s(?:non|share|no ?deriv))" if parts[-1][1] else ""))


def flowing(folded: bytes, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts without line breaks: the bytes, and where each of them stood.

    A run of white space is one blank, and so is a run of white space and margin signs with a line break in it.  The
    line feeds between texts stay.
    """
    data = np.frombuffer(folded, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = MARGIN[data]
    inside[starts[1:]] = 0
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    breaks, blanks = sums(data == 10), sums(SPACE[data])
    soft = (breaks[end] > breaks[begin]) | (blanks[end] - blanks[begin] == end - begin)
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, begin[soft] + 1, 1)
    np.add.at(edge, end[soft], -1)
    keep = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    out = data.copy()
    out[begin[soft]] = 0x20
    return out[keep].tobytes(), keep


class Scanner:
    """Finds phrases and notices in a block of texts."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str | tuple[str, ...]]):
        self.phrases = [(label, re.compile(SPLIT.join(re.escape(w.encode()) for w in phrase.split()) + FOLLOWED)) for phrase, label in phrases.items()]
        self.notices: list[tuple[str, int, int, regex.Pattern]] = []
        self.seeds = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for label, texts in notices.items():
            for notice in (texts,) if isinstance(texts, str) else texts:
                size = sum(len(x.encode()) for x, _ in segments(notice))
                k = max(1, size // CHARS_PER_EDIT)
                for offset, piece in seeds(notice, k):
                    pieces.setdefault(piece.decode("latin-1"), []).append((len(self.notices), offset))
                self.notices.append((label, size, k, rule_of(notice, k)))
        for piece, of in pieces.items():
            self.seeds.add_word(piece, (len(piece), of))
        self.seeds.make_automaton()

    def exact(self, folded: bytes) -> Iterator[tuple[str, int, int]]:
        for label, rule in self.phrases:
            for m in rule.finditer(folded):
                at = m.start()
                if not at or not (48 <= folded[at - 1] < 58 or 97 <= folded[at - 1] < 123 or folded[at - 1] >= 128):
                    yield label, at, m.end()

    def windows(self, blank: bytes, starts: list[int]) -> set[tuple[int, int, int, int]]:
        """(row, first byte, last byte + 1, notice) around the seeds, all found in one pass of an automaton."""
        out: set[tuple[int, int, int, int]] = set()
        for end, (size, of) in self.seeds.iter(blank.decode("latin-1")) if len(self.seeds) else ():
            at = end - size + 1
            row = bisect_right(starts, at) - 1
            lo, hi = starts[row], starts[row + 1] - 1
            if end < hi:
                for number, offset in of:
                    _, whole, k, _ = self.notices[number]
                    a, b = max(lo, at - offset - 4 * k), min(hi, at - offset + whole + 4 * k)
                    # windows begin and end with whole characters
                    while a > lo and blank[a] & 0xC0 == 0x80:
                        a -= 1
                    while b < hi and blank[b] & 0xC0 == 0x80:
                        b += 1
                    out.add((row, a, b, number))
        return out

    def fuzzy(self, folded: bytes, begins: np.ndarray) -> Iterator[tuple[int, str, int, int, int, int]]:
        """(row, label, first byte, last byte + 1, edits, most edits), in the order of their places.

        Seeds give windows, the regex library judges these.  Of matches that overlap, the one with the smallest share of
        edits counts (then the longest, then the first label).
        """
        blank, place = flowing(folded, begins)
        starts = np.searchsorted(place, begins).tolist()
        hits: set[tuple[int, int, int, str, int, int]] = set()
        for row, a, b, number in self.windows(blank, starts):
            label, _, k, rule = self.notices[number]
            # some bytes more, for what follows decides where a name ends
            text = blank[a : min(b + 16, starts[row + 1] - 1)].decode("utf-8", "ignore")
            m = rule.search(text)
            if m and sum(m.fuzzy_counts) <= k:
                lead = a + len(text[: m.start()].encode())
                hits.add((row, int(place[lead]), int(place[lead + len(m.group().encode()) - 1]) + 1, label, sum(m.fuzzy_counts), k))
        group: list[tuple[int, int, int, str, int, int]] = []
        reach = 0
        for hit in [*sorted(hits), (-1, 0, 0, "", 0, 0)]:
            if group and (hit[0] != group[0][0] or hit[1] >= reach):
                yield from best_apart(group)
                group, reach = [], 0
            group.append(hit)
            reach = max(reach, hit[2])


def best_apart(hits: list[tuple[int, int, int, str, int, int]]) -> list[tuple[int, str, int, int, int, int]]:
    """Of overlapping hits those that are left when the best ones are taken first."""
    taken: list[tuple[int, str, int, int, int, int]] = []
    for row, first, last, label, edits, k in sorted(hits, key=lambda h: (h[4] / (h[5] + 1), h[1] - h[2], h[3], h[1])):
        if all(last <= t[2] or first >= t[3] for t in taken):
            taken.append((row, label, first, last, edits, k))
    return sorted(taken, key=lambda t: t[2])


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str | tuple[str, ...]] | None = None, block: int = 8 << 20) -> DataFrame:
    """doc_id with n_words, hits: array of (label, kind, start, end, word, edits), and score.

    One pass over the texts with no shuffle.  start and end are code points of the text, word is the index of the
    first word; kind is `phrase` or `notice`.  score is 1 with a phrase or an exact notice, less by the share of
    allowed edits that the best notice needs, 0 without hits.  Every place counts.  Notices are found across line breaks,
    with the indents and comment signs at them; a span then holds these as well.  Of notices that overlap the best one
    counts.  notices: short ones, one or several a label.  A null text is empty and has no hits, an empty table no rows; rows with the same doc_id are judged each for itself.  Texts are worked on in blocks of about `block` bytes.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices

    def run(batches):
        scanner = Scanner(phrases, notices)
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch["text"]]
            ids = batch["doc_id"]
            for a, b in slices(np.array([len(t) for t in texts]), block):
                starts, _, raw = joined(texts[a:b])
                folded = raw.translate(FOLD)
                begin, _ = word_bounds(np.frombuffer(folded, dtype=np.uint8))
                first = np.searchsorted(begin, starts)
                hits: list[list[dict]] = [[] for _ in range(b - a)]
                score = [0.0] * (b - a)
                rows = starts.tolist()

                def add(row, label, kind, lo, hi, edits, worth):
                    at = rows[row]
                    head = len(raw[at:lo].decode("utf-8", "replace"))
                    word = int(np.searchsorted(begin, lo) - first[row])
                    hits[row].append({"label": label, "kind": kind, "start": head, "end": head + len(raw[lo:hi].decode("utf-8", "replace")), "word": word, "edits": edits})
                    score[row] = max(score[row], worth)

                for label, lo, hi in scanner.exact(folded):
                    row = bisect_right(rows, lo) - 1
                    if hi <= rows[row + 1] - 1:
                        add(row, label, "phrase", lo, hi, 0, 1.0)
                for row, label, lo, hi, edits, most in scanner.fuzzy(folded, starts):
                    add(row, label, "notice", lo, hi, edits, 1.0 - edits / (most + 1))
                yield pd.DataFrame({"doc_id": ids.iloc[a:b].to_numpy(), "n_words": np.diff(first), "hits": [sorted(h, key=lambda x: (x["start"], x["end"], x["kind"], x["label"])) for h in hits], "score": score}).astype({"doc_id": "Int64"})

    hit = "array<struct<label:string,kind:string,start:long,end:long,word:long,edits:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, f"doc_id long, n_words long, hits {hit}, score double")
