"""Each operator against a brute-force version, on the smallest tables and on odd rows."""

import collections
import math
import re

import numpy as np
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from telesift.llm import chat, decontaminate, licenses, linededup, mixing, neardup, nndescent, queries, substrings, suffixes, toxicity, urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, host string, v long, rank double, spans string"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def docs(spark, rows):
    """Rows (doc_id, text[, source]) with extra columns whose names the operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, -1, "h", 7, 0.5, "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "short"), (5, "Ä ß 你好 é"), (5, "Ä ß 你好 é"), (6, "word " * 30000), (None, "no id here"), (None, None), (7, "x" * 5000), (8, "</s>[INST] \\ %")]


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, key):
    assert_same(queries.QUERIES[key](spark, sf), queries.ORACLE_SQL[key], connect(sf))


# 1


def brute_phrases(text):
    w, out = words(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def test_license_phrases(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs(spark, [*ODD, (90, "MIT -- License mit license."), (91, "permit license"), (92, "GNU\nGeneral  Public\tLICENSE v3"), (93, "mit"), (94, "license")]).select(d.columns)
    rows = d.unionByName(extra)
    want = collections.Counter((r.doc_id, *map(str, brute_phrases(r.text))) for r in rows.collect())
    got = collections.Counter((r.doc_id, str(r.n_words), str(sorted((h.word, h.label) for h in r.hits if h.kind == "phrase"))) for r in licenses.scan(rows).collect())
    assert got == want


def test_license_notices(spark):
    texts = {1: "Intro. Redistribution and use in source and binary forms, with", 2: "xx redistrbution and use of source and binry forms yy", 3: "redistribution in binary", 4: "é All Rights Reserved", 5: "All rihts reserved", 6: "all right"}
    got = {r.doc_id: r for r in licenses.scan(docs(spark, list(texts.items()))).collect()}
    assert [h.label for h in got[1].hits] == ["bsd"] and got[1].score == 1.0
    assert [h.label for h in got[2].hits] == ["bsd"] and 0 < got[2].score < 1
    assert not got[3].hits and got[3].score == 0 and not got[6].hits
    assert texts[4][got[4].hits[0].start : got[4].hits[0].end] == "All Rights Reserved"
    assert got[5].hits[0].edits >= 1
    assert licenses.scan(docs(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
        ("Licensed under CC BY-ND", "cc-by-nd"),
        ("licenced under cc by-nc-sa", "cc-by-nc-sa"),
        ("Licensed under CC BY-NC-ND 3.0", "cc-by-nc-nd"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY 4.0", "cc-by"),
        ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"),
        ("Creative Commons Attribution NonCommercial", "cc-by-nc"),
        ("Creative Commons Attribution 4.0", "cc-by"),
        ("Creativ Commons Attribution", "cc-by"),
        ("all lights reserved by the hotel", ""),
        ("all nights reserved", ""),
        ("All rights deserved", ""),
        ("All rihts reserved", "reserved"),
        ("under the terms of the GNU General Public License", "gpl"),
        ("under the terms of the GNU Lesser General Public License", "gpl,lgpl"),
        ("under the terms of the GNU Affero General Public License", "agpl,gpl"),
        ("licensed under cc by-something", ""),
    ],
)
def test_license_names(spark, text, labels):
    """One license is not taken for another (the phrase of the base finds gpl in all of that family)."""
    r = licenses.scan(docs(spark, [(1, text)])).first()
    assert ",".join(sorted({h.label for h in r.hits})) == labels


@pytest.mark.parametrize("text", ["\ufffd\ufffd all rights reserved", "x\ufffd all rights reserved \ufffd", "all rig\ufffdhts reserved", "\u4f60\u597d all rights reserved \u00e9", "\u00e9\u00e9\u00e9\u00e9all rights reserved\u4f60"])
def test_license_spans(spark, text):
    """Spans by brute force: of all stretches of the text the one with the fewest edits, then the first."""
    r = licenses.scan(docs(spark, [(1, text)])).first()
    notice = "all rights reserved"
    best = min((distance(text[a:b].lower(), notice), b - a != len(notice), a, b) for a in range(len(text)) for b in range(a + 1, len(text) + 1))
    assert [(h.label, h.edits, h.start, h.end) for h in r.hits] == [("reserved", best[0], best[2], best[3])]


def test_license_overlaps():
    """Of hits that overlap the best one counts, however many there are."""
    scanner = licenses.Scanner({}, {"a": "one two three four", "b": "two three four five six"})
    raw = b"one two three four five sux. one two three four\n"
    starts = np.array([0, len(raw)])
    got = [(label, raw[a:b]) for _, label, a, b, _, _ in scanner.fuzzy(raw, starts)]
    assert got == [("a", b"one two three four"), ("a", b"one two three four")]
    many = (b"all rights reserved. " * 5000)[:-1] + b"\n"
    assert len(list(licenses.Scanner({}, licenses.NOTICES).fuzzy(many, np.array([0, len(many)])))) == 5000


def test_license_wrapped(spark):
    """Notices over several lines, in comments of several kinds; spans point into the text as it is."""
    bsd = "Redistribution and use in source\n *   and binary forms"
    mit = "Permission is hereby granted,\r\n# free of charge,\n#\n#\tto any person\n# obtaining a copy"
    texts = {1: "/*\n * " + bsd + ", with\n */", 2: "é\n# " + mit, 3: "// this source code form is subject\n// to the terms of the\n// mozilla public license", 4: "a * b / c # redistribution and\nuse", 5: "all rights\n", 6: "reserved"}
    got = {r.doc_id: r for r in licenses.scan(docs(spark, list(texts.items())).coalesce(1)).collect()}
    assert [h.label for h in got[1].hits] == ["bsd"] and got[1].score == 1.0
    assert texts[1][got[1].hits[0].start : got[1].hits[0].end] == bsd
    assert [h.label for h in got[2].hits] == ["mit"] and texts[2][got[2].hits[0].start : got[2].hits[0].end] == mit
    assert [h.label for h in got[3].hits] == ["mpl"] and got[3].score == 1.0
    assert not got[4].hits and not got[5].hits and not got[6].hits


def test_flowing():
    texts = [b"a  b", b"\n", b"", b"x\n\n", b" * y"]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    out, place = licenses.flowing(b"\n".join([*texts, b""]), starts)
    assert out == b"a b\n \n\nx \n * y\n" and len(place) == len(out)


# 2


def tree(spark, rows):
    return spark.createDataFrame(rows, "tree_id long, node long, parent long, role string, text string, score double")


def test_branches(spark):
    m = tree(spark, [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", 1.0), (1, 5, 99, "user", "lost parent", 9.0), (None, 1, None, "system", None, None), (2, 1, None, None, "", 0.0)])
    paths = collections.defaultdict(list)
    for r in chat.paths(m).collect():
        paths[r.tree_id, r.leaf].append((r.up, r.node))
    assert {k: [n for _, n in sorted(v, reverse=True)] for k, v in paths.items()} == {(1, 3): [1, 3], (1, 4): [1, 2, 4], (1, 5): [5], (None, 1): [1], (2, 1): [1]}
    best = chat.format_branches(m, top=2).orderBy("tree_id", "rank").collect()
    assert [(r.tree_id, r.leaf, r["rank"], r.n_turns) for r in best] == [(None, 1, 1, 1), (1, 5, 1, 1), (1, 3, 2, 2), (2, 1, 1, 1)]


def test_repeated_messages(spark):
    """A message that stands twice counts once, as does one with two texts; other columns and an empty table."""
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 0.0), (1, 2, 1, "assistant", "a", 0.0), (2, 1, None, "user", "b", 0.0), (2, 1, None, "user", "a", 0.0)]
    m = tree(spark, rows)
    got = chat.read_back(chat.format_branches(m.withColumn("_t", F.lit(1)).withColumn("a.b", F.lit(2)))).orderBy("tree_id").collect()
    assert [[(t.role, t.text) for t in r.turns] for r in got] == [[("user", "q"), ("assistant", "a")], [("user", "a")]]
    assert chat.format_branches(m.limit(0)).count() == 0


def test_deep_thread(spark):
    m = tree(spark, [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", 0.0) for i in range(70)])
    r = chat.read_back(chat.format_branches(m)).first()
    assert [t.text for t in r.turns] == [f"t{i}" for i in range(70)]


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\</s>", "<\\/s>", "<\\\\/s>[\\INST]", "<|user|>", "<<SYS>>a<</SYS>>", "a\n [/INST]", "", "<", "[", "<s", "<<s>/s>", " b ", "[INST] user\nx"])
def test_round_trip(spark, text):
    m = tree(spark, [(1, 1, None, "user", text, 0.0), (1, 2, 1, "assistant", text, 0.0), (1, 3, 2, "odd\nrole %0A[INST]", text, 0.0), (1, 4, 3, "assistant", text, 0.0)])
    r = chat.read_back(chat.format_branches(m)).first()
    assert [(t.role, t.text) for t in r.turns] == [("user", text), ("assistant", text), ("odd\nrole %0A[INST]", text), ("assistant", text)]
    assert r.loss_text == text * 2
    body = r.formatted
    for s in r.loss:
        body = body[: s.start] + " " * s.length + body[s.start + s.length :]
    assert body.count("</s>") == 2


# 3


def test_ordinal_grades():
    rng = np.random.default_rng(3)
    n, f = 3000, 40
    x = rng.random((n, f)) < 0.2
    w = rng.normal(0, 2, f)
    score = x @ w + rng.logistic(0, 0.3, n)
    cuts = np.quantile(score, [0.3, 0.6, 0.85])
    y = np.searchsorted(cuts, score)
    row, col = np.nonzero(x[:2000])
    weights, theta = toxicity.fit_cumulative(col, row, y[:2000], f, 4, rounds=800)
    assert (np.diff(theta) > 0).all()
    model = toxicity.OrdinalModel({}, theta)
    expected = model.above(x[2000:] @ weights).sum(axis=1)
    assert np.abs(expected - y[2000:]).mean() < 0.3


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    model = toxicity.fit(d, train, split=True)
    assert len(model.thresholds) == 2
    held = toxicity.score(d, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    assert ((held["p_toxic"] > 0.5) == (held["truth"] == 1)).mean() > 0.97
    assert held[held.truth == 0]["p_toxic"].max() < 0.5


def test_toxicity_recall(spark):
    """Held-out documents: most toxic ones are found, hardly a clean one is rejected."""
    folder = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(d, labels.where("doc_id % 3 <> 0"), split=True)
    held = labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth").select("doc_id", "truth").distinct()
    held = toxicity.score(d.select("doc_id", "text").join(held, "doc_id"), model).toPandas()
    print("recall", (held[held.truth == 1]["p_toxic"] > 0.5).mean(), "rejected", (held[held.truth == 0]["p_toxic"] > 0.5).mean())
    assert (held[held.truth == 1]["p_toxic"] > 0.5).mean() >= 0.85
    assert (held[held.truth == 0]["p_toxic"] > 0.5).mean() <= 0.005


def test_toxicity_names(spark):
    """Columns with a dot and with the operator's own names stay as they are."""
    d = spark.createDataFrame([(1, "bad words here", 5, 6, 0.1), (2, None, 5, 6, 0.2)], "doc_id long, text string, `a.b` int, _j int, severity double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for model in (None, toxicity.OrdinalModel({"bad": 3.0}, np.array([1.0]))):
        out = toxicity.score(d, model)
        assert out.columns == ["doc_id", "text", "a.b", "_j", "severity", "grade", "p_toxic"]
        assert {(r["a.b"], r["_j"]) for r in out.collect()} == {(5, 6)}
    assert toxicity.fit(d.select("doc_id", "text"), labels) is None


def test_toxicity_odd(spark):
    d = docs(spark, ODD)
    labels = spark.createDataFrame([(2, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    out = toxicity.score(d, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.severity <= 1 for r in out)
    assert toxicity.fit(d, labels.limit(0)) is None
    assert {r.severity for r in toxicity.score(d, None).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), model).count() == 0


# 4


def test_trust_spreads(spark):
    page = "page_id long, url string, html string, host string, trust double"
    link = lambda *hosts: "".join(f'<a class="x" href="http://{h}/p">t</a>' for h in hosts)
    rows = [(1, "http://good.org/", link("friend.net", "friend.net"), "clash", 1.0), (2, "http://friend.net/a", "", "", 0.0), (3, "http://shady.net/a", link("x.com"), "", 0.0), (4, "https://X.com/de/1?q", "", "", 0.0), (5, None, None, "", 0.0), (6, "no scheme", '<a href="/x">', "", 0.0), (7, "ftp://alone.net", "", "", 0.0), (7, "ftp://alone.net", "", "", 0.0), (8, "http://example.org/es/x#y", "", "", 0.0)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, page)).collect()}
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {
        1: ("good.org", "/", "org/", "allow"),
        2: ("friend.net", "/a", None, "allow"),
        3: ("shady.net", "/a", None, "block"),
        4: ("x.com", "/de/1", "com/de/", "block"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("alone.net", "", None, "allow"),
        8: ("example.org", "/es/x", "example.org/es/", "block"),
    }
    assert got[2].trust > 0 and got[3].distrust > 0 and got[1].distrust == 0
    assert urls.judge(spark.createDataFrame([], page)).count() == 0


def test_distrust_reaches_far(spark):
    """A chain of 14 hosts that ends at a blocked one."""
    hosts = [f"h{i}.net" for i in range(14)] + ["x.com"]
    rows = [(i, f"http://{h}/de/1", f'<a href="http://{n}/">t</a>') for i, (h, n) in enumerate(zip(hosts, [*hosts[1:], ""], strict=True))]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {r.verdict for r in got.values()} == {"block"}
    total = 1 - 0.85**15  # what the end of the chain loses goes back to the seed
    assert all(abs(r.distrust - 0.15 * 0.85 ** (14 - i) / total) < 1e-5 for i, r in got.items())


# 5


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, total, out = set(names), share * sum(sizes.values()), {}
    while left:
        level = (total - sum(out.values())) / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: level * w[s] for s in left}
        for s in over:
            out[s] = most * sizes[s]
            left.remove(s)
    return out


def check_mix(d, out, near):
    sizes = collections.Counter()
    for r in d:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want, taken = brute_targets(sizes), collections.Counter()
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near(s), (s, taken[s], want[s])


def test_mix(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(d).collect()
    assert len(out) == 1000
    check_mix(d.collect(), out, lambda s: 60)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(d.repartition(3)).collect()) == sorted((r.doc_id, r.taken) for r in out)


def test_mix_odd(spark):
    rows = [*ODD, (20, "a b c", None), (21, "a b c", None), (22, "", "empty"), (23, "one two", "ä"), (24, "w " * 10, "z")]
    d = docs(spark, rows)
    check_mix(d.collect(), mixing.mix(d).collect(), lambda s: 30000)
    assert mixing.mix(docs(spark, [])).count() == 0


# 6


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_edit_distance():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        a = rng.integers(0, rng.choice([2, 9, 60]), rng.integers(0, 26)).astype("u4")
        b = a.tolist()
        for _ in range(rng.integers(0, 12)):
            i, kind = int(rng.integers(0, len(b) + 1)), rng.integers(0, 3)
            b[i : i + (kind != 0)] = [] if kind == 1 else [int(rng.integers(0, 9))]
        b, most = np.array(b, dtype="u4"), int(rng.integers(0, 12))
        d = distance(a.tolist(), b.tolist())
        assert neardup.edits_within(a, b, most) == min(d, most + 1)
        assert neardup.alike(a, b, most) == (d <= most)


def test_near_duplicates(spark):
    rng = np.random.default_rng(6)
    base = [[f"w{rng.integers(0, 3000)}" for _ in range(200)] for _ in range(12)]
    rows, truth = [], {}
    for g, text in enumerate(base):
        for k in range(g * 5):
            t = list(text)
            for i in rng.choice(200, 8 if k else 0, replace=False):
                t[i] = f"n{rng.integers(0, 10**6)}"
            if k % 3 == 1:
                t = t[5:]
            rows.append((len(rows) + 100, " ".join(t).upper() if k % 4 == 2 else " ".join(t)))
            truth[rows[-1][0]] = g
    d = docs(spark, rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(d, few_members=8).collect()}
    first = {g: min(i for i in truth if truth[i] == g) for g in set(truth.values())}
    assert got == {i: first[g] for i, g in truth.items()}
    assert neardup.keep_first(d).count() == len(first)


def test_near_duplicates_repeated_id(spark):
    """An id that stands with several texts is linked by each of them, in small buckets and in large ones."""
    rng = np.random.default_rng(31)
    text = lambda: [f"w{rng.integers(0, 10**6)}" for _ in range(60)]
    a, b, c = text(), text(), text()
    edited = lambda t: " ".join(["x", *t[1:-1], "y"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, edited(a)), (3, edited(b)), (4, " ".join(c)), (4, " ".join(c)), (5, edited(c))]
    for few in (40, 1):
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(spark, rows), few_members=few).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    many = [(7, " ".join(t)) for t in (text() for _ in range(30))]
    rows = many + [(100 + i, edited(t.split(" "))) for i, (_, t) in enumerate(many)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {7: 7, **{100 + i: 7 for i in range(30)}}


def test_near_duplicates_odd(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_id) for r in neardup.near_duplicates(docs(spark, ODD)).collect())
    assert got == [(False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 4), (False, 5, 5), (False, 6, 6), (False, 7, 7), (False, 8, 8), (True, 0, None)]
    kept = neardup.keep_first(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 5, 6, 7, 8]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def brute_classes(rows, similarity=0.8, candidates=None):
    """Components of all pairs of (doc_id, words) of that edit similarity, or of those of the candidates."""
    ids = {}
    coded = {i: np.array([ids.setdefault(w, len(ids)) for w in t], dtype="u4") for i, t in rows}
    links = {i: set() for i in coded}
    for a in coded:
        for b in coded:
            if a < b and (candidates is None or candidates(a, b)) and neardup.alike(coded[a], coded[b], int((1 - similarity) * max(len(coded[a]), len(coded[b])) + 1e-9)):
                links[a].add(b)
                links[b].add(a)
    return reach(links)


def sharing(rows, count=40, picks=2):
    """Whether two of the documents (as Spark rows) share a sketch."""
    sketch = {r.doc_id: list(r.sketch) for r in neardup.sketch_table(rows, count, picks).collect()}
    return lambda a, b: any(x == y for x, y in zip(sketch[a], sketch[b], strict=True))


@pytest.mark.parametrize("n", [5, 6, 10, 20, 40, 61, 100, 300])
def test_candidates_near_threshold(n):
    """Pairs of edit similarity 0.8 to 0.83 (as near to 0.8 as whole words allow) that share a sketch."""
    rng, pairs, caught = np.random.default_rng(n), 0, 0
    while pairs < 400:
        a = rng.integers(0, 2**32, n)
        b = a.tolist()
        for i in sorted(rng.choice(n, n // 5, replace=False), reverse=True):
            kind = rng.integers(0, 3)
            b[i : i + (kind != 0)] = [] if kind == 1 else [int(rng.integers(0, 2**32))]
        u, v = a.astype("u4"), np.array(b, dtype="u4")
        longer = max(len(u), len(v))
        if not neardup.alike(u, v, int(0.2 * longer + 1e-9)) or longer >= 20 and neardup.alike(u, v, int(0.17 * longer)):
            continue
        pairs += 1
        caught += bool(set(enumerate(neardup.signature(a.astype("u8"), 40, 2))) & set(enumerate(neardup.signature(np.array(b, dtype="u8"), 40, 2))))
    print(n, caught / pairs)
    assert caught >= 0.97 * pairs


def test_near_duplicates_chain(spark):
    """Copies of copies, each near the one before only: a head matches few, and what it does not match links on."""
    rng = np.random.default_rng(16)
    t, rows = [f"w{rng.integers(0, 3000)}" for _ in range(100)], []
    passage = [f"p{i}" for i in range(40)]
    for i in range(400):
        rows.append((i + 1, passage + t))
        t = list(t)
        for j in rng.choice(100, 20, replace=False):
            t[j] = f"n{rng.integers(0, 10**6)}"
    d = docs(spark, [(i, " ".join(t)) for i, t in rows])
    want = brute_classes(rows, candidates=sharing(d))
    assert len(set(want.values())) < 40
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    assert got == want


def test_near_duplicates_passage(spark):
    """Pairs that agree in one sketch are found in a bucket of any size, whatever else shares a passage with them."""
    rng = np.random.default_rng(26)
    passage, rows = [f"p{i}" for i in range(60)], []
    for g in range(60):
        t = [f"w{rng.integers(0, 10**6)}" for _ in range(100)]
        u = list(t)
        for j in rng.choice(100, 26, replace=False):
            u[j] = f"n{rng.integers(0, 10**6)}"
        rows += [(2 * g + 1, passage + t), (2 * g + 2, passage + u)]
    d = docs(spark, [(i, " ".join(t)) for i, t in rows])
    want = brute_classes(rows, candidates=sharing(d))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    assert got == want


# 7


def brute_hits(text, items, length=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(len(b), length)
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontaminate(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Ab cd"), (3, None), (4, "solo"), (5, "a a a a a a a a a a a a"), (6, "..."), (7, "Ab cd"), (None, "null id item")]
    rows = [*ODD, (30, "x ONE two three four five six seven eight nine ten eleven y"), (31, "two three four five six seven eight nine ten"), (32, "ab, CD ab cd"), (33, "solo"), (34, "a " * 15), (34, "other text"), (35, "one two three four five six seven eight nine ten one two three four five six seven eight nine ten")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, rows)
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, str(r["items"]), r.contaminated) for r in decontaminate.find(d, bench).collect())
    want = collections.Counter()
    for r in rows:
        n, h, f = brute_hits(r[1], [i for i in items if i[0] is not None])
        want[(r[0], n, h, str(f), h > 0)] += 1
    assert got == want
    assert decontaminate.remove(d, bench).columns == d.columns
    assert decontaminate.remove(d, bench).count() == sum(v for k, v in want.items() if not k[4])
    assert decontaminate.find(d, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find(docs(spark, []), bench).count() == 0


# 8


def test_patience():
    a, b = list("abcdefgh"), list("xbcdyfghz")
    assert linededup.patience(a, b) == [(1, 1), (2, 2), (3, 3), (5, 5), (6, 6), (7, 7)]
    assert linededup.patience(list("aab"), list("aab")) == [(0, 0), (1, 1), (2, 2)]
    assert linededup.patience([], list("a")) == []
    assert linededup.shared_lines(list("abxyc"), list("xyab"), [1] * 4, 2) == [0, 1, 2, 3]
    assert linededup.shared_lines(list("ab"), list("axb"), [1] * 3, 2) == []


def test_line_dedup(spark):
    p = ["first line that is shared by both", "second line that is shared too", "third one"]
    rows = [(1, "\n".join(["own of one here"] + p)), (2, "\n".join(["start of two"] + p + ["", "end of two"])), (3, "start of two\nnothing else is common"), (4, "\n".join(p)), *[(r[0] + 100 if r[0] else None, r[1]) for r in ODD]]
    out = collections.defaultdict(list)
    d = docs(spark, rows)
    cleaned = linededup.dedup_lines(d)
    assert cleaned.columns == [*d.columns, "n_lines", "n_removed"]
    for r in cleaned.collect():
        out[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert out[1] == [(rows[0][1], 4, 0)]
    assert out[2] == [("start of two\n\nend of two", 5, 3)]
    assert out[3] == [(rows[2][1], 2, 0)]
    assert out[4] == [("", 3, 3)]
    assert out[101] == [(None, 0, 0)] and len(out[105]) == 2 and len(out[None]) == 2
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def brute_lines(rows, least=5):
    """Removed lines of each document: every run of lines that an earlier one has as well, from all pairs of places."""
    cut_up = {i: [x for x in (line.strip(linededup.BLANK) for line in (t or "").split("\n")) if x] for i, t in rows}
    out = {i: set() for i in cut_up}
    for b, mine in cut_up.items():
        n = [len(re.findall(r"[^ \t\n\x0b\f\r]+", x)) for x in mine]
        for a, theirs in cut_up.items():
            if a < b and set(theirs) & set(mine):
                for x in range(len(theirs)):
                    for y in range(len(mine)):
                        if theirs[x] == mine[y] and not (x and y and theirs[x - 1] == mine[y - 1]):
                            k = 0
                            while x + k < len(theirs) and y + k < len(mine) and theirs[x + k] == mine[y + k]:
                                k += 1
                            if sum(n[y : y + k]) >= least:
                                out[b].update(range(y, y + k))
    return out


def removed_lines(spark, rows):
    return {r.doc_id: set(r.lines) for r in linededup.removals(docs(spark, rows)).collect()}


def test_line_dedup_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert removed_lines(spark, rows) == {i: x for i, x in brute_lines(rows).items() if x}


def test_line_dedup_third_owner(spark):
    """3 and 4 share a block whose lines stand first, each alone, in 1 and 2."""
    rows = [(1, "one two three\nrest of the first"), (2, "four five six\nrest of the second"), (3, "top\none two three\nfour five six\nend"), (4, "head\none two three\nfour five six\ntail")]
    assert removed_lines(spark, rows) == {4: {1, 2}}
    rng = np.random.default_rng(23)
    rows = [(i, "\n".join(" ".join(["w"] * int(rng.integers(1, 4))) + f" {rng.integers(0, 12)}" for _ in range(12))) for i in range(40)]
    assert removed_lines(spark, rows) == {i: x for i, x in brute_lines(rows).items() if x}


@pytest.mark.parametrize("block", ["pqpq", "abcabc", "aaaa", "abab" * 5, "abacabad"])
def test_line_dedup_repeated_lines(spark, block):
    """A common block of lines that repeat, none of them unique on either side."""
    lines = [f"line {c} has seven words in it" for c in block]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["top of the second", *lines, "end of the second"])), (3, "\n".join(["one more", *lines[::-1], "last"]))]
    got = removed_lines(spark, rows)
    assert got == {i: x for i, x in brute_lines(rows).items() if x} and got[2] == set(range(1, len(block) + 1))


def test_line_dedup_linear():
    """A list against its reverse, against itself twice, and a single line 20,000 times."""
    import time

    a = list(range(20_000))
    began = time.process_time()
    assert linededup.shared_lines(a, a[::-1], [3] * len(a), 5) == []
    assert linededup.shared_lines(a, a[::-1], [5] * len(a), 5) == a
    assert len(linededup.shared_lines(a, a[10_000:] + a[:10_000], [1] * len(a), 5)) == len(a)
    assert len(linededup.shared_lines([7] * 20_000, [7] * 20_000 + [8], [1] * 20_001, 5)) == 20_000
    assert time.process_time() - began < 8


def test_line_dedup_many_copies(spark):
    text = "\n".join(f"line number {i} of the copied page" for i in range(6))
    out = linededup.dedup_lines(docs(spark, [(i, text + f"\nown words of copy {i} stand here") for i in range(60)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(i, 6 if i else 0) for i in range(60)]


@pytest.mark.parametrize("n", [21, 2000])
def test_line_dedup_frequent_passage(spark, n):
    """One line, or two short ones with different owners, that many documents share."""
    line = " ".join(f"p{i}" for i in range(60))
    rows = [(0, "two words\nown of 0"), (1, "own of 1\ntwo words\nthree more words\nend 1"), *[(i, f"own of {i}\n{line}\nend {i}\ntwo words\nthree more words\nlast {i}") for i in range(2, n + 2)]]
    out = {r.doc_id: r.n_removed for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert out == {0: 0, 1: 0, 2: 2, **{i: 3 for i in range(3, n + 2)}}


# 9


def brute_links(x, least=0.9):
    good = {i: np.asarray(v, dtype=float) for i, v in x if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = {i: set() for i, _ in x}
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least:
                links[a].add(b)
    return links


def reach(links):
    out = {}
    for i in sorted(links):
        if i not in out:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in out:
                    out[j] = i
                    todo += links[j]
    return out


def test_vectors(spark):
    rng = np.random.default_rng(9)
    x = []
    for size in (1, 2, 3, 40, 15):
        middle = rng.normal(size=16)
        x += [(middle + rng.normal(size=16) * 0.1).tolist() for _ in range(size)]
    x += [rng.normal(size=16).tolist() for _ in range(60)] + [x[3]] * 4
    rows = [*enumerate(x), (500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] + [1.0] * 15), (505, [float("inf")] * 16), (506, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: r for r in nndescent.near_vectors(df, k=4, block=16).collect()}
    links = brute_links(rows)
    comp = reach(links)
    # the method is approximate: no link is wrong, and nearly all are found
    assert all(r.n_links <= len(links[i]) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(map(len, links.values()))
    assert all(comp[r.component_id] == comp[i] and r.kept == (r.component_id == i) for i, r in got.items())
    assert {i for i, v in links.items() if not v} <= {i for i, r in got.items() if r.n_links == 0 and r.kept}
    assert nndescent.near_vectors(df.limit(0)).count() == 0


def around(rng, middle, spread, n):
    """n unit vectors about a middle."""
    x = middle + rng.normal(size=(n, len(middle))) * spread
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def turned(a, b, cosine):
    """A unit vector of that cosine with unit vector a, in the plane of a and b."""
    b = b - a * (a @ b)
    b /= np.linalg.norm(b)
    return a * cosine + b * math.sqrt(1 - cosine * cosine)


def vector_case(name):
    rng = np.random.default_rng(19)
    unit = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    if name == "one group":
        return around(rng, unit[0], 0.01, 5000)
    if name == "wide group":
        return np.concatenate([around(rng, unit[0], 0.085, 2500), around(rng, unit[1], 0.3, 200)])
    if name.startswith("two groups"):
        n = int(name.split()[-1])
        return np.concatenate([around(rng, unit[0], 0.003, n), around(rng, turned(unit[0], unit[1], 0.95), 0.003, n)])
    # a chain of tight groups, each linked with the next only
    middle, out = unit[0], []
    for i in range(8):
        out.append(around(rng, middle, 0.002, 150))
        middle = turned(middle, unit[i + 1], 0.92)
    return np.concatenate([*out, around(rng, unit[15], 0.3, 300)])


@pytest.mark.parametrize("name", ["two groups 120", "two groups 1500", "chain", "one group", "wide group"])
def test_vectors_saturated(spark, name):
    """Groups that fill the lists of their vectors: components are those of brute force, link counts in each of them too."""
    x = vector_case(name)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in nndescent.near_vectors(df).collect()}
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    comp = reach({i: set(np.flatnonzero(r).tolist()) for i, r in enumerate(near)})
    assert {i: r.component_id for i, r in got.items()} == comp
    found = np.array([got[i].n_links for i in range(len(x))])
    for c in set(comp.values()):
        own = np.array([i for i in comp if comp[i] == c])
        assert (found[own] <= want[own] + 2).all() and found[own].sum() >= 0.97 * want[own].sum(), c


# 10


def brute_repeats(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            if w in seen:
                gone[s : s + n] = b"\1" * n
            seen.add(w)
        out[i] = (bytes(c for c, g in zip(b, gone, strict=True) if not g), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])))
    return out


@pytest.mark.parametrize("n", [30, 100])
def test_substrings(spark, n):
    rng = np.random.default_rng(n)
    text = lambda k: "".join(rng.choice(list("abcdeé "), k))
    shared = text(300)
    rows = [(1, text(500)), (2, text(80) + shared + text(90)), (3, shared[50:]), (4, text(40) + shared[: n + 7]), (5, "ab" * 400), (6, "ab" * 90 + "c" + "ab" * 90), (7, None), (8, ""), (9, shared[: n - 1]), (10, shared[3 : 3 + n]), (11, "z" * 700), (12, text(200) * 3), (13, shared)]
    d = docs(spark, [*rows, (20, shared), (20, shared + "x"), (None, shared)])
    got = collections.defaultdict(list)
    for r in substrings.remove_repeats(d, n).collect():
        got[r.doc_id].append((bytes(r.kept), sum(s.hi - s.lo for s in r.spans), len(r.spans)))
    for i, want in brute_repeats(rows, n).items():
        assert got[i] == [want], i
    assert {b for b, *_ in got[20]} == {shared.encode(), shared.encode() + b"x"} and got[None] == [(shared.encode(), 0, 0)]
    assert substrings.remove_repeats(docs(spark, []), n).count() == 0


def test_substrings_hot_gram(spark, monkeypatch):
    """A boilerplate in many texts that differ around it: its group is dealt again by longer grams."""
    rng = np.random.default_rng(31)
    text = lambda k: "".join(rng.choice(list("abcdefgh "), k))
    middle = text(140)
    rows = [(i, text(30) + middle[: int(rng.integers(30, 140))] + text(60)) for i in range(60)] + [(100 + i, "q" * int(rng.integers(90, 300))) for i in range(10)]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.repeats(docs(spark, rows).select("doc_id", "text"), 100, most_bytes=300).collect()}
    plain = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.repeats(docs(spark, rows).select("doc_id", "text"), 100).collect()}
    covered = lambda x: {i: {b for lo, hi in s for b in range(lo, hi)} for i, s in x.items()}
    assert covered(found) == covered(plain) and {i: len(b) for i, b in covered(found).items()} == {i: g for i, (_, g, _) in brute_repeats(rows, 100).items() if g}


@pytest.mark.parametrize("symbols", [1, 2, 3, 60])
def test_suffixes(monkeypatch, symbols):
    """Small memory, small blocks and a small limit for doubling: everything goes through disk and recursion."""
    rng = np.random.default_rng(symbols)
    for block, memory, inner in ((4, 5, 2), (64, 5, 10**6), (1 << 18, 10**6, 2), (1 << 18, 10**6, 10**6)):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        for n in (1, 2, 17, 90):
            for x in (rng.integers(0, symbols, n).tolist(), (rng.integers(0, symbols, 6).tolist() * n)[:n]):
                got = np.concatenate(list(suffixes.suffixes(np.array(x, np.uint16), n, symbols, 200, 200, memory, inner)))
                order = sorted(range(n), key=lambda i: x[i:])
                assert (got >> 8).tolist() == order
                for a, b, c in zip(order, order[1:], (got & 255)[1:].tolist(), strict=False):
                    real = next((k for k, (u, v) in enumerate(zip(x[a:], x[b:], strict=False)) if u != v), min(n - a, n - b))
                    # beyond the end of the text nothing follows, so a prefix that reaches it may count on
                    assert c == real or max(a, b) + real == n


def test_shard_on_disk(monkeypatch):
    """A shard much larger than the memory it may use finds the same windows as one in memory."""
    import pandas as pd

    rng = np.random.default_rng(8)
    middle = rng.integers(97, 100, 300).astype("u1").tobytes()
    rows = pd.DataFrame([(d, 7 * 256 + 60, middle[k : k + 89]) for d, k in enumerate(rng.integers(0, 200, 400).tolist())], columns=["doc_id", "at", "piece"])
    out = []
    for block, memory in ((1 << 18, 1 << 23), (256, 1000)):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        monkeypatch.setattr(suffixes, "INNER", 50)
        shard = substrings.Shard(30, memory)
        shard.add(rows)
        covered = {(r.doc_id, i) for part in shard.late() for r in part.itertuples() for i in range(r.lo, r.hi)}
        out.append(covered)
    assert out[0] == out[1] and len(out[0]) > 30000
    seen, want = set(), set()
    for r in rows.itertuples():
        for i in range(60):
            w = r.piece[i : i + 30]
            want |= {(r.doc_id, 7 + j) for j in range(i, i + 30)} if w in seen else set()
            seen.add(w)
    assert out[0] == want
