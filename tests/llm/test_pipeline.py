"""Each stage of the corpus pipeline against a plain version, on small tables and on odd rows."""

import collections
import re

import pytest
from test_operators import ODD, brute_classes, brute_hits, brute_lines, brute_targets, words

import corpus_pipeline
from telesift.llm import linededup

NAMES = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "_row string, _d string, _t2 string, _u double, _s string, _c string, _h string, _gone string, _spans string, _cut string, _m double, _id long, _class string, _host string, _rank double, _w string, n_lines string, class_id string, copies_ string, _j string, rep string, key string, words string, `a.b` string"


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Documents before the first stage and after each, as lists of rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf))
        out.append(docs.collect())
    return out


def ids(rows):
    return {r.doc_id for r in rows}


def test_toxicity_stage(spark, sf, stages):
    """Labelled toxic documents go for the most part, clean ones stay, and what stays is unchanged."""
    before, after = stages[0], stages[1]
    toxic = collections.defaultdict(int)
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        toxic[r.doc_id] = max(toxic[r.doc_id], r.toxic or 0)
    bad, good = {i for i, t in toxic.items() if t} & ids(before), {i for i, t in toxic.items() if not t} & ids(before)
    assert len(bad - ids(after)) >= 0.8 * len(bad) and len(good & ids(after)) >= 0.99 * len(good)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_line_dedup_stage(stages):
    before, after = stages[1], {r.doc_id: r for r in stages[2]}
    gone = brute_lines([(r.doc_id, r.text) for r in before])
    assert len(after) == len(before)
    for r in before:
        lines = [x.strip(linededup.BLANK) for x in (r.text or "").split("\n")]
        kept = [x for i, x in enumerate(x for x in lines if x) if i not in gone[r.doc_id]]
        got = [x.strip(linededup.BLANK) for x in (after[r.doc_id].text or "").split("\n")]
        assert [x for x in got if x] == kept
        if gone[r.doc_id]:
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_near_dedup_stage(stages):
    before = [(r.doc_id, words(r.text)) for r in stages[2]]
    classes = brute_classes(before)
    want = {i for i, c in classes.items() if i == c}
    empty = {i for i, w in before if not w}
    want = want - empty | ({min(empty)} if empty else set())
    assert ids(stages[3]) == want


def test_decontaminate_stage(spark, sf, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids(stages[4]) == {r.doc_id for r in stages[3] if not brute_hits(r.text, items)[1]}


def test_mix_stage(stages):
    sizes, taken = collections.Counter(), collections.Counter()
    for r in stages[4]:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in stages[5]:
        assert r.copies in (1, 2) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    want = brute_targets(sizes)
    largest = max(r.size for r in stages[5])
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    assert ids(stages[5]) <= ids(stages[4])


def test_odd_rows(spark, sf):
    """Nulls, empty and long texts, repeats, and columns with the names that operators use inside."""
    extra = [c.replace("`", "").split() for c in CLASHING.split(", ")]
    fill = {"string": "x", "double": 0.5, "long": 7}
    rows = [(*r, "en", "s" if r[0] != 4 else None, 3, *[fill[t] for _, t in extra]) for r in ODD]
    docs = spark.createDataFrame(rows, f"{NAMES}, {CLASHING}")
    want = {"toxicity": 11, "line_dedup": 11, "near_dedup": 9, "decontaminate": 11, "mix": None}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert want[name] is None or len(got) == want[name], name
        for r in got:
            assert all(r[c] == fill[t] for c, t in extra if c in out.columns), name
        if name != "mix":
            assert out.dtypes == docs.dtypes, name
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0 and empty.columns == out.columns


def test_operators_keep_clashing_columns(spark):
    from telesift.llm import substrings, urls

    extra = [c.replace("`", "").split() for c in CLASHING.split(", ")]
    fill = {"string": "x", "double": 0.5, "long": 7}
    values = [fill[t] for _, t in extra]
    text = "".join(f"{i}," for i in range(60))[:150]
    docs = spark.createDataFrame([(1, text, *values), (2, text, *values)], f"doc_id long, text string, {CLASHING}")
    got = substrings.remove_repeats(docs).orderBy("doc_id").collect()
    assert [len(r.kept) for r in got] == [150, 0] and all(r[c] == fill[t] for r in got for c, t in extra)
    pages = spark.createDataFrame([(1, "http://a.org/", "", *values)], f"page_id long, url string, html string, {CLASHING}")
    r = urls.judge(pages).first()
    assert r.verdict == "allow" and all(r[c] == fill[t] for c, t in extra)
