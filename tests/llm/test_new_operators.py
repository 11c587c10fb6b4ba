"""Spelling variants, whitening and packing against plain versions, on the smallest tables and on odd rows."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import ODD, docs

from telesift.llm import packing, queries, spelling, whitening

# 11

RUN = re.compile("[a-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, noise=97):
    n = collections.Counter()
    for i, text in rows:
        for w in RUN.findall((text or "").translate(FOLD)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % noise == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_edit_apart(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        if others and n[best := min(others, key=lambda x: (-n[x], x))] >= 2 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def got_variants(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got_variants(queries.QUERIES["op11_spelling_variants"](spark, sf)) == brute_variants(brute_counts(rows))


def test_word_counts_odd(spark):
    rows = [*ODD, *ODD, *ODD, (None, "ÀÿABCd×e abcde ABCDE abcde-abcde Ābcdef")]
    for noise in (97, 2, 1):
        got = {r.word: r.n for r in spelling.word_counts(docs(spark, rows), noise=noise).collect()}
        assert got == brute_counts(rows, noise)
    assert spelling.word_counts(docs(spark, [])).count() == 0


@pytest.mark.parametrize("most", [3, 4096])
@pytest.mark.parametrize("alphabet, lengths", [("ab", (5, 9)), ("abcd", (5, 8)), ("aéz", (5, 7)), ("xy你\U0001f600", (2, 7))])
def test_variants_dense(spark, alphabet, lengths, most):
    """Dense vocabularies, with grams that repeat in a word, short words, ties of n, and keys in blocks."""
    rng = np.random.default_rng(len(alphabet) + most)
    words = {"".join(rng.choice(list(alphabet), rng.integers(*lengths))) for _ in range(400)}
    n = {w: int(2 ** rng.integers(0, 9)) for w in sorted(words)}
    got = got_variants(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3), most=most))
    assert got == brute_variants(n)


def test_variants_chain(spark):
    """A chain of forms, each twice as frequent as the one before; a null word; an empty table."""
    words = ["a" * i + "b" * (20 - i) for i in range(21)]
    n = {w: 3 << i for i, w in enumerate(words)}
    d = spark.createDataFrame([*n.items(), (None, 5)], "word string, n long")
    got = got_variants(spelling.variants(d))
    assert got == brute_variants(n) and {r[1] for r in got.values()} == {"a" * 20}
    short = got_variants(spelling.variants(spark.createDataFrame([("a", 1), ("b", 9), ("ab", 2), ("", 3)], "word string, n long")))
    assert short == {"a": (None, "a", 1, 0, None), "b": (None, "b", 9, 0, None), "ab": (None, "ab", 2, 0, None), "": (None, "", 3, 0, None)}
    assert spelling.variants(d.limit(0)).count() == 0


# 12


def brute_whitened(x, k=16):
    """Distinct count, and by row deviations, whitened values and explained shares, from the whole covariance."""
    x = np.floor(64 * np.asarray(x, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, np.square(x * n - sums).sum(axis=1), ((x * n - sums) / n) @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def check_whitened(got, ids, x, k, close=1e-8):
    n, deviation, want, share = brute_whitened(x, k)
    k = want.shape[1]
    got = got.assign(nth=got.groupby(["vec_id", "component"]).cumcount()).sort_values(["vec_id", "nth", "component"], kind="stable")
    assert len(got) == len(ids) * k and set(got["n"]) == {n}
    values = got["whitened"].to_numpy().reshape(-1, k)
    order = np.argsort(ids, kind="stable")
    signs = np.sign((values * want[order]).sum(axis=0))
    assert np.abs(values - want[order] * signs).max() < close
    assert (got["deviation"].to_numpy()[::k] == deviation[order]).all()
    assert np.allclose(got["explained"].to_numpy()[:k], share, rtol=1e-9) and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-8


def test_whitening_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [r for r in rows if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check_whitened(queries.QUERIES["op12_whitening"](spark, sf).toPandas(), np.array([r.vec_id for r in good]), [r.embedding for r in good], 16)


VECTORS = "vec_id long, embedding array<float>, n string, component string, `a.b` int, _row int, _v int, _x int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 5, 6, 7, 8) for i, v in rows], VECTORS)


def test_whitening_few_passes(spark):
    """A steep spectrum converges with a narrow block, in more passes the flatter it is; a quite flat one gets wider
    blocks, up to all dimensions.  All are right."""
    rng = np.random.default_rng(12)
    for scale, passes in ((0.5 ** np.arange(60), (2, 3)), (0.8 ** np.arange(60), (4, 20)), (np.ones(60), (3, 4))):
        x = (rng.normal(size=(900, 60)) * scale * 20).astype(np.float32)
        out = whitening.whiten(vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)]).repartition(5), k=3)
        check_whitened(out.toPandas(), np.arange(900), x, 3)
        fit = out.sparkSession.createDataFrame([([int(c) for c in v],) for v in np.unique(np.floor(64 * x.astype(float)).astype(int), axis=0)], "x array<long>")
        found = whitening.components(fit, fit.count(), 60, 3)
        assert passes[0] <= found.passes <= passes[1] and found.vectors.shape == (60, 3)


def test_whitening_odd(spark):
    """Null, empty, non-finite and repeated vectors, null ids, another length, clashing names."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(40, 6)).round(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(50, None), (51, []), (52, [None] * 6), (53, [float("nan")] * 6), (54, [float("inf")] + [0.0] * 5), (55, [1.0, 2.0]), (None, rows[0][1])]
    d = vectors(spark, rows + rows[:30] * 3 + odd)
    out = whitening.whiten(d)
    assert out.columns == ["vec_id", "embedding", "a.b", "_row", "_v", "_x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.toPandas()
    ids = np.array([i for i, _ in rows + rows[:30] * 3] + [10**6])
    check_whitened(got.fillna({"vec_id": 10**6}), ids, [v for _, v in rows + rows[:30] * 3 + rows[:1]], 6)
    for some in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, odd[:5]):
        assert whitening.whiten(vectors(spark, some)).count() == 0
    two = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert [(r.component, r.deviation, abs(r.whitened), r.explained) for r in two] == [(1, 128**2, 1.0, 1.0)] * 2


def test_whitening_overflow(spark):
    with pytest.raises(Exception, match="long|overflow|OVERFLOW"):
        whitening.whiten(vectors(spark, [(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0])])).collect()


# 13

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokens_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode((x or ""), add_special_tokens=False).ids, 0] for x in texts]


def check_packing(rows, out, window=1024, short=1):
    """Each row's ids lie in one piece each, in order; sequences have no gaps and `short` of them are not full."""
    want = collections.Counter((i, tuple(ids)) for (i, _), ids in zip(rows, tokens_of([t for _, t in rows]), strict=True))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        by_doc[r.doc_id].append((r.start, r.doc_tokens, ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert sum(sum(n for _, n in p) < window for p in by_sequence.values()) <= short
    if max(collections.Counter(i for i, _ in rows).values(), default=1) == 1:
        got = {i: tuple(x for _, _, ids in sorted(p) for x in ids) for i, p in by_doc.items()}
        assert collections.Counter(got.items()) == want
        assert all(total == len(got[i]) for i, p in by_doc.items() for _, total, _ in p)
    assert collections.Counter(x for p in by_doc.values() for _, _, ids in p for x in ids) == collections.Counter(x for (_, ids), k in want.items() for x in list(ids) * k)


def test_packing_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = packing.pack(docs(spark, rows), PATH).collect()
    check_packing(rows, out, short=4)
    got = queries.QUERIES["op13_retrieval_packing"](spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = dict(zip((i for i, _ in rows), tokens_of([t for _, t in rows]), strict=True))
    for r in got.collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])


@pytest.mark.parametrize("window, shard", [(64, 8), (1024, 1024), (5, 3), (1, 4)])
def test_packing_odd(spark, window, shard):
    rows = [(i, "".join(f"{j * i % 7} word{j % 5} " for j in range(i * 3))) for i in range(40)] + [(100, None), (101, ""), (102, "<|endoftext|> in a text"), (103, "你好 \U0001f600\x00\r\n  "), (None, "no id")]
    check_packing(rows, packing.pack(docs(spark, rows), PATH, window=window, shard=shard).collect(), window, short=4)
    check_packing(ODD, packing.pack(docs(spark, ODD), PATH, window=window, shard=shard).collect(), window, short=4)
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_packing_empty_texts(spark):
    rows = [(i, "") for i in range(3000)]
    check_packing(rows, packing.pack(docs(spark, rows).coalesce(1), PATH).collect(), short=4)


def test_neighbours_by_bm25():
    """Ranks of unused pieces by brute force, before and after some are used."""
    rng = np.random.default_rng(14)
    ids = [rng.integers(0, 40, rng.integers(1, 60)).astype("<u4") for _ in range(50)]
    held = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=40)
    stats = packing.Stats(50, float(np.mean([len(x) for x in ids])), held)
    shard = packing.Shard(ids, stats, stats.idf())

    def score(q, d):
        total = 0.0
        for t in set(q.tolist()):
            tf = (ids[d] == t).sum()
            total += np.log1p((50 - held[t] + 0.5) / (held[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ids[d]) / stats.mean)) if tf else 0
        return total

    for used in ((), (3, 4, 5), tuple(range(20))):
        shard.left[list(used)] = 0
        shard.compact()
        for seed in (30, 41):
            free = [i for i in range(50) if i not in used and i != seed]
            assert shard.ranked(seed).tolist() == sorted(free, key=lambda d: (-round(score(ids[seed], d), 9), d))


def test_packing_keeps_topics_together(spark):
    """Documents of one topic fill windows together, whatever order they come in."""
    rng = np.random.default_rng(15)
    rows = [(i, " ".join(f"{'abcdefgh'[i % 8] * 3}{rng.integers(0, 40)}" for _ in range(60))) for i in range(160)]
    out = packing.pack(docs(spark, rows).coalesce(1), PATH).collect()
    topics = collections.defaultdict(set)
    for r in out:
        topics[r.sequence_id].add(r.doc_id % 8)
    assert np.mean([len(t) for t in topics.values()]) < 2.5


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, " " * 3000, "It's  they'll\n\n x", "é́你好\U0001f600‍", "<|endoftext|>", "a<|endoftext|>b", "\x00\x7f\x80", "1234567890 12,5"])
def test_encoder(text):
    assert packing.encoder(PATH)([text])[0] == tokens_of([text])[0][:-1]


def test_encoder_many(sf):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]
    assert [[*x, 0] for x in packing.encoder(PATH)(texts)] == tokens_of(texts)
    other = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    assert packing.encoder(other)(texts[:5]) == [e.ids for e in Tokenizer.from_file(other).encode_batch(texts[:5], add_special_tokens=False)]
