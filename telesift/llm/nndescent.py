"""Near-duplicate vectors by NN-descent."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, shared
from .components import components


def unit(column) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stacked(column) -> np.ndarray:
    """Unit vectors that are held as the bytes of their components."""
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def usable(column: str) -> F.Column:
    """Not null, not empty, not all zero, no component null or not finite."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(column).isNotNull() & ~bad & F.exists(column, lambda v: v != 0)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u, ties to the smaller v."""
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    one = found.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"), F.max("turn").alias("turn"))
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def start(vectors: DataFrame, n: int, k: int, trees: int, block: int, seed: int) -> DataFrame:
    """A first graph: neighbours within blocks of vectors on the same side of random planes, for several sets of planes.

    vectors: id, x, label, open.  Open vectors get lists, and only of vectors with another label.
    """
    bits = max(0, math.ceil(math.log2(max(n, 1) / block)))

    def code(batches):
        for batch in batches:
            x = stacked(batch["x"])
            for t in range(trees):
                planes = np.random.default_rng([seed, t]).standard_normal((x.shape[1], max(bits, 1)))
                side = (x @ planes > 0) @ (1 << np.arange(max(bits, 1))) if bits else np.zeros(len(x), dtype=np.int64)
                yield pd.DataFrame({"t": t, "code": side.astype(np.int64), "id": batch["id"]})

    codes = cut(vectors.select("id", "x").mapInPandas(code, "t int, code long, id long"))
    counts = codes.groupBy("t", "code").agg(F.count("*").alias("c")).select(F.col("t").alias("_t"), F.col("code").alias("_c"), F.ceil(F.col("c") / (2 * block)).alias("parts"))
    spread = codes.join(shared(counts), (F.col("t") == F.col("_t")) & (F.col("code") == F.col("_c")))
    spread = spread.select("t", "code", F.pmod(F.xxhash64("id", "t"), F.col("parts")).alias("part"), "id").join(vectors.select("id", "x", "label", "open"), "id")

    def near(g: pd.DataFrame) -> pd.DataFrame:
        ids, x, label, rows = g["id"].to_numpy(), stacked(g["x"]), g["label"].to_numpy(), np.flatnonzero(g["open"].to_numpy())
        m, out = min(k, len(ids) - 1), [pd.DataFrame({"u": [], "v": [], "sim": []})]
        for a in range(0, len(rows) if m > 0 else 0, 1024):
            r = rows[a : a + 1024]
            s = x[r] @ x.T
            s[label[r][:, None] == label[None, :]] = -2
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            sim = np.take_along_axis(s, top, 1).ravel()
            out.append(pd.DataFrame({"u": np.repeat(ids[r], m), "v": ids[top].ravel(), "sim": sim})[sim > -2])
        return pd.concat(out)

    found = spread.groupBy("t", "code", "part").applyInPandas(near, "u long, v long, sim double")
    return best(found.select("*", F.lit(False).alias("old"), F.lit(False).alias("turn")), k)


def refine(graph: DataFrame, vectors: DataFrame, k: int, inner: DataFrame | None = None) -> DataFrame:
    """One round: all that meet at a vector, as its neighbours or as those it is a neighbour of, are compared.

    Of those that chose a vector, 2k take part for it in a round, first those that have not had their turn; `turn` says
    who had it, `old` what has met as a neighbour.  Pairs that met before are left out.  inner: lists inside labels,
    whose vectors meet as well, so that what lies beyond a label is found through its other vectors.
    """
    kth = graph.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("c")).select(F.col("u").alias("_u"), F.when(F.col("c") < k, -2.0).otherwise(F.col("least")).alias("least"))
    queue = Window.partitionBy("v").orderBy("turn", F.xxhash64("u", "v"))
    g = graph.withColumn("now", F.row_number().over(queue) <= 2 * k)
    meet = g.select(F.col("u").alias("p"), F.col("v").alias("id"), "old").unionByName(g.where("now").select(F.col("v").alias("p"), F.col("u").alias("id"), F.col("turn").alias("old")))
    if inner is not None:
        meet = meet.unionByName(inner.select(F.col("u").alias("p"), F.col("v").alias("id"), F.lit(True).alias("old")))
    meet = meet.groupBy("p", "id").agg(F.min("old").alias("old"))
    fresh = meet.where("not old").select("p").distinct()
    rows = meet.join(fresh, "p", "left_semi").join(vectors.select("id", "x", "label", "open"), "id").join(kth, F.col("id") == F.col("_u"), "left")
    rows = rows.select("p", "id", "old", "x", "label", "open", F.coalesce("least", F.lit(-2.0)).alias("least"))

    def local(batches):
        """Rows come sorted by p; the last p of a batch waits for the next."""
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            p = held["p"].to_numpy()
            if p[0] != p[-1]:
                last = int(np.searchsorted(p, p[-1]))
                yield met(held.iloc[:last])
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None:
            yield met(held)

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        p, ids, old, least, label, may = (rows[c].to_numpy() for c in ("p", "id", "old", "least", "label", "open"))
        x = stacked(rows["x"])
        edge = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
        out: list[tuple] = []
        for a, b in zip(edge, edge[1:], strict=False):
            s = x[a:b] @ x[a:b].T
            better = (s > least[a:b, None]) & may[a:b, None] & (label[a:b, None] != label[None, a:b]) & ~(old[a:b, None] & old[None, a:b])
            i, j = np.nonzero(better)
            out.append((ids[a + i], ids[a + j], s[i, j]))
        u, v, sim = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"u": u, "v": v, "sim": sim})

    found = rows.repartition("p").sortWithinPartitions("p").mapInPandas(local, "u long, v long, sim double").select("*", F.lit(False).alias("old"), F.lit(False).alias("turn"))
    return best(g.select("u", "v", "sim", F.lit(True).alias("old"), (F.col("turn") | F.col("now")).alias("turn")).unionByName(found), k)


def counted(members: DataFrame, vectors: DataFrame, least: float, block: int = 1000) -> DataFrame:
    """(id, n): the exact number of links of each vector of members (component, id) within its component.

    A component is cut into cells around some of its vectors.  The angles between these and the radii of the cells bound
    every angle between two cells: of most pairs of cells all vectors are linked, or none, and sizes are enough.
    Vectors are compared only for the other pairs, in tiles of about `block` by `block`, which return counts, not pairs.
    """
    angle, slack = math.acos(least), 1e-6
    size = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    m = cut(members.join(size, "component").join(vectors.select("id", "x", "w"), "id"))
    heads = cut(m.where((F.pmod(F.xxhash64("id"), F.lit(block)) == 0) | (F.col("id") == F.col("component"))).select("component", "id", "x", "nb"))
    own = m.select("component", F.pmod(F.xxhash64(F.lit(1), "id"), "nb").cast("int").alias("part"), F.lit(False).alias("head"), "id", "x")
    rows = own.unionByName(heads.select("component", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("part"), F.lit(True).alias("head"), "id", "x"))

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        h, r = g[g["head"]].sort_values("id"), g[~g["head"]]
        if not len(r):
            return pd.DataFrame({"component": [], "id": [], "cell": [], "angle": []})
        s, xr, ids = stacked(h["x"]), stacked(r["x"]), h["id"].to_numpy()
        best, sim = np.zeros(len(r), np.int64), np.full(len(r), -2.0)
        for a in range(0, len(s), 1024):
            c = xr @ s[a : a + 1024].T
            k = c.argmax(axis=1)
            top = c[np.arange(len(r)), k]
            best, sim = np.where(top > sim, ids[a + k], best), np.maximum(sim, top)
        return pd.DataFrame({"component": g["component"].iloc[0], "id": r["id"].to_numpy(), "cell": best, "angle": np.arccos(np.clip(sim, -1, 1))})

    cells_of = cut(rows.groupBy("component", "part").applyInPandas(assign, "component long, id long, cell long, angle double").join(m.select("id", "w"), "id"))
    cells = cells_of.groupBy("component", "cell").agg(F.sum("w").alias("w"), F.max("angle").alias("radius"), F.ceil(F.count("*") / (2 * block)).cast("int").alias("parts"))
    cells = cut(cells.join(heads.select(F.col("id").alias("cell"), "x"), "cell"))
    many = cells.groupBy("component").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("nc"))
    c = cells.join(many, "component")
    mine = c.select("component", F.pmod(F.xxhash64(F.lit(2), "cell"), "nc").cast("int").alias("part"), F.lit(True).alias("mine"), "cell", "x", "w", "radius", "parts")
    c = mine.unionByName(c.select("component", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("part"), F.lit(False).alias("mine"), "cell", "x", "w", "radius", "parts"))

    def bound(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["mine"]], g[~g["mine"]]
        apart = np.arccos(np.clip(stacked(a["x"]) @ stacked(b["x"]).T, -1, 1)) if len(a) else np.zeros((0, len(b)))
        reach = a["radius"].to_numpy()[:, None] + b["radius"].to_numpy()[None, :]
        whole = apart + reach <= angle - slack
        some = ~whole & (apart - reach <= angle + slack)
        other, parts = b["cell"].to_numpy(), b["parts"].to_numpy()
        return pd.DataFrame({"component": a["component"], "cell": a["cell"], "parts": a["parts"], "sure": whole @ b["w"].to_numpy(), "self": (whole & (a["cell"].to_numpy()[:, None] == other[None, :])).any(axis=1), "other": [[{"cell": int(c), "parts": int(p)} for c, p in zip(other[r], parts[r], strict=True)] for r in some]})

    bounds = cut(c.groupBy("component", "part").applyInPandas(bound, "component long, cell long, parts int, sure long, self boolean, other array<struct<cell:long,parts:int>>"))
    sure = cells_of.join(bounds.select("cell", "sure", "self"), "cell").select("id", (F.col("sure") - F.when(F.col("self"), F.col("w")).otherwise(0)).alias("n"))
    pairs = bounds.select("cell", "parts", F.explode("other").alias("o")).select("cell", "parts", F.col("o.cell").alias("other"), F.col("o.parts").alias("oparts"))
    full = cells_of.select("id", "cell", "w").join(vectors.select("id", "x"), "id")

    def side(key: str, own: str, others: str, row: bool) -> DataFrame:
        """Vectors of one side of the pairs: each in its own part, and there for every part of the other side."""
        p = pairs.select(F.col("cell").alias("a"), F.col("other").alias("b"), F.col("parts").alias("na"), F.col("oparts").alias("nb"))
        here, there = ("i", "j") if row else ("j", "i")
        at = full.join(p, F.col("cell") == F.col(key)).select("a", "b", F.pmod(F.xxhash64(F.lit(3), "id"), own).cast("int").alias(here), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(there), "id", "x", "w")
        return at.select("a", "b", "i", "j", F.lit(row).alias("row"), "id", "x", "w")

    def tile(g: pd.DataFrame) -> pd.DataFrame:
        r, c = g[g["row"]], g[~g["row"]]
        if not len(r) or not len(c):
            return pd.DataFrame({"id": [], "n": []})
        s = stacked(r["x"]) @ stacked(c["x"]).T >= least
        s &= r["id"].to_numpy()[:, None] != c["id"].to_numpy()[None, :]
        return pd.DataFrame({"id": r["id"].to_numpy(), "n": s @ c["w"].to_numpy()})

    tiles = side("a", "na", "nb", True).unionByName(side("b", "nb", "na", False)).groupBy("a", "b", "i", "j").applyInPandas(tile, "id long, n long")
    return sure.unionByName(tiles).groupBy("id").agg(F.sum("n").alias("n"))


def audit(vectors: DataFrame, found: DataFrame, least: float, queries: int) -> float:
    """Recall against brute force of `queries` vectors at most, each compared with all vectors in blocks.

    found: id, component, n links.  The mean over the vectors that have links, each counting alike however many it has,
    of two shares: links that were counted, and links whose other end is in the same component.  The lower one counts.
    """
    named = vectors.join(found, "id", "left").select("id", "x", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component"))
    asked = named.orderBy(F.xxhash64("id"), "id").limit(queries).orderBy("id").collect()
    if not asked:
        return 1.0
    ids, q, home = np.array([r["id"] for r in asked]), stacked([r["x"] for r in asked]), np.array([r["component"] for r in asked])

    def count(batches):
        for batch in batches:
            s = stacked(batch["x"]) @ q.T >= least
            s &= batch["id"].to_numpy()[:, None] != ids[None, :]
            here = batch["component"].to_numpy()[:, None] == home[None, :]
            yield pd.DataFrame({"id": ids, "n": batch["w"].to_numpy() @ s, "same": batch["w"].to_numpy() @ (s & here)})

    exact = {r["id"]: r for r in named.mapInPandas(count, "id long, n long, same long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("same").alias("same")).collect()}
    real = [(min(r["n"], e["n"]) / e["n"], e["same"] / e["n"]) for r in asked if (e := exact[r["id"]])["n"]]
    return float(np.mean(real, axis=0).min()) if real else 1.0


def near_vectors(embeddings: DataFrame, least: float = 0.9, k: int = 10, rounds: int = 2, trees: int = 8, block: int = 256, queries: int = 512, recall: float = 0.97, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: links are pairs of cosine `least` or more.

    Equal vectors are one vector with a weight.  A first graph of k neighbours each is refined in rounds.  A list is
    saturated if even its last neighbour is a link: then it goes on with k neighbours outside the component that is
    known so far, again and again, until no component gains a link; within a component all links are counted exactly, by
    cells.  Then `queries` vectors are compared with all others.  Below `recall` all starts again with lists and blocks
    twice as long, until the audit passes; blocks that hold all vectors give exact lists, so it ends.
    Every cosine is in double precision, so no link is below the threshold.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of
    another length than theirs (lengths are worked on apart).  Rows that share a vec_id count as separate vectors if
    they differ; the id has the links of all of them.  A null vec_id gets nulls.
    """
    e = embeddings.select("vec_id", F.col("embedding").alias("x")).where("vec_id is not null")
    good = e.where(usable("x")).withColumn("d", F.size("x"))
    sizes = [r["d"] for r in good.select("d").distinct().collect()]
    parts = [one_length(good.where(F.col("d") == d).drop("d"), least, k, rounds, trees, block, queries, recall, seed) for d in sorted(sizes)]
    ids = embeddings.select("vec_id")
    if not parts:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("component").alias("component")).withColumnRenamed("vec_id", "_v")
    out = ids.join(found, F.col("vec_id") == F.col("_v"), "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def one_length(rows: DataFrame, least, k, rounds, trees, block, queries, recall, seed) -> DataFrame:
    """(vec_id, n, component) for vectors of one length."""
    key = F.sha2(F.to_binary(F.to_json(F.struct("x")), F.lit("utf-8")), 256)
    keyed = cut(rows.withColumn("key", key))
    vectors = keyed.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("x").alias("x"))

    def scaled(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "id": b["id"], "w": b["w"], "x": [r.tobytes() for r in unit(b["x"])]})

    vectors = cut(vectors.select("key", "id", "w", "x").mapInPandas(scaled, "key string, id long, w long, x binary"))
    # one id may stand for several vectors only if the table repeats it; then they are numbered apart by their hash
    twice = vectors.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    if not twice.isEmpty():
        vectors = cut(vectors.join(twice.withColumn("_more", F.lit(True)), "id", "left").withColumn("id", F.when("_more", F.xxhash64("key")).otherwise(F.col("id"))).drop("_more"))
    v = vectors.select("id", "x", "w")
    n = v.count()

    def descend(labelled: DataFrame, inner: DataFrame | None = None) -> DataFrame:
        graph = cut(start(labelled, n, k, trees, block, seed))
        for _ in range(rounds):
            old = graph
            graph = cut(refine(graph, labelled, k, inner))
            drop(old)
        return graph

    while True:
        graph = descend(v.select("id", "x", F.col("id").alias("label"), F.lit(True).alias("open")))
        near = graph.where(F.col("sim") >= least)
        links = cut(near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
        comp = cut(components(links))
        full = near.groupBy("u").agg(F.count("*").alias("c")).where(F.col("c") >= k).select(F.col("u").alias("id"))
        full = cut(full)
        more = not full.isEmpty()
        while more:
            # saturated lists go on outside their components, until no component gains a link
            open_ = comp.join(full, "id", "left_semi").select("component").distinct().withColumn("open", F.lit(True))
            label = comp.join(open_, "component", "left").select("id", F.col("component").alias("label"), "open")
            labelled = cut(v.join(label, "id", "left").select("id", "x", F.coalesce("label", "id").alias("label"), F.coalesce("open", F.lit(False)).alias("open")))
            beyond = descend(labelled, graph).where(F.col("sim") >= least).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
            beyond = cut(beyond)
            more = not beyond.isEmpty()
            if more:
                links = cut(links.unionByName(beyond).distinct())
                comp = cut(components(links))
        grown = comp.join(comp.join(full, "id", "left_semi").select("component").distinct(), "component", "left_semi")
        both = links.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("o")))
        plain = both.join(v.select(F.col("id").alias("o"), "w"), "o").groupBy("id").agg(F.sum("w").alias("n"))
        exact = counted(grown.select("component", "id"), v, least).withColumnRenamed("n", "n2")
        found = cut(comp.join(plain, "id", "left").join(exact, "id", "left").select("id", "component", F.coalesce("n2", "n", F.lit(0)).cast("long").alias("n")))
        if block >= n or audit(v, found, least, queries) >= recall:
            break
        k, block = 2 * k, 2 * block
    named = keyed.select("key", "vec_id").join(vectors.select("key", "id", "w").join(found, "id", "left"), "key")
    # components by their smallest vec_id
    named = named.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    name = named.groupBy("c").agg(F.min("vec_id").alias("component"))
    return named.join(name, "c").select("vec_id", "n", "component")
