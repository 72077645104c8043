"""Near-duplicate embeddings: an exact cosine threshold join within labels, by tiles ordered along principal components.

Vectors that are equal component by component are one class.  Classes are turned to principal axes and cut, label by label,
in cells along the first two axes: two unit vectors with cosine t differ by at most sqrt(2 - 2t) in any coordinate, so only
vectors of one cell or of neighbouring cells can link.  Cells are dealt out in tiles of bounded size and every pair of tiles
is compared in one task: leading dimensions first, dropping a pair as soon as its sum so far plus the product of what is
left of both norms cannot reach the threshold.  Pairs that are left are decided in double precision on the given components.
A pair of tiles returns sums of links and a spanning forest, never the pairs.

The axes come from a bounded sample; any orthonormal axes give the same result, good ones give it sooner.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, components, forest, sliced, table

NAME = "op1_near_embeddings"
THRESHOLD = 0.98
#: Vectors of a tile, on average.
TILE = 1_000
#: Vectors that the axes are fitted to, on average: those of the least hash, up to the sum of all rows.
SAMPLE = 4_000
#: Dimensions that are added at a time.
STEPS = (8, 16, 32, 64, 128, 256, 512)


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows in doubles times a power of two each, so that squares neither vanish nor overflow; cosines stay as they are."""
    m = m.astype(np.float64)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """dimension -> orthonormal axes (columns), most variance first, of the sampled unit vectors of that dimension."""
    found = {}
    rows: dict[int, list] = {}
    for (e,) in vectors.select("e").toLocalIterator():
        rows.setdefault(len(e), []).append(e)
    for d, some in rows.items():
        m = scaled(np.array(some, np.float64))
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        found[d] = np.linalg.eigh(u.T @ u)[1][:, ::-1].copy()
    return found


def linked(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) of cosine >= t; px, py: the same unit vectors along principal axes.  same: x is y, each pair once."""
    d = px.shape[1]
    left = lambda p: np.sqrt(np.maximum(0, np.cumsum((p * p)[:, ::-1], axis=1)[:, ::-1]))  # noqa: E731  norm of what follows
    rx, ry = (np.concatenate([left(p), np.zeros((len(p), 1))], axis=1) for p in (px, py))
    k = min(STEPS[0], d)
    dot = px[:, :k] @ py[:, :k].T
    alive = dot + np.outer(rx[:, k], ry[:, k]) >= t - 1e-9
    if same:
        alive &= np.tri(len(x), len(y), -1, dtype=bool).T
    i, j = np.nonzero(alive)
    norm = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    out = []
    for at in range(0, len(i), 100_000):
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        s, done = dot[a, b], k
        while done < d and len(a):
            end = min(d, next((v for v in STEPS if v > done), 2 * done))
            s = s + np.einsum("ij,ij->i", px[a, done:end], py[b, done:end])
            done = end
            keep = s + rx[a, done] * ry[b, done] >= t - 1e-9
            a, b, s = a[keep], b[keep], s[keep]
        c = np.empty(len(a))
        for m in range(0, len(a), 20_000):
            p, q = a[m : m + 20_000], b[m : m + 20_000]
            c[m : m + 20_000] = np.einsum("ij,ij->i", x[p], y[q]) / (norm[0][p] * norm[1][q])
        out.append((a[c >= t], b[c >= t]))
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (i, j)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: other rows of its label with cosine >= threshold, the smallest
    vec_id reachable by links, and whether that is its own.

    Null labels, and vectors that are null, empty, of norm zero, or hold null or non-finite components, link with nothing;
    so do vectors of different dimension.  Components may be as small or large as doubles can be.  Rows that repeat a vector
    link with each other.  A row without vec_id links with nothing and is not kept.  Rows that repeat a vec_id are one node of
    the graph, with one component_id; each has the links of its own vector.  An empty table gives none; columns other than
    vec_id, embedding and label are not read.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < math.inf) & ~F.isnan(x))
    fit = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0),
        F.lit(False),
    )
    key = F.when(fit, F.concat_ws(":", F.xxhash64("label", e).cast("string"), F.hash("label", e).cast("string")))
    rows = vectors.select(F.col("vec_id"), F.col("label"), e.alias("e"), key.alias("k"))
    classes = checkpointed(
        rows.filter("k is not null").groupBy("k").agg(
            F.min("vec_id").alias("rep"),
            F.count("*").alias("n"),
            F.first("label").alias("label"),
            F.first("e").alias("e"),
        )
    )
    count, dims = classes.count(), classes.select(F.size("e").alias("d")).distinct()
    some = F.xxhash64("k") / 2.0**64 + 0.5 < min(1.0, SAMPLE / max(1, count))
    axes = principal_axes(classes.filter(some))
    for (d,) in dims.toLocalIterator():  # a dimension that the sample missed
        axes.setdefault(d, np.eye(d))
    axes = vectors.sparkSession.sparkContext.broadcast(axes)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-12

    def cells(batches):
        for b in sliced(batches, 2048):
            v = b.column(0).to_numpy(zero_copy_only=False)
            x, y, dim = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.fromiter(map(len, v), np.int64, len(v))
            for d in np.unique(dim):
                m = scaled(np.stack([v[i] for i in np.flatnonzero(dim == d)]))
                at = np.floor((m @ axes.value[int(d)][:, :2]) / np.linalg.norm(m, axis=1, keepdims=True) / width).astype(np.int64)
                x[dim == d], y[dim == d] = at[:, 0], at[:, -1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(dim), pa.array(x), pa.array(y)],
                names=["e", "k", "rep", "n", "label", "d", "x", "y"],
            )

    kinds = dict(classes.dtypes)
    banded = classes.select("e", "k", "rep", "n", "label").mapInArrow(
        cells,
        f"e {kinds['e']}, k string, rep {kinds['rep']}, n long, label {kinds['label']}, d long, x long, y long",
    )
    sizes = checkpointed(banded.groupBy("label", "d", "x", "y").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    # Of two neighbouring cells the one that comes first is where they meet.
    steps = [(0, 0), *((u, v) for u in (-1, 0, 1) for v in (-1, 0, 1) if (u, v) != (0, 0))]
    step = F.explode(F.array(*[F.struct(F.lit(u).cast("long").alias("u"), F.lit(v).cast("long").alias("v")) for u, v in steps])).alias("s")
    beside = sizes.select("label", "d", "x", "y", "tiles", step).select(
        F.col("label").alias("_l"),
        F.col("d").alias("_d"),
        (F.col("x") - F.col("s.u")).alias("_x"),
        (F.col("y") - F.col("s.v")).alias("_y"),
        F.struct("s.u", "s.v", "tiles").alias("o"),
    )
    beside = checkpointed(beside.groupBy("_l", "_d", "_x", "_y").agg(F.collect_list("o").alias("beside")))
    same_cell = (F.col("label") == F.col("_l")) & (F.col("d") == F.col("_d")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    dealt = banded.join(beside.hint("merge"), same_cell)
    h = F.xxhash64("k")

    def places_in(o):
        """Where a vector goes for one of the cells beside its own, which is given by its steps u and v and its tiles."""
        here, first = (o["u"] == 0) & (o["v"] == 0), (o["u"] > 0) | ((o["u"] == 0) & (o["v"] > 0))
        own = F.pmod(h, F.col("own")).cast("int")
        place = lambda j: F.struct(
            F.when(first | here, F.col("x")).otherwise(F.col("x") + o["u"]).alias("px"),
            F.when(first | here, F.col("y")).otherwise(F.col("y") + o["v"]).alias("py"),
            F.when(first, o["u"]).otherwise(-o["u"]).alias("u"),
            F.when(first, o["v"]).otherwise(-o["v"]).alias("v"),
            F.when(here, F.least(own, j)).when(first, own).otherwise(j).alias("a"),
            F.when(here, F.greatest(own, j)).when(first, j).otherwise(own).alias("b"),
            F.when(here, own <= j).otherwise(first).alias("left"),
        )
        return F.transform(F.sequence(F.lit(0), o["tiles"] - 1), place)

    own_tiles = F.element_at(F.filter("beside", lambda o: (o["u"] == 0) & (o["v"] == 0)), 1)["tiles"]
    dealt = dealt.withColumn("own", own_tiles)
    placed = dealt.select(
        "label",
        "d",
        "k",
        "rep",
        "n",
        "e",
        F.explode(F.flatten(F.transform("beside", places_in))).alias("p"),
    ).select("label", "d", "k", "rep", "n", "e", "p.*")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        v = scaled(np.stack(pdf["e"].to_numpy()))
        p = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ axes.value[v.shape[1]]
        side = pdf["left"].to_numpy()
        same = pdf["u"].iloc[0] == pdf["v"].iloc[0] == 0 and pdf["a"].iloc[0] == pdf["b"].iloc[0]
        l, r = (np.arange(len(v)),) * 2 if same else (np.flatnonzero(side), np.flatnonzero(~side))
        if not len(l) or not len(r):
            return pdf.iloc[:0][["k", "rep"]].assign(links=np.empty(0, np.int64), root=np.empty(0, np.int64))
        a, b = linked(v[l], v[r], p[l], p[r], threshold, same)
        a, b = l[a], r[b]
        ids, n = pdf["rep"].to_numpy(), pdf["n"].to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        links = np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
        root = ids[order][forest(len(ids), place[a], place[b])[place]]
        some = links > 0
        return pd.DataFrame({"k": pdf["k"].to_numpy()[some], "rep": ids[some], "links": links[some].astype(np.int64), "root": root[some]})

    found = placed.groupBy("label", "d", "px", "py", "u", "v", "a", "b").applyInPandas(
        compare,
        f"k string, rep {kinds['rep']}, links long, root {kinds['rep']}",
    )
    found = checkpointed(found)
    links = found.groupBy(F.col("k").alias("_r")).agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    # Rows that repeat an id tie the classes that they belong to together.
    repeated = checkpointed(
        rows.filter("vec_id is not null").groupBy(F.col("vec_id").alias("_v")).agg(F.count("*").alias("c")).filter("c > 1").select("_v")
    )
    tied = bool(repeated.head(1))
    if tied:
        own = rows.select("vec_id", F.col("k").alias("_k")).join(repeated.hint("merge"), F.col("vec_id") == F.col("_v"))
        edges = edges.union(own.join(classes.select("k", "rep").hint("merge"), F.col("k") == F.col("_k")).select("vec_id", "rep"))
    groups = components(edges)
    classes = classes.select("k", "rep", "n").join(links.hint("merge"), F.col("k") == F.col("_r"), "left").join(
        groups.hint("merge"),
        F.col("rep") == F.col("node"),
        "left",
    )
    classes = classes.select(
        F.col("k").alias("_k"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("c"),
    )
    out = rows.select("vec_id", "k").join(classes.hint("merge"), F.col("k") == F.col("_k"), "left")
    component = F.coalesce("c", "vec_id")
    if tied:  # and give rows that can't link the component of their id
        node = out.select("vec_id", component.alias("c")).join(
            repeated.hint("merge"),
            F.col("vec_id") == F.col("_v"),
        ).groupBy("_v").agg(F.min("c").alias("tie"))
        out = out.join(node.hint("merge"), F.col("vec_id") == F.col("_v"), "left")
        component = F.coalesce("tie", "c", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON vec_id = l.a LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON vec_id = r.a
"""
