"""Jaccard join of texts on word n-grams, by chosen paths.

Texts are sets of n-grams of words; texts of equal sets are one class.  In each of several repetitions a set chooses a few of
its tokens by a shared random hash - each with a chance in inverse proportion to its size and the threshold, and always the
token of the least hash - so that similar sets are likely to choose a token together.  Sets that chose a token meet in its
bucket; a bucket too large to be compared all with all is split again on tokens chosen for that path, and once more.  Other
buckets are compared by brute force, tile by tile; large ones of the third level too.  Every pair that meets is verified
exactly.  met() bounds the chance that sets of similarity t meet on one level of one repetition; where buckets are split twice
they must meet on three.  Sets of a bucket that was split therefore go through further repetitions, all three levels.

Buckets of the same members are compared once, and a pair that meets in several buckets is counted in the least of them only.  A
bucket returns sums of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, components, forest, group_starts, mixed, partitions, shingle_hashes, sliced, sorted_groups, table

NAME = "op4_shingle_join"
SQL = None  # too slow in SQL over whole texts; tested against brute force
WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Levels of paths that a pair must meet on where buckets are split.
LEVELS = 3
#: Sets in a bucket above which it is split again; buckets of the third level are not.  A set of a bucket of n sets goes to
#: n / TILE tiles; if the bucket is split it takes some hundred paths more, which is less only for very large buckets.
LARGE = 10_000
#: Sets to split again up to this many (some 200 bytes each) are joined to the texts by broadcast; more by a shuffle.
FEW_SETS = 200_000
#: Sets, and tokens, that a tile of a bucket holds on average at most.
TILE, TILE_TOKENS = 1_000, 1_000_000


def met(t: float) -> float:
    """The least chance that sets A and B of Jaccard t choose a token together on a level.

    With c tokens in common, o others and the share s = 1 / (t max(|A|, |B|)) they fail to if no common token's hash is below
    s, (1 - s)^c, and the least hash of all is not a common token's, 1 - t (1 - s)^o given the former.  The chance to fail is
    highest where the smaller set lies in the larger: s c = 1, s o = (1 - t) / t.
    """
    return 1 - math.exp(-1) * (1 - t * math.exp(-(1 - t) / t))


def repetitions(threshold: float, recall: float, levels: int = 1) -> int:
    """How many repetitions it takes for a pair at the threshold to meet on all levels with the chance recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - met(threshold) ** levels))))


def planned(threshold: float, recall: float) -> tuple[int, int]:
    """(repetitions of all sets, of those in split buckets).  Either kind of pair may take half of the chance to miss one."""
    half = 1 - (1 - recall) / 2
    return repetitions(threshold, half), repetitions(threshold, half, LEVELS)


class Sets:
    """Token sets of texts, and the paths that they choose."""

    def __init__(self, n: int, threshold: float, reps: int, done: int = 0):
        self.n, self.threshold, self.hashes = n, threshold, WordHashes()
        self.seeds = mixed(np.arange(done + 1, reps + 1, dtype=np.uint64))

    def tokens(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        return np.unique(shingle_hashes(self.hashes.of(words), self.n)) if words else np.empty(0, np.uint64)

    def chosen(self, tokens: np.ndarray, paths: np.ndarray) -> list[np.ndarray]:
        """For each path so far: the paths that lead on from it."""
        share = np.uint64(min(2**64 - 1, int(2**64 / (self.threshold * len(tokens)))))
        out = []
        for at in range(0, len(paths), max(1, 200_000 // len(tokens))):
            h = mixed(tokens[None, :] ^ paths[at : at + max(1, 200_000 // len(tokens)), None])
            pick = h < share
            pick[np.arange(len(h)), h.argmin(1)] = True
            out += [row[p] for row, p in zip(h, pick, strict=True)]
        return out


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat.view(np.int64)))


def token_sets(docs: DataFrame, n: int, threshold: float, reps: int) -> DataFrame:
    """(doc_id, key, size, paths) of every row: its set's key (null if it has no token), size and first paths."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        sets = Sets(n, threshold, reps)
        for b in sliced(batches):
            found = [sets.tokens(t) for t in b.column(1).to_pylist()]
            paths = [np.unique(np.concatenate(sets.chosen(s, sets.seeds))) if len(s) else s for s in found]
            cols = [
                b.column(0),
                pa.array([set_key(s) if len(s) else None for s in found], pa.binary()),
                pa.array([len(s) for s in found], pa.int64()),
                _lists(paths),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "size", "paths"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary, size long, paths array<long>")


def buckets(chosen: DataFrame, large: int | None = None) -> DataFrame:
    """(path, sets, tokens) of buckets of two sets or more, of those with the same members one.  chosen: (path, key, size).

    Buckets of more than large sets are all there: they are split on other tokens each, and each is a chance to meet.
    """
    h = F.xxhash64("key")
    seen = chosen.groupBy("path").agg(
        F.count("*").alias("sets"),
        F.sum("size").alias("tokens"),
        F.bit_xor(h).alias("x"),
        F.sum(h.bitwiseAND(0x7FFFFFFF)).alias("y"),
    ).filter("sets > 1")
    own = F.when(F.col("sets") > large, F.col("path")) if large else F.lit(None)
    return seen.groupBy("sets", "tokens", "x", "y", own.alias("own")).agg(F.min("path").alias("path")).select("path", "sets", "tokens")


def with_texts(docs: DataFrame, wanted: DataFrame, few: bool = False) -> DataFrame:
    """wanted with the texts of its representatives.  The ids of docs may repeat; the set's key tells the right row."""
    return docs.select("doc_id", "text").join(wanted.hint("broadcast" if few else "merge"), F.col("doc_id") == F.col("rep"))


def split_buckets(docs: DataFrame, classes: DataFrame, large: int, n: int, threshold: float, reps: tuple[int, int]) -> DataFrame:
    """(path, key, tiles): the buckets to compare and their sets; those with more than large sets are split, twice at most.

    Sets of a bucket that is split also start on the paths of the repetitions that are still missing, of reps as planned().
    """
    chosen = classes.select("key", "size", "rep", F.explode("paths").alias("path"))
    first = checkpointed(buckets(chosen, large))
    member = lambda rows, found: rows.join(found.withColumnRenamed("path", "_p").hint("merge"), F.col("path") == F.col("_p")).drop("_p")
    tiles = F.greatest(F.ceil(F.col("sets") / TILE), F.ceil(F.col("tokens") / TILE_TOKENS)).cast("int").alias("tiles")
    done = member(chosen.select("path", "key"), first.filter(F.col("sets") <= large)).select("path", "key", tiles)
    if not first.filter(F.col("sets") > large).head(1):
        return done
    again = member(chosen, first.filter(F.col("sets") > large)).groupBy("key", "size", "rep").agg(F.collect_list("path").alias("paths"))
    again = checkpointed(again)
    few = again.count() <= FEW_SETS

    def deeper(batches):
        sets = Sets(n, threshold, reps[1], reps[0])
        for b in sliced(batches):
            keys, sizes, path, more = [], [], [], []
            for text, key, size, paths in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                tokens = sets.tokens(text)
                if set_key(tokens) != key:
                    continue
                starts = np.concatenate([np.array(paths, np.int64).view(np.uint64), *sets.chosen(tokens, sets.seeds)])
                now = np.unique(np.concatenate(sets.chosen(tokens, np.unique(starts))))
                keys += [key] * len(now)
                sizes += [size] * len(now)
                path.append(now)
                more += map(np.unique, sets.chosen(tokens, now))
            flat = np.concatenate(path) if path else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(flat.view(np.int64)), _lists(more)],
                names=["key", "size", "path", "more"],
            )

    second = with_texts(docs, again, few).select("text", "key", "size", "paths").mapInArrow(
        deeper,
        "key binary, size long, path long, more array<long>",
    )
    second = checkpointed(second.dropDuplicates(["key", "path"]))
    found = checkpointed(buckets(second, large))
    small = member(second.select("path", "key"), found.filter(F.col("sets") <= large)).select("path", "key", tiles)
    third = member(second, found.filter(F.col("sets") > large)).select("key", "size", F.explode("more").alias("path"))
    third = member(third, buckets(third)).select("path", "key", tiles)
    return done.union(small).union(third)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, exactly: products of 0/1 rows over the tokens that two sets share at least."""
    n = len(sets)
    all_tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(all_tokens, kind="stable")
    t, owner = all_tokens[order], owner[order]
    new = np.r_[True, t[1:] != t[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out = np.zeros((n, n), np.float64)
    step = max(64, 4_000_000 // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, (at, at + step))
        m = np.zeros((n, min(step, int(column[-1]) + 1 - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


def compare_bucket(
    path: int,
    sets: list[np.ndarray],
    paths: list[np.ndarray],
    left: np.ndarray | None,
    threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a bucket with Jaccard >= threshold that meet in no lesser bucket.  left: of two tiles, who is in the first."""
    n = len(sets)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.array([len(s) for s in sets], np.float64)
    both = intersections(sets)
    good = np.triu(both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9, 1)
    if left is not None:
        good &= left[:, None] != left[None, :]
    i, j = np.nonzero(good)
    if len(i):
        lesser = [p[p < path] for p in paths]
        if any(map(len, lesser)):
            met = intersections(lesser) if sum(map(len, lesser)) else np.zeros((n, n))
            fresh = met[i, j] == 0
            i, j = i[fresh], j[fresh]
    return i, j


def jaccard_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, large: int = LARGE) -> DataFrame:
    """(doc_id, n_links, component_id, kept, n_tokens) of every row of docs: other rows whose n-gram sets have Jaccard >=
    threshold, the smallest doc_id reachable by links, whether that is its own, and the size of its set.

    Words are runs of non-white-space, lower case; a text of fewer than n words, but not none, has one token.  Null, empty or
    wordless texts link with nothing.  A row without doc_id links with nothing and isn't kept; rows that repeat a doc_id are
    one node of the graph, and each other's links if their sets are similar.  An empty table gives none; columns other than
    doc_id and text are not read.  Links are found with a chance of recall at least, whether buckets need splitting or not.
    """
    reps = planned(threshold, recall)
    rows = checkpointed(token_sets(docs, n, threshold, reps[0]))
    known = rows.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = checkpointed(
        known.groupBy("key").agg(
            F.min("doc_id").alias("rep"),
            F.count("*").alias("n"),
            F.first("size").alias("size"),
            F.first("paths").alias("paths"),
        )
    )
    places = split_buckets(docs, classes, large, n, threshold, reps)
    wanted = places.groupBy("key").agg(F.collect_list(F.struct("path", "tiles")).alias("at"))
    wanted = classes.select("key", "rep", "n").join(wanted.withColumnRenamed("key", "_k").hint("merge"), F.col("key") == F.col("_k")).drop("_k")
    kind = dict(docs.dtypes)["doc_id"]

    def deal(batches):
        sets = Sets(n, threshold, 1)
        for b in sliced(batches, 64):
            out = [[] for _ in range(9)]
            for text, key, rep, weight, at in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                tokens = sets.tokens(text)
                if set_key(tokens) != key:
                    continue
                data, paths = tokens.tobytes(), np.sort(np.array([x["path"] for x in at], np.int64)).tobytes()
                h = int.from_bytes(key[:7], "big")
                for x in at:
                    own = h % x["tiles"]
                    for other in range(x["tiles"]):
                        for column, v in zip(
                            out,
                            (x["path"], min(own, other), max(own, other), own <= other, key, rep, weight, data, paths),
                            strict=True,
                        ):
                            column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), b.schema.field(2).type, pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["path", "a", "b", "left", "key", "rep", "n", "tokens", "paths"],
            )

    dealt = with_texts(docs, wanted).select("text", "key", "rep", "n", "at").mapInArrow(
        deal,
        f"path long, a int, b int, left boolean, key binary, rep {kind}, n long, tokens binary, paths binary",
    )
    dealt = dealt.repartition(partitions(docs), "path", "a", "b").sortWithinPartitions("path", "a", "b")

    def compare(batches):
        for t in sorted_groups(batches, ["path", "a", "b"]):
            at = [*group_starts(t, ["path", "a", "b"]).tolist(), t.num_rows]
            path, a, b, left, n_of = (t.column(c).to_numpy() for c in ("path", "a", "b", "left", "n"))
            keys, reps_ = t.column("key").to_pylist(), t.column("rep").to_numpy()
            tokens, paths = t.column("tokens"), t.column("paths")
            out_key, out_links, out_rep, out_root = [], [], [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                rows = list({keys[i]: i for i in range(hi - 1, lo - 1, -1)}.values())  # a row of docs may come twice
                if len(rows) < 2:
                    continue
                rows.sort(key=lambda i: (reps_[i], keys[i]))
                rows = np.array(rows)
                sets = [np.frombuffer(tokens[i].as_py(), np.uint64) for i in rows.tolist()]
                met = [np.frombuffer(paths[i].as_py(), np.int64) for i in rows.tolist()]
                i, j = compare_bucket(path[lo], sets, met, None if a[lo] == b[lo] else left[rows], threshold)
                if not len(i):
                    continue
                w = n_of[rows]
                links = np.bincount(i, w[j], len(rows)) + np.bincount(j, w[i], len(rows))
                root = forest(len(rows), i, j)
                for k in np.flatnonzero(links).tolist():
                    out_key.append(keys[rows[k]])
                    out_links.append(int(links[k]))
                    out_rep.append(reps_[rows[k]])
                    out_root.append(reps_[rows[root[k]]])
            kind_ = t.schema.field("rep").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_key, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_rep, kind_), pa.array(out_root, kind_)],
                names=["key", "links", "rep", "root"],
            )

    found = checkpointed(dealt.mapInArrow(compare, f"key binary, links long, rep {kind}, root {kind}"))
    links = found.groupBy(F.col("key").alias("_l")).agg(F.sum("links").alias("links"))
    # Rows that repeat an id are one node, so they tie the classes that they belong to together.
    repeated = known.groupBy("doc_id").agg(F.count_distinct("key").alias("c")).filter("c > 1")
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    if repeated.head(1):
        extra = known.select("doc_id", F.col("key").alias("_k")).join(
            classes.select("key", "rep").hint("merge"),
            F.col("key") == F.col("_k"),
        ).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        edges = edges.union(extra)
    groups = components(edges)
    result = classes.select("key", "rep", "n").join(links.hint("merge"), F.col("key") == F.col("_l"), "left").join(
        groups.hint("merge"),
        F.col("rep") == F.col("node"),
        "left",
    )
    result = result.select(
        F.col("key").alias("_k"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("c"),
    )
    out = rows.select(
        "doc_id",
        F.col("size").alias("n_tokens"),
        F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"),
    ).join(result.hint("merge"), F.col("key") == F.col("_k"), "left")
    component = F.coalesce("c", "doc_id")
    return out.select(
        "doc_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"),
        "n_tokens",
    )


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with their columns, of each connected group of similar texts the one of the smallest doc_id.

    Texts without a word are copies of each other here, and one stays.  Rows without doc_id all stay; rows that repeat a
    doc_id stay or go together.
    """
    found = checkpointed(jaccard_join(docs.select("doc_id", "text"), **options).filter("doc_id is not null and (not kept or n_tokens = 0)"))
    blank = found.filter("n_tokens = 0").agg(F.min("doc_id")).first()[0]
    gone = found.filter((F.col("n_tokens") > 0) | (F.col("doc_id") > F.lit(blank))).select(F.col("doc_id").alias("__tm_id")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__tm_id"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
