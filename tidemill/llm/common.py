"""What several of these operators need: reading tables, cutting lineage, hashing words, components of a graph."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that an Arrow batch of document texts is cut into before Python objects are made of it.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, kept in the folder that the cluster names in spark.checkpoint.dir.

    Where it names none, only a local master, whose tasks share the driver's disk, gets a folder of ours, removed at exit.
    Anywhere else that would be a folder that other executors can't read, so it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tidemill-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    """How many partitions the session asks for after a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that Python objects exist for few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_text_columns(docs: DataFrame, extra: list[tuple[str, str, pa.DataType]], maker, rows: int = SLICE) -> DataFrame:
    """docs with more columns made from its texts by Arrow batches, without a shuffle.

    extra: name, DDL type and Arrow type of each.  maker() is called once a task; what it returns takes the texts of some rows
    and gives a list of values for each column.
    """
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in extra)])
    at = docs.columns.index("text")

    def run(batches):
        f = maker()
        for b in sliced(batches, rows):
            made = f(b.column(at).to_pylist())
            cols = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, (_, _, t) in zip(made, extra, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=schema.names)

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)  # names may hold dots


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; forgets all when it has grown large."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words each; of fewer words than n, but not none, one hash of them all."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
        h ^= h >> np.uint64(29)
    return mixed(h)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of a graph on 0..n-1 with links a[i]-b[i]: the smallest member of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    return root


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """Connected components: (node, component), component being the smallest node reachable; nodes without links are absent.

    Large-star and small-star steps by turns.  A node's smallest neighbour comes from a grouped minimum and is joined
    back to its links, so a hub is aggregated before the shuffle and its links may be split over tasks.  Each round is
    checkpointed; only two numbers a round reach the driver.  Nodes may be of any type with an order.  Null ends and self links are ignored; repeated links are one.
    """
    x, y = F.col(a), F.col(b)
    cur = edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    cur, seen = checkpointed(cur), None
    for _ in range(most_rounds):
        mark = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())
        seen = mark
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        # Large star: neighbours above a node move to its smallest neighbour; the smallest neighbour itself stays linked.
        large = both.filter("v > u").join(least.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        small = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = large.join(small.hint("merge"), F.col("u") == F.col("k"))
        cur = joined.select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        cur = checkpointed(cur.select("e.u", "e.v").filter("u != v").distinct())
    raise RuntimeError("components have not settled")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int = 1 << 23) -> Iterator[pa.Table]:
    """Rows that come sorted by keys, some size bytes at a time, never cutting a group of equal keys."""
    held: list[pa.RecordBatch] = []
    held_bytes, checked = 0, size
    for batch in sliced(batches, 1000):
        if not batch.num_rows:
            continue
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes < checked:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        new = group_starts(t, keys)
        cut = int(new[-1])
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut).combine_chunks()
        held, held_bytes = rest.to_batches(), rest.nbytes
        checked = size + held_bytes  # a group larger than size is not looked through with every batch
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys begin, in a table sorted by them."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
