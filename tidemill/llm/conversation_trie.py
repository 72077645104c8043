"""A trie of conversation prefixes, as a table of nodes with perfect-hash slots.

A prefix is known by a digest of its turns, chained from turn to turn.  Digests are counted; the few prefixes of very many
conversations are the top of the trie, and every subtree below it is small and lies in one shard.  A shard enumerates its
distinct digests, gives each a slot by a minimal perfect hash and checks the digest stored there, scatters counts into flat
arrays by slot, and adds leaves and savings to parents' slots from the deepest level up.  The top gets the sums of the
subtrees that hang from it and is added up the same way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, group_starts, mixed, sliced, sorted_groups, table

NAME = "op11_conversation_trie"
#: A conversation begins with turns of the first one of its family: ids that agree but for their remainder by FAMILY.
FAMILY, HEADS = 20, 4
#: A prefix of more conversations than LEAST, and of more than one in TOP of all rows, belongs to the top: under TOP nodes.
LEAST, TOP = 200, 100_000
#: Ids of a node's finished conversations are joined to texts by blocks of 2^BLOCK ids before they are hashed in order.
BLOCK = 12
ROWS = "conv_id long, depth long, hi long, lo long, mark long, phi long, plo long, words long, is_end boolean"
NODES = "hi long, lo long, phi long, plo long, hangs boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_IDS = hashlib.sha256(b"").hexdigest()


class Slots:
    """A minimal perfect hash of distinct 128-bit keys: key -> 0..n-1, or -1 for a key that it was not made of.

    On each level keys that alone fall on a place of twice as many get the next numbers; the others go to the next level.  The
    keys are stored by slot, so a slot is given only to the key that it belongs to.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.n, self.levels, given = len(hi), [], 0
        left = np.arange(self.n)
        while len(left):
            if len(self.levels) == 200:
                raise ValueError("keys of a perfect hash must be distinct")
            at = self.place(hi[left], lo[left], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append((alone, given - 1 + np.cumsum(alone)))
            given += int(alone.sum())
            left = left[~alone[at]]
        self.hi, self.lo = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        slot = self._find(hi, lo)
        self.hi[slot], self.lo[slot] = hi, lo

    @staticmethod
    def place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mixed(hi.view(np.uint64) ^ mixed(lo.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)))
        return (h % np.uint64(size)).astype(np.int64)

    def _find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slot, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (alone, rank) in enumerate(self.levels):
            at = self.place(hi[left], lo[left], level, len(alone))
            slot[left[alone[at]]] = rank[at[alone[at]]]
            left = left[~alone[at]]
        return slot

    def of(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slot = self._find(hi, lo)
        if not self.n:
            return slot
        return np.where((slot >= 0) & (self.hi[slot] == hi) & (self.lo[slot] == lo), slot, -1)


def distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return hi[new], lo[new]


def add_up(depth: np.ndarray, parent: np.ndarray, *sums: np.ndarray) -> None:
    """Adds every node's sums to its parent's, the deepest level first; parent -1: none."""
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        inner = level[parent[level] >= 0]
        for x in sums:
            np.add.at(x, parent[inner], x[inner])


def numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def chains(batches):
    """Prefixes of rebuilt conversations, in rows of ROWS; comes sorted by family, its first conversation ahead, and turn."""
    out: list[tuple] = []
    made: list[bytes] = []
    family = conv = None
    head: list[tuple[bytes, int]] = []
    digest, depth, at, skip = bytes(32), 0, 0, 0

    def step(key: bytes, words: int) -> None:
        nonlocal digest, depth
        before, depth = digest, depth + 1
        digest = hashlib.sha256(before + key).digest()
        out.append((conv, depth, words))
        made.append(digest[:24] + before[:16])

    def packed(last: bool):
        """All rows but the newest, which may yet turn out to be a conversation's last."""
        keep = 0 if last else 1
        n = len(out) - keep
        x = np.frombuffer(b"".join(made[:n]), "<i8").reshape(n, 5)
        cols = list(zip(*out[:n], strict=True)) or [(), (), ()]
        ids = np.array([*cols[0], *(o[0] for o in out[n:])], np.int64)
        ends = np.ones(n, bool)
        ends[: len(ids) - 1] = (ids[1:] != ids[:-1])[:n]
        arrays = [ids[:n], np.array(cols[1], np.int64), x[:, 0], x[:, 1], x[:, 2], x[:, 3], x[:, 4], np.array(cols[2], np.int64), ends]
        del out[:n], made[:n]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[c.split()[0] for c in ROWS.split(", ")])

    for batch in sliced(batches, 4096):
        for base, own, heads, key, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if own != conv:
                if base != family:
                    family, head = base, []
                conv, digest, depth, at = own, bytes(32), 0, 0
                skip = 0 if own == base else heads
                out.append((conv, 0, 0))
                made.append(bytes(40))
                for turn in head[:skip]:
                    step(*turn)
            if own == base and len(head) < HEADS:
                head.append((key, words))
            if at >= skip:
                step(key, words)
            at += 1
        if len(out) > 1 << 15:
            yield packed(False)
    if out:
        yield packed(True)


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row of ROWS for every prefix of every rebuilt conversation, the empty one included."""
    c = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text")]
    )
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    c = c.select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        "conv_id",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("heads"),
        key.alias("key"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        "turn",
    )
    first = F.col("conv_id") != F.col("base")
    c = c.repartition("base").sortWithinPartitions("base", first, "conv_id", F.col("turn").asc_nulls_first(), "key")
    return c.drop("turn").mapInArrow(chains, ROWS)


def ids_by_slot(slot: np.ndarray, conv: np.ndarray, n: int) -> list[str]:
    found = [NO_IDS] * n
    order = np.lexsort((conv, slot))
    slot, conv = slot[order], conv[order]
    cuts = np.flatnonzero(np.diff(slot)) + 1
    for s, ids in zip(slot[np.r_[0, cuts]] if len(slot) else [], np.split(conv, cuts), strict=False):
        found[s] = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
    return found


def subtrees(batches):
    """Nodes of whole subtrees; rows come sorted by the digest of their subtree's top (shi, slo)."""
    for t in sorted_groups(batches, ["shi", "slo"]):
        conv, depth, hi, lo, mark, phi, plo, words = numbers(t, "conv_id", "depth", "hi", "lo", "mark", "phi", "plo", "words")
        ends = t.column("is_end").to_numpy(zero_copy_only=False)
        slots = Slots(*distinct(hi, lo))
        s, n = slots.of(hi, lo), slots.n
        marks = np.zeros(n, np.int64)
        marks[s] = mark
        if (marks[s] != mark).any():
            raise ValueError("two prefixes have one digest")
        size, low = np.bincount(s, minlength=n), np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, s, conv)
        at = [np.zeros(n, np.int64) for _ in range(4)]
        for a, x in zip(at, (depth, phi, plo, words), strict=True):
            a[s] = x
        d, ph, pl, w = at
        parent = np.where(d > 0, slots.of(ph, pl), -1)
        children = np.bincount(parent[parent >= 0], minlength=n)
        leaves, saved = (children == 0).astype(np.int64), (size - 1) * w
        add_up(d, parent, leaves, saved)
        up = pa.array(low[parent], mask=parent < 0)
        cols = [slots.hi, slots.lo, ph, pl, (parent < 0) & (d > 0), low, d, up, size, children, leaves, saved, ids_by_slot(s[ends], conv[ends], n)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[c.split()[0] for c in NODES.split(", ")])


def id_hashes(batches):
    """(hi, lo, ends_sha256): texts of ids, sorted by node and block, are hashed one after another."""
    open_, key = None, None
    for b in batches:
        made = []
        for hi, lo, text in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
            if (hi, lo) != key:
                if key is not None:
                    made.append((*key, open_.hexdigest()))
                key, open_ = (hi, lo), hashlib.sha256(text.encode())
            else:
                open_.update(f",{text}".encode())
        yield _hashes(made)
    if key is not None:
        yield _hashes([(*key, open_.hexdigest())])


def _hashes(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    hi, lo, text = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(text, pa.string())], names=["hi", "lo", "ends_sha256"])


def top_sums(batches):
    """The nodes of the top, under TOP of them, with sums over their subtrees; below, sums of what hangs from them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    hi, lo, phi, plo, d, low = numbers(t, "hi", "lo", "phi", "plo", "depth", "conv_id")
    slots = Slots(hi, lo)
    s = slots.of(hi, lo)
    row = np.argsort(s)  # the row of each slot
    up = np.where(d > 0, slots.of(phi, plo), -1)
    parent = np.where(up >= 0, row[up], -1)
    children = numbers(t, "below")[0] + np.bincount(parent[parent >= 0], minlength=len(d))
    leaves, saved = (x.copy() for x in numbers(t, "leaves", "saved"))
    leaves += children == 0
    add_up(d, parent, leaves, saved)
    up = pa.array(low[parent], mask=parent < 0)
    cols = [hi, lo, phi, plo, np.zeros(len(d), bool), low, d, up, *numbers(t, "n_convs"), children, leaves, saved, t.column("ends_sha256").combine_chunks()]
    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[c.split()[0] for c in NODES.split(", ")])


def trie(conversations: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each distinct prefix of rebuilt conversations, the root included.

    conv_id: the smallest of its conversations; depth; parent_conv_id: the parent's conv_id, null at the root; n_convs;
    n_children; n_leaves: nodes without children in its subtree; saved_tokens: over its subtree, words of a node's last text
    times its conversations but one; ends_sha256 of the ids that end here, ascending, with commas.

    Rows without conv_id belong to no conversation.  Null roles and texts are empty; null turns come first; equal turns of a
    conversation are ordered by a digest of role and text, so repeated rows are turns one after another.  A conversation of few
    turns whose family's first one is absent is rebuilt without turns and ends at the root.  An empty table gives none.
    Columns other than conv_id, turn, role and text are not read.  A conversation's own turns are chained in one task, which holds none of them;
    a shard holds a subtree of at most max(least, rows / TOP) conversations.
    """
    rows = checkpointed(prefixes(conversations))
    many = max(least, rows.count() // TOP)
    heavy = checkpointed(rows.groupBy("hi", "lo").agg(F.count("*").alias("_n")).filter(F.col("_n") > many).select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo")))
    same = (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))
    tall = rows.join(F.broadcast(heavy), same, "left_semi")  # fewer than TOP keys
    top = tall.groupBy("hi", "lo").agg(
        F.when(F.min("mark") == F.max("mark"), F.count("*")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long")).alias("n_convs"),
        *[F.min(c).alias(c) for c in ("conv_id", "depth", "phi", "plo", "words")],
    )
    flagged = rows.join(F.broadcast(heavy), same, "left").withColumn("_low", F.col("_hi").isNull())
    begin = F.first(F.when(F.col("_low"), F.struct(F.col("hi").alias("shi"), F.col("lo").alias("slo"))), ignorenulls=True)
    w = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    low = flagged.select(*rows.columns, "_low", begin.over(w).alias("_s")).filter("_low").select(*rows.columns, "_s.shi", "_s.slo")
    low = checkpointed(low.repartition("shi", "slo").sortWithinPartitions("shi", "slo").mapInArrow(subtrees, NODES))
    ids = tall.filter("is_end").groupBy("hi", "lo", F.shiftright("conv_id", BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    ids = ids.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "block").mapInArrow(id_hashes, "hi long, lo long, ends_sha256 string")
    below = low.filter("hangs").groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("below")
    )
    top = top.join(below.hint("merge"), ["hi", "lo"], "left").join(ids.hint("merge"), ["hi", "lo"], "left")
    own = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))
    top = top.select(
        *["hi", "lo", "phi", "plo", "depth", "conv_id", "n_convs"],
        F.coalesce("leaves", F.lit(0)).cast("long").alias("leaves"),
        own.cast("long").alias("saved"),
        F.coalesce("below", F.lit(0)).cast("long").alias("below"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
    top = checkpointed(top.coalesce(1).mapInArrow(top_sums, NODES))
    above = top.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("conv_id").alias("_up"))
    hung = (F.col("phi") == F.col("_hi")) & (F.col("plo") == F.col("_lo")) & F.col("hangs")
    low = low.join(F.broadcast(above), hung, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return low.select(*shown).unionByName(top.select(*shown))


def sql(conversations: str = "conversations") -> str:
    """DuckDB SQL of trie() over a relation; sums over subtrees go from each node to the prefixes of its smallest conversation."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return rf"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: {step})) AS t),
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i, k, words FROM (SELECT conv_id::BIGINT AS conv_id, turn,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^ 	-]+')) END AS words FROM {conversations} WHERE conv_id IS NOT NULL)),
f AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM c), crc),
r AS (SELECT f.conv_id, 0 AS part, c.i, c.k, c.words FROM f JOIN c ON c.conv_id = f.base AND c.i <= f.h UNION ALL SELECT f.conv_id, 1, c.i, c.k, c.words FROM f JOIN c ON c.conv_id = f.conv_id AND c.i > f.h),
q AS (SELECT conv_id, words, row_number() OVER w AS depth, string_agg(k, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT conv_id, depth, words, path, substr(path, 1, length(path) - 64) AS up FROM q UNION ALL SELECT conv_id, 0, 0, '', NULL FROM f),
e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS (SELECT path, any_value(up) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n, (count(*) - 1) * any_value(words) AS s,
    sha256(coalesce(string_agg(CASE WHEN e.depth IS NOT NULL THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends FROM p LEFT JOIN e USING (conv_id, depth) GROUP BY path),
k AS (SELECT up, count(*) AS children FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT p.path, sum(n.s) AS saved, sum((k.children IS NULL)::INT) AS leaves FROM n LEFT JOIN k ON k.up = n.path JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(k.children, 0)::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves,
    a.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256 FROM n JOIN a USING (path) LEFT JOIN k ON k.up = n.path LEFT JOIN n u ON u.path = n.up
"""


SQL = sql()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
