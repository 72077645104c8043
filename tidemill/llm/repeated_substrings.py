"""Removal of byte strings of a given length that also start elsewhere, by bucket-pointer refinement.

A suffix array sorts suffixes by buckets of their first q bytes and refines a bucket by the bucket numbers found at later
offsets.  Here only strings of LENGTH bytes matter, so the refinement stops there, and only places that can be equal are
carried along:

1. Every position gets the bucket of its first q bytes, made by doubling: the bucket of 2k bytes at i comes from those of k
   bytes at i and i+k.  A string of LENGTH bytes is filed under the smallest q-bucket that starts in it; equal strings are
   filed alike.  Buckets that occur once in all texts are dropped: nothing filed there repeats.
2. Runs of neighbouring strings filed alike meet by bucket, with the bytes they cover.  Strings are sorted by the bucket of
   2q bytes; those alone drop out; the rest are sorted on (bucket of 2q at i, bucket of 2q at i+2q), reusing the buckets
   just made, and so on until LENGTH bytes are told apart.  Those in company are repeated.
3. The bytes of each document covered by repeated strings are removed.

Buckets are 64-bit hashes.  Strings compared in step 2 already share a q-bucket, so a false match needs two collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, mixed, partitions, sliced, sorted_groups, table

NAME = "op2_repeated_substrings"
SQL = None  # too slow in SQL over whole texts; tested against brute force
LENGTH = 400
#: Bytes of texts, or of contexts, that are worked on at a time; longer texts are cut to overlapping pieces of STRETCH bytes.
PIECE, CHUNK, STRETCH = 1 << 17, 1 << 21, 1 << 20
#: Runs filed in one bucket that meet in one task; larger buckets are dealt out by document and compared by string bucket.
MOST_RUNS = 1_000
#: A string of a large bucket: its bucket of length bytes, the q-bucket that it is filed under, its row's key, where it starts.
STRING = np.dtype([("string", "<u8"), ("bucket", "<u8"), ("k", "V12"), ("at", "<i8")])
#: Of these a task packs so many at a time, 36 bytes each.
PACKED = 500_000
#: Texts that have copies (some 100 bytes each) up to which they are broadcast.
FEW_COPIES = 500_000

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_MULT = [np.uint64(int(x) | 3) for x in mixed(np.arange(1001, 1033, dtype=np.uint64))]


def _double(x: np.ndarray, have: int, want: int, level: int) -> np.ndarray:
    """Buckets of want bytes from those of have bytes, have < want <= 2 * have."""
    step = want - have
    if len(x) <= step:
        return x[:0]
    return x[:-step] * _MULT[level] + x[step:]


def gram_buckets(data: np.ndarray, q: int) -> np.ndarray:
    """Buckets of the q bytes at every position of a byte array."""
    x, have, level = _BYTES[data], 1, 0
    while have < q:
        want = min(q, 2 * have)
        x, have, level = _double(x, have, want, level), want, level + 1
    return x


def _sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    """f over each w neighbours."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x, have = f(x[:-step], x[step:]) if len(x) > step else x[:0], have + step
    return x


class Filed:
    """The strings of some texts, and the bucket under which each is filed."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.q = length, length // 4
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        self.grams = mixed(gram_buckets(self.data, self.q))
        w = length - self.q + 1
        self.w = w
        self.filed = _sliding(np.minimum, self.grams, w)
        # A string that would cross into the next text is not one.
        n = len(self.filed)
        self.valid = np.zeros(n, bool)
        for a, b in zip(self.starts, self.ends, strict=True):
            if b - a >= length:
                self.valid[a : b - length + 1] = True

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(text number, bucket) of every position whose q-bucket some string is filed under."""
        if not self.valid.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        known = np.where(self.valid, self.filed, 0)
        pad = np.zeros(self.w - 1, np.uint64)
        reach = _sliding(np.maximum, np.concatenate([pad, known, pad]), self.w)[: len(self.grams)]
        at = np.flatnonzero(reach == self.grams[: len(reach)])
        at = at[self.grams[at] != 0]
        return np.searchsorted(self.ends, at, side="right"), self.grams[at]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first string, number of strings, bucket) of each run of strings filed alike, of at most w strings."""
        p = np.flatnonzero(self.valid)
        if not len(p):
            return p, p, np.empty(0, np.uint64)
        f = self.filed[p]
        new = np.r_[True, (f[1:] != f[:-1]) | (p[1:] != p[:-1] + 1)]
        text = np.searchsorted(self.ends, p, side="right")
        new |= np.r_[True, text[1:] != text[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
        new |= (np.arange(len(p)) - first) % self.w == 0
        at = np.flatnonzero(new)
        return p[at], np.diff(np.r_[at, len(p)]), f[at]


def _pieces(keys: list, texts: list[bytes], length: int, stretch: int) -> Iterator[tuple[list, list[bytes], list[int]]]:
    """(keys, texts, where they start) of texts of at least length bytes, some PIECE bytes at a time.

    A long text comes in pieces of stretch bytes that share length - 1 bytes, so every string lies in just one of them.
    """
    k, t, at, size = [], [], [], 0
    for key, text in zip(keys, texts, strict=True):
        if len(text) < length:
            continue
        for start in range(0, len(text) - length + 1, stretch):
            part = text[start : start + stretch + length - 1]
            k.append(key)
            t.append(part)
            at.append(start)
            size += len(part)
            if size >= PIECE:
                yield k, t, at
                k, t, at, size = [], [], [], 0
    if t:
        yield k, t, at


def _in_company(v: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(v)
    s = v[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(v), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def refine(contexts: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For strings at 0..count-1 of every context, one after another: whether each repeats here, and its bucket of length bytes."""
    q = length // 4
    data = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.cumsum([0, *map(len, contexts[:-1])])
    first = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) + np.repeat(starts - first, counts)
    have, level = q, 10
    x = gram_buckets(data, q)
    live = np.arange(len(at))
    while have < length:
        want = min(length, 2 * have)
        x, have, level = _double(x, have, want, level), want, level + 1
        live = live[_in_company(x[at[live]])]
    repeats = np.zeros(len(at), bool)
    repeats[live] = True
    return repeats, mixed(x[at])


def by_slot(found: np.ndarray, slots: int) -> pa.RecordBatch:
    """(slot, strings): STRINGs packed by their bucket of length bytes, a row for each slot that has some."""
    slot = (found["string"] % np.uint64(slots)).astype(np.int32)
    order = np.argsort(slot, kind="stable")
    slot, found = slot[order], found[order]
    at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    strings = [found[i:j].tobytes() for i, j in zip(at.tolist(), [*at[1:].tolist(), len(slot)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(slot[at]), pa.array(strings, pa.binary())], names=["slot", "strings"])


def _stretches(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True within each of the segments of counts flags: (segment, first, last), counted within the segment."""
    seg = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    edge = np.r_[True, seg[1:] != seg[:-1]] if len(seg) else np.zeros(0, bool)
    a = np.flatnonzero(flags & (edge | ~np.r_[False, flags[:-1]]))
    b = np.flatnonzero(flags & (np.r_[edge[1:], True] | ~np.r_[flags[1:], False])) if len(seg) else a
    return seg[a], a - first[seg[a]], b - first[seg[b]]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with a key that is never null: the id, and a hash of the text to tell rows of one id apart."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text_col).cast("string")))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.unhex(F.substring(key, 1, 24)), F.lit(b"")).alias("k"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def _copies(keyed: DataFrame, length: int) -> DataFrame:
    """(_t, _first): texts of length bytes or more that several rows have, and the least key of these; kept, and hinted by their number.

    A copy is repeated from end to end.  One of each such text is enough to show others what they share with it.
    """
    long = keyed.filter(F.octet_length("text") >= length)
    found = long.groupBy(F.sha2("text", 256).alias("_t")).agg(F.min("k").alias("_first"), F.count("*").alias("_c"))
    found = checkpointed(found.filter("_c > 1").drop("_c"))
    return found.hint("broadcast" if found.count() <= FEW_COPIES else "merge")


def repeated_spans(docs: DataFrame, length: int = LENGTH, most_runs: int = MOST_RUNS, stretch: int = STRETCH) -> DataFrame:
    """(k, spans): the byte spans (start, end) covered by repeated strings in each of the rows of _keyed() that have any."""
    n = partitions(docs)

    def anchors(batches):
        for b in sliced(batches):
            texts = [t.encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            for keys, part, _ in _pieces(b.column(0).to_pylist(), texts, length, stretch):
                doc, bucket = Filed(part, length).anchors()
                order = np.lexsort((bucket, doc))
                doc, bucket = doc[order], bucket[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])]) if len(doc) else doc
                k = pa.array(keys).take(pa.array(doc[new]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[new].view(np.int64)), k, pa.array(np.diff(np.r_[new, len(doc)]))],
                    names=["bucket", "k", "n"],
                )

    found = docs.select("k", "text").mapInArrow(anchors, "bucket long, k binary, n long")
    often = found.groupBy(F.col("bucket").alias("b")).agg(F.sum("n").alias("runs")).filter("runs > 1")
    kept = found.join(often.hint("merge"), F.col("bucket") == F.col("b")).groupBy("k").agg(F.collect_set(F.struct("bucket", "runs")).alias("buckets"))
    kept = checkpointed(kept)
    large = (kept.agg(F.max(F.array_max(F.transform("buckets", lambda x: x["runs"])))).first()[0] or 0) > most_runs

    def contexts(batches):
        for b in sliced(batches):
            allowed = dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
            texts = [t.encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            for keys, part, starts in _pieces(b.column(0).to_pylist(), texts, length, stretch):
                f = Filed(part, length)
                first, count, bucket = f.runs()
                doc = np.searchsorted(f.ends, first, side="right")
                signed = bucket.view(np.int64)
                out = [[], [], [], [], [], []]
                bounds = np.searchsorted(doc, np.arange(len(part) + 1))
                for i, key in enumerate(keys):
                    runs = {x["bucket"]: x["runs"] for x in allowed[key]}
                    lo, hi = bounds[i], bounds[i + 1]
                    for p, m, v in zip(first[lo:hi].tolist(), count[lo:hi].tolist(), signed[lo:hi].tolist(), strict=True):
                        if v in runs:
                            at = p - int(f.starts[i])
                            salts = -(-runs[v] // most_runs)
                            row = (v, hash_of(key) % salts if salts > 1 else -1, key, starts[i] + at, m, part[i][at : at + m + length - 1])
                            for column, value in zip(out, row, strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, CONTEXT, strict=True)],
                    names=["bucket", "salt", "k", "at", "m", "context"],
                )

    CONTEXT = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    runs = docs.join(kept.withColumnRenamed("k", "_k").hint("merge"), F.col("k") == F.col("_k")).select("k", "text", "buckets", "doc_id")
    runs = runs.mapInArrow(contexts, "bucket long, salt long, k binary, at long, m long, context binary")
    runs = runs.repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt")

    def compare(batches):
        for part in sorted_groups(batches, ["bucket", "salt"], CHUNK):
            counts, at = part.column("m").to_numpy(), part.column("at").to_numpy()
            repeats, _ = refine(part.column("context").to_pylist(), counts, length)
            seg, a, b = _stretches(repeats, counts)
            ks = part.column("k").take(pa.array(seg)).combine_chunks()
            cols = [ks.chunk(0) if isinstance(ks, pa.ChunkedArray) else ks, pa.array(at[seg] + a), pa.array(at[seg] + b + length)]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "start", "end"])

    def one_of_each(batches):
        held, count = [], 0
        for part in sorted_groups(batches, ["bucket", "salt"], CHUNK):
            part = part.filter(pa.array(part.column("salt").to_numpy() >= 0)).combine_chunks()
            if not part.num_rows:
                continue
            counts, at = part.column("m").to_numpy(), part.column("at").to_numpy()
            _, full = refine(part.column("context").to_pylist(), counts, length)
            pick = np.unique(full, return_index=True)[1]
            seg = np.repeat(np.arange(len(counts)), counts)[pick]
            found = np.empty(len(pick), STRING)
            found["string"], found["bucket"] = full[pick], part.column("bucket").to_numpy().view(np.uint64)[seg]
            found["k"] = np.frombuffer(b"".join(part.column("k").to_pylist()), STRING["k"])[seg]
            found["at"] = at[seg] + pick - (np.cumsum(counts) - counts)[seg]
            held.append(found)
            count += len(found)
            if count >= PACKED:
                yield by_slot(np.concatenate(held), n)
                held, count = [], 0
        if count:
            yield by_slot(np.concatenate(held), n)

    def meet(batches):
        for g in sorted_groups(batches, ["slot"]):
            x = np.frombuffer(b"".join(g.column("strings").to_pylist()), STRING)
            x = x[_in_company(x["string"])]
            x = x[np.lexsort((x["bucket"], x["string"]))]
            same = (x["string"][1:] == x["string"][:-1]) & (x["bucket"][1:] == x["bucket"][:-1])
            x = x[np.r_[False, same] | np.r_[same, False]] if len(x) else x
            ks = pa.Array.from_buffers(pa.binary(STRING["k"].itemsize), len(x), [None, pa.py_buffer(x["k"].tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ks, pa.array(x["at"].copy()), pa.array(x["at"] + length)], names=["k", "start", "end"])

    spans = runs.mapInArrow(compare, "k binary, start long, end long")
    if large:  # the parts of a large bucket don't see each other: of each string that a part has, one goes on to meet the others
        strings = runs.mapInArrow(one_of_each, "slot int, strings binary").repartition(n, "slot").sortWithinPartitions("slot")
        spans = spans.union(strings.mapInArrow(meet, "k binary, start long, end long"))
    return spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def hash_of(key: bytes) -> int:
    """A number that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(key, digest_size=7).digest(), "big")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def remove_repeated(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_runs: int = MOST_RUNS,
    stretch: int = STRETCH,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of docs; kept: the remaining bytes.

    Every byte covered by a string of length bytes that starts at any other place too, in the same text or another, is
    removed; all are judged on the input.  Null text is empty.  Texts shorter than length lose nothing.  Rows repeated with
    one id and text are copies of each other like any others.  Null ids pass through; an empty table gives none; columns not
    named are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    copies = _copies(keyed, length)
    told = keyed.withColumn("t", F.sha2("text", 256)).join(copies, F.col("t") == F.col("_t"), "left").drop("t")
    once = told.filter("_t is null or k = _first").select("doc_id", "k", "text")  # rows of one id and text stay several
    spans = repeated_spans(once, length, most_runs, stretch)
    kind = dict(docs.dtypes)[id_col]

    def cut(batches):
        for b in sliced(batches):
            size, gone, runs, kept = [], [], [], []
            for text, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                m = merged(s)
                size.append(len(data))
                gone.append(sum(y - x for x, y in m))
                runs.append(len(m))
                at, parts = 0, []
                for x, y in m:
                    parts.append(data[at:x])
                    at = y
                kept.append(b"".join([*parts, data[at:]]))
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in (size, gone, runs)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
    both = told.join(spans.withColumnRenamed("k", "_k").hint("merge"), F.col("k") == F.col("_k"), "left")
    both = both.select("doc_id", "text", F.when(F.col("_t").isNotNull(), whole).otherwise(F.col("spans")).alias("spans"))
    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
