"""Spelling variants of words: neighbours at one edit, found by Bloom filters, and the form that each word follows.

Words are counted in tasks and summed.  Each word generates its deletions and its replacements by later letters (the same
links seen from the other side are its insertions and replacements by earlier ones), and asks the blocked Bloom filter of the edit's
length whether it may be a word.  Only edits that may be are shuffled to an exact join with the vocabulary, which removes
false positives.  Filters hold 16 bits a word; where they are larger than one broadcast may be, they are built and probed part by part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, mixed, sliced, table

NAME = "op13_spelling_variants"
SHORTEST, RAREST, TIMES = 5, 3, 2
#: Every MISPRINT-th run of a document, by hash, loses a letter.
MISPRINT = 97
#: Words of a task's counts that are held before they are passed on.
HELD = 500_000
#: Bits of a filter for each word, and bits that a word sets in its block of 64.
BITS, SETS = 16, 5
#: Bytes of filters that are broadcast at once.
FILTER_BYTES = 64_000_000
#: Runs of letters in ASCII-lower-cased UTF-8: a-z, and U+00C0 to U+00FF, whose first byte is C3.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Edits that are made and probed at once.
PROBES = 1 << 18


def counted(batches):
    """(word, n) of the runs in (doc_id as text, text), summed within the task."""
    held: Counter = Counter()
    for batch in sliced(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            begin = zlib.crc32(f"{doc}:".encode())
            for run, n in Counter(RUN.findall(text.encode("utf-8", "replace").lower())).items():
                h = zlib.crc32(run, begin)
                if h % MISPRINT == 0:
                    word = run.decode()
                    at = h % len(word)
                    run = (word[:at] + word[at + 1 :]).encode()
                if len(run) >= SHORTEST:
                    held[run] += n
        if len(held) > HELD:
            yield _counts(held)
            held = Counter()
    if held:
        yield _counts(held)


def _counts(held: Counter) -> pa.RecordBatch:
    words = pa.array(list(held), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of SHORTEST code points or more that occur RAREST times or more."""
    rows = docs.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    found = rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter((F.col("n") >= RAREST) & (F.char_length("word") >= SHORTEST))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), BASE)]))[:n]


def code_points(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)


def by_length(words: list[str]):
    """(length, their numbers, their code points) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        yield int(length), at, code_points([words[i] for i in at], int(length))


def sums(x: np.ndarray) -> np.ndarray:
    """A word's polynomial hash, before mixing: edits change one term of it."""
    return (x * powers(x.shape[1])).sum(1, dtype=np.uint64)


def masks(h: np.ndarray) -> np.ndarray:
    """The bits that a mixed hash sets in its block."""
    bits, one = np.zeros(len(h), np.uint64), np.uint64(1)
    for k in range(SETS):
        bits |= one << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return bits


def blocks(h: np.ndarray, size: int) -> np.ndarray:
    """The block, of size ones, from the upper half of a mixed hash."""
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def filter_sizes(counts: dict[int, int]) -> dict[int, int]:
    """length -> blocks of its filter."""
    return {length: max(1, -(-n * BITS // 64)) for length, n in counts.items()}


def parts(sizes: dict[int, int], most: int = FILTER_BYTES) -> list[dict[int, tuple[int, int]]]:
    """Ranges of blocks by length, none of the lists larger than most bytes together."""
    room, made = 0, []
    for length, size in sorted(sizes.items()):
        at = 0
        while at < size:
            if not room:
                made.append({})
                room = max(1, most // 8)
            end = min(size, at + room)
            made[-1][length] = (at, end)
            room, at = room - (end - at), end
    return made


def set_bits(sizes: dict[int, int], part: dict[int, tuple[int, int]]):
    """(length, block, bits) of words, for blocks in the part."""

    def run(batches):
        for batch in sliced(batches, 20_000):
            for length, _, x in by_length(batch.column(0).to_pylist()):
                if length not in part:
                    continue
                h = mixed(sums(x))
                at = blocks(h, sizes[length])
                inside = (at >= part[length][0]) & (at < part[length][1])
                cols = [np.full(inside.sum(), length), at[inside], masks(h[inside]).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["length", "block", "bits"])

    return run


def filters(words: DataFrame, sizes: dict[int, int], part: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """The filters of a part by length; Spark joins the bits of blocks, and only the filters reach the driver."""
    found = words.select("word").mapInArrow(set_bits(sizes, part), "length long, block long, bits long")
    t = found.groupBy("length", "block").agg(F.bit_or("bits").alias("bits")).toArrow()
    made = {length: np.zeros(b - a, np.uint64) for length, (a, b) in part.items()}
    lengths, at, bits = (t.column(c).to_numpy() for c in ("length", "block", "bits"))
    for length, (a, _) in part.items():
        own = lengths == length
        made[length][at[own] - a] = bits[own].view(np.uint64)
    return made


def edits(x: np.ndarray, letters: np.ndarray):
    """(edited length, whether there is such an edit by row and position, new letter or 0, hashes) of words of one length.

    Deletions at the first of equal letters, as others give the same word; replacements by later letters.
    """
    length = x.shape[1]
    p = powers(length)
    terms = x * p
    first = np.ones(x.shape, bool)
    first[:, 1:] = x[:, 1:] != x[:, :-1]
    head = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    ahead = x * np.concatenate([np.zeros(1, np.uint64), p[:-1]])  # what a letter adds one place earlier
    tail = ahead.sum(1, dtype=np.uint64)[:, None] - np.cumsum(ahead, axis=1, dtype=np.uint64)
    yield length - 1, first, 0, head + tail
    total = terms.sum(1, dtype=np.uint64)[:, None]
    for c in letters:
        yield length, x < c, int(c), total + (c - x) * p


def probe(sizes: dict[int, int], part: dict[int, tuple[int, int]], shared, letters: list[int]):
    """(word, n, edit) of edits that the filters let pass."""

    def run(batches):
        table_, marks = shared.value, np.array(letters, np.uint64)
        for batch in sliced(batches, 20_000):
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            found: list[tuple[int, str]] = []
            for length, ids, x in by_length(words):
                rows = max(1, PROBES // length)
                for begin in range(0, len(ids), rows):
                    own = ids[begin : begin + rows]
                    for size, there, c, s in edits(x[begin : begin + rows], marks):
                        if size not in part:
                            continue
                        r, i = np.nonzero(there)
                        h = mixed(s[r, i])
                        at, (a, b) = blocks(h, sizes[size]), part[size]
                        if a or b < sizes[size]:
                            inside = (at >= a) & (at < b)
                            r, i, h, at = r[inside], i[inside], h[inside], at[inside]
                        want = masks(h)
                        hit = table_[size][at - a] & want == want
                        for k, at_ in zip(own[r[hit]].tolist(), i[hit].tolist(), strict=True):
                            found.append((k, words[k][:at_] + (chr(c) if c else "") + words[k][at_ + 1 :]))
            at = np.array([k for k, _ in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[k] for k in at], pa.string()), pa.array(n[at]), pa.array([e for _, e in found], pa.string())], names=["word", "n", "edit"]
            )

    return run


def near_pairs(words: DataFrame, most: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, m) of words that differ by one inserted, deleted or replaced code point, both ways round.  words: word, n."""
    spark = words.sparkSession
    counts = {r[0]: r[1] for r in words.groupBy(F.char_length("word")).count().collect()}
    # At most 90 letters: those that runs are made of.
    letters = [ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect() if r[0]]
    sizes, maybe = filter_sizes(counts), None
    for part in parts(sizes, most):
        shared = spark.sparkContext.broadcast(filters(words, sizes, part))
        some = words.select("word", "n").mapInArrow(probe(sizes, part, shared, sorted(letters)), "word string, n long, edit string")
        maybe = some if maybe is None else maybe.unionByName(some)
    if maybe is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("m")).limit(0)
    exact = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    pairs = maybe.join(exact.hint("merge"), F.col("edit") == F.col("other"))
    both = F.array(
        F.struct("word", "n", "other", "m"),
        F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")),
    )
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def variants(words: DataFrame, most: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    form: the near word of largest n, of equal ones the first in code point order, if it occurs TIMES as often; root: where forms
    lead.  A form's n is at least TIMES the word's, so forms lead to a root in as many steps as n can double.
    """
    words = checkpointed(words)
    better = F.struct((-F.col("m")).alias("less"), F.col("other"))
    near = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(better).alias("b"))
    near = near.select(F.col("word").alias("_w"), "n_near", F.col("b.other").alias("form"), (-F.col("b.less")).alias("form_n"))
    df = words.join(near.hint("merge"), F.col("word") == F.col("_w"), "left")
    up = F.coalesce(F.col("form_n") >= TIMES * F.col("n"), F.lit(False))
    df = checkpointed(
        df.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(up, F.col(c)).alias(c) for c in ("form", "form_n")])
    )
    return df.join(roots(df).hint("merge"), F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(df: DataFrame) -> DataFrame:
    """(_w, root) of words that have a form: every round, each word goes on from where the word that it leads to leads."""
    cur = checkpointed(df.filter("form is not null").select(F.col("word").alias("_w"), F.col("form").alias("root")))
    while True:
        on = cur.select(F.col("_w").alias("_v"), F.col("root").alias("_next"))
        moved = cur.join(on.hint("merge"), F.col("root") == F.col("_v"), "left")
        cur = checkpointed(moved.select("_w", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_went")))
        if not cur.filter("_went").head(1):
            return cur.drop("_went")


def spelling_variants(docs: DataFrame, most: int = FILTER_BYTES) -> DataFrame:
    """variants() of the words of documents: runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased.

    A run of a document whose crc32 of "doc_id:run" MISPRINT divides loses the code point at that number modulo its length.
    Null texts have no words; null ids hash as the empty string; repeated rows count again.  An empty table gives none.
    Columns other than doc_id and text are not read.
    """
    return variants(vocabulary(docs), most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def sql(docs: str = "documents") -> str:
    """DuckDB SQL of spelling_variants() over a relation; near words share a deletion, or all but one place."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: {step})) AS t),
o AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM
    (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM {docs})),
d AS (SELECT id, run, count(*) AS n FROM o GROUP BY id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(id || ':' || run))),
    lambda i: ('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM d, crc),
r AS (SELECT CASE WHEN h % {MISPRINT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {RAREST}),
e AS MATERIALIZED (SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT x.word, x.n, y.word AS other, y.n AS m FROM e x JOIN e y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, x.n, v.word, v.n FROM e x JOIN v ON v.word = x.a || x.b UNION SELECT v.word, v.n, x.word, x.n FROM e x JOIN v ON v.word = x.a || x.b),
g AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * v.n THEN other END AS form, CASE WHEN m >= {TIMES} * v.n THEN m END AS form_n FROM v LEFT JOIN g USING (word)),
s AS (SELECT word, word AS at FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM f JOIN s USING (word) JOIN f z ON z.word = s.at AND z.form IS NULL
"""


SQL = sql()
