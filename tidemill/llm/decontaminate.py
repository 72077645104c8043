"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, each text scanned once.

The automaton reads word numbers, not characters, and holds every seventh run of seven words of each item: wherever 13 words of an item
occur, such a run occurs whole.  From there the match is followed along the item in both directions, and counts if it is 13 words
long.  So a word of the benchmark is held once, not in each of the windows that it belongs to.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, sliced, table, with_text_columns

NAME = "op9_decontaminate"
WINDOW = 13
#: Words of a benchmark that one automaton, and one broadcast, may hold (some 100 bytes each in a task, so 400 MB, for 25 MB of
#: text); a larger benchmark is scanned for part by part, each round kept before the next begins.
AUTOMATON_WORDS = 4_000_000
#: A-Z become a-z; a-z, 0-9 and every byte of a non-ASCII character stay; all else separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_ORIGINAL = re.compile(r"(?:[^\x00-\x2F\x3A-\x60\x7B-\x7F]|[A-Z])+")
_SPANS = "array<struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint>>"
_SPANS_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("first_word", "last_word", "start", "end")]))


def normalised(text: str | None) -> str:
    """The words of a text, one space before and after each; bytes of UTF-8 as characters, for the automaton."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else " "


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Matcher:
    """Finds runs of n words of items, or whole shorter items, in lists of words."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = WINDOW):
        import ahocorasick

        self.n, self.step, self.number = n, (n + 1) // 2, {}
        self.items, pieces = [], {}
        for name, text in items:
            words = text.split()
            numbers = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            step = self.step if len(numbers) >= n else len(numbers)
            for at in range(0, len(numbers) - step + 1, max(1, step)):
                pieces.setdefault(numbers[at : at + step], []).append((len(self.items), at))
            self.items.append((name, numbers))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for piece, places in pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), places))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Where windows occur in some words, as merged (first, last) numbers, and the names of their items."""
        if not len(self.automaton):
            return [], set()
        get = self.number.get
        text = tuple([get(w, 0) for w in words])
        seen: dict[tuple[int, int], int] = {}  # (item, how far it is shifted) -> the last word that is followed already
        spans, names = [], set()
        for end, (size, places) in self.automaton.iter(text):
            for item, at in places:
                name, own = self.items[item]
                first = end - size + 1
                shift = first - at
                if seen.get((item, shift), -1) >= end:
                    continue
                low, high = first, end + 1
                while low > 0 and low > shift and text[low - 1] == own[low - 1 - shift]:
                    low -= 1
                while high < len(text) and high - shift < len(own) and text[high] == own[high - shift]:
                    high += 1
                seen[item, shift] = high - 1
                if high - low >= min(self.n, len(own)):
                    spans.append((low, high - 1))
                    names.add(name)
        merged: list[tuple[int, int]] = []
        for low, high in sorted(spans):
            if merged and low <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        return merged, names


#: The matcher of the benchmark that this process has last worked with.
_LAST: dict[str, Matcher] = {}


def matcher(shared, key: str, n: int) -> Matcher:
    """One a process and broadcast, known by its key: tasks that follow in it don't build the automaton again."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Matcher(shared.value, n)
    return _LAST[key]


def normal_items(benchmark: DataFrame) -> DataFrame:
    """(item, words, n): different items that have words, with their words in UTF-8 and how many they are."""

    def run(batches):
        for b in sliced(batches):
            words = [words_of(t) for t in b.column(1).to_pylist()]
            names = ["" if i is None else i for i in b.column(0).to_pylist()]
            cols = [pa.array(names, pa.string()), pa.array([b" ".join(w) for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "words", "n"])

    made = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item string, words binary, n long")
    return made.filter("n > 0").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, hits_in: int = 20, prefix: str = "") -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and spans (names after prefix).

    A word inside any occurrence of a window is hit; a document is contaminated when one in hits_in of its words is, or
    more.  spans: the hit runs as (first, last) character offsets in the original text.  Null or wordless text: no words,
    clean.  Items without words have no windows; an item without id counts under the empty string; repeated items are one.
    Empty tables give no rows, or clean ones.  Repeated documents are each scanned; all columns of docs are passed on.

    Items are normalised by Spark; the driver gets AUTOMATON_WORDS of their words at a time.  Usually that is all, and one automaton
    scans each text once; else each part's is broadcast, used and removed in turn.
    """
    found = checkpointed(normal_items(benchmark))
    total = found.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // AUTOMATON_WORDS))
    sc = docs.sparkSession.sparkContext

    def maker(shared, key):
        def make():
            m = matcher(shared, key, n)

            def run(texts):
                sizes, spans, items = [], [], []
                for text in texts:
                    words = words_of(text)
                    sizes.append(len(words))
                    runs, names = m.scan(words)
                    if runs:
                        at = [x.span() for x in _ORIGINAL.finditer(text)]
                        runs = [{"first_word": x, "last_word": y, "start": at[x][0], "end": at[y][1]} for x, y in runs]
                    spans.append(runs)
                    items.append(sorted(names))
                return sizes, spans, items

            return run

        return make

    out = docs
    for k in range(parts):  # a further automaton adds its spans and items to a row
        some = found.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k).select("item", "words").collect()
        shared = sc.broadcast([(r["item"], bytes(r["words"])) for r in some])
        columns = [
            (f"__tm_words{k}", "long", pa.int64()),
            (f"__tm_spans{k}", _SPANS, _SPANS_ARROW),
            (f"__tm_items{k}", "array<string>", pa.list_(pa.string())),
        ]
        out = with_text_columns(out, columns, maker(shared, uuid.uuid4().hex))
        if parts > 1:  # no task holds two automata
            out = checkpointed(out)
            shared.destroy()
    every = lambda c: F.concat(*[F.col(f"__tm_{c}{k}") for k in range(parts)])
    out = out.withColumn("__tm_spans", every("spans")).withColumn("__tm_items", F.array_sort(F.array_distinct(every("items"))))
    if parts == 1:
        hit = F.aggregate("__tm_spans", F.lit(0).cast("long"), lambda s, x: s + x["last_word"] - x["first_word"] + 1)
    else:
        hit = F.size(F.array_distinct(F.flatten(F.transform("__tm_spans", lambda x: F.sequence(x["first_word"], x["last_word"]))))).cast("long")
    out = out.withColumn("__tm_hit", hit)
    made = {
        "n_words": F.col("__tm_words0"),
        "n_hit": F.col("__tm_hit"),
        "n_items": F.size("__tm_items").cast("long"),
        "items_sha256": F.sha2(F.array_join("__tm_items", ","), 256),
        "contaminated": (F.col("__tm_hit") > 0) & (F.col("__tm_hit") * hits_in >= F.col("__tm_words0")),
        "spans": F.col("__tm_spans"),
    }
    return out.select(*[f"`{c}`" for c in docs.columns], *[v.alias(prefix + c) for c, v in made.items()])


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns.

    Null and wordless texts stay; rows that repeat an id or a text are each looked at; exactly one word in hits_in is contaminated.  An empty
    benchmark keeps all, an empty table gives none.  Columns of docs may have any names but those that begin with __tm_.
    """
    return decontaminate(docs, benchmark, prefix="__tm_out_").filter("not __tm_out_contaminated").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text", "spans")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM items),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT pos.doc_id, pos.n, pos.i, items.item_id FROM pos JOIN items ON pos.n = items.n AND pos.win = items.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
