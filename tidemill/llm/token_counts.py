"""Token counts of a public tokenizer, without making token ids of whole texts.

Texts are split to pre-tokens twice.  First their different pre-tokens are gathered in one table, summed in tasks and over them, and
the pieces of each are counted once.  Then every document's pre-token frequencies are joined to that table and summed.  The most
frequent pre-tokens of the table, as many as one broadcast may hold, are joined in the tasks that split the documents, so their frequencies
are never rows; the rest, if there is one, is joined by a shuffle of documents' rare pre-tokens alone.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, sliced, table

NAME = "op10_token_counts"
SQL = None  # no SQL counts byte-pair pieces
#: Different pre-tokens that a task holds before it passes their sums on.
HELD = 300_000
#: Pre-tokens of the table that are broadcast (some 100 bytes each in a task, so 100 MB); all others are joined by a shuffle.
FEW = 1_000_000
#: Longer pre-tokens are counted where they stand: they are hardly ever met twice, and may be as long as a text.
LONGEST = 200
#: Texts of these characters only are split by PLAIN; others by the tokenizer library's own splitter.
PLAIN_TEXT = re.compile(r"[\t\n\r -~À-ÖØ-öø-ɏ]*")
#: The byte-level splitting rule, for PLAIN_TEXT.
PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Splitter:
    """Splits texts as a byte-level tokenizers file does, and counts pieces of pre-tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=lambda s: (-len(s), s))
        self.cut = re.compile("|".join(map(re.escape, special))) if special else None

    def split(self, text: str | None) -> tuple[int, Counter]:
        """(tokens that are known at once, frequencies of pre-tokens): a special token's string in a text is one token, as the
        library has it by default, and long pre-tokens are counted here."""
        found: Counter = Counter()
        if not text:
            return 0, found
        parts = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
        fixed = len(parts) - 1
        for part in parts:
            if PLAIN_TEXT.fullmatch(part):
                found.update(PLAIN.findall(part))
            else:
                found.update(part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part))
        long = [p for p in found if len(p) > LONGEST]
        if long:
            fixed += sum(n * found.pop(p) for p, n in zip(long, self.pieces(long), strict=True))
        return fixed, found

    def pieces(self, parts: list[str]) -> list[int]:
        """How many tokens each of some pre-tokens is."""
        return list(map(len, self.tok.encode_batch(parts, add_special_tokens=False)))


def pre_tokens(texts: DataFrame, path: str) -> DataFrame:
    """(pre, n, pieces): the different pre-tokens of all texts (one column), how often they occur, and how many tokens each is."""

    def gather(batches):
        splitter, held = Splitter(path), Counter()
        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                held.update(splitter.split(text)[1])
            if len(held) > HELD:
                yield passed(held)
                held = Counter()
        if held:
            yield passed(held)

    def passed(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], names=["pre", "n"])

    def count(batches):
        splitter = Splitter(path)
        for b in sliced(batches, 10_000):
            pieces = pa.array(splitter.pieces(b.column(0).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pieces], names=["pre", "n", "pieces"])

    found = texts.mapInArrow(gather, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return found.mapInArrow(count, "pre string, n long, pieces int")


def frequent(pre: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(the rows of the highest powers of two of n that are at most so many, the others or None)."""
    level = F.floor(F.log2("n"))
    counts = {r[0]: r[1] for r in pre.groupBy(level.alias("level")).count().collect()}  # some 60 rows
    total, least = 0, None
    for k in sorted(counts, reverse=True):
        total += counts[k]
        if total > most:
            break
        least = k
    if total <= most:
        return pre, None
    if least is None:
        return pre.limit(0), pre
    return pre.filter(level >= least), pre.filter(level < least)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs, one result row for each.

    Null text counts as empty: 0 bytes, 0 tokens.  Null and repeated ids are passed on as they are.  Texts are counted
    whole, however long.  An empty table gives none.  Columns other than the two named are not read.  few: pre-tokens that are broadcast.
    """
    known, rest = frequent(checkpointed(pre_tokens(docs.select(F.col(text_col).alias("text")), path)), few)
    t = known.select("pre", "pieces").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)))
    rare_type = pa.list_(pa.struct([("pre", pa.string()), ("times", pa.int64())]))

    def run(batches):
        splitter, pieces = Splitter(path), shared.value.get
        for b in sliced(batches):
            counts, rare = [], []
            for text in b.column(1).to_pylist():
                total, found = splitter.split(text)
                each = list(map(pieces, found))
                if None in each:
                    rare.append([{"pre": p, "times": found[p]} for p, n in zip(found, each, strict=True) if n is None])
                    each = [n or 0 for n in each]
                else:
                    rare.append([])
                counts.append(total + sum(map(mul, each, found.values())))
            cols = [b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array(rare, rare_type)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "rare"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, rare array<struct<pre:string,times:bigint>>")
    if rest is not None:
        out = checkpointed(out.withColumn("row", F.monotonically_increasing_id()))
        other = out.select("row", F.inline("rare")).join(rest.select(F.col("pre").alias("_pre"), "pieces").hint("merge"), F.col("pre") == F.col("_pre"))
        more = other.groupBy(F.col("row").alias("_row")).agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
        out = out.join(more.hint("merge"), F.col("row") == F.col("_row"), "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
