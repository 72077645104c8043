"""Language identification by compression: a text belongs to the language whose dictionary compresses it best."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, sliced, table

NAME = "op8_language_id"
SQL = None  # SQL has no compressor
UND = "und"
#: Training texts a language gives at most, and bytes of its dictionary: the bounds of the fitted sample.
SAMPLE_TEXTS, DICT_BYTES = 400, 65_536
#: Bytes of the pieces, spread evenly over a training text, that a dictionary is made of.
SPREAD = 200
#: Bytes of a text that are compressed at a time.  Short pieces keep the dictionary, not the text itself, the best help.
PIECE = 1_500
#: zstandard level and shortest match; the optimal parser makes the most of a dictionary.
LEVEL, SHORTEST = 3, 3
#: Share of the best size by which the second best must be larger; else the prediction is marked as not reliable.
MARGIN = 0.02
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))  # digits of other kinds are no letters


def plain(text: str) -> str:
    """Lower-case letters, one space for all else: what is compressed, of training texts too."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def spread(data: bytes, most: int) -> list[bytes]:
    """At most that many bytes of data: all of it, or pieces at even distances from its start to its end."""
    if len(data) <= most:
        return [data]
    n = max(1, most // SPREAD)
    size = most // n
    return [data[at : at + size] for at in ((len(data) - size) * k // max(1, n - 1) for k in range(n))]


def dictionary(texts: list[list[bytes]], most: int) -> bytes:
    """One dictionary of at most that many bytes from pieces of every text; short texts leave their share to longer ones."""
    sizes = sorted(sum(map(len, t)) for t in texts)
    left, each = most, 0
    for k, n in enumerate(sizes):
        each = max(each, left // (len(sizes) - k))
        if n >= each:
            break
        left -= n
    return b"".join(x for t in texts for x in spread(b"".join(t), each))


#: Bytes, in pieces spread over the whole text, that a sampled text may give to its label's dictionary: with SAMPLE_TEXTS texts that is
#: several times DICT_BYTES, so only where texts are few does it bind, and then the dictionary holds all there is.
TEXT_BYTES = 4096
#: Sampled texts of all labels (some 60 bytes each) that are broadcast to fetch them; more are joined by a shuffle.
FEW_TEXTS = 200_000


def fit(
    docs: DataFrame,
    label: str = "lang",
    text_col: str = "text",
    per_label: int = SAMPLE_TEXTS,
    dict_bytes: int = DICT_BYTES,
) -> dict[str, bytes]:
    """label -> raw-content dictionary, from at most per_label whole texts of each label, those of the least text hash.

    Rows without label or text don't count; of equal texts one does.  Every sampled text gives the same share of its label's
    dictionary, in pieces spread over all of it.  The labels come in order of their number of rows, which settles ties.
    Labels are a closed list of languages; the driver gets per_label x TEXT_BYTES bytes of each at most.

    A threshold on the hash leaves a few times the wanted number to choose from, so no label gathers in one task; texts are
    fetched last, for the chosen hashes only.
    """
    rows = docs.filter(F.col(label).isNotNull() & (F.length(text_col) > 0)).select(F.col(label).alias("label"), F.xxhash64(text_col).alias("h"))
    share = {r[0]: r[1] for r in docs.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not share:
        return {}
    part = F.element_at(F.create_map(*[F.lit(v) for name, n in share.items() for v in (name, min(1.0, 8 * per_label / n))]), F.col("label"))
    few = rows.filter(F.col("h") / 2.0**64 + 0.5 <= part).distinct()
    top = few.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h"))).filter(F.col("k") <= per_label)
    top = checkpointed(top.select(F.col("label").alias("_l"), F.col("h").alias("_h")))  # labels x per_label rows

    def pieces(batches):
        for b in sliced(batches, 64):
            found = [spread(plain(t).encode("utf-8", "replace"), TEXT_BYTES) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary()))], names=["label", "h", "pieces"])

    chosen = docs.select(
        F.col(label).alias("label"),
        F.xxhash64(text_col).alias("h"),
        F.col(text_col).alias("text"),
    ).join(top.hint("broadcast" if len(share) * per_label <= FEW_TEXTS else "merge"), (F.col("label") == F.col("_l")) & (F.col("h") == F.col("_h")))
    chosen = chosen.select("label", "h", "text").mapInArrow(pieces, f"label {dict(docs.dtypes)[label]}, h long, pieces array<binary>")
    texts: dict[str, dict] = {}
    for r in chosen.groupBy("label", "h").agg(F.min("pieces").alias("pieces")).collect():
        texts.setdefault(r["label"], {})[tuple(map(bytes, r["pieces"]))] = r["h"]
    order = sorted(texts, key=lambda name: (-share[name], name))
    return {name: dictionary([list(t) for t, _ in sorted(texts[name].items(), key=lambda x: x[1])], dict_bytes) for name in order}


class Compressors:
    """Sizes of texts under each label's dictionary."""

    def __init__(self, dicts: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.names, self.by = list(dicts), []
        params = z.ZstdCompressionParameters.from_level(
            level,
            window_log=17,
            min_match=SHORTEST,
            strategy=z.STRATEGY_BTOPT,
            write_content_size=0,
            write_checksum=0,
            write_dict_id=0,
        )
        for name in self.names:
            d = z.ZstdCompressionDict(dicts[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        """The whole text, piece by piece; a constant frame header is not counted."""
        data = plain(text).encode("utf-8", "replace")
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(max(1, len(c.compress(p)) - 9) for p in pieces) for c in self.by]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(label, score 0 to 1, whether the margin is wide enough)."""
        if not text or not self.names or not has_letter(text):
            return UND, 0.0, False
        sizes = self.sizes(text)
        (best, k), *rest = sorted((s, k) for k, s in enumerate(sizes))
        if not rest:
            return self.names[k], 1.0, True
        margin = (rest[0][0] - best) / best
        return self.names[k], min(1.0, 0.5 + 0.5 * margin / (margin + MARGIN)), margin >= MARGIN


def identify(docs: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, reliable) of every row of docs: the label whose dictionary compresses the whole text best.

    Null text, and text without a letter, is `und` with score 0; so is all when nothing was learnt.  Equal sizes go to the label with
    more rows to learn from, with score 0.5.  reliable is false when the margin is narrow.  Null and repeated ids pass through; an empty
    table gives none; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(dicts)

    def run(batches):
        c = Compressors(shared.value)
        for b in sliced(batches):
            found = [c.predict(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "lang_pred", "score", "reliable"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, lang_pred string, score double, reliable boolean",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = identify(docs, fit(docs.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "reliable")
