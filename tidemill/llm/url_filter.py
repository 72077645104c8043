"""Verdicts on urls: rules first, then naive Bayes over words of the host, split by a unigram Viterbi, and tokens of the path.

The dictionary is counted over page titles.  Letter runs of distinct hosts are cut into all their short substrings, which
are joined to the dictionary; a run's found words are gathered and the split of highest probability is kept.  Examples are
urls that a rule judges, and urls that name a word of BLOCK_WORDS; what the rules themselves name is no feature, as it would only
repeat them.  Features are hashed to BUCKETS numbers, so the model has one size however many words there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, sliced, table

NAME = "op12_url_filter"
SQL = None  # SQL finds no most probable split
#: (host, path, verdict); of rules that fit a url the longest decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words in a host or path that make a url an example of what to block.
BLOCK_WORDS = tuple(
    "adult bet betting casino cheap crack cracked escort gambling keygen loan loans lottery phishing pill pills poker porn replica scam sex slots spam torrent viagra warez xxx".split()
)
#: Share of the dictionary's words that each of BLOCK_WORDS counts for, besides its own occurrences.
BLOCK_SHARE = 1e-4
#: The longest word that is looked up.
LONGEST = 24
BUCKETS = 1 << 18
#: Hosts up to this many (some 200 bytes each) are broadcast to their urls.
FEW_HOSTS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no "://"."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting(host: Column, path: Column, rules: tuple, k: int) -> Column:
    """Of the longest rule that fits, its text (k = 0) or its verdict (1), or null; of equally long ones the first by text."""
    found = []
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found.append(F.when(fits, F.lit((h + p, verdict)[k])))
    return F.coalesce(*found, F.lit(None).cast("string"))


def named(rules: tuple) -> set[str]:
    """The words that rules are made of."""
    return {w for h, p, _ in rules for w in "".join(c if c in LOWER else " " for c in (h + p).lower()).split()}


def dictionary(pages: DataFrame) -> DataFrame:
    """(word, n): words of a-z in page titles, case ignored, up to LONGEST letters."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1)
    words = F.filter(F.regexp_extract_all(F.lower(title), F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.rlike(rf"^[a-z]{{1,{LONGEST}}}$"))
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def best_split(run: str, found: list[tuple[int, int, float]], total: float) -> list[str]:
    """The words of highest probability that make a run.  found: begin, length and count of dictionary words in it.

    A stretch that is no word costs a rare word's probability and a tenth for each letter; of equal splits the one whose last
    word is longest is kept.
    """
    size, ending = len(run), {}
    for begin, length, n in found:
        ending.setdefault(begin + length, []).append((begin, math.log(n / total)))
    best, unknown, begins = [0.0] * (size + 1), [(-math.inf, 0)] * (size + 1), [0] * (size + 1)
    rare, tenth = math.log(10 / total), math.log(10)
    for end in range(1, size + 1):
        more, anew = unknown[end - 1][0] - tenth, best[end - 1] + rare - tenth
        unknown[end] = (more, unknown[end - 1][1]) if more >= anew else (anew, end - 1)
        best[end], begins[end] = unknown[end]
        for begin, cost in sorted(ending.get(end, ())):
            score = best[begin] + cost
            if score > best[end] or score == best[end] and begin < begins[end]:
                best[end], begins[end] = score, begin
    words, end = [], size
    while end:
        words.append(run[begins[end] : end])
        end = begins[end]
    return words[::-1]


def host_words(hosts: DataFrame, words: DataFrame, block_words: tuple = BLOCK_WORDS) -> DataFrame:
    """(host, words) of distinct hosts that have a letter.  words: the dictionary, (word, n)."""
    spark = hosts.sparkSession
    total = float(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) or 1.0
    more = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in block_words])).alias("word"), F.lit(BLOCK_SHARE * total).alias("n"))
    words = words.select("word", F.col("n").cast("double").alias("n")).unionByName(more).groupBy("word").agg(F.sum("n").alias("n"))
    total *= 1 + BLOCK_SHARE * len(block_words)
    per_host = hosts.select("host", F.explode(F.array_distinct(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0)))).alias("run"))
    runs = per_host.select("run").distinct()
    # A long run goes by its hash, so that its substrings don't carry it along.
    key = F.when(F.length("run") <= 32, F.col("run")).otherwise(F.concat(F.lit("#"), F.sha2("run", 256)))
    runs = checkpointed(runs.withColumn("key", key))
    begin = runs.select("key", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("begin"))
    longest = F.least(F.lit(LONGEST), F.length("run") - F.col("begin") + 1)
    cut = begin.select("key", "begin", F.substr("run", "begin", F.lit(LONGEST)).alias("rest"), F.explode(F.sequence(F.lit(1), longest)).alias("size"))
    cut = cut.select("key", "begin", "size", F.substr("rest", F.lit(1), "size").alias("cut"))
    found = cut.join(words.hint("merge"), F.col("cut") == F.col("word")).groupBy(F.col("key").alias("_k")).agg(
        F.collect_list(F.struct((F.col("begin") - 1).alias("begin"), "size", "n")).alias("found")
    )

    def split(batches):
        for b in sliced(batches):
            made = []
            for run, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                made.append(best_split(run, [(h["begin"], h["size"], h["n"]) for h in hits or ()], total))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(made, pa.list_(pa.string()))], names=["_r", "words"])

    each = runs.join(found.hint("merge"), F.col("key") == F.col("_k"), "left").select("key", "run", "found").mapInArrow(split, "_r string, words array<string>")
    joined = per_host.join(each.hint("merge"), F.col("run") == F.col("_r"))
    return joined.groupBy("host").agg(F.flatten(F.array_sort(F.collect_list("words"))).alias("words"))


def features(pages: DataFrame, rules: tuple = RULES, block_words: tuple = BLOCK_WORDS) -> DataFrame:
    """(page_id, host, path, rule, given, label, buckets) of every row; label: what a row is an example of, or null."""
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = checkpointed(host_words(urls.select("host").distinct(), dictionary(pages), block_words))
    hosts = hosts.withColumnRenamed("host", "_h").hint("broadcast" if hosts.count() <= FEW_HOSTS else "merge")
    df = urls.join(hosts, F.col("host") == F.col("_h"), "left").drop("_h")
    none = F.array().cast("array<string>")
    own = F.coalesce("words", none)
    inside = F.regexp_extract_all(F.translate("path", UPPER, LOWER), F.lit("[a-z]+"), F.lit(0))
    digits = F.when(F.col("path").rlike("[0-9]"), F.array(F.lit("0"))).otherwise(none)
    stop = F.array(*[F.lit(w) for w in sorted(named(rules))]).cast("array<string>")
    plain = lambda a: F.filter(a, lambda w: ~F.array_contains(stop, w))
    marked = F.arrays_overlap(F.concat(own, inside), F.array(*[F.lit(w) for w in block_words]).cast("array<string>"))
    bucket = lambda kind: lambda w: F.pmod(F.xxhash64(F.lit(kind), w), F.lit(BUCKETS)).cast("int")
    given = fitting(F.col("host"), F.col("path"), rules, 1)
    return df.select(
        "page_id",
        "host",
        "path",
        fitting(F.col("host"), F.col("path"), rules, 0).alias("rule"),
        given.alias("given"),
        F.when(marked, "block").otherwise(given).alias("label"),
        F.concat(F.transform(plain(own), bucket("host")), F.transform(F.concat(plain(inside), digits), bucket("path"))).alias("buckets"),
    )


def fitted(df: DataFrame) -> tuple[np.ndarray, float]:
    """(what each bucket adds to the log odds of block against allow, what they are before any), with one added to all counts."""
    sides = [F.count_if(F.col("label") == k).alias(k) for k in ("block", "allow")]
    known = df.filter("label is not null")
    rows = known.agg(*sides).first()
    t = known.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*sides).toArrow()  # BUCKETS rows at most
    counts = np.ones((2, BUCKETS))
    for k, side in enumerate(("block", "allow")):
        counts[k, t.column("bucket").to_numpy()] += t.column(side).to_numpy()
    weights = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    return weights, math.log((rows["block"] + 1) / (rows["allow"] + 1))


def judged(pages: DataFrame, rules: tuple = RULES, block_words: tuple = BLOCK_WORDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages.

    host: what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: what follows up to "?" or "#"; of a
    url that is null or has no "://" both are empty.  A rule judges its host and all subdomains where the path begins with the
    rule's; the longest decides.  Other urls are blocked where naive Bayes finds that likelier; score is its log odds, of all urls.
    Without examples of either kind the odds are even and even odds allow.  Null and repeated ids pass through; null html has no
    title; an empty table gives none.  Columns other than page_id, url and html are not read, nor any of html but titles.
    """
    df = checkpointed(features(pages, rules, block_words))
    weights, prior = fitted(df)
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            lists = b.column(5)
            at = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            score = prior + np.bincount(np.repeat(np.arange(b.num_rows), sizes), w[at], minlength=b.num_rows)
            given = b.column(4).to_pylist()
            verdict = [g or ("block" if s > 0 else "allow") for g, s in zip(given, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(verdict, pa.string()), pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "score"]
            )

    kind = dict(pages.dtypes)["page_id"]
    return df.drop("label").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
