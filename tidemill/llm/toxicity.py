"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the sum of an embedding of its own (if the sample knows it) and the mean embedding of its character 3- and
4-grams.  The network reads windows of WINDOW words, each STRIDE words after the last; a text's score is that of its
highest-scoring window.  As labels belong to texts, not windows, training begins with every window under its text's label and
goes on with those windows of toxic texts that score highest in their text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mixed, table, with_text_columns

NAME = "op7_toxicity"
SQL = None  # SQL trains no network
#: Labelled texts of each class that the network is fitted to, at most: those of the least text hash.
SAMPLE_TEXTS = 1_500
#: Windows of a text that one epoch is expected to draw, so that no long text outweighs the others.  Each epoch draws anew from all of them, and
#: the windows of toxic texts that it goes on with are chosen among all.
EPOCH_WINDOWS = 75
WINDOW, STRIDE = 24, 16
#: Shrinking of embeddings at each step, as a share of the learning rate.
DECAY = 0.02
HIDDEN, WIDTH = 12, 16
GRAM_BUCKETS, KNOWN_WORDS = 1 << 14, 8_000
#: Steps that training takes at least, if six times the usual number of epochs allow.
FEWEST_STEPS = 1_200
#: Words whose gate inputs a task remembers.
CACHE = 100_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each character 3- and 4-gram, number of its word), a mark at either end of a word; every word has some."""
    data = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    out, of = [], []
    k = np.uint64(0x9E3779B97F4A7C15)
    for n in (3, 4):
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for i in range(n):
            h = (h + data[i : len(data) - n + 1 + i] + np.uint64(1)) * k
            h ^= h >> np.uint64(31)
        own = owner[: len(h)] == owner[n - 1 :]
        out.append(mixed(h[own]) % np.uint64(GRAM_BUCKETS))
        of.append(owner[: len(h)][own])
    return (np.concatenate(out).astype(np.int64), np.concatenate(of)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def starts(n: int) -> list[int]:
    """Where the windows of a text of n words begin; together they cover it whole."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """The weights, by name, and the words with an embedding of their own."""

    p: dict[str, np.ndarray]
    known: dict[str, int]

    @staticmethod
    def new(known: dict[str, int], seed: int) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, s: r.normal(0, s, shape).astype(np.float32)
        p = {
            "word": f(len(known) + 1, WIDTH, s=0.1),
            "gram": f(GRAM_BUCKETS, WIDTH, s=0.3),
            "v": f(2 * HIDDEN, s=0.3),
            "u": f(2 * HIDDEN, s=0.3),
            "b": np.zeros(1, np.float32),
        }
        p["word"][0] = 0
        for d in "fb":
            p |= {f"W{d}": f(WIDTH, 3 * HIDDEN, s=0.4), f"U{d}": f(HIDDEN, 3 * HIDDEN, s=0.25), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return Network(p, known)

    def vectors(self, words: list[str], own: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Input vectors of words; own: the embedding numbers to use instead of the known ones."""
        ids = own if own is not None else np.fromiter((self.known.get(w, 0) for w in words), np.int64, len(words))
        g, of = grams(words)
        order = np.argsort(of, kind="stable")
        g, of = g[order], of[order]
        n = np.bincount(of, minlength=len(words)).astype(np.float32)
        x = np.add.reduceat(
            self.p["gram"][g],
            np.searchsorted(of, np.arange(len(words))),
            axis=0,
        ) / n[:, None] if len(words) else np.empty((0, WIDTH), np.float32)
        return x + self.p["word"][ids], (ids, g, of, n)

    def gates(self, words: list[str]) -> np.ndarray:
        """Gate inputs of both directions for words."""
        out = np.empty((len(words), 6 * HIDDEN), np.float32)
        for i in range(0, len(words), 5_000):
            x, _ = self.vectors(words[i : i + 5_000])
            out[i : i + len(x)] = np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)
        return out

    def forward(self, gates: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows; at: rows of gates, -1 where a window has no word."""
        n, steps = at.shape
        there = at >= 0
        h = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        tape = {}
        for d, order, cols in (("f", range(steps), slice(0, 3 * HIDDEN)), ("b", range(steps - 1, -1, -1), slice(3 * HIDDEN, None))):
            own, now = (slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)), np.zeros((n, HIDDEN), np.float32)
            part = gates[:, cols]
            for t in order:
                x, hu = part[at[:, t]], now @ self.p[f"U{d}"]
                zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = c + z * (now - c)
                new[~there[:, t]] = 0
                if keep:
                    tape[d, t] = now, z, r, c, hu[:, 2 * HIDDEN :]
                h[t, :, own] = now = new
        s = np.where(there.T, h @ self.p["v"], -1e9)
        a = np.exp(s - s.max(0)) * there.T
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * h).sum(0)
        logit = pooled @ self.p["u"] + self.p["b"][0]
        return (logit, (h, a, pooled, tape)) if keep else logit

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted logistic loss: by every weight, and by the input vectors x."""
        p = self.p
        gates = np.concatenate([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]], axis=1)
        logit, (h, a, pooled, tape) = self.forward(gates, at, keep=True)
        g = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        out = {"u": pooled.T @ g, "b": np.array([g.sum()], np.float32)}
        dc = g[:, None] * p["u"]
        da = (h * dc).sum(2)
        ds = a * (da - (a * da).sum(0))
        dh = a[:, :, None] * dc + ds[:, :, None] * p["v"]
        out["v"] = (ds[:, :, None] * h).sum((0, 1))
        dx = np.zeros_like(x)
        steps = at.shape[1]
        for d, order, own in (("f", range(steps - 1, -1, -1), slice(0, HIDDEN)), ("b", range(steps), slice(HIDDEN, None))):
            back = np.zeros((len(y), HIDDEN), np.float32)
            dg, du = np.zeros((len(x), 3 * HIDDEN), np.float32), np.zeros_like(p[f"U{d}"])
            for t in order:
                now, z, r, c, hc = tape[d, t]
                e = (dh[t, :, own] + back) * (at[:, t] >= 0)[:, None]
                dn = e * (1 - z) * (1 - c * c)
                dz = e * (now - c) * z * (1 - z)
                dr = dn * hc * r * (1 - r)
                hu = np.concatenate([dz, dr, dn * r], axis=1)
                du += now.T @ hu
                back = e * z + hu @ p[f"U{d}"].T
                gate = np.concatenate([dz, dr, dn], axis=1)
                order_t = np.argsort(at[:, t], kind="stable")
                rows = at[order_t, t]
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                dg[rows[first]] += np.add.reduceat(gate[order_t], first, axis=0)  # row -1 has only zeros
            out |= {f"W{d}": x.T @ dg, f"U{d}": du, f"c{d}": dg.sum(0)}
            dx += dg @ p[f"W{d}"].T
        return out, dx


def numbered(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The different words of some texts in order, and each text as numbers of its words: no Python object stays for a word that repeats."""
    found: dict[str, int] = {}
    docs = []
    for t in texts:
        words = words_of(t)
        docs.append(np.fromiter((found.setdefault(w, len(found)) for w in words), np.int32, len(words)))
    names = sorted(found)
    place = np.empty(len(names), np.int32)
    place[np.fromiter(map(found.__getitem__, names), np.int64, len(names))] = np.arange(len(names), dtype=np.int32)
    return names, [place[d] for d in docs]


def grams_by_word(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of grams, word after word, and where each word's begin); some words are worked on at a time."""
    buckets, sizes = [np.empty(0, np.int16)], [np.zeros(1, np.int64)]
    for i in range(0, len(names), 5_000):
        g, of = grams(names[i : i + 5_000])
        buckets.append(g[np.argsort(of, kind="stable")].astype(np.int16))  # GRAM_BUCKETS fits
        sizes.append(np.bincount(of, minlength=len(names[i : i + 5_000])))
    return np.concatenate(buckets), np.cumsum(np.concatenate(sizes))


def fit(texts: list[str], labels: list[int], epochs: tuple[int, int] = (3, 5), seed: int = 7, rate: float = 0.01, most: int = 512) -> Network:
    """Train on texts with labels 0 or 1, whole.  Without both classes the result scores everything near 0."""
    y = np.array(labels, np.int64)
    names, docs = numbered(texts)
    count = dict(zip(names, np.bincount(np.concatenate([np.empty(0, np.int32), *map(np.unique, docs)]), minlength=len(names)).tolist(), strict=True))
    known = [w for w in sorted(count, key=lambda w: (-count[w], w)) if count[w] >= 5][:KNOWN_WORDS]
    net = Network.new({w: i + 1 for i, w in enumerate(known)}, seed)
    if not len(y) or y.min() == y.max():
        net.p["b"][0], net.p["u"][:] = -4, 0
        return net
    test = np.arange(len(y)) % 4 == 3  # not trained on: sets the level of 0.5
    ids = np.fromiter((net.known.get(w, 0) for w in names), np.int64, len(names))
    g, bounds = grams_by_word(names)
    firsts = [starts(len(d)) for d in docs]
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), list(map(len, firsts)))
    at, n = np.full((len(doc), WINDOW), -1, np.int32), 0  # windows of word numbers
    for d, first in zip(docs, firsts, strict=True):
        if len(d) < WINDOW:
            at[n, : len(d)] = d
        else:
            at[n : n + len(first)] = np.lib.stride_tricks.sliding_window_view(d, WINDOW)[first]
        n += len(first)
    del docs, firsts
    share = EPOCH_WINDOWS / np.bincount(doc, minlength=len(y))[doc]  # the chance of a window to be drawn
    drawn = int(np.minimum(share, 1).sum())
    r = np.random.default_rng(seed)
    batch = min(most, max(32, drawn // 20))
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0

    def score(rows):
        gates = net.gates(names)
        return np.concatenate([net.forward(gates, at[rows[i : i + 4096]]) for i in range(0, len(rows), 4096)])

    more = min(6, max(1, -(-FEWEST_STEPS // (sum(epochs) * max(1, len(doc) // batch)))))  # few texts are gone through more often
    epochs = (epochs[0] * more, epochs[1] * more)
    for epoch in range(sum(epochs)):
        some = r.random(len(doc)) < share
        pos, neg = np.flatnonzero((y[doc] == 1) & ~test[doc]), np.flatnonzero((y[doc] == 0) & ~test[doc] & some)
        if epoch < epochs[0]:
            pos = pos[some[pos]]
        else:
            s = score(pos)
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, doc[pos], s)
            pos = pos[(s >= best[doc[pos]]) | (s > 1)]
            s = score(neg)
            hard = neg[np.argsort(-s, kind="stable")[: len(neg) // 4]]
            neg = np.concatenate([hard, r.choice(neg, len(neg) // 4)])
        rows = np.concatenate([pos, neg])
        target = np.r_[np.ones(len(pos)), np.zeros(len(neg))]
        weight = np.r_[np.full(len(pos), len(rows) / 2 / len(pos)), np.full(len(neg), len(rows) / 2 / len(neg))]
        for part in np.array_split(r.permutation(len(rows)), max(1, len(rows) // batch)):
            windows = at[rows[part]]
            used, local = np.unique(windows, return_inverse=True)
            local = local.reshape(windows.shape)
            if used[0] == -1:
                used, local = used[1:], local - 1
            n = bounds[used + 1] - bounds[used]
            own = np.repeat(np.arange(len(used)), n)
            gs = g[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[used], n)]
            wid = ids[used] * (r.random(len(used)) < 0.5)  # half of the time the characters must do
            x = np.add.reduceat(net.p["gram"][gs], np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32) + net.p["word"][wid]
            grad, dx = net.gradients(x, local, target[part], weight[part])
            dw = np.zeros_like(net.p["word"])
            np.add.at(dw, wid, dx)
            dw[0] = 0
            o = np.argsort(gs, kind="stable")
            first = np.flatnonzero(np.r_[True, gs[o][1:] != gs[o][:-1]])
            dgram = np.zeros_like(net.p["gram"])
            dgram[gs[o][first]] = np.add.reduceat((dx / n[:, None])[own[o]], first, axis=0)
            grad |= {"word": dw, "gram": dgram}
            step += 1
            lr = rate * (1 - 0.9 * epoch / sum(epochs))
            for k, v in grad.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                if k in ("gram", "word"):
                    net.p[k] *= 1 - lr * DECAY
                net.p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, doc, score(np.arange(len(doc))))
    if len(set(y[test])) == 2:
        best, seen = best[test], y[test]
    else:
        seen = y
    # Put 0.5 where fewest texts are on the wrong side; of equal places, midway.
    cuts = np.sort(best)
    cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    pos, neg = np.sort(best[seen == 1]), np.sort(best[seen == 0])
    wrong = np.searchsorted(pos, cuts) / len(pos) + (1 - np.searchsorted(neg, cuts) / len(neg))
    good = cuts[wrong <= wrong.min() + 1e-9]
    net.p["b"][0] -= (good[0] + good[-1]) / 2
    return net


class Scorer:
    """Scores texts; remembers the gate inputs of words."""

    def __init__(self, net: Network, cache: int = CACHE):
        self.net, self.cache, self.at = net, cache, {}
        self.gates = np.empty((0, 6 * HIDDEN), np.float32)
        self.used = 0

    def rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        new = list({w for d in docs for w in d if w not in self.at})
        if self.used + len(new) > self.cache and self.used:
            self.at, self.gates, self.used = {}, np.empty((0, 6 * HIDDEN), np.float32), 0
            new = list({w for d in docs for w in d})
        if self.used + len(new) > len(self.gates):
            more = np.empty((max(self.used + len(new), min(2 * len(self.gates), self.cache)), 6 * HIDDEN), np.float32)
            more[: self.used] = self.gates[: self.used]
            self.gates = more
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.gates[self.used : self.used + len(part)] = self.net.gates(part)
            self.at.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)
        return [np.fromiter(map(self.at.__getitem__, d), np.int64, len(d)) for d in docs]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """(score of each text, number of its first word of the highest window)."""
        docs = [words_of(t) for t in texts]
        owner, first, windows = [], [], []
        for i, row in enumerate(self.rows(docs)):
            s = np.array(starts(len(row)))
            owner.append(np.full(len(s), i))
            first.append(s)
            windows.append(
                np.pad(
                    row,
                    (0, WINDOW - len(row)),
                    constant_values=-1,
                )[None, :] if len(row) < WINDOW else np.lib.stride_tricks.sliding_window_view(row, WINDOW)[s]
            )
        owner, first, windows = np.concatenate(owner), np.concatenate(first), np.concatenate(windows)
        gates = self.gates if len(self.gates) else np.zeros((1, 6 * HIDDEN), np.float32)
        logit = np.concatenate([self.net.forward(gates, windows[i : i + 2048]) for i in range(0, len(windows), 2048)])
        order = np.lexsort((first, -logit, owner))
        top = order[np.searchsorted(owner[order], np.arange(len(texts)))]
        return _sigmoid(logit[top].astype(np.float64)), first[top].tolist()


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_TEXTS) -> tuple[list[str], list[int]]:
    """At most per_class texts of each label, those of the least text hash; rows without text or label don't count.

    Rows of labels that repeat a doc_id count as toxic if one of them is.
    """
    flags = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    many = {r[0]: r[1] for r in flags.groupBy("toxic").count().collect()}
    rows = docs.filter(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("h")).join(flags.hint("merge"), "doc_id")
    # Hashes are even, so a few times the wanted share of each class is enough to choose from; texts are fetched last.
    share = F.element_at(
        F.create_map(*[F.lit(v) for c, n in many.items() for v in (c, min(1.0, 8 * per_class / n))]),
        F.col("toxic"),
    ) if many else F.lit(1.0)
    rows = rows.filter((F.col("h") / 2.0**64 + 0.5) <= share).groupBy("toxic", "h").agg(F.min("doc_id").alias("id"))
    chosen = rows.withColumn("k", F.row_number().over(Window.partitionBy("toxic").orderBy("h"))).filter(F.col("k") <= per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).filter(F.xxhash64("text") == F.col("h"))  # 2 x per_class rows
    found = sorted({(r["h"], r["text"], r["toxic"]) for r in rows.select("h", "text", "toxic").collect()})
    return [x[1] for x in found], [x[2] for x in found]


def score(docs: DataFrame, net: Network, prefix: str = "") -> DataFrame:
    """docs with score, window and predicted (names after prefix) for its whole text; window: first word of the worst window.

    Null, empty or wordless text has the score of an empty window, near 0.  Of equal windows the first counts.  Every row is
    passed on with all its columns, whatever is null or repeated in it; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def maker():
        s = Scorer(shared.value)

        def run(texts):
            value, at = s.scores(texts)
            return value, at, (value >= 0.5).astype(np.int32)

        return run

    extra = [(prefix + "score", "double", pa.float64()), (prefix + "window", "long", pa.int64()), (prefix + "predicted", "int", pa.int32())]
    return with_text_columns(docs, extra, maker, 256)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that a network learnt from its labelled rows does not reject, with their columns.

    Null and empty texts are scored like any others, rows that repeat an id or a text each for themselves, so that equal texts stay or go
    together.  A score of exactly 0.5 rejects.  Without labels of both kinds all stay; an empty table gives none.  Columns of docs
    may have any names but those that begin with __tm_.
    """
    return score(docs, fitted(docs, labels), "__tm_").filter("__tm_predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def held_out(fold: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> Network:
    """The network of the query and the pipeline: learnt from rows, and labels, that are not held out."""
    return fit(*sample(docs.filter(~held_out()), labels.filter(~held_out())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "window")
