"""Operators on pairs and repeats, and the pipeline: against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import fuzzy_lines, near_embeddings, repeated_substrings, shingle_join
from tidemill.llm.common import WordHashes, components, shingle_hashes


class Groups:
    """Union-find whose roots are the least members."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(1)
    edges = [
        (r.randrange(300), r.randrange(300)) for _ in range(250)
    ] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(50)] + [(5, 5), (None, 7)]
    g = Groups()
    for a, b in edges:
        if a is not None and a != b:
            g.join(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.component for x in got} == {x: g.find(x) for x in g.up} and len(got) == len(g.up)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_tell_texts_apart():
    h = WordHashes(most=10)
    of = lambda t: shingle_hashes(h.of(t.split()), 5).tolist()
    assert len(of("a b c d e f")) == 2 and len(of("a b")) == 1 and of("") == [] and of("a b") != of("b a") and of("a b c d e") == of("a b c d e")


def brute_vectors(rows, t):
    fit = {}
    for k, (i, e, label) in enumerate(rows):
        if i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            fit[k] = np.array(e, float)
    links, g = Counter(), Groups()
    for a in fit:
        for b in fit:
            if a < b and rows[a][2] == rows[b][2] and len(fit[a]) == len(fit[b]) and fit[a] @ fit[b] / np.linalg.norm(fit[a]) / np.linalg.norm(fit[b]) >= t:
                links[a] += 1
                links[b] += 1
                g.join(rows[a][0], rows[b][0])
    return sorted((str(i), links[k], str(None if i is None else g.find(i)), i is not None and g.find(i) == i) for k, (i, e, label) in enumerate(rows))


def small_and_large(rows):
    """The rows as brute force can compare them: no square vanishes or overflows."""
    return [(i, e and [x * 2.0**600 if abs(x or 0) < 1e-100 else x * 2.0**-600 if abs(x or 0) > 1e100 else x for x in map(lambda x: x if x is None else float(x), e)], label) for i, e, label in rows]


def test_embeddings_of_repeated_ids_and_odd_sizes(spark):
    one, two, near = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [1.0, 0.01, 0.0, 0.0]
    rows = [(5, one, 1), (6, near, 1), (5, two, 1), (13, one, 2), (15, one, 2), (15, two, 2), (15, None, 2), (16, two, 2)]
    rows += [
        (20, [x * 1e-170 for x in one], 3),
        (21, [x * 1e160 for x in near], 3),
        (22, one, 3),
        (23, [x * 1e-170 for x in two], 3),
        (24, two, 3),
        (24, two, 3),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in near_embeddings.near_duplicates(df).collect())
    assert got == brute_vectors(small_and_large(rows), 0.98)
    assert {(x[0], x[2]) for x in got if x[0] in "15 16 5 6".split()} == {("15", "13"), ("16", "13"), ("5", "5"), ("6", "5")}


@pytest.mark.parametrize("threshold,tile", [(0.98, 1000), (0.9, 7), (0.3, 11)])
def test_embeddings(spark, threshold, tile):
    r = np.random.default_rng(2)
    base = r.normal(0, 1, (25, 8))
    rows = [(k, (base[k % 25] * (1 + k % 3) + r.normal(0, 0.15, 8) * (k >= 25)).tolist(), k % 2) for k in range(100)]
    rows += [
        (200, rows[3][1], 1),
        (201, rows[3][1], None),
        (202, None, 1),
        (203, [0.0] * 8, 1),
        (204, [float("nan")] * 8, 1),
        (205, [None] + [1.0] * 7, 1),
        (206, [float("inf")] * 8, 1),
        (207, [], 1),
        (208, [1.0, 2.0], 1),
        (209, [1.0, 2.0], 1),
        (None, rows[5][1], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"k": F.lit(1), "n": F.lit(2), "rep": F.lit("x")})
    got = sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in near_embeddings.near_duplicates(df, threshold, tile).collect())
    assert got == brute_vectors(rows, threshold)
    assert near_embeddings.near_duplicates(df.limit(0)).count() == 0


def brute_repeats(texts, n):
    count = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append(
            (
                len(b),
                sum(gone),
                len([x for x in bytes(gone).split(b"\0") if x]),
                hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest(),
            )
        )
    return out


@pytest.mark.parametrize("length,most_runs,stretch", [(40, 20_000, 1 << 20), (40, 2, 30), (16, 1, 7)])
def test_repeats(spark, length, most_runs, stretch):
    r = random.Random(3)
    p = "".join(r.choice("abcdé ") for _ in range(300))
    texts = ["a" * 150, "ab" * 60, None, "", p, p[30:] + "zz", p + p, "x" + p[50:] + "y" + p[:45], "é" * 40, "short", "short", "a" * 41]
    texts += ["".join(r.choice("xyz") for _ in range(30)) + p[20 * k : 20 * k + 43] + f"tail{k}" for k in range(8)]
    rows = [(None if k % 9 == 3 else k // 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(1), "bucket": F.lit(2), "spans": F.lit("x")})
    got = repeated_substrings.remove_repeated(df, length, most_runs=most_runs, stretch=stretch).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted((g.n_bytes, g.n_removed, g.n_spans, g.sha) for g in got) == sorted(brute_repeats(texts, length))
    assert sorted(str(g.doc_id) for g in got) == sorted(str(i) for i, _ in rows)
    assert repeated_substrings.remove_repeated(df.limit(0), length).count() == 0


def rows_made(node, name="MapInArrow", metric="pythonNumRowsReceived"):
    """Rows out of each MapInArrow of a plan that ran, or another metric of other nodes."""
    kind = node.getClass().getSimpleName()
    if kind.startswith("Adaptive") or kind.endswith("QueryStageExec"):
        return rows_made(node.executedPlan() if kind.startswith("Adaptive") else node.plan(), name, metric)
    own = [node.metrics().apply(metric).value()] if node.nodeName() == name else []
    below = node.children()
    return own + [x for i in range(below.size()) for x in rows_made(below.apply(i), name, metric)]


def test_strings_of_a_hot_bucket_are_packed(spark):
    r = random.Random(4)
    p = "".join(r.choice("abcdefgh") for _ in range(30))  # too short to be removed, but filed alike everywhere
    texts = ["".join(r.choice("uvwxyz") for _ in range(60)) + p + "".join(r.choice("uvwxyz") for _ in range(60)) for _ in range(60)]
    texts += [texts[0][:120] + "1", "2" + texts[1][30:]]
    keyed = repeated_substrings._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").repartition(3)
    spans = repeated_substrings.repeated_spans(keyed, 40, most_runs=5)
    got = {bytes(x.k): repeated_substrings.merged([y.asDict() for y in x.spans]) for x in spans.collect()}
    key = {x.doc_id: bytes(x.k) for x in keyed.collect()}
    assert got == {key[0]: [(0, 120)], key[60]: [(0, 120)], key[1]: [(30, 150)], key[61]: [(1, 121)]}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = rows_made(spans._jdf.queryExecution().executedPlan())
    assert made and max(made) < max(2 * n * n, 400)  # a row for each string: 505


def brute_join(rows, t=0.8, n=5):
    sets = {}
    for k, (i, text) in enumerate(rows):
        w = (text or "").lower().split()
        if i is not None and w:
            sets[k] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))}
    links, g = Counter(), Groups()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                g.join(rows[a][0], rows[b][0])
    return sorted((str(i), links[k], str(None if i is None else g.find(i))) for k, (i, _) in enumerate(rows))


def near_rows(seed, bases=12, copies=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    common = " ".join(word() for _ in range(30))
    rows = []
    for b in range(bases):
        w = [word() for _ in range(120)]
        for c in range(copies):
            v = list(w)
            for _ in range(r.randrange(0, 4)):
                v[r.randrange(len(v))] = word()
            rows.append((len(rows), " ".join(v) + ("\n" + common if c % 2 else "")))
    return rows + [
        (900, rows[0][1]),
        (901, rows[0][1].upper()),
        (902, None),
        (903, " "),
        (904, ""),
        (905, "tiny text"),
        (906, "Tiny  text"),
        (None, rows[0][1]),
    ]


@pytest.mark.parametrize("large", [1000, 4])
def test_join(spark, monkeypatch, large):
    monkeypatch.setattr(shingle_join, "TILE", 1000 if large == 1000 else 5)
    rows = near_rows(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "rep": F.lit(2), "path": F.lit("x"), "n": F.lit(0)})
    got = shingle_join.jaccard_join(df, large=large).collect()
    assert sorted((str(g.doc_id), g.n_links, str(g.component_id)) for g in got) == brute_join(rows)
    assert all(g.kept == (g.doc_id is not None and g.doc_id == g.component_id) for g in got)
    one = shingle_join.one_of_each_group(df, large=large)
    kept = [x.doc_id for x in one.collect()]
    assert one.columns == df.columns and sorted(str(x) for x in kept) == sorted(
        [str(g.doc_id) for g in got if g.kept and g.n_tokens] + ["902", "None"]
    )
    assert shingle_join.jaccard_join(df.limit(0)).count() == 0 and shingle_join.one_of_each_group(df.limit(0)).count() == 0


def test_join_of_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (3, a)], "doc_id long, text string")
    assert {(g.doc_id, g.component_id) for g in shingle_join.jaccard_join(df).collect()} == {(1, 1), (2, 1), (3, 1)}


def brute_lines(rows, least=1, likeness=fuzzy_lines.LIKENESS):
    """By edit similarity alone."""
    places = {}
    for i, text in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        for n, line in enumerate((text or "").split("\n")):
            norm = fuzzy_lines.normalised(line)
            if norm and len(norm.encode()) >= least:
                places.setdefault(norm, []).append((i, n))
    keys, g = sorted(places), Groups()
    for a in range(len(keys)):
        g.find(a)
        for b in range(a):
            most = likeness.most(max(len(keys[a]), len(keys[b])))
            if abs(len(keys[a]) - len(keys[b])) <= most and fuzzy_lines.edit_distance(keys[a], keys[b]) <= most:
                g.join(a, b)
    group = defaultdict(list)
    for k, x in enumerate(keys):
        group[g.find(k)] += places[x]
    gone = {p for v in group.values() for p in v if p != min(v)}
    cut = lambda i, t: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if i is None or (i, n) not in gone)
    return sorted((str(i), str(cut(i, t))) for i, t in rows), len(gone)


@pytest.mark.parametrize("few,tile", [(500_000, 1000), (0, 3)])
def test_lines(spark, monkeypatch, few, tile):
    for bound in ("FEW_BUCKETS", "FEW_DOCS"):
        monkeypatch.setattr(fuzzy_lines, bound, few)
    monkeypatch.setattr(fuzzy_lines, "TILE", tile)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    lines = [" ".join(word() for _ in range(40)) for _ in range(15)]
    rows = []
    for k in range(40):
        own = []
        for _ in range(4):
            w = r.choice(lines).split()
            if r.random() < 0.7:
                w[r.randrange(len(w))] = word()
            own.append(" ".join(w).upper() if r.random() < 0.2 else ", ".join(w))
        rows.append((k, "\n".join([*own, "short", f"unique {k} {word()} {word()} {word()}"])))
    rows += [(100, None), (101, ""), (102, lines[0]), (103, "\n\n\n"), (104, lines[1] + "\n" + lines[1] + "\n"), (None, lines[0])]
    rows += [(111, "ΑΣ\nΣΑΣ σ\nİx\t y\r\n\x0b"), (112, "ας\nΣας Σ\ni̇x y")]
    kanji = "".join(chr(0x4E00 + r.randrange(500)) for _ in range(30))
    rows += [
        (105, kanji),
        (106, kanji[:9] + "x" + kanji[10:]),
        (107, "--- !\n***"),
        (108, "--- !\n***"),
        (109, "y" * 200),
        (110, "y" * 99 + "z" + "y" * 100),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"n_chars": F.lit(7).cast("long"), "line": F.lit(1), "key": F.lit("x"), "_gone": F.lit(2)}
    )
    out = fuzzy_lines.dedup_lines(df)
    got = out.collect()
    want, gone = brute_lines(rows)
    assert sorted((str(g.doc_id), str(g.text)) for g in got) == want and sum(g["_n_removed"] for g in got) == gone > 60
    assert out.columns == [*df.columns, "_n_lines", "_n_removed"]
    assert all(g.n_chars == (len(g.text) if g["_n_removed"] else 7) for g in got)
    assert fuzzy_lines.dedup_lines(df.limit(0)).count() == 0


def slow_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def slow_blocks(line):
    """Keys of a line's blocks, word by word, bit by bit: of words of up to 24 bytes, none of them wide."""
    words = line.encode().split(b" ")
    hashes = [int(fuzzy_lines.tokens_of([w])[0][0]) for w in words]

    def sim(chosen, width):
        total = [sum(1 if hashes[i] >> b & 1 else -1 for i in chosen) for b in range(8 * width)]
        # bytes from the lowest, bits of a byte from the highest
        return sum(1 << b for b in range(8 * width) if total[b] > 0)

    size = lambda chosen: sum(len(words[i]) for i in chosen)
    out, parts = set(), [[i for i, h in enumerate(hashes) if h >> 60 == k and h not in hashes[:i]] for k in range(16)]
    done = set()
    for width in (1, 2, 4, 8):
        for k in range(0, 16, width):
            here = range(k, k + width)
            if sum(size(parts[x]) for x in here) >= fuzzy_lines.PART_BYTES and not done & set(here):
                out.add(("part", width, k, tuple(sim(parts[x], 6) for x in here)))
                done |= {x for x in here}
    sixths = [[i for i in range(len(words)) if i * 6 // len(words) == k] for k in range(6)]
    for many, (low, high) in fuzzy_lines.SIXTHS.items():
        for c in itertools.combinations(range(6), many):
            if low <= sum(size(sixths[x]) for x in c) and (
                sum(size(sixths[x]) for x in c) < high or many == 2 and sum(map(size, parts)) < 3 * fuzzy_lines.PART_BYTES
            ):
                out.add(("sixth", c, tuple(sim(sixths[x], 3) for x in c)))
    return out


def test_blocks():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    lines = []
    for _ in range(60):
        w = [word() for _ in range(r.choice([1, 3, 6, 12, 40, 300]))]
        lines.append(" ".join(w))
        w[r.randrange(len(w))] = word()
        lines.append(" ".join(w))
    lines.append(" ".join(["same"] * 700))
    data = [x.encode() for x in lines]
    bounds, keys = fuzzy_lines.blocks(data)
    mine = [set(keys[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(lines))]
    slow = [slow_blocks(x) for x in lines]
    assert all(len(a) == len(b) for a, b in zip(mine, slow, strict=True))
    assert all(len(mine[i] & mine[j]) == len(slow[i] & slow[j]) for i in range(len(lines)) for j in range(i))
    other = fuzzy_lines.blocks(data, 10)
    assert other[0].tolist() == bounds.tolist() and other[1].tolist() == keys.tolist()
    assert fuzzy_lines.blocks([])[0].tolist() == [0]
    for _ in range(200):
        a = [r.choice(["a", "bb", "ccc", "dd"]) for _ in range(r.randrange(1, 9))]
        b = [x for x in a if r.random() < 0.8] + [r.choice(["e", "ff"])] * r.randrange(2)
        if b:
            assert fuzzy_lines.words_apart(a, b) >= slow_distance(" ".join(a), " ".join(b))


def test_small_buckets_are_dealt_without_lists(spark):
    lines = [f"line {k // 2} of the pair is like the other {k % 2}".encode() for k in range(40)]
    at = lambda k: [{"bucket": 1000 * (k // 2) + i, "tiles": 1, "few": True, "go": i < 100} for i in range(300)]
    members = spark.createDataFrame(
        [(bytes([k]) * 16, at(k)) for k in range(40)],
        "key binary, at array<struct<bucket: long, tiles: int, few: boolean, go: boolean>>",
    )
    texts = spark.createDataFrame([(bytes([k]) * 16, x) for k, x in enumerate(lines)], "key binary, norm binary")
    found = fuzzy_lines.similar(members, texts, fuzzy_lines.LIKENESS, 4)
    assert {frozenset((x.a[0], x.b[0])) for x in found.collect()} == {frozenset((k, k + 1)) for k in range(0, 40, 2)}
    # 4,000 rows of a bucket, a key and a line; 300 numbers of 8 bytes in each made it 10 MB and more.
    assert max(rows_made(found._jdf.queryExecution().executedPlan(), "Exchange", "dataSize")) < 2e6


def test_close_pairs_lose_none():
    r = random.Random(10)
    base = ["".join(r.choice("abc éß漢") for _ in range(40)) for _ in range(6)]
    lines = []
    for _ in range(60):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = r.choice("abcé漢😀")
        lines.append("".join(w))
    i, j = fuzzy_lines.close_pairs([x.encode() for x in lines], None, fuzzy_lines.Likeness(0.9, 0, 0.9, 10**6))
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(a, b) for b in range(60) for a in range(b) if slow_distance(lines[a], lines[b]) <= 4}
    assert want <= found and want
    side = np.array([k % 2 == 0 for k in range(60)])
    i, j = fuzzy_lines.close_pairs([x.encode() for x in lines], side, fuzzy_lines.Likeness(0.9, 0, 0.9, 10**6))
    assert {p for p in found if side[p[0]] != side[p[1]]} == set(zip(i.tolist(), j.tolist(), strict=True))


def test_edit_distance():
    r = random.Random(7)
    for _ in range(300):
        a = "".join(r.choice("abc ") for _ in range(r.randrange(0, 25)))
        b = list(a)
        for _ in range(r.randrange(0, 5)):
            b.insert(r.randrange(len(b) + 1), r.choice("abcd"))
        b = "".join(b)[r.randrange(0, 3) :]
        assert fuzzy_lines.edit_distance(a, b) == slow_distance(a, b)


def test_within():
    r = random.Random(8)
    for size in (0, 1, 2, 15, 16, 17, 60, 300) * 40:
        a = [r.choice("ab é漢") for _ in range(size)]
        b = list(a)
        for _ in range(r.randrange(0, 7)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "a", "z"])
        a, b = "".join(a), "".join(b)
        apart = fuzzy_lines.edit_distance(a, b)
        assert all(fuzzy_lines.within(a, b, most) == (apart <= most) for most in (0, max(0, apart - 1), apart, apart + 1, 15))
        assert all(fuzzy_lines.words_apart(a.split(" "), b.split(" "), most) > most or apart <= most for most in (0, 3, 15))


def test_pipeline(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfgl") + r.choice("aeiou") for _ in range(3))
    text = lambda n=60: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for k in range(240):
        t = text()
        if k % 4 == 0:
            w = t.split()
            for at in r.sample(range(60), 5):
                w[at] = "stupidmoron"
            t = " ".join(w)
        rows.append((k, t, "en", f"s{k % 3}", len(t)))
        labels.append((k, 1, int(k % 4 == 0)))
    passage = text(30)
    t1, t2 = text(80), text(80)
    near = t1.split()
    near[40] = "changed"
    rows += [
        (300, t1, "en", "s0", 1),
        (301, " ".join(near), None, None, None),
        (302, t2 + " " + passage, "en", "s1", 1),
        (303, None, "en", "s1", None),
        (304, "", "en", "s1", 0),
        (None, text(), "en", "s2", 3),
        (305, t1, "en", "s0", 1),
    ]
    spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen, columns = {}, docs.columns
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = {x.doc_id for x in docs.collect()}
        f(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = before - {x.doc_id for x in docs.collect()}
        if k < 4:
            assert docs.columns == columns
    toxic = {k for k in range(0, 240, 4)}
    assert len(seen["toxicity"] & toxic) >= 0.9 * len(toxic) and len(seen["toxicity"] - toxic) <= 12
    assert seen["line_dedup"] == set() and seen["decontamination"] <= {302}
    assert {"taken", "copies", "target"} <= set(docs.columns) and all(x.taken == x.copies * x.size for x in docs.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_without_training_exactly(spark, tmp_path):
    """Every stage after the first, on what the one before has kept, against brute force."""
    from tests.llm.test_text_operators import brute_hits, brute_mix

    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfgl") + r.choice("aeiou") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    passages, line = [text(20), text(9)], text(15)
    bodies = [text(90) for _ in range(8)]
    rows = []
    for k in range(60):
        w = bodies[k % 8].split() if k % 3 else text(80).split()
        if k % 4 == 1:
            w[r.randrange(len(w))] = word()
        half = len(w) // 2
        t = "\n".join([" ".join(w[:half]), line + (" x" if k % 5 == 0 else ""), " ".join(w[half:])])
        if k % 7 == 0:
            t += "\n" + text(5) + " " + passages[k % 2].upper() + " " + text(3)
        rows.append((k, t, "en", [None, "a", "b"][k % 3], len(t)))
    rows += [(70, None, "en", "a", None), (71, "", None, None, 0), (72, line, "en", "b", 9), (73, rows[3][1], "en", "b", 9)]
    items = [(1, passages[0]), (2, passages[1]), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def kept(name):
        nonlocal docs
        docs = spark.createDataFrame(stages[name](spark, docs, str(tmp_path)).collect(), docs.schema)
        return sorted((x.doc_id, x.text) for x in docs.collect())

    want, gone = brute_lines([(i, t) for i, t, *_ in rows])
    lines = kept("line_dedup")
    assert sorted((str(i), str(t)) for i, t in lines) == want and gone > 40
    linked = {i: c for i, _, c in brute_join(lines)}
    blank = sorted(i for i, t in lines if not (t or "").split())
    one = [(i, t) for i, t in lines if (t or "").split() and linked[str(i)] == str(i) or i in blank[:1]]
    joined = kept("ngram_join")
    assert joined == one and len(one) < len(lines)
    clean = [(i, t) for i, t in joined if not brute_hits(t, items)[4]]
    assert kept("decontamination") == clean and len(clean) < len(joined)
    mixed = stages["source_mix"](spark, docs, str(tmp_path)).collect()
    source = {x.doc_id: x.source for x in docs.collect()}
    total, target, size = brute_mix([(i, t, source[i]) for i, t in clean])
    for s in total:
        mine = [x for x in mixed if x.source == s]
        assert abs(sum(x.taken for x in mine) - target[s]) <= max(size(t) for i, t in clean if source[i] == s) / 2 + 1e-6
        assert all(x.copies in (1, 2) and x.taken == x.copies * size(x.text) and x.target == pytest.approx(target[s]) for x in mine)


def test_stages_with_clashing_names_and_without_rows(spark, tmp_path):
    """Extra columns pass through all stages but the last, whatever they are called; of an empty table nothing is left."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(k, f"words of number {k} stand here alone", "en", "s") for k in range(6)] + [(None, None, None, None), (3, "", "en", "s"), (3, "", "en", "s")]
    names = ["_n_lines", "_n_removed", "n_lines", "line", "key", "k", "n_words", "contaminated", "score", "predicted", "size", "h", "a.b", "component"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in names})
    for name, f in corpus_pipeline.STAGES:
        left = f(spark, docs, str(tmp_path))
        if name != "source_mix":
            assert left.columns == docs.columns and left.count() >= 6
            assert {x["_n_lines"] for x in left.collect()} == {"x"}
        else:
            assert left.count() >= 1 and "a.b" in left.columns
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
