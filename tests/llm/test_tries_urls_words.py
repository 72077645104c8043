"""The conversation trie, the url filter and spelling variants: against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import conversation_trie as ct
from tidemill.llm import spelling_variants as sv
from tidemill.llm import url_filter as uf

TURNS = "conv_id long, turn long, role string, text string"


# --- conversation trie -------------------------------------------------------------------------------------------------


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = [*own.get(c - int(math.fmod(c, 20)), [])[:h], *turns[h:]]
    return made


def slow_trie(rows):
    made = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        leaves = sum(not children[q] for q in below)
        out.append((min(m), len(p), up, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n=60, seed=1):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -25, 10**12 + 7]:
        for t in range(r.choice([1, 1, 2, 3, 5])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "hi there you", "", "long  text\twith\x0bspaces"])))
    return rows


ODD_TURNS = [(None, 0, "user", "nobody"), (1, None, None, None), (1, None, None, None), (1, 5, "user", "x"), (1, 5, "bot", "x"), (40, 0, None, "é 漢"), (40, 1, "user", None), (43, 9, "user", "w " * 40_000)]


@pytest.mark.parametrize("least", [1, 20])
@pytest.mark.parametrize("rows", [conversations(), conversations(25, 2) + ODD_TURNS, ODD_TURNS])
def test_trie(spark, rows, least):
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit(1), "hi": F.lit("x"), "words": F.lit(None)})
    got = sorted((tuple(x) for x in ct.trie(df, least).collect()), key=str)
    assert got == slow_trie(rows)


def test_trie_of_nothing_and_of_one_long_conversation(spark):
    assert ct.trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(20, t, "user", f"turn {t}") for t in range(3000)]
    got = {x.depth: x for x in ct.trie(spark.createDataFrame(rows, TURNS), least=1).collect()}
    assert len(got) == 3001 and got[0].n_leaves == got[3000].n_leaves == 1 and got[0].parent_conv_id is None
    assert got[0].ends_sha256 == hashlib.sha256(b"").hexdigest() and got[3000].ends_sha256 == hashlib.sha256(b"20").hexdigest()


def test_one_first_turn_of_all(spark):
    rows = [(c, t, "user", "same" if t < 5 else str(c)) for c in range(2000) for t in range(6)]
    got = {(x.depth, x.conv_id): x for x in ct.trie(spark.createDataFrame(rows, TURNS), least=50).collect()}
    assert [got[d, 0].n_convs for d in range(6)] == [2000] * 5 + [2000] and got[5, 0].n_children == 2000
    assert len(got) == 2006 and got[0, 0].n_leaves == 2000 and got[0, 0].saved_tokens == 5 * 1999


def test_perfect_hash():
    r = np.random.default_rng(1)
    hi, lo = r.integers(-(2**63), 2**63, (2, 5000))
    slots = ct.Slots(hi, lo)
    assert sorted(slots.of(hi, lo)) == list(range(5000))
    assert (slots.of(lo, hi) == -1).all() and (slots.of(hi, lo + 1) == -1).all()
    with pytest.raises(ValueError):
        ct.Slots(np.zeros(2, np.int64), np.zeros(2, np.int64))
    assert ct.Slots(hi[:0], lo[:0]).of(hi[:2], lo[:2]).tolist() == [-1, -1]


def test_trie_tells_a_collision(spark):
    rows = ct.prefixes(spark.createDataFrame(conversations(), TURNS)).toPandas()
    rows["shi"] = rows["slo"] = 0
    rows.loc[rows.depth == 1, ["hi", "lo"]] = 7  # different prefixes of one digest
    import pyarrow as pa

    with pytest.raises(ValueError, match="one digest"):
        list(ct.subtrees([pa.RecordBatch.from_pandas(rows, preserve_index=False)]))


# --- url filter --------------------------------------------------------------------------------------------------------


def slow_rule(host, path):
    fit = [r for r in uf.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def slow_split(run, counts, total):
    """All ways to cut a run into words and strange stretches."""
    best = (-math.inf, [])

    def go(at, score, words, strange):
        nonlocal best
        if at == len(run):
            best = max(best, (score, words), key=lambda x: x[0])
            return
        for end in range(at + 1, len(run) + 1):
            w = run[at:end]
            if w in counts:
                go(end, score + math.log(counts[w] / total), [*words, w], False)
            if not strange:
                go(end, score + math.log(10 / total) - math.log(10) * len(w), [*words, w], True)

    go(0, 0.0, [], False)
    return best


def test_best_split():
    counts = {"cheap": 50, "pills": 40, "pill": 60, "s": 5, "the": 900, "rapist": 1, "therapist": 30, "a": 500}
    total = 10_000.0
    for run in ("cheappills", "therapist", "cheapxyzpill", "q", "aaa", "xcheap", "thepillsa"):
        found = [(i, n, counts[run[i : i + n]]) for i in range(len(run)) for n in range(1, len(run) - i + 1) if run[i : i + n] in counts]
        got = uf.best_split(run, found, total)
        cost = sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - math.log(10) * len(w) for w in got)
        want = slow_split(run, counts, total)
        assert "".join(got) == run and cost == pytest.approx(want[0])
    assert uf.best_split("cheappills", [(0, 5, 50), (5, 5, 40)], total) == ["cheap", "pills"]


URLS = [
    None,
    "",
    "no scheme.example.net/en/",
    "http://A.Example.NET/en/x?q=http://b.org/fr/",
    "http://example.net/En/",
    "http://x.net",
    "http://x.net?y",
    "http://x.net/",
    "http://notnet/",
    "http://a.example.com/de",
    "http://a.example.com/de/1#f",
    "https://foo.org/fr/é?",
    "x://y://z.net/",
    "http://cheappills.example.org/en/12",
    "http://spam-farm.example.org/fr/buy",
    "http://" + "a" * 30_000 + ".example.com/en/",
    "http:///path",
    "HTTP://ÀB.net/",
    "http://user@h.example.net:80/en/",
]


def pages(spark):
    r = random.Random(3)
    names = ["goodnews", "cheappills", "newsgood", "dailypost", "casinobet", "weatherday"]
    rows = [(k % 50, u, None) for k, u in enumerate(URLS)]
    rows += [(100 + k, f"https://{r.choice(names)}.example.{r.choice(['net', 'com', 'org'])}/{r.choice(['en', 'de', 'fr'])}/{r.choice(['buy', 'read', '77'])}", "<TITLE lang=x>Good news daily post\nweather day</title>") for k in range(300)]
    rows.append((None, "http://good.example.org/en/", "no title"))
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"rule": F.lit(0), "host": F.lit("x"), "words": F.lit(1)})


def test_url_filter(spark):
    rows, df = pages(spark)
    got = uf.judged(df).collect()
    assert len(got) == len(rows)
    title, seeds = Counter(), set(uf.BLOCK_WORDS)
    for _, _, html in rows:
        m = re.search(r"(?is)<title[^>]*>(.*?)</title", html or "")
        title.update(re.findall("[a-z]+", m[1].lower()) if m else [])
    total = sum(title.values())
    counts = {w: title[w] + uf.BLOCK_SHARE * total * (w in seeds) for w in set(title) | seeds}
    total *= 1 + uf.BLOCK_SHARE * len(seeds)
    examples, parsed = {"block": [], "allow": []}, []
    for i, u, _ in rows:
        m = re.search(r"(?s)://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        words = []
        for run in set(re.findall("[a-z]+", host)):
            found = [(a, n, counts[run[a : a + n]]) for a in range(len(run)) for n in range(1, min(uf.LONGEST, len(run) - a) + 1) if run[a : a + n] in counts]
            words += uf.best_split(run, found, total)
        inner = re.findall("[a-z]+", re.sub("[A-Z]", lambda c: c[0].lower(), path))
        rule, given = slow_rule(host, path)
        stop = uf.named(uf.RULES)
        feats = [("host", w) for w in words if w not in stop] + [("path", w) for w in inner if w not in stop] + [("path", "0")] * bool(re.search("[0-9]", path))
        label = "block" if seeds & {*words, *inner} else given
        parsed.append((i, host, path, rule, given, feats))
        if label:
            examples[label].append(feats)
    tokens = {k: Counter(f for x in v for f in x) for k, v in examples.items()}
    size = {k: sum(v.values()) + uf.BUCKETS for k, v in tokens.items()}
    want = []
    for i, host, path, rule, given, feats in parsed:
        s = math.log((len(examples["block"]) + 1) / (len(examples["allow"]) + 1))
        s += sum(math.log((tokens["block"][f] + 1) / size["block"]) - math.log((tokens["allow"][f] + 1) / size["allow"]) for f in feats)
        want.append((i, host, path, rule, given or ("block" if s > 0 else "allow"), round(s, 6)))
    order = lambda r: str(r[:4])
    assert sorted([(*tuple(g)[:5], round(g.score, 6)) for g in got], key=order) == sorted(want, key=order)
    verdicts = {(g.host, g.path): g.verdict for g in got}
    assert verdicts["cheappills.example.org", "/en/12"] == "block" and verdicts["spam-farm.example.org", "/fr/buy"] == "allow"


def test_urls_without_examples(spark):
    assert uf.judged(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0
    got = uf.judged(spark.createDataFrame([(1, None, None), (1, "http://abc/", "")], "page_id int, url string, html string")).collect()
    assert sorted((g.page_id, g.host, g.path, g.rule, g.verdict) for g in got) == [(1, "", "", None, "allow"), (1, "abc", "/", None, "allow")]


# --- spelling variants -------------------------------------------------------------------------------------------------


def slow_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    v = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    others = {w: [o for o in v if abs(len(o) - len(w)) < 2 and near(w, o)] for w in v}
    for w, n in v.items():
        best = min(others[w], key=lambda o: (-v[o], o), default=None)
        form[w] = best if best and v[best] >= 2 * n else None
    for w, n in v.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(others[w]), v[form[w]] if form[w] else None))
    return sorted(out, key=str)


def word_rows():
    r = random.Random(5)
    rows = []
    for d in range(150):
        words = []
        for _ in range(60):
            w = r.choice(["colour", "Flavour", "straße", "ÉCOLE", "ÿÿÿÿÿ", "aaaaaa", "letter", "banana", "ab"])
            if r.random() < 0.5:
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aeé÷") + w[i:], w[:i] + r.choice("aeé×") + w[i + 1 :]])
            words.append(w)
        rows.append((d, r.choice([" ", ", ", "\n"]).join(words)))
    long = "é" * 3000
    return rows + [(None, None), (None, ""), (None, "letter letter"), (7, "letter"), (7, "letter"), (900, f"{long} {long}x {long} {long}x {long} {long} {long}x"), (901, f"{long} " * 6 + "ﬁ漢字 colour_colour1colour")]


@pytest.mark.parametrize("most", [sv.FILTER_BYTES, 64])
def test_spelling_variants(spark, most):
    rows = word_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "_w": F.lit(None)})
    got = sorted((tuple(g) for g in sv.spelling_variants(df, most).collect()), key=str)
    assert got == slow_variants(rows)


def test_variants_of_nothing_and_a_chain_of_forms(spark):
    assert sv.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    chain = [("a" * (6 + k), 3 * 2**k) for k in range(12)]
    got = {x.word: x for x in sv.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert {x.root for x in got.values()} == {"a" * 17} and got["a" * 17].form is None and got["a" * 6].form == "a" * 7


def test_filters_keep_every_word_and_few_others():
    import pyarrow as pa

    r = random.Random(2)
    words = list({"".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(5000)})
    sizes = sv.filter_sizes({9: len(words)})
    part = {9: (0, sizes[9])}
    made = np.zeros(sizes[9], np.uint64)
    for b in sv.set_bits(sizes, part)([pa.RecordBatch.from_arrays([pa.array(words)], names=["word"])]):
        np.bitwise_or.at(made, b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64))

    def passed(some):
        h = sv.mixed(sv.sums(sv.code_points(some, 9)))
        want = sv.masks(h)
        return (made[sv.blocks(h, sizes[9])] & want == want).mean()

    others = ["".join(r.choice("ijklmnop") for _ in range(9)) for _ in range(20_000)]
    assert passed(words) == 1 and passed(others) < 0.02
    assert sv.parts({5: 10, 6: 3}, 64) == [{5: (0, 8)}, {5: (8, 10), 6: (0, 3)}]
