"""Token counts, decontamination, language, toxicity, main text and mixing: against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, html_text, language_id, source_mix, token_counts, toxicity

ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (None, "a word"),
    (4, "same same"),
    (4, "same same"),
    (5, "é" * 3000 + " x" * 30000),
    (6, "<|endoftext|>a<|endoftext|>"),
    (7, "ﬁ 漢字 ½   it's 12345\x1c\x85_"),
    (8, "UPPER case"),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "n": F.lit("x"), "size": F.lit(2.0)})


@pytest.mark.parametrize("few", [token_counts.FEW, 40, 0])
def test_token_counts(spark, few):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(1)
    extra = [(100 + k, "".join(r.choice("ab 1'\n\tsé_.½") for _ in range(200))) for k in range(50)]
    extra += [(200 + k, "the and of " * k + f"rare{k}") for k in range(20)]
    got = token_counts.token_counts(docs(spark, ODD + extra), path, few=few).collect()
    want = sorted((len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for _, x in ODD + extra)
    assert sorted((g.n_bytes, g.n_tokens) for g in got) == want
    assert all(g.over_limit == (g.n_tokens > 512) for g in got)
    assert token_counts.token_counts(docs(spark, []), path, few=few).count() == 0


def test_pre_tokens_are_one_table(spark, monkeypatch):
    """Each pre-token is there once, with its occurrences in all texts and its pieces, however little a task holds."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "HELD", 5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [f"word{k % 7} other {k % 3} <|endoftext|>words" for k in range(100)] + [None, "", "x" * 500]
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(5)
    got = {r.pre: (r.n, r.pieces) for r in token_counts.pre_tokens(df, path).collect()}
    assert got[" other"][0] == 100 and got["words"][0] == 100 and "x" * 500 not in got
    assert all(n == len(t.encode(p, add_special_tokens=False)) for p, (_, n) in got.items())
    pre = token_counts.pre_tokens(df, path)
    for most in (0, 3, 10, 1000):
        known, rest = token_counts.frequent(pre, most)
        assert known.count() <= most and known.count() + (rest.count() if rest else 0) == len(got)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for i, item in items:
        w = WORD.findall(low(item))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words), hit


@pytest.mark.parametrize("automaton_words", [4_000_000, 30])
def test_decontaminate(spark, monkeypatch, automaton_words):
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", automaton_words)
    r = random.Random(2)
    vocab = ["aa", "b", "Ce", "é1", "x"]
    item = lambda n: "-".join(r.choice(vocab) for _ in range(n))
    items = [(k, item(n)) for k, n in enumerate((20, 13, 3, 1, 40, 15))] + [(20, None), (21, "?!"), (2, "aa")]
    texts = list(ODD) + [
        (
            50 + k,
            " ".join(r.choice(vocab + ["zz"] * 4) for _ in range(60)) + "\n" + (items[k % 6][1].upper() if k % 2 else "") + " tail",
        ) for k in range(20)
    ]
    got = decontaminate.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), prefix="o_").collect()
    assert len(got) == len(texts)
    by = defaultdict(list)
    for g in got:
        by[g.doc_id].append(g)
    for i, text in texts:
        g = by[i][0]
        *want, hit = brute_hits(text, items)
        assert [g.o_n_words, g.o_n_hit, g.o_n_items, g.o_items_sha256, g.o_contaminated] == want, (i, text[:80])
        words = [m.group() for m in re.finditer(r"(?:[^\x00-\x2F\x3A-\x60\x7B-\x7F]|[A-Z])+", text or "")]
        for s in g.o_spans:
            assert text[s.start : s.end].split()[0] and set(range(s.first_word, s.last_word + 1)) <= hit
            assert text[s.start :].startswith(words[s.first_word]) and text[: s.end].endswith(words[s.last_word])
    none = decontaminate.decontaminate(docs(spark), spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("contaminated").count() == 0 and none.count() == len(ODD)
    assert decontaminate.without_contaminated(
        docs(spark),
        spark.createDataFrame([(1, "same same")], "item_id long, text string"),
    ).filter("doc_id = 4").count() == 0


ENGLISH = "the weather of the north was cold and the people there went to their houses with wood for the fire"
GERMAN = "das wetter im norden war kalt und die leute gingen mit holz für das feuer in ihre häuser zurück"


def language_rows(seed, n=60):
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = (ENGLISH if k % 2 else GERMAN).split()
        out.append((k, " ".join(r.choice(words) for _ in range(25)), "en" if k % 2 else "de"))
    return out


def test_language(spark):
    train = spark.createDataFrame(language_rows(1) + [(900, None, "en"), (901, "no label", None)], "doc_id long, text string, lang string")
    dicts = language_id.fit(train)
    assert set(dicts) == {"de", "en"} and dicts == language_id.fit(train.repartition(5))
    test = language_rows(2)
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), dicts).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 0.95 * len(test) and all(0 <= g.score <= 1 for g in got.values())
    odd = language_id.identify(docs(spark), dicts).collect()
    assert len(odd) == len(ODD)
    for (_, text), n in [(x, sum(o.doc_id == x[0] for o in odd)) for x in ODD]:
        assert n >= 1
    blank = [o for o in odd if o.doc_id in (1, 2, 3)]
    assert {o.lang_pred for o in blank} == {"und"} and not any(o.reliable for o in blank)
    assert not language_id.has_letter("½ ² 12_٣ -") and language_id.has_letter("½é")
    assert {o.lang_pred for o in language_id.identify(docs(spark), {}).collect()} == {"und"}
    assert language_id.identify(docs(spark, []), dicts).count() == 0


def slow_language(text, dicts):
    """Predicted label and sizes, each piece by a new compressor."""
    import zstandard as z

    letters = "".join(c if c.isalpha() or c.isalnum() and not c.isdigit() and c not in "½²" else " " for c in text.lower())
    data = (" " + " ".join(letters.split()) + " ").encode()
    sizes = {}
    for name, d in dicts.items():
        params = z.ZstdCompressionParameters.from_level(
            3,
            window_log=17,
            min_match=3,
            strategy=z.STRATEGY_BTOPT,
            write_content_size=0,
            write_checksum=0,
            write_dict_id=0,
        )
        new = lambda d=d, params=params: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params)
        sizes[name] = sum(max(1, len(new().compress(data[i : i + 1500])) - 9) for i in range(0, len(data), 1500))
    return min(sizes, key=lambda k: (sizes[k], list(dicts).index(k))), sizes


def test_language_query_like_slow_scorer(spark, tmp_path):
    rows = language_rows(5, 90) + [(200, "Ein längerer Text, 12 Zahlen. " * 200, "de"), (201, None, "de"), (202, "", None), (203, "99 !", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in language_id.query(spark, str(tmp_path)).collect()}
    crc = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    dicts = language_id.fit(spark.createDataFrame([r for r in rows if not crc(r[0])], "doc_id long, text string, lang string"))
    assert list(dicts) == ["de", "en"] and len(got) == len(rows)
    for i, text, _ in rows:
        assert got[i].held_out == crc(i)
        if i in (201, 202, 203):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        name, sizes = slow_language(text, dicts)
        best, other = sorted(sizes.values())
        margin = (other - best) / best
        assert got[i].lang_pred == name and got[i].score == pytest.approx(
            min(1, 0.5 + 0.5 * margin / (margin + 0.02))
        ) and got[i].reliable == (margin >= 0.02)
    changed = [(i, t, "en" if crc(i) and lang else lang) for i, t, lang in rows]
    assert language_id.fit(spark.createDataFrame([r for r in changed if not crc(r[0])], "doc_id long, text string, lang string")) == dicts


def test_dictionaries_hold_all_sampled_texts():
    texts = [[f"t{k} ".encode() * n] for k, n in enumerate((1, 5, 2000, 9000, 3))]
    d = language_id.dictionary(texts, 3000)
    assert 2900 <= len(d) <= 3000 and all(f"t{k} ".encode() in d for k in range(5)) and texts[1][0] in d
    data = bytes(range(256)) * 40
    parts = language_id.spread(data, 1000)
    assert data.startswith(parts[0]) and data.endswith(parts[-1]) and sum(map(len, parts)) == 1000 and language_id.spread(b"abc", 10) == [b"abc"]


def slow_toxicity(net, text):
    """Highest score of all windows, one word of one window at a time."""
    words = toxicity.words_of(text)
    sig = lambda v: 1 / (1 + np.exp(-v))
    best, h_ = -np.inf, toxicity.HIDDEN
    for s in sorted({*range(0, max(1, len(words) - toxicity.WINDOW), toxicity.STRIDE), max(0, len(words) - toxicity.WINDOW)}):
        window = words[s : s + toxicity.WINDOW]
        x = [net.vectors([w])[0][0].astype(float) for w in window]
        states = {}
        for d in "fb":
            now, out = np.zeros(h_), []
            for v in x if d == "f" else x[::-1]:
                gate, hidden = v @ net.p[f"W{d}"] + net.p[f"c{d}"], now @ net.p[f"U{d}"]
                z, r = sig(gate[:h_] + hidden[:h_]), sig(gate[h_ : 2 * h_] + hidden[h_ : 2 * h_])
                now = (1 - z) * np.tanh(gate[2 * h_ :] + r * hidden[2 * h_ :]) + z * now
                out.append(now)
            states[d] = out if d == "f" else out[::-1]
        logit = float(net.p["b"][0])
        if window:
            h = np.concatenate([np.array(states["f"]), np.array(states["b"])], axis=1)
            a = np.exp(h @ net.p["v"])
            logit += float((a / a.sum()) @ h @ net.p["u"])
        best = max(best, logit)
    return sig(best)


def test_toxicity_query_like_slow_version(spark, tmp_path):
    rows = toxic_rows(11, 260)
    crc = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    docs_ = [(k, t) for k, (t, _) in enumerate(rows)] + [(500, None), (501, ""), (502, "longer " * 300 + "idiot " + "words " * 400)]
    spark.createDataFrame(docs_, "doc_id long, text string").write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame(docs_, "doc_id long, text string").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    for folder, flip in (("a", False), ("b", True)):
        labels = [(k, int(y) ^ int(flip and crc(k))) for k, (_, y) in enumerate(rows)]
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / folder / "labels.parquet"))
    got, again = ({r.doc_id: r for r in toxicity.query(spark, str(tmp_path / x)).collect()} for x in "ab")
    assert got == again and len(got) == len(docs_)  # labels of held-out rows change nothing
    known = spark.read.parquet(str(tmp_path / "a" / "labels.parquet"))
    net = toxicity.fitted(spark.createDataFrame(docs_, "doc_id long, text string"), known)
    for i, text in docs_[::9] + docs_[-3:]:
        assert got[i].held_out == crc(i) and got[i].score == pytest.approx(slow_toxicity(net, text), abs=1e-4)
        assert got[i].predicted == int(got[i].score >= 0.5)
    assert got[502].window <= 300 < got[502].window + toxicity.WINDOW and got[500].score == got[501].score < 0.5


def toxic_rows(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4))) for _ in range(300)]
    bad = ["idiot", "scumbag", "moron"]
    out = []
    for _ in range(n):
        toxic = r.random() < 0.4
        w = [r.choice(words) for _ in range(r.randrange(5, 90))]
        if toxic:
            w[r.randrange(len(w))] = r.choice(bad)
        out.append((" ".join(w), int(toxic)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_rows(3, 900)
    net = toxicity.fit([t for t, _ in rows[:700]], [y for _, y in rows[:700]])
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows[700:])], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(df, net).collect()}
    assert np.mean([got[i] == y for i, (_, y) in enumerate(rows[700:])]) >= 0.9
    odd = toxicity.score(docs(spark), net, "o_").collect()
    assert len(odd) == len(ODD) and all(0 <= o.o_score <= 1 for o in odd) and all(o.o_predicted == 0 for o in odd if o.doc_id in (1, 2, 3))
    long = " ".join(["banana"] * 5000 + ["idiot"] + ["banana"] * 5000)
    s = toxicity.Scorer(net)
    (a, b), (at, _) = s.scores([long, " ".join(["banana"] * 10001)])
    assert a > b and at <= 5000 < at + toxicity.WINDOW
    small = toxicity.Scorer(net, cache=50)
    assert np.allclose(np.concatenate([small.scores([t])[0] for t, _ in rows[700:720]]), s.scores([t for t, _ in rows[700:720]])[0], atol=1e-5)
    assert toxicity.score(docs(spark, []), net).count() == 0


def test_toxicity_gradients():
    rows = toxic_rows(5, 40)
    net = toxicity.Network.new({}, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = sorted({w for t, _ in rows for w in toxicity.words_of(t)})[:40]
    x = net.vectors(words)[0].astype(np.float64)
    r = np.random.default_rng(0)
    at = r.integers(0, len(x), (6, 7))
    at[0, 4:] = -1
    y, w = r.integers(0, 2, 6), np.ones(6)

    def loss():
        gates = np.concatenate([x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"]], axis=1)
        z = net.forward(gates, at).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    grad, dx = net.gradients(x, at, y, w)
    for name in ("Wf", "Ub", "v", "u", "cf"):
        i = np.unravel_index(int(np.abs(grad[name]).argmax()), grad[name].shape)
        old = net.p[name][i]
        net.p[name][i] = old + 1e-2
        up = loss()
        net.p[name][i] = old - 1e-2
        down = loss()
        net.p[name][i] = old
        assert (up - down) / 2e-2 == pytest.approx(grad[name][i], rel=0.05, abs=1e-4), name


def test_toxicity_fit_holds_no_object_for_each_word(monkeypatch):
    monkeypatch.setattr(toxicity, "FEWEST_STEPS", 1)
    r = random.Random(9)
    texts = [" ".join(r.choices([f"w{i}" for i in range(300)], k=4_000)) for _ in range(300)]
    tracemalloc.start()
    try:
        toxicity.fit(texts, [i % 2 for i in range(300)], epochs=(1, 0))
        assert tracemalloc.get_traced_memory()[1] < 80e6  # 1.2 million words
    finally:
        tracemalloc.stop()


def test_toxicity_with_one_class_or_none():
    for rows in ([], [("fine words here", 0)] * 5):
        net = toxicity.fit([t for t, _ in rows], [y for _, y in rows])
        assert (toxicity.Scorer(net).scores(["anything", ""])[0] < 0.5).all()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=1>Home</a></li></ul></nav><header><h1>Site</h1></header><div class="ad">Buy</div>{body}
<div class="sidebar"><p>Other stories of the day, of which there are many and long ones at that.</p></div><form><p>Mail us</p></form>
<section id="comments"><p>A reader's comment that is long enough to look like the text of an article, surely.</p></section><footer>&copy; x</footer></body></html>"""
ARTICLE = "<h1>Head &amp; line</h1><p>First  paragraph\nof text, which is long enough to count.<p>Second &mdash; <b>bold</b> paragraph, also long enough to count as text.</p><p>Of.</p><ul><li>Item one of the list</li></ul>"
TEXT = "Head & line\n\nFirst paragraph of text, which is long enough to count.\n\nSecond — bold paragraph, also long enough to count as text.\n\nOf.\n\nItem one of the list"


@pytest.mark.parametrize(
    "wrap",
    [
        "<article>{}</article>",
        "<main>{}</main>",
        '<div id="content">{}</div>',
        '<article><header class="entry-header"><p>By line</p></header>{}</article>',
    ],
)
def test_main_text(wrap):
    got = html_text.main_text(PAGE.replace("{body}", wrap.format(ARTICLE)))
    assert got == ("By line\n\n" if "By line" in wrap else "") + TEXT


def test_main_text_odd_rows(spark):
    rows = [
        (1, "u", None),
        (2, "u", ""),
        (3, None, "<p>"),
        (None, "u", "plain text only"),
        (4, "u", "<article><p>" + "w " * 50_000),
        (4, "u", "<nav>a</nav>"),
        (5, "u", "<b><i></p></div>x<"),
        (6, "u", "<article><p>a</p>" * 3000),
    ]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(g.n_chars == len(g.text) for g in got)
    assert {g.text for g in got if g.page_id in (1, 2, 3)} == {""} and next(g.text for g in got if g.page_id is None) == "plain text only"
    assert max(g.n_chars for g in got) == 99_999
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "A paragraph of the article that goes on for a while, so that it has many letters for each tag. "
MENU = "".join(f'<li><a href="/{k}">Other story number {k} of the day</a></li>' for k in range(6))


@pytest.mark.parametrize(
    "page,want",
    [
        ('<div class="share-price-table"><p>Prices rose.</p></div>', "Prices rose."),
        ('<div class="comment-on-law"><p>The law says so.</p></div>', "The law says so."),
        ('<div class="related-posts"><p>' + LONG + "</p></div>", None),
        ('<div id="site-footer"><p>' + LONG + "</p></div>", None),
        ('<div class="ad-slot-1"><p>Buy.</p></div>', None),
        ("<ul>" + MENU + "</ul>", None),
        ('<p><a href="/x">One link alone stays.</a></p>', "One link alone stays."),
        ('<article class="comment-body"><p>' + LONG + "</p></article>", None),
    ],
)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<body><div>{}</div></body>"])
def test_parts_inside_the_article(page, want, wrap):
    html = wrap.format(f"<h1>Head</h1><p>{LONG * 3}</p><p>{LONG * 2}</p>{page}<p>{LONG * 3}</p>")
    body = ["Head", (LONG * 3).strip(), (LONG * 2).strip(), *([want] if want else []), (LONG * 3).strip()]
    assert html_text.main_text(html) == "\n\n".join(body)


@pytest.mark.parametrize(
    "wrap",
    [
        '<form id="aspnet">{}</form>',
        '<div class="content has-sidebar">{}</div>',
        '<div class="sidebar-wrapper">{}</div>',
        '<div id="page-with-comments">{}</div>',
    ],
)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>"])
def test_wrappers_of_the_article_stay(wrap, inner):
    html = "<body>" + wrap.format(inner.format(f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>")) + "</body>"
    assert html_text.main_text(html) == f"Head\n\n{LONG.strip()}\n\n{LONG.strip()}"


def test_ratios_decide(monkeypatch):
    """Pages without telling tags: text against teasers with many tags, and with a list of links in it."""
    teasers = "".join(f'<div><b><i>Teaser {k}</i></b> <span>by</span> <em>someone</em> <u>now</u></div>' for k in range(14))
    text = f"<div><p>{LONG * 4}</p><p>{LONG * 5}</p><ul>{MENU}</ul><p>{LONG * 4}</p></div>"
    page = f"<body><div>{teasers}</div>{text}<div>{teasers}</div></body>"
    want = "\n\n".join((LONG * k).strip() for k in (4, 5, 4))
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text, "ratios", lambda lines: [1.0] * len(lines))
    assert html_text.main_text(page) != want


def test_deep_pages_take_linear_time():
    began = time.time()
    assert html_text.main_text("<div>" * 50_000 + "text" + "</b>" * 50_000) == "text"
    assert html_text.main_text("<b><article>" + "<div>" * 50_000 + "text" + "</b>" * 50_000) == "text"
    assert html_text.main_text("<article><p>a</p>" * 20_000).count("a") == 20_000
    assert time.time() - began < 20


class Tree:
    """A page of well-formed elements, each (tag, attributes, children), worked on without regard to time."""

    def __init__(self, r, tag="body", depth=0):
        self.tag, self.cls, self.kids = tag, "", []
        if tag in ("p", "li", "h2"):
            words = " ".join(r.choice(["some", "words", "of", "text", "longer"]) for _ in range(r.choice([1, 3, 25, 60])))
            self.kids = [words] if r.random() < 0.7 else [("a", words)] if r.random() < 0.5 else [words[:9] + " ", ("b", words)]
            return
        if tag == "div" and depth and r.random() < 0.3:
            self.cls = r.choice(["ad", "comments", "related-posts", "share-price", "story"])
        for _ in range(r.randrange(1, 5)):
            self.kids.append(
                Tree(r, r.choice(["p", "p", "li", "h2", "nav"] if depth > 2 else ["p", "div", "div", "section", "article", "p", "form"]), depth + 1)
            )

    def html(self):
        inner = "".join(k if isinstance(k, str) else f"<{k[0]}>{k[1]}</{k[0]}>" if isinstance(k, tuple) else k.html() for k in self.kids)
        return f'<{self.tag}{f" class={chr(34)}{self.cls}{chr(34)}" if self.cls else ""}>{inner}</{self.tag}>'

    def lines(self, path=()):
        """(path, text, link characters, tags before)"""
        path = (*path, self)
        if self.kids and not isinstance(self.kids[0], Tree):
            tags = sum(isinstance(k, tuple) for k in self.kids)
            text = "".join(k if isinstance(k, str) else k[1] for k in self.kids)
            return [(path, " ".join(text.split()), sum(len(k[1]) for k in self.kids if isinstance(k, tuple) and k[0] == "a"), tags)]
        return [x for k in self.kids if isinstance(k, Tree) for x in k.lines(path)]


def slow_main_text(root):
    lines, tags, seen = root.lines(), [], set()
    for path, _, _, own in lines:  # every element opens right before its first line
        new = [n for n in path if id(n) not in seen]
        seen |= {id(n) for n in new}
        tags.append(len(new) + own)
    shown = [len(x[1]) - x[2] for x in lines]
    ratio = np.array([max(0, n) / max(1, t) for n, t in zip(shown, tags, strict=True)])
    w = np.array([[np.exp(-0.5 * ((i - j) / 1.5) ** 2) if abs(i - j) <= 5 else 0 for j in range(len(lines))] for i in range(len(lines))])
    ratio = (w * ratio).sum(1) / w.sum(1)
    low, high = ratio.min(), ratio.max()
    while True:
        cut = (low + high) / 2
        if (ratio <= cut).all() or (ratio > cut).all():
            cut = ratio.min()
            break
        new = ratio[ratio <= cut].mean(), ratio[ratio > cut].mean()
        if np.allclose(new, (low, high), rtol=0, atol=1e-12):
            break
        low, high = new
    good = [r >= cut and x[2] < len(x[1]) for r, x in zip(ratio, lines, strict=True)]
    never = lambda n: n.tag == "nav" or n.cls == "comments"
    maybe = lambda n: n.tag == "form" or n.cls in ("ad", "related-posts")
    weigh = lambda x: len(x[1]) * (3 if any(n.tag == "article" for n in x[0]) else 1)
    within = lambda n, x: any(m is n for m in x[0])
    some = [x for x, g in zip(lines, good, strict=True) if g and not any(map(never, x[0]))]
    total = sum(map(weigh, some))
    wrap = lambda n: total and sum(weigh(x) for x in some if within(n, x)) >= 0.9 * total
    left = [any(never(n) or maybe(n) and not wrap(n) for n in x[0]) for x in lines]
    body = [x for x, out in zip(lines, left, strict=True) if not out]
    content = [x for x, g, out in zip(lines, good, left, strict=True) if g and not out] or [x for x in body if x[2] < len(x[1])]
    if not content:
        return ""
    total = sum(map(weigh, content))
    chain = [n for n in content[0][0] if n.tag in ("article", "div", "section") and sum(weigh(x) for x in content if within(n, x)) >= 0.7 * total]
    for x in content:
        for n in x[0]:
            if n.tag in ("article", "div", "section") and not any(m is n for m in chain) and sum(
                weigh(y) for y in content if within(n, y)
            ) >= 0.7 * total:
                chain.append(n)
    chain.sort(key=lambda n: next(x[0].index(n) for x in lines if within(n, x)))
    articles = [n for n in chain if n.tag == "article"]
    best = articles[0] if articles else chain[-1] if chain else root
    size = lambda n: sum(len(x[1]) for x in body if within(n, x))
    up = next((x[0][: x[0].index(best)][::-1] for x in lines if within(best, x)), ())
    if not articles:
        for n in up:
            if size(n) > 1.15 * size(best):
                break
            best = n
    kept = [(x, any(x is c for c in content)) for x in body if within(best, x)]
    link = [not g and x[2] >= len(x[1]) for x, g in kept]
    menu = [v and (k > 0 and link[k - 1] or k + 1 < len(link) and link[k + 1]) for k, v in enumerate(link)]
    return "\n\n".join(x[1] for (x, _), m in zip(kept, menu, strict=True) if not m)


def test_main_text_like_slow_version():
    r, some = random.Random(11), 0
    for _ in range(300):
        page = Tree(r)
        got = html_text.main_text(page.html())
        assert got == slow_main_text(page)
        some += bool(got)
    assert some > 200


def brute_mix(rows, weights=(5, 2, 1), share=1.5):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, free, target = share * sum(total.values()), set(names), {}
    while True:
        left = budget - sum(target.values())
        over = [s for s in free if w[s] * left / sum(w[x] for x in free) > 2 * total[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            free.discard(s)
        if not free:
            break
    for s in free:
        target[s] = w[s] * left / sum(w[x] for x in free)
    return total, target, size


@pytest.mark.parametrize("few", [20_000, 0])
def test_mix(spark, monkeypatch, few):
    monkeypatch.setattr(source_mix, "FEW_SOURCES", few)
    r = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(r.randrange(0, 40))), r.choice(["a", "b", "b", "b", "c", "d", None])) for k in range(400)]
    rows += [(None, "one two", "a"), (3, "again and again", "a"), (500, None, "e"), (501, "   ", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(df).collect()
    total, target, size = brute_mix(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for g in got:
        assert 0 <= g.taken <= 2 * g.size
    merged = defaultdict(list)
    for g in got:
        merged[(g.source_size, round(g.target, 6))].append(g.taken)
    for s in total:
        assert abs(sum(merged[(total[s], round(target[s], 6))]) - target[s]) <= max(size(t) for _, t, x in rows if x == s), s
    assert not taken and sorted(map(tuple, got), key=str) == sorted(map(tuple, source_mix.mix(df.repartition(7)).collect()), key=str)
    kept = source_mix.mixed_documents(df.withColumn("size", F.lit("clash")).withColumn("h", F.lit(1)))
    assert {(k.doc_id, k.taken) for k in kept.collect()} == {(g.doc_id, g.taken) for g in got if g.copies > 0}
    assert source_mix.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["one id and text", "one id", "no id"])
def test_targets_are_met_where_ids_repeat(spark, kind):
    """400 rows of one id, or none, are as many documents; copies of one id and text are told apart by number."""
    r = random.Random(7)
    rows = [("a", k, " ".join(["w"] * r.randint(5, 40))) for k in range(300)] + [("b", k, "x " * r.randint(1, 30)) for k in range(300)]
    text = lambda k: "same words here " * 5 if kind == "one id and text" else f"t{k} words here " * 5
    rows += [("c", None if kind == "no id" else 7, text(k)) for k in range(400)]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string")
    got = source_mix.mix(df.repartition(5)).collect()
    assert len(got) == len(rows)
    by = defaultdict(lambda: [0, 0.0])
    for g in got:
        by[g.source_size][0] += g.taken
        by[g.source_size][1] = g.target
    assert len(by) == 3
    for taken, target in by.values():
        assert abs(taken - target) <= 20, (taken, target)  # half of the longest document
    taken = lambda df: sorted((x.doc_id or -1, x.size, x.taken) for x in source_mix.mix(df).collect())
    assert taken(df) == taken(df.repartition(3))
    kept = source_mix.mixed_documents(df)
    assert sum(x.copies for x in kept.collect()) == sum(g.copies for g in got)


def test_matcher_against_brute_force():
    r = random.Random(11)
    for vocab in (["a"], ["a", "b"], ["a", "b", "c", "d"]):
        for _ in range(60):
            items = [(str(k), " ".join(r.choice(vocab) for _ in range(r.randrange(0, 40)))) for k in range(r.randrange(0, 5))]
            text = " ".join(r.choice(vocab) for _ in range(r.randrange(0, 70)))
            runs, found = decontaminate.Matcher([(k, t.encode()) for k, t in items]).scan(decontaminate.words_of(text))
            n_words, n_hit, n_items, _, _, hit = brute_hits(text, items)
            assert {p for a, b in runs for p in range(a, b + 1)} == hit and len(found) == n_items


def test_a_large_benchmark_is_one_automaton():
    """20 MB of words: each is held once, and one scan finds what is there."""
    r = np.random.default_rng(1)
    vocab = np.array([f"w{k:x}" for k in range(200_000)])
    items, size = [], 0
    while size < 20_000_000:
        words = vocab[r.integers(0, len(vocab), 400)].tolist()
        items.append((str(len(items)), " ".join(words).encode()))
        size += len(items[-1][1])
    assert sum(len(t.split()) for _, t in items) < decontaminate.AUTOMATON_WORDS
    m = decontaminate.Matcher(items)
    doc = [b"x"] * 50 + items[77][1].split()[101:114] + [b"y"] * 50 + items[5][1].split()[0:12] + [b"z"]
    assert m.scan(doc) == ([(50, 62)], {"77"})


def test_very_repetitive_texts_are_scanned_in_time():
    m = decontaminate.Matcher([("1", b"a " * 500), ("2", b"a b " * 300)])
    began = time.process_time()
    runs, found = m.scan([b"a"] * 10_000 + [b"a", b"b"] * 5_000)
    assert runs == [(0, 19_999)] and found == {"1", "2"} and time.process_time() - began < 30
