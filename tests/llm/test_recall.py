"""How many of the pairs there are get found, on tables made to be hard to search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemill.llm import fuzzy_lines, shingle_join


def nested_pairs(seed, pairs, size, threshold, shared=0):
    """Texts 2k and 2k + 1: the latter's words are the former's and some more, so that their Jaccard is the threshold at least."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    common, rows = [word() for _ in range(shared)], []
    for k in range(pairs):
        w = common + [word() for _ in range(size - shared)]
        rows += [(2 * k, " ".join(w[: round(threshold * (size - 4) + 0.4999) + 4])), (2 * k + 1, " ".join(w))]
    return rows


def linked(spark, rows, **options):
    got = shingle_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    return sum(g.n_links for g in got) // 2


def test_pairs_of_split_buckets(spark):
    """All buckets are split twice; pairs are at the threshold and nested, which is the worst case."""
    rows = nested_pairs(1, 300, 44, 0.5)
    assert 297 <= linked(spark, rows, threshold=0.5, recall=0.99, large=1) <= 300


def test_thousands_in_a_bucket(spark):
    rows = nested_pairs(2, 1500, 84, 0.8, shared=40)
    assert linked(spark, rows) == 1500
    assert linked(spark, rows, large=1000) == 1500  # split


@pytest.mark.parametrize("threshold,recall", [(0.8, 0.99999), (0.5, 0.99), (0.9, 0.999)])
def test_repetitions_bound_misses(threshold, recall):
    few, more = shingle_join.planned(threshold, recall)
    chance = shingle_join.met(threshold)
    assert (1 - chance) ** few + (1 - chance**3) ** more <= 1 - recall
    assert shingle_join.RECALL == 0.99999


@pytest.mark.parametrize("common,left,right", [(8, 0, 2), (80, 0, 20), (80, 10, 10), (800, 0, 200), (72, 4, 14), (16, 2, 2)])
def test_chance_to_meet(common, left, right):
    """Sets of Jaccard 0.8 choose a token together as often as the bound says, or more."""
    sets, often = shingle_join.Sets(5, 0.8, 1), 4000
    r = np.random.default_rng(common)
    hit = 0
    for _ in range(often):
        tokens = r.integers(0, 2**63, common + left + right, dtype=np.uint64)
        a, b = np.sort(tokens[: common + left]), np.sort(np.r_[tokens[:common], tokens[common + left :]])
        x, y = (set(sets.chosen(v, sets.seeds)[0].tolist()) for v in (a, b))
        hit += bool(x & y)
    assert hit / often >= shingle_join.met(0.8) - 3 * (0.25 / often) ** 0.5


def edited(r, line, edits, join=True):
    """The line after so many edits of a character: another letter, one more, one less, or, with join, two words made one."""
    x = list(line)
    for _ in range(edits):
        at, kind = r.randrange(len(x)), r.randrange(8 if join else 6)
        while x[at] == " " and not join:
            at = r.randrange(len(x))
        if kind < 5 and x[at] != " ":
            x[at] = r.choice("xyz")
        elif kind == 5:
            x.insert(at, r.choice("vw"))
        elif kind == 6 and x[at] != " " and len(x) > 2:
            del x[at]
        elif 0 < at < len(x) - 1:
            x[at] = "k"  # joins two words, where it takes the place of a space
    return "".join(x)


@pytest.mark.parametrize("words", [3, 6, 12, 30, 120, 600])
def test_similar_lines(spark, words):
    """Of pairs of lines that the likeness accepts, with any number of edits up to all that it allows, nine in ten are found at least.

    In lines of under 12 words no words are joined: of such pairs some four in five are found.
    """
    r = random.Random(words)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9)))
    rows, want, full = [], 0, set()
    while want < 250:
        a = " ".join(word() for _ in range(words))
        most = fuzzy_lines.LIKENESS.most(len(a))
        edits = r.randint(1, max(1, most))
        b = edited(r, a, edits, words >= 12)
        apart = fuzzy_lines.edit_distance(fuzzy_lines.normalised(a), fuzzy_lines.normalised(b))
        if a != b and 0 < apart <= fuzzy_lines.LIKENESS.most(max(len(a), len(b))):
            full |= {2 * want + 1} if apart >= most else set()
            rows += [(2 * want, a), (2 * want + 1, b)]
            want += 1
    out = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {x.doc_id for x in out.filter(F.col("_n_removed") > 0).collect()}
    assert found <= {i for i, _ in rows if i % 2} and len(found) >= 0.9 * want, len(found) / want
    assert len(found & full) >= 0.75 * len(full), (len(found & full), len(full))


@pytest.mark.parametrize("words", [3, 5, 12, 25, 40, 120, 600])
def test_no_similar_line_is_missed(spark, words):
    """All pairs of as many edits as the likeness allows, words joined or not: none is left out at any length."""
    r = random.Random(words + 1)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9)))
    rows, apart = [], []
    while len(rows) < 2 * (60 if words > 100 else 200):
        a = " ".join(word() for _ in range(words))
        allowed = fuzzy_lines.LIKENESS.most(len(a))
        b = edited(r, a, allowed)
        norms = [fuzzy_lines.normalised(x) for x in (a, b)]
        apart.append(fuzzy_lines.edit_distance(*norms))
        if 0 < apart[-1] <= fuzzy_lines.LIKENESS.most(max(map(len, norms))):
            rows += [(len(rows), a), (len(rows) + 1, b)]
    assert max(apart) > 15 or words < 600
    out = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in out.filter(F.col("_n_removed") > 0).collect()} == {i for i, _ in rows if i % 2}


@pytest.mark.parametrize("likeness", [fuzzy_lines.LIKENESS, fuzzy_lines.Likeness(0.95, 2, 0.8)])
def test_similar_lines_share_a_stretch(likeness):
    r, seen = random.Random(11), 0
    while seen < 1500:
        a = " ".join("".join(r.choice("abcé語 ") for _ in range(r.choice((r.randrange(4, 60), r.randrange(60, 260), 700)))).split())
        x = list(a)
        for _ in range(likeness.most(len(a))):
            at, kind = r.randrange(len(x)), r.randrange(3)
            x[at : at + 1] = [[r.choice("abcé語 ")], [x[at], r.choice("abc ")], []][kind]
        b = " ".join("".join(x).split())
        if a != b and fuzzy_lines.within(a, b, likeness.most(max(len(a), len(b)))):
            owner, keys = fuzzy_lines.stretches([a.encode(), b.encode()], likeness)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (a, b)
            seen += 1


def test_distance_past_the_most_is_only_told_to_be_past():
    r = random.Random(3)
    for _ in range(500):
        a = "".join(r.choice("abcd ") for _ in range(r.randrange(0, 60)))
        b = edited(r, a, r.randrange(0, 12)) if len(a) > 2 and r.random() < 0.7 else "".join(r.choice("abcd ") for _ in range(r.randrange(0, 60)))
        whole, most = fuzzy_lines.edit_distance(a, b), r.randrange(0, 10)
        cut = fuzzy_lines.edit_distance(a, b, most)
        assert cut == whole if whole <= most else most < cut <= whole
    for size in range(0, 3000, 7):
        assert fuzzy_lines.LIKENESS.most(size) == int(fuzzy_lines.LIKENESS.allowed(np.array([size]))[0])


@pytest.mark.parametrize("likeness", [fuzzy_lines.LIKENESS, fuzzy_lines.Likeness(0.95, 2, 0.8)])
def test_signatures_rule_out_no_line_alike(likeness):
    r = random.Random(12)
    seen = 0
    for n in (11, 19, 21, 29, 31, 119, 199, 203, 349, 353, 849, 860, 1_640, 1_670, 3_290, 3_330, 12_990, 13_200):
        for kind in range(12):
            a = "".join(r.choice("abcdefghij é中") for _ in range(n)).strip() or "a"
            b = list(a)
            for _ in range(r.choice((1, likeness.most(n), likeness.most(n)))):
                at = r.randrange(len(b))
                b[at : at + (kind % 3 != 1)] = ["z"] * (kind % 3 != 2)  # replaced, put in, left out
            b = "".join(b)
            if fuzzy_lines.within(a, b, likeness.most(max(len(a), len(b)))):
                lines = [a.encode(), b.encode()]
                both = fuzzy_lines.signatures(lines, fuzzy_lines.code_points(lines), likeness)
                assert fuzzy_lines.may_be_alike(both[:1], both[1:], likeness)[0]
                assert not fuzzy_lines.torn(a, b, likeness.most(max(len(a), len(b))))
                seen += 1
    assert seen > 150


def test_unlike_lines_of_a_bucket_go_no_further(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    passage = " ".join(word() for _ in range(12))
    lines = [f"{passage} " + " ".join(word() for _ in range(40)) for _ in range(30)]
    lines.append(lines[0][:-1] + "é")
    keyed = fuzzy_lines._key(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    found = fuzzy_lines.met(keyed, 1, fuzzy_lines.LIKENESS).collect()
    # All 31 lines have the passage at one place, but two are alike.
    assert found and {tuple(sorted(x.lines)) for x in found} == {tuple(sorted(found[0].lines))} and found[0].n == 2
