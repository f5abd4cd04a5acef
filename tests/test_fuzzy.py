import random

import pytest

from lectern.operators import joins


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def score(a, b):
    n = max(len(a), len(b))
    return 100.0 * (1 - distance(a, b) / n) if n else 100.0


def names(draw, n, size):
    out = set()
    while len(out) < n:
        out.add("".join(draw.choice("aeiourstlnmé") for _ in range(draw.choice(size))))
    return sorted(out)


def edited(draw, name):
    for _ in range(draw.randrange(0, 4)):
        i = draw.randrange(len(name) + 1)
        name = draw.choice([name[:i] + draw.choice("xyzae") + name[i:], name[:i] + name[i + 1 :], name[:i] + draw.choice("xyz") + name[i + 1 :]])
    return name


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(12)
    left, right = [], []
    for block, n, size in (("long", 150, range(8, 19)), ("short", 60, range(1, 7)), ("mixed", 80, range(2, 15))):
        known = names(draw, n, size)
        right += [(block, x) for x in known]
        left += [(block, edited(draw, draw.choice(known))) for _ in range(n)]
    left += [("long", "zzzzzzzz"), ("none", "abc"), ("mixed", None), (None, "abc"), ("long", "")]
    right += [("mixed", None), ("long", right[0][1])]
    return left, right, spark.createDataFrame(left, "block string, a string"), spark.createDataFrame(right, "block string, b string")


@pytest.mark.parametrize("like", [50.0, 60.0, 75.0, 90.0])
def test_candidates_hold_all_like_pairs(sides, like):
    left, right, ls, rs = sides
    got = {(r.block, r.a, r.b) for r in joins.like_pairs(ls, rs, ["block"], "a", "b", like).collect()}
    want = {(p, a, b) for p, a in left for q, b in right if p == q and p is not None and None not in (a, b) and score(a, b) >= like}
    assert want <= got and len(want) > 50


def test_long_names_meet_few_others(sides):
    left, right, ls, rs = sides
    of = lambda rows, block: {x for p, x in rows if p == block and x is not None}
    pairs = joins.like_pairs(ls, rs, ["block"], "a", "b", 75.0).where("block = 'long'").count()
    assert pairs < len(of(left, "long")) * len(of(right, "long")) / 6


@pytest.mark.parametrize("least", [0.0, 70.0])
def test_best_matches_equal_those_among_all_pairs(sides, least):
    left, right, ls, rs = sides
    want = []
    for p, a in left:
        some = [(-score(a, b), b) for q, b in set(right) if p == q and p is not None and None not in (a, b) and score(a, b) >= least]
        if some:
            want.append((p, a, min(some)[1], round(-min(some)[0], 9)))
    got = [(r.block, r.a, r.b, round(r.score, 9)) for r in joins.best_match(ls, rs, ["block"], "a", "b", least).collect()]
    assert sorted(got) == sorted(want)


def test_nearest_of_a_piece_is_the_first_of_the_most_similar():
    draw = random.Random(5)
    rights = sorted({*names(draw, 120, range(1, 20)), "", "é" * 64, "x" * 63, "ab" * 30})
    lefts = sorted([*(edited(draw, draw.choice(rights)) for _ in range(150)), "", "q", "x" * 70, "é" * 130])
    want = [min((-score(a, b), b) for b in rights) for a in lefts]
    assert [(-s, rights[i]) for i, s in joins.nearest(lefts, rights)] == want


def test_names_of_a_large_block_meet_in_pieces_without_broadcasts(spark, monkeypatch):
    """More names than a piece holds, and right names that are longer than a word of bits."""
    monkeypatch.setattr(joins, "LEFTS", 16)
    monkeypatch.setattr(joins, "RIGHTS", 8)
    draw = random.Random(8)
    right = [("x", b) for b in [*names(draw, 50, range(3, 12)), "ab" * 40, "lo" * 33]]
    left = [("x", edited(draw, b)) for _, b in right] + [("x", "ab" * 39), ("y", "alone")]
    ls, rs = spark.createDataFrame(left, "block string, a string"), spark.createDataFrame(right, "block string, b string")
    best = joins.best_match(ls, rs, ["block"], "a", "b")
    want = [(a, *min((-score(a, b), b) for _, b in right)) for p, a in left if p == "x"]
    assert sorted((r.a, -r.score, r.b) for r in best.collect()) == sorted(want)
    assert "BroadcastHashJoin" not in best._jdf.queryExecution().executedPlan().toString()
