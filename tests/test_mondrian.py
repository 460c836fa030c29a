"""k-anonymity by splits at medians."""

import random
from collections import Counter, defaultdict

import pytest

from mockloom.operators import mondrian
from mockloom.operators.scan import settled


def plain(rows, k):
    """Boxes of coded rows by the same rule, one after the other: sets of row numbers."""
    d = len(rows[0])
    spans = [max(r[i] for r in rows) for i in range(d)]

    def split(box):
        widths = sorted((((max(rows[j][i] for j in box) - min(rows[j][i] for j in box)) / max(spans[i], 1), -i) for i in range(d)), reverse=True)
        for width, i in widths if len(box) >= 2 * k else []:
            if width <= 0:
                break
            v = sorted(rows[j][-i] for j in box)
            m = next(x for x in v if 2 * sum(y <= x for y in v) >= len(v))
            room = lambda left: min(left, len(v) - left)
            behind, before = sum(y <= m for y in v), sum(y < m for y in v)
            if max(room(behind), room(before)) >= k:
                goes = (lambda x: x > m) if room(behind) >= room(before) else (lambda x: x >= m)
                return split([j for j in box if not goes(rows[j][-i])]) + split([j for j in box if goes(rows[j][-i])])
        return [frozenset(box)]

    return set(split(list(range(len(rows)))))


@pytest.mark.parametrize(("seed", "parts", "k"), [(1, 256, 12), (2, 3, 40)])
def test_against_plain_splits(spark, monkeypatch, seed, parts, k):
    monkeypatch.setattr(mondrian, "PARTS", parts)
    r = random.Random(seed)
    pick = lambda v: None if r.random() < 0.1 else v
    rows = [(j, pick(int(r.gauss(0, 1) ** 2 * 30)), pick(r.choice("aabbcxyz"))) for j in range(160)]
    # a third of all rows is one combination
    rows += [(j, 7, "a") for j in range(160, 240)]
    quasi = ["v", "t"]
    cells, sizes = mondrian.boxes_of(spark.createDataFrame(rows, "id int, v int, t string"), k, quasi)
    places = [{v: k for k, v in enumerate([None, *sorted({row[i] for row in rows} - {None})])} for i in (1, 2)]
    assert sizes == [len(p) for p in places]
    found = defaultdict(set)
    by_code = {(c["c0"], c["c1"]): c["box"] for c in cells.collect()}
    for row in rows:
        found[by_code[places[0][row[1]], places[1][row[2]]]].add(row[0])
    assert {frozenset(v) for v in found.values()} == plain([(places[0][row[1]], places[1][row[2]]) for row in rows], k)


@pytest.mark.parametrize("task", [0, 30, 10_000])
def test_boxes_split_in_one_task_are_the_same(spark, monkeypatch, task):
    monkeypatch.setattr(mondrian, "TASK", task)
    r = random.Random(9)
    rows = [(int(r.gauss(0, 1) ** 2 * 40), r.randint(0, 6)) for _ in range(700)]
    cells, _ = mondrian.boxes_of(spark.createDataFrame(rows, "v int, w int"), 12, ["v", "w"])
    of = {(c["v"], c["w"]): c["box"] for c in cells.collect()}
    found = defaultdict(set)
    for j, row in enumerate(rows):
        found[of[row]].add(j)
    places = [{v: j + 1 for j, v in enumerate(sorted({row[i] for row in rows}))} for i in (0, 1)]
    assert set(map(frozenset, found.values())) == plain([(places[0][v], places[1][w]) for v, w in rows], 12)


def test_small_boxes_take_one_pass(spark, monkeypatch):
    """Rounds over the whole table are those of large boxes only."""
    rounds = []
    monkeypatch.setattr(mondrian, "_medians", lambda *a, f=mondrian._medians: rounds.append(1) or f(*a))
    cells, _ = mondrian.boxes_of(spark.range(3000).selectExpr("id AS v", "id * 7919 % 3000 AS w"), 5, ["v", "w"])
    assert cells.select("box").distinct().count() > 256 and not rounds


def test_settled_rows_carry_no_plan(spark):
    """Rounds are planned in a time that does not grow from one to the next."""
    df = spark.range(10).selectExpr("id", "id % 3 AS v", "cast(null AS string) AS t").where("v >= 0")
    kept = settled(df)
    assert len(kept.inputFiles()) > 0 and kept.dtypes == df.dtypes and sorted(r["id"] for r in kept.collect()) == list(range(10))
    assert settled(df.limit(0)).count() == 0 and settled(df.limit(0)).columns == df.columns


def test_rows_and_columns(spark):
    r = random.Random(4)
    rows = [(j, r.randint(0, 50), r.choice(["x", "y", None])) for j in range(120)]
    df = spark.createDataFrame(rows, "id int, age int, kind string")
    made = mondrian.anonymise(df, 15, ["age", "kind"])
    assert made.columns == ["id", "age_low", "age_high", "age_null", "kind_low", "kind_high", "kind_null"]
    got = {m["id"]: m for m in made.collect()}
    assert len(got) == 120 and min(Counter(tuple(m)[1:] for m in got.values()).values()) >= 15
    for j, age, kind in rows:
        assert got[j]["age_low"] <= age <= got[j]["age_high"]
        assert got[j]["kind_null"] if kind is None else got[j]["kind_low"] <= kind <= got[j]["kind_high"]
    assert len({tuple(m)[1:] for m in got.values()}) >= 4


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "c")], "id int, age int, kind string")
    assert mondrian.anonymise(df, 4, ["age", "kind"]).count() == 0
    assert {tuple(m)[1:4] for m in mondrian.anonymise(df, 3, ["age", "kind"]).collect()} == {(1, 3, False)}
    assert mondrian.anonymise(df.limit(0), 2, ["age", "kind"]).count() == 0
    same = spark.createDataFrame([(j, 5, "z") for j in range(50)], "id int, age int, kind string")
    assert {tuple(m)[1:] for m in mondrian.anonymise(same, 3, ["age", "kind"]).collect()} == {(5, 5, False, "z", "z", False)}
