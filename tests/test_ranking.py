"""Ordered counting bucket by bucket equals the plain loop, also with one huge group."""

import random

from pyspark.sql import functions as F

from siteledger.operators import ranking
from siteledger.operators.nesting import nest_children, nest_kinds
from siteledger.operators.ranking import Place, latest, nested_positions, positions, positions_of, positions_of_copies, previous_value, previous_values, running_count


def skewed(spark, n=900):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.5 else rng.randrange(1, 9)
        rows.append((key, i * 7 % n, rng.random() < 0.2, rng.choice([1.0, 2.0, None])))
    return rows, spark.createDataFrame(rows, "k int, pos int, flag boolean, v double")


def by_group(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_positions(spark):
    rows, df = skewed(spark)
    got = {(r.k, r.pos): r.n for r in positions(df, ["k"], ["pos"], F.floor(F.col("pos") / 64), "n").collect()}
    want = {(k, r[1]): i for k, group in by_group(rows).items() for i, r in enumerate(group)}
    assert got == want


def test_running_count(spark):
    rows, df = skewed(spark)
    got = {(r.k, r.pos): r.n for r in running_count(df, ["k"], ["pos"], F.floor(F.col("pos") / 50), F.col("flag"), "n").collect()}
    want = {}
    for k, group in by_group(rows).items():
        n = 0
        for r in group:
            n += r[2]
            want[k, r[1]] = n
    assert got == want


def test_previous_value(spark):
    rows, df = skewed(spark)
    got = {(r.k, r.pos): r.p for r in previous_value(df, ["k"], "pos", F.floor(F.col("pos") / 13), "v", "p").collect()}
    want = {(k, r[1]): (group[i - 1][3] if i else None) for k, group in by_group(rows).items() for i, r in enumerate(group)}
    assert got == want


def test_positions_spread_a_hot_group(spark):
    """The window of a hot group is hashed by key and bucket, not by key alone."""
    df = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("pos"))
    plan = positions(df, ["k"], ["pos"], F.floor(F.col("pos") / 4), "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
    assert windows and all("__bucket" in line for line in windows)


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert sorted((r.k, r.seq, r.v) for r in latest(df, ["k"], ["seq"]).collect()) == [("a", 3, None), ("b", 1, "z")]


def test_nesting_pages_keep_every_child(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    kids = spark.createDataFrame([(1, i, f"k{i}") for i in range(25)] + [(2, 99, "only"), (None, 5, "lost")], "p int, id int, name string")
    nested = nest_children(parents, kids, {"id": "p"}, "id", ["id", "name"], "kids", page_size=10)
    got = {(r.id, r.page): [k.id for k in r.kids] for r in nested.collect()}
    assert got == {(1, 0): list(range(10)), (1, 1): list(range(10, 20)), (1, 2): list(range(20, 25)), (2, 0): [99], (3, 0): []}


def test_nesting_of_several_kinds(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    kids = spark.createDataFrame([(1, i, f"k{i}") for i in range(25)] + [(9, 0, "orphan")], "id int, pos int, k string")
    pets = spark.createDataFrame([(2, 0, "cat"), (1, 0, None)], "id int, pos bigint, pet string")
    nested = nest_kinds(parents, ["id"], ["name"], {"kids": (kids, "pos", ["k"]), "pets": (pets, "pos", ["pet"])}, page_size=10)
    got = {(r.id, r.page): (r.name, [k.k for k in r.kids], [p.pet for p in r.pets]) for r in nested.collect()}
    names = [f"k{i}" for i in range(25)]
    assert got == {(1, 0): ("a", names[:10], [None]), (1, 1): (None, names[10:20], []), (1, 2): (None, names[20:], []), (2, 0): ("b", [], ["cat"]), (3, 0): ("c", [], [])}
    assert "Join" not in nested._jdf.queryExecution().optimizedPlan().toString()


def test_several_positions_at_once(spark):
    rows, df = skewed(spark)
    places = {
        "in_key": Place(["k"], ["pos"], F.floor(F.col("pos") / 64)),
        "in_flag": Place(["flag"], [F.desc("pos")], -F.floor(F.col("pos") / 50)),
    }
    got = {(r.k, r.pos): (r.in_key, r.in_flag) for r in positions_of(df, places).collect()}
    by_key = {(k, r[1]): i for k, group in by_group(rows).items() for i, r in enumerate(group)}
    flagged = {f: sorted((r for r in rows if r[2] == f), key=lambda r: -r[1]) for f in (True, False)}
    by_flag = {(r[0], r[1]): i for group in flagged.values() for i, r in enumerate(group)}
    assert got == {key: (by_key[key], by_flag[key]) for key in by_key}


def test_copies_get_consecutive_places(spark, monkeypatch):
    monkeypatch.setattr(ranking, "COPY_STEP", 4)
    rows = [(1, 5, "x")] * 11 + [(1, 3, "a"), (1, 5, "y"), (1, 9, "z")] + [(2, 1, "q")] * 2
    df = spark.createDataFrame(rows, "k int, o int, v string")
    got = sorted(tuple(r) for r in positions_of_copies(df, ["k"], ["o", "v"], F.floor(F.col("o") / 4), "n").collect())
    want = []
    for k in (1, 2):
        want += [(*row, i) for i, row in enumerate(sorted(r for r in rows if r[0] == k))]
    assert got == sorted(want)


def test_two_levels_of_totals(spark):
    """Buckets of one row each: runs of them are summed first."""
    rows, df = skewed(spark, 400)
    narrow = F.col("pos").cast("bigint")
    got = {(r.k, r.pos): r.n for r in running_count(df, ["k"], ["pos"], narrow, F.col("flag"), "n", fan=16).collect()}
    seen = {(r.k, r.pos): r.p for r in previous_value(df, ["k"], "pos", narrow, "v", "p", fan=16).collect()}
    want, before = {}, {}
    for k, group in by_group(rows).items():
        n, last = 0, None
        for r in group:
            n += r[2]
            want[k, r[1]], before[k, r[1]], last = n, last, r[3]
    assert got == want and seen == before


def test_several_previous_values_in_one_pass(spark):
    rows, df = skewed(spark)
    found = previous_values(df, ["k"], "pos", F.floor(F.col("pos") / 13), {"p": "v", "q": "flag"})
    want = {(k, r[1]): (group[i - 1][3], group[i - 1][2]) if i else (None, None) for k, group in by_group(rows).items() for i, r in enumerate(group)}
    assert {(r.k, r.pos): (r.p, r.q) for r in found.collect()} == want


def test_nested_positions(spark):
    rng = random.Random(9)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 5), n, rng.choice(["a", "b", None]), rng.choice(["x", "y"])) for n in range(700)]
    df = spark.createDataFrame(rows, "k int, pos bigint, a string, b string").repartition(7)
    within = {"all": [], "by_a": ["a"], "by_ab": ["a", "b"]}
    found = nested_positions(df, ["k"], "pos", F.floor(F.col("pos") / 40), within)
    assert found.columns == ["k", "pos", "a", "b", *within]
    want, seen = {}, {}
    for k, pos, a, b in rows:
        places = []
        for group in ((k,), (k, a), (k, a, b)):
            places.append(seen.setdefault((len(group), group), 0))
            seen[len(group), group] += 1
        want[pos] = tuple(places)
    assert {r.pos: (r["all"], r.by_a, r.by_ab) for r in found.collect()} == want
    text = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("Exchange hashpartitioning") <= 3 and "Join" not in text, text
