"""Queries over whole tables: nothing is left out by id."""

import math
import random

import numpy as np

import __spark_entry__ as entry
from attesta.operators import neighbours
from tests.oracle import DATA


def _pairs(rows, ratio=0.74):
    out = set()
    for a, x in rows:
        near = sorted((math.dist(x, y), b) for b, y in rows if b != a and len(y) == len(x))[:2]
        if len(near) == 2 and a < near[0][1] and near[0][0] < ratio * near[1][0]:
            out.add((a, near[0][1], round(near[0][0], 6)))
    return out


def test_descriptor_pairs(spark, monkeypatch):
    """Near and equal vectors far beyond the first 200 ids, over many blocks."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, [x + 1e-3 for x in rows[i * 9][1]]) for i in range(40)]  # one near copy
    rows += [(2000 + i, [*rows[i * 9 + 1][1]]) for i in range(20)]  # equal pairs
    rows += [(3000 + i, [9.0] * 6) for i in range(50)] + [(3100, [9.001] * 6)]  # equal in large number
    rows += [(3200 + i, [20 + i * 1e-9] + [0.0] * 5) for i in range(30)]  # closer than products can tell
    rows += [(4000, [1.0, 2.0]), (4001, [1.0, 2.5]), (4002, [9.0, 2.0])]
    odd = [(5000, None), (5001, []), (5002, [float("nan")] * 6), (5003, [None] * 6)]
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 200)
    got = [tuple(r) for r in neighbours.ratio_pairs(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()]
    want = _pairs(rows)
    assert len(got) == len(set(got)) and {(a, b, round(d, 6)) for a, b, d in got} == want
    assert {(a, b) for a, b, _ in want} >= {(i * 9, 1000 + i) for i in range(40)} | {(i * 9 + 1, 2000 + i) for i in range(20)}


def test_two_nearest_where_products_round():
    rng = np.random.default_rng(4)
    c = 1e3 + rng.normal(size=(300, 4)) * 1e-7
    ids, near, d = neighbours.two_nearest(np.arange(300), c, np.arange(300), c)
    full = np.sqrt(((c[:, None] - c) ** 2).sum(axis=2))
    np.fill_diagonal(full, np.inf)
    assert (ids == np.repeat(np.arange(300), 2)).all() and (d.reshape(-1, 2) == np.sort(full, axis=1)[:, :2]).all()


def _keys(spark, table, column):
    return {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(column).collect()}


def test_every_member_and_parent(spark):
    run = entry.queries()
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_linenumber").collect()
    children = {r.l_orderkey: r.children.split(",") for r in run["j16_children"](spark, DATA).collect()}
    assert children.keys() == {r.l_orderkey for r in lines} and sum(map(len, children.values())) == len(lines)
    owners = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    members = {r.c_custkey for r in run["j7_rbac_permissions"](spark, DATA).collect()}
    assert members == {owners[k] for k in children if k in owners} & _keys(spark, "customer", "c_custkey")


def test_first_page_of_all_orders(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderpriority", "o_orderdate", "o_orderkey").collect()
    page = [r.o_orderkey for r in entry.queries()["t2_severity_order"](spark, DATA).collect()]
    assert page == [k for *_, k in sorted(map(tuple, orders))[:50]]


def test_confidence_of_every_document(spark):
    got = {r.l_orderkey for r in entry.queries()["a15_field_confidence"](spark, DATA).collect()}
    assert got == _keys(spark, "lineitem", "l_orderkey")


def test_dates_of_every_customer(spark):
    got = {r.o_custkey for r in entry.queries()["u5_distinct_dates"](spark, DATA).collect()}
    assert got == _keys(spark, "orders", "o_custkey")


def test_listed_names_that_contain_a_name(spark):
    """Fragments of words, names of several words and of one letter, common words; blank names match nothing."""
    names = ["anna smith", "a", "AN", "Joanna", "son", " ", "", None, "annasmith", "ith", "smith anna"]
    listed = ["Joanna Smithson", "Anna Smith", "ANNASMITH", "Bo", "", None, "Hannah Anna Smith"] + [f"Smithson {i}" for i in range(30)]
    s = spark.createDataFrame(list(enumerate(names)), "subject long, name string")
    w = spark.createDataFrame(list(enumerate(listed)), "id long, full_name string")
    got = sorted((r.subject, r.id) for r in neighbours.containing(s, "name", w, "full_name").collect())
    assert got == [(i, j) for i, n in enumerate(names) for j, f in enumerate(listed) if n and n.strip() and f and n.lower() in f.lower()]
