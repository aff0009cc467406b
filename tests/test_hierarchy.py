from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from fotoloom.operators.hierarchy import closure, hierarchy

SCHEMA = "a bigint, b bigint, steps int, node_id string"  # the last two clash with names the operator uses


def brute(edges):
    kids = {}
    for a, b in edges:
        if a is not None and b is not None:
            kids.setdefault(a, set()).add(b)
    out = {}
    for a in kids:
        front, d = {a}, 0
        while front:
            d += 1
            front = {y for x in front for y in kids.get(x, ()) if (a, y) not in out}
            out |= {(a, y): d for y in front}
    return out


def run(spark, edges, **kw):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in edges], SCHEMA)
    return {(r.ancestor_id, r.node_id): r for r in closure(df, "a", "b", **kw).collect()}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), st.integers(0, 12))), max_size=25))
def test_closure_is_breadth_first_search(spark, edges):
    assert {k: r.steps for k, r in run(spark, edges).items()} == brute(edges)


def test_long_chain_and_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (0, 1)]
    got = run(spark, edges, with_path=True)
    assert {k: r.steps for k, r in got.items()} == brute(edges)
    assert got[(0, 40)].path == list(range(41)) and got[(100, 100)].path == [100, 101, 102, 100]


def test_hierarchy(spark):
    edges = [(1, 2), (2, 3), (1, 4), (4, 3), (9, 3), (20, 21), (21, 20), (21, 22)]
    rows = {r.node_id: r for r in hierarchy(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert (rows[3].root_id, rows[3].n_roots, rows[3].depth, rows[3].path, rows[3].n_ancestors) == (9, 2, 1, "9/3", 4)
    assert (rows[1].depth, rows[1].path, rows[1].n_descendants, rows[1].in_cycle) == (0, "1", 3, False)
    assert rows[20].in_cycle and rows[21].in_cycle and not rows[22].in_cycle and rows[22].depth is None


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert closure(none, "a", "b").count() == 0 and hierarchy(none.select(F.col("a").alias("x"), "b"), "x", "b").count() == 0
