import pytest
from pyspark.sql import functions as F

from quirefold.operators import evidence as ev
from quirefold.operators import relational as rel
from quirefold.operators import sequences as seq


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([("a", "north", 4102.0), ("b", "north", 3479.0), ("c", "south", 3350.0), ("d", "south", 3479.0), ("e", "south", None)], "id string, grp string, value double")


def test_extremum_keeps_ties_in_order(facts):
    for df in (facts, facts.repartition(7)):
        assert rows(rel.extremum(df, "value", "id"), "rk", "id") == [(1, "a"), (2, "b"), (3, "d")]
        assert rows(rel.extremum(df, "value", "id", 2, largest=False), "rk", "id") == [(1, "c"), (2, "b")]
        assert rows(rel.extremum_by_group(df, "grp", "value", "id", 1), "grp", "id") == [("north", "a"), ("south", "d")]


def test_gate_declines(facts):
    assert not rel.complete(facts.select("id"), facts.where("value is not null"), "id")
    assert rel.complete(facts.where("value is not null").select("id"), facts, "id")


def test_totals_are_dropped_but_small_columns_stay(spark):
    df = spark.createDataFrame([("t", 10.0), ("t", 20.0), ("t", 30.0), ("t", 60.0), ("s", 0.9), ("s", 0.9), ("s", 0.9), ("two", 5.0), ("two", 5.0)], "tab string, v double")
    assert rows(rel.without_totals(df, ["tab"], "v"), "tab", "v") == [("s", 0.9)] * 3 + [("t", 10.0), ("t", 20.0), ("t", 30.0), ("two", 5.0), ("two", 5.0)]


def test_unit_outlier(spark):
    def found(units):
        return rows(rel.unit_outliers(spark.createDataFrame([(r, "area", u) for r, u in units], "record_id string, field string, unit string")), "record_id", "unit")

    assert found([("a", "sq km"), ("b", "sq km"), ("c", "sq miles")]) == [("c", "sq miles")]
    assert found([("a", "sq km"), ("b", "sq km"), ("c", "sq miles"), ("c", "sq km")]) == []
    assert found([("a", "sq km"), ("b", "sq km")]) == []


def test_claim_conflicts(spark):
    claims = spark.createDataFrame([(1, "x", 5.0), (2, "x", 9.0), (3, "y", 4.0), (4, "x", 9.0)], "id long, grp string, v double")
    assert rows(rel.claim_conflicts_in_group(claims, "grp", "v", "id"), "id", "peer") == [(1, 2)]
    assert rows(rel.claim_conflicts_universal(claims, "v", "id"), "id", "peer") == [(1, 2), (3, 2)]


def test_range_join_matches_a_plain_comparison(spark):
    points = spark.range(100).withColumnRenamed("id", "p")
    ranges = spark.createDataFrame([("a", 0, 5), ("b", 3, 70), ("c", 99, 120), ("d", 8, 8)], "name string, lo long, hi long")
    want = sorted((p, n) for p in range(100) for n, lo, hi in (("a", 0, 5), ("b", 3, 70), ("c", 99, 120), ("d", 8, 8)) if lo <= p <= hi)
    assert rows(rel.range_join(points, ranges, "p", "lo", "hi", 16), "p", "name") == want


def test_islands_across_blocks(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 31]
    df = spark.createDataFrame([("k", v) for v in values] + [("m", 4)], "key string, at long")
    assert rows(seq.islands(df, ["key"], "at", block=4), "key", "first", "last", "n") == [("k", 1, 9, 9), ("k", 12, 12, 1), ("k", 15, 17, 3), ("k", 31, 31, 1), ("m", 4, 4, 1)]


def test_packing(spark):
    df = spark.createDataFrame([("d", k, n) for k, n in enumerate((3000, 3000, 7000, 20000))], "doc string, k int, size long")
    for own in (df, df.repartition(7)):
        assert rows(seq.pack_records(own, "doc", "k", "size", 3, 8000), "k", "batch") == [(0, 1), (1, 1), (2, 2), (3, 3)]


def test_fill_and_spans(spark):
    df = spark.createDataFrame([("d", 1, "g"), ("d", 2, None), ("d", 3, "h"), ("e", 1, None)], "doc string, k int, head string")
    assert sorted((r["doc"], r["k"], r["f"] or "") for r in seq.forward_fill(df, "doc", ["k"], "head", "f").collect()) == [("d", 1, "g"), ("d", 2, "g"), ("d", 3, "h"), ("e", 1, "")]
    assert rows(seq.lead_spans(df, "doc", ["k"], "k", F.lit(99)), "doc", "k", "span_end") == [("d", 1, 2), ("d", 2, 3), ("d", 3, 99), ("e", 1, 99)]


def test_absence_and_coverage(spark):
    docs = spark.createDataFrame([(1, "forest-fire risk"), (2, "Forest fire and flood"), (3, None)], "id long, text string")
    topics = ["forest fire", "flood", "landslide"]
    assert rows(ev.absence_matrix(docs, "text", topics), "topic", "n_records", "is_answer") == [("flood", 1, False), ("forest fire", 2, False), ("landslide", 0, True)]
    report = ev.coverage_report(ev.map_statuses(docs, "id", "text", topics))
    assert rows(report, "topic", "n_found", "n_none", "coverage") == [("flood", 1, 1, 66.67), ("forest fire", 2, 0, 66.67), ("landslide", 0, 2, 66.67)]


def test_status_merge(spark):
    a = spark.createDataFrame([(1, "uncertain"), (2, "evidence_found")], "id long, status string")
    b = spark.createDataFrame([(1, "no_evidence"), (2, "no_evidence"), (3, "parse_failed")], "id long, status string")
    assert rows(rel.merge_by_priority(a, b, "id", "status", ev.STATUSES), "id", "status") == [(1, "no_evidence"), (2, "evidence_found"), (3, "parse_failed")]


def test_tercile_quotas(spark):
    df = spark.createDataFrame([(k, k // 5, 1) for k in range(15)], "k int, third int, score int")
    assert [k for k, in rows(ev.tercile_selection(df, "third", "score", "k"), "k")] == [0, 1, 2, 5, 6, 7, 10, 11]


def test_modal_value_takes_the_least_of_equals(spark):
    df = spark.createDataFrame([("f", "x"), ("f", "y"), ("g", "z")], "field string, label string")
    assert rows(rel.modal_value(df, "field", "label"), "field", "label") == [("f", "x"), ("g", "z")]


def test_fills_and_spans_in_blocks(spark):
    """A key read block by block has the same values as in one window."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice("aab"), k, rng.choice([None, k])) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, at int, own int")
    block = F.floor(F.col("at") / 16)
    level = lambda d, c: sorted((r["at"], r[c]) for r in d.collect())
    assert level(seq.forward_fill(df, "key", ["at"], "own", "filled", block), "filled") == level(seq.forward_fill(df, "key", ["at"], "own", "filled"), "filled")
    assert level(seq.lead_spans(df, "key", ["at"], "at", F.lit(-1), block), "span_end") == level(seq.lead_spans(df, "key", ["at"], "at", F.lit(-1)), "span_end")
