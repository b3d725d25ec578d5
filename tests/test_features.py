"""The specification, hand feeds and their features."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.features import Derived, Feature, FeatureSet, Window, safe_ratio, standard_features
from tidemark.operators import admission
from tidemark.operators.grid import Grid, Span
from tidemark.operators.pit import feature_table
from tidemark.plans.tables import Run
from tidemark.schema import TICK, micros


def tick(event, ltq=100.0, ltp=10.0, seq=0, arrival=None, symbol="X"):
    return (symbol, micros(event), micros(event if arrival is None else arrival), ltp, ltq, seq)


def feed(spark, *ticks):
    return spark.createDataFrame(list(ticks), TICK)


def features_at(spark, ticks, at, watermark=1000.0, symbol="X", arrived=False, panes=None, features=None):
    """Features of a symbol at one instant over the ticks a stream has admitted."""
    admitted = admission.admit(admission.deduplicate(ticks), watermark)
    cells = spark.range(1).select(F.lit(symbol).alias("symbol"), F.lit(0).cast("long").alias("k"), F.lit(micros(at)).alias("at_us"))
    return feature_table(admitted, cells, Span(micros(at), 0), features or standard_features(), Grid(60.0, 0.0), arrived, panes=panes).first()


def test_window_edges(spark):
    w = Window(120.0)
    edges = [880.0, 880.1, 1000.0, 1000.1]
    df = spark.createDataFrame([(micros(e),) for e in edges], "e long")
    assert [r[0] for r in df.select(w.contains(F.col("e"), F.lit(micros(1000)))).collect()] == [False, True, True, False]


def test_names_windows_and_text():
    s = standard_features()
    assert len(s.names) == 12 and s.names[0] == "ltq_avg_2m" and s.names[-1] == "ltp_range_5m"
    assert s.longest_us == micros(1200) and "longest window: 1200 s" in s.describe()
    assert [w.seconds for w in standard_features(60).windows] == [7200, 18000, 72000]


def test_unknown_aggregation():
    with pytest.raises(ValueError):
        Feature("m", "ltp", "median", Window(1))
    with pytest.raises(ValueError):
        Feature("m", "ltp", "mean")


def test_empty_row(spark):
    row = standard_features().empty_row(spark).first().asDict()
    assert {k: v for k, v in row.items() if v is not None} == {"ltq_sum_2m": 0.0, "tick_count_2m": 0.0}


def test_safe_ratio(spark):
    df = spark.createDataFrame([(5.0, None), (None, 5.0), (5.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, None, 2.0]


def test_derived_sees_earlier_ones_and_missing_inputs_are_null(spark):
    s = FeatureSet((), (Derived("twice", ("x",), lambda x: x * 2), Derived("more", ("twice", "y"), lambda t, y: F.coalesce(y, t) + 1)))
    assert s.derive(spark.createDataFrame([(2.0,)], "x double")).first().asDict() == {"x": 2.0, "twice": 4.0, "more": 5.0}


@pytest.mark.parametrize("panes", [True, False])
def test_simple_windows(spark, panes):
    r = features_at(spark, feed(spark, *(tick(1000 + i, 10.0 * i, seq=i) for i in (1, 2, 3))), 1003, panes=panes)
    assert (r.ltq_avg_2m, r.ltq_sum_2m, r.tick_count_2m) == (20.0, 60.0, 3.0)
    r = features_at(spark, feed(spark, tick(880, 999.0, seq=1), tick(950, 10.0, seq=2)), 1000, panes=panes)
    assert r.ltq_avg_2m == 10.0
    assert features_at(spark, feed(spark, tick(1000, 42.0, seq=1)), 1000, panes=panes).ltq_avg_2m == 42.0


def test_as_of_is_at_or_before_and_breaks_ties_by_seq(spark):
    assert features_at(spark, feed(spark, tick(1000, ltp=10.0, seq=1), tick(1100, ltp=99.0, seq=2)), 1050).ltp_last == 10.0
    for order in ((1, 2, 3), (3, 1, 2), (2, 3, 1)):
        ticks = feed(spark, *(tick(1000, ltp=float(s), seq=s) for s in order))
        assert features_at(spark, ticks, 1000).ltp_last == 3.0


def test_unknown_symbol_is_empty(spark):
    r = features_at(spark, feed(spark, tick(1000, seq=1)), 1000, symbol="NOPE")
    assert (r.ltp_last, r.ltq_avg_2m, r.ltq_sum_2m, r.tick_count_2m) == (None, None, 0.0, 0.0)


def test_naive_sees_what_replay_does_not(spark):
    ticks = feed(spark, tick(1000, 10.0, seq=1), tick(1010, 20.0, seq=2, arrival=9999))
    assert features_at(spark, ticks, 1020).ltq_avg_2m == 15.0
    assert features_at(spark, ticks, 1020, arrived=True).ltq_avg_2m == 10.0


@pytest.mark.parametrize("panes", [True, False])
def test_arrival_at_the_instant_is_visible(spark, panes):
    ticks = feed(spark, tick(1000, 10.0, seq=1, arrival=1060), tick(1000, 30.0, seq=2, arrival=1060.000001))
    r = features_at(spark, ticks, 1060, arrived=True, panes=panes)
    assert (r.tick_count_2m, r.ltq_avg_2m) == (1.0, 10.0)


def test_null_measures(spark):
    r = features_at(spark, feed(spark, tick(1000, None, None, seq=1), tick(1001, 4.0, 2.0, seq=2)), 1001)
    assert (r.tick_count_2m, r.ltq_avg_2m, r.ltp_max_5m) == (1.0, 4.0, 2.0)
    r = features_at(spark, feed(spark, tick(1000, None, None, seq=1)), 1001)
    assert (r.tick_count_2m, r.ltq_sum_2m, r.ltq_avg_2m, r.ltp_last) == (0.0, 0.0, None, None)


# --- admission


def verdicts(spark, watermark, *ticks):
    found = admission.verdicts(feed(spark, *ticks), watermark).orderBy("arrival_us", "seq").collect()
    return [r.verdict for r in found], admission.stream_stats(feed(spark, *ticks), watermark).first()


def test_duplicates(spark):
    v, s = verdicts(spark, 1000, tick(1000, seq=7), tick(1000, seq=7, arrival=1002))
    assert v == ["accepted", "duplicate"] and (s.seen, s.duplicates, s.accepted) == (2, 1, 1)


def test_late_drop_keep_and_the_inclusive_edge(spark):
    late = tick(900, seq=2, arrival=1001)
    v, s = verdicts(spark, 30, tick(1000, seq=1), late)
    assert v == ["accepted", "late"] and s.dropped_late == 1
    v, s = verdicts(spark, 200, tick(1000, seq=1), late)
    assert v == ["accepted", "accepted"] and s.out_of_order == 1
    assert verdicts(spark, 100, tick(1000, seq=1), late)[0] == ["accepted", "late"]
    assert verdicts(spark, 100.000001, tick(1000, seq=1), late)[0] == ["accepted", "accepted"]


def test_watermark_is_global_and_starts_with_nothing(spark):
    v, _ = verdicts(spark, 30, tick(1000, seq=1), tick(900, seq=1, arrival=1001, symbol="Y"))
    assert v == ["accepted", "late"]
    assert verdicts(spark, 0, tick(-5, seq=1), tick(-4, seq=2))[0] == ["accepted", "accepted"]


def test_redelivery_of_a_dropped_tick_is_a_duplicate(spark):
    v, _ = verdicts(spark, 30, tick(1000, seq=1), tick(900, seq=2, arrival=1001), tick(900, seq=2, arrival=1002))
    assert v == ["accepted", "late", "duplicate"]


def test_first_delivery_survives(spark):
    (row,) = admission.deduplicate(feed(spark, tick(100, seq=1, arrival=105), tick(100, seq=1, arrival=100))).collect()
    assert row.arrival_us == micros(100)


def test_running_maximum_does_not_depend_on_its_buckets(spark):
    import random

    rnd = random.Random(1)
    ticks = [tick(1000 + i - rnd.choice([0, 0, rnd.random() * 300]), seq=i, arrival=1000 + i + rnd.random(), symbol=rnd.choice("XYZ")) for i in range(400)]
    want, most = {}, None
    for t in sorted(ticks, key=lambda t: (t[2], t[5], t[0])):
        want[t[5]] = most
        most = t[1] if most is None else max(most, t[1])
    for bucket in (1.0, 37.0, 1e6):
        got = {r.seq: r.prev_max_us for r in admission.with_previous_max(feed(spark, *ticks), bucket).collect()}
        assert got == want


# --- grids


def test_grid_after_warm_up_to_the_last_event(spark):
    ticks = feed(spark, tick(0, seq=1), tick(100, seq=2, symbol="Y"), tick(65, seq=3))
    grid = Grid(30.0, 10.0)
    span = grid.span(ticks)
    assert [r.at_us for r in grid.instants(spark, span).orderBy("k").collect()] == [micros(t) for t in (10, 40, 70, 100)]
    assert grid.of_symbols(ticks, span).count() == 8
    assert Grid(30.0, 101.0).span(ticks) == Grid().span(feed(spark)) == Span()
    assert grid.instants(spark, Span()).count() == grid.of_symbols(ticks, Span()).count() == 0


def test_empty_feed_and_empty_grid(spark):
    for ticks in (feed(spark), feed(spark, tick(1000, seq=1))):
        run = Run(ticks, grid=Grid(30.0, 1200.0))
        assert run.naive().count() == run.replay().count() == run.streaming().count() == 0
