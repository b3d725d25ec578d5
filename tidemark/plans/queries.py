"""Registered queries over `events` as a tick feed, each with its SQL twin in `plans.oracle` where SQL can state it.

The feed spans a month, so windows are stretched from minutes to hours.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import safe_ratio, standard_features
from ..operators import admission, parity, records, statistics
from ..operators.grid import Grid
from ..schema import MICROS, TICK_COLUMNS, lateness_us, micros
from ..session import shared_folder
from ..sources import codec, store, transport
from ..sources.events import events_feed
from ..sources.generator import NOISY, START_S, generate
from ..streaming import engine
from .tables import Run

UNIT = 60.0
STEP_S, WARMUP_S, WATERMARK_S = 600.0, 1200.0 * UNIT, 1800.0
SWEEP = (0.0, 900.0, 1800.0, 3600.0, 5400.0, 7200.0)
#: Seconds whose shifted windows and range frames are shown; and window edges, as seconds before an instant.
HOPPING_S, HOP_S, FRAME_S = 7200, 1800, 7200
EDGES = (0, 1, 7199, 7200, 7201)


def _run(spark: SparkSession, sf_dir: str, step_s: float = STEP_S, panes: bool | None = None) -> Run:
    return Run(events_feed(spark, sf_dir), WATERMARK_S, Grid(step_s, WARMUP_S), standard_features(UNIT), panes)


#: What every law of the generator says; the tables of the record engine.
LAWS = ("in_session", "measures_whole", "lateness_bounded", "late_rate", "disorder_rate", "seqs_whole", "mean_gap", "duplicate_rate", "event_order", "same_again")


def _rounded(table: DataFrame, names: list[str]) -> DataFrame:
    """Quotients at six decimals, as the comparison hashes values."""
    return table.withColumns({n: F.round(n, 6) for n in names})


def ticks_from_events(spark, sf_dir):
    return events_feed(spark, sf_dir)


def tick_lateness(spark, sf_dir):
    ticks = events_feed(spark, sf_dir)
    return ticks.select("symbol", "seq", "arrival_us", lateness_us().alias("lateness_us"))


def dedup_first_wins(spark, sf_dir):
    return admission.deduplicate(events_feed(spark, sf_dir))


def event_order(spark, sf_dir):
    """The place of each deduplicated tick of a symbol by event time, then seq: that in its bucket, and the ticks of buckets before."""
    ticks = events_feed(spark, sf_dir)
    named = admission.in_buckets(admission.deduplicate(ticks), "event_us", ("symbol",), of=ticks)
    earlier = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = named.groupBy("symbol", "_bucket").agg(F.count("*").alias("_n")).select("symbol", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("symbol", "_bucket").orderBy("event_us", "seq"))
    return named.withColumn("_within", inside).join(heads, ["symbol", "_bucket"]).select("symbol", "seq", "event_us", (F.col("_before") + F.col("_within")).cast("long").alias("place"))


def distinct_symbols(spark, sf_dir):
    return events_feed(spark, sf_dir).select("symbol").distinct()


def distinct_keys(spark, sf_dir):
    return events_feed(spark, sf_dir).select("symbol", "seq").distinct()


def redelivered_keys(spark, sf_dir):
    return admission.redelivered(events_feed(spark, sf_dir))


def feed_statistics(spark, sf_dir):
    row = statistics.feed_statistics(events_feed(spark, sf_dir))
    return _rounded(row, [c for c in row.columns if c.endswith(("_s", "_pct", "_minutes"))])


def out_of_order_pairs(spark, sf_dir):
    ticks = events_feed(spark, sf_dir)
    return statistics.inversions(admission.deduplicate(ticks), of=ticks).select("symbol", "seq", "event_us", "arrival_us")


def lateness_exact_rank(spark, sf_dir):
    unique = admission.deduplicate(events_feed(spark, sf_dir))
    return statistics.ranked(unique.select(lateness_us().alias("late")), "late", {"p99_us": statistics.P99, "median_us": statistics.MEDIAN})


def eval_grid(spark, sf_dir):
    run = _run(spark, sf_dir)
    return run.grid.instants(spark, run.span)


def symbol_grid(spark, sf_dir):
    return _run(spark, sf_dir).cells


def _features(names: tuple[str, ...], spark, sf_dir):
    run = _run(spark, sf_dir)
    run.features = run.features.only(*names)
    return _rounded(run.naive(), [n for n in run.features.names if "avg" in n])


def _table(kind: str, spark, sf_dir):
    run = _run(spark, sf_dir)
    return _rounded(getattr(run, kind)(), run.features.names)


def replay_by_range_join(spark, sf_dir):
    """The replay by the range join on time buckets, which windows of any length can use."""
    run = _run(spark, sf_dir, panes=False)
    return _rounded(run.replay(), run.features.names)


def odd_windows(spark, sf_dir):
    """Windows that are no whole number of steps of the grid."""
    run = Run(events_feed(spark, sf_dir), WATERMARK_S, Grid(7 * 3600.0, WARMUP_S), standard_features(UNIT))
    return _rounded(run.replay(), run.features.names)


def derived_features(spark, sf_dir):
    """Derived features over features that may be null or zero."""
    run = _run(spark, sf_dir)
    table = run.replay().select("symbol", "at_us", "ltq_avg_2m", "ltq_avg_5m", "ltp_max_5m", "ltp_min_5m")
    ratio, spread = safe_ratio(F.col("ltq_avg_2m"), F.col("ltq_avg_5m")), F.col("ltp_max_5m") - F.col("ltp_min_5m")
    zero = safe_ratio(F.col("ltq_avg_2m"), F.col("ltq_avg_5m") - F.col("ltq_avg_5m"))
    return table.select("symbol", "at_us", F.round(ratio, 6).alias("ratio"), F.round(spread, 6).alias("spread"), zero.alias("over_zero"))


def empty_rows(spark, sf_dir):
    return standard_features(UNIT).empty_row(spark)


def window_shifted_hopping(spark, sf_dir):
    """Hopping windows whose edges are (end - w, end]: aligned windows over times one microsecond earlier."""
    unique = admission.deduplicate(events_feed(spark, sf_dir))
    ts = F.timestamp_micros(F.col("event_us") - 1)
    hop = F.window(ts, f"{HOPPING_S} seconds", f"{HOP_S} seconds")
    found = unique.groupBy("symbol", hop.alias("w")).agg(F.count("*").alias("ticks"), F.sum("ltq").alias("ltq_sum"))
    return found.select("symbol", F.unix_micros("w.end").alias("end_us"), "ticks", "ltq_sum")


def range_frame_left_open(spark, sf_dir):
    """Per tick, the ticks of its symbol in the two hours up to it, the left edge left out. Frames stay within stretches of time as long as
    they are; each tick is also seen by the next stretch."""
    unique = admission.deduplicate(events_feed(spark, sf_dir)).select("symbol", "seq", "event_us", "ltq")
    stretch = F.floor(F.col("event_us") / micros(FRAME_S)).cast("long")
    seen = unique.select("*", F.posexplode(F.array(stretch, stretch + 1)).alias("_copy", "_stretch"))
    frame = Window.partitionBy("symbol", "_stretch").orderBy("event_us").rangeBetween(1 - micros(FRAME_S), 0)
    framed = seen.select("symbol", "seq", "_copy", F.count("*").over(frame).alias("ticks"), F.sum("ltq").over(frame).alias("ltq_sum"))
    return framed.filter("_copy = 0").drop("_copy")


def boundary_edges(spark, sf_dir):
    """Whether instants at and around a window's edges are inside, counted over the feed's ticks."""
    unique = admission.deduplicate(events_feed(spark, sf_dir))
    window = standard_features(UNIT).windows[0]
    ends = unique.select("event_us", F.explode(F.array(*(F.lit(e) for e in EDGES))).alias("seconds_before"))
    end = F.col("event_us") + F.col("seconds_before").cast("long") * 1_000_000
    return ends.groupBy("seconds_before").agg(F.count_if(window.contains(F.col("event_us"), end)).alias("inside"), F.count("*").alias("ticks"))


def admission_verdicts(spark, sf_dir):
    return admission.verdicts(events_feed(spark, sf_dir), WATERMARK_S).select("symbol", "seq", "arrival_us", "verdict", "out_of_order")


def stream_stats(spark, sf_dir):
    return admission.stream_stats(events_feed(spark, sf_dir), WATERMARK_S)


def watermark_sweep(spark, sf_dir):
    return _rounded(parity.watermark_sweep(_run(spark, sf_dir), SWEEP), ["dropped_pct", "worst_feature_rate_pct"])


def boundary_law(spark, sf_dir):
    return parity.boundary(_run(spark, sf_dir), list(SWEEP))


def exact_watermark(spark, sf_dir):
    return admission.least_exact_watermark_us(admission.deduplicate(events_feed(spark, sf_dir)))


def _compared(per_feature: DataFrame) -> DataFrame:
    return _rounded(per_feature.select("name", "compared", "disagreements", "presence_mismatch", "max_abs", "max_rel", "rate"), ["max_abs", "max_rel", "rate"])


def parity_skew(spark, sf_dir):
    return _compared(parity.skew(_run(spark, sf_dir)))


def parity_correctness(spark, sf_dir):
    return _compared(parity.correctness(_run(spark, sf_dir)))


def parity_retrospective(spark, sf_dir):
    """Retrospective against replay: reading today's store for yesterday's instants."""
    run = _run(spark, sf_dir)
    return _compared(parity.compare(run.retrospective(), run.replay(), run.features.names, parity.SKEW_TOLERANCE))


def parity_worst(spark, sf_dir):
    """Features by falling rate of disagreement, with their place."""
    per = parity.skew(_run(spark, sf_dir))
    place = F.row_number().over(Window.orderBy(F.desc("rate"), "ordinal")).cast("long")  # a row per feature
    return per.select("name", F.round("rate", 6).alias("rate"), place.alias("place"))


def parity_report(spark, sf_dir):
    return _rounded(parity.report(parity.skew(_run(spark, sf_dir))), ["worst_rate"])


def unmatched_cells(spark, sf_dir):
    run = _run(spark, sf_dir)
    return parity.unmatched(run.streaming(), run.naive())


def lost_keys_anti(spark, sf_dir):
    """Keys that a watermark of zero loses."""
    ticks = events_feed(spark, sf_dir)
    return transport.lost_keys(ticks, admission.admit(admission.deduplicate(ticks), 0.0))


def union_feeds(spark, sf_dir):
    """On-time and late deliveries as two feeds, brought together; counted per symbol."""
    ticks = events_feed(spark, sf_dir)
    feeds = ticks.filter(lateness_us() == 0).unionByName(ticks.filter(lateness_us() > 0))
    return feeds.groupBy("symbol").agg(F.count("*").alias("ticks"), F.sum("ltq").alias("ltq_sum"), F.min("arrival_us").alias("first_us"), F.max("arrival_us").alias("last_us"))


def symbols_per_partition(spark, sf_dir):
    ticks = events_feed(spark, sf_dir)
    received = transport.round_trip(ticks, transport.Folder(shared_folder(spark, "folder")))
    return transport.partitions_of_symbols(received)


def transport_reorder(spark, sf_dir):
    """Symbols whose records the transport returned out of arrival order: none, as a key keeps to one partition."""
    received = transport.round_trip(events_feed(spark, sf_dir), transport.Folder(shared_folder(spark, "folder")))
    turned = statistics.inversions(received, "arrival_us", ("symbol", "partition"), ("offset",)).groupBy("symbol").agg(F.count("*").alias("_n"))
    return received.select("symbol").distinct().join(turned, "symbol", "left").select("symbol", F.coalesce("_n", F.lit(0)).alias("reordered"))


def tick_json_roundtrip(spark, sf_dir):
    return codec.from_records(codec.to_records(events_feed(spark, sf_dir)))


def store_roundtrip(spark, sf_dir):
    run = _run(spark, sf_dir)
    path = shared_folder(spark, "store")
    store.write_lines(run.naive(), path)
    return _rounded(store.read_lines(spark, path, store.feature_schema(run.features)), run.features.names)


def stream_dedup_late(spark, sf_dir):
    """Structured Streaming's own watermark and deduplication over the feed, drained."""
    return engine.native_counts(events_feed(spark, sf_dir), shared_folder(spark, "native"), WATERMARK_S)


def stream_features_exact(spark, sf_dir):
    """The streaming table from micro-batches that carry the exact per-record watermark."""
    run = _run(spark, sf_dir)
    ticks = engine.admit_stream(run.ticks, shared_folder(spark, "exact"), WATERMARK_S)
    return _rounded(engine.served(run, ticks), run.features.names)


def delivered_features(spark, sf_dir):
    """The naive table with every delivery counted: the deduplication switched off."""
    run = Run(events_feed(spark, sf_dir), WATERMARK_S, Grid(STEP_S, WARMUP_S), standard_features(UNIT), deduplicated=False)
    return _rounded(run.naive(), run.features.names)


def stream_delivered(spark, sf_dir):
    """Ticks per symbol that the exact stream admits with deduplication switched off."""
    ticks = engine.admit_stream(events_feed(spark, sf_dir), shared_folder(spark, "delivered"), WATERMARK_S, deduplicated=False)
    return ticks.groupBy("symbol").agg(F.count("*").alias("ticks"))


def stream_retained(spark, sf_dir):
    """The keys of admitted ticks that the exact stream still holds at the feed's end: those its longest window can need."""
    keep = engine.default_retention_s(standard_features(UNIT), WATERMARK_S)
    return engine.admit_stream(events_feed(spark, sf_dir), shared_folder(spark, "retained"), WATERMARK_S, retain_s=keep).select("symbol", "seq")


def generator_laws(spark, sf_dir):
    """What holds for every generated feed, by symbol: ticks in the session and in event order by seq, measures above zero, prices in
    cents, arrivals at or after events, rates near the profile's, redeliveries of what was sent, the same feed for the same seed."""
    symbols, minutes, start_us = ["IDEA", "YESBANK", "PNB", "SUZLON"], 60.0, micros(START_S)
    feed = generate(spark, symbols, minutes, NOISY, 3)
    unique = admission.deduplicate(feed)
    again = generate(spark, symbols[:2], minutes, NOISY, 3).select("symbol", F.shiftright(F.xxhash64(*TICK_COLUMNS), 20).alias("h")).groupBy("symbol").agg(F.sum("h").alias("h"))
    same = feed.select("symbol", F.shiftright(F.xxhash64(*TICK_COLUMNS), 20).alias("h")).groupBy("symbol").agg(F.sum("h").alias("first")).join(again, "symbol", "left")
    turned = statistics.inversions(unique, "event_us", ("symbol",), ("seq",)).groupBy("symbol").agg(F.count("*").alias("turned"))
    late, near = lateness_us(), lambda share, rate: F.abs(share - rate) < 0.02
    share = lambda c: F.avg(c.cast("double"))
    per = unique.groupBy("symbol").agg(
        F.bool_and((F.col("event_us") > start_us) & (F.col("event_us") <= start_us + micros(minutes * 60))).alias("in_session"),
        F.bool_and((F.col("ltp") >= 0.05) & (F.col("ltq") >= 1) & (F.round("ltp", 2) == F.col("ltp")) & (F.floor("ltq") == F.col("ltq"))).alias("measures_whole"),
        F.bool_and((late >= 0) & (late <= micros(NOISY.max_lateness_s))).alias("lateness_bounded"),
        near(share(late >= MICROS), NOISY.late_rate).alias("late_rate"),
        near(share((late > 0) & (late < MICROS)), NOISY.out_of_order_rate * (1 - NOISY.late_rate)).alias("disorder_rate"),
        (F.count("*") == F.max("seq") + 1).alias("seqs_whole"),
        (F.abs(F.count("*") * NOISY.mean_gap_s / (minutes * 60) - 1) < 0.1).alias("mean_gap"),
        F.count("*").alias("_unique"),
    )
    sent = feed.groupBy("symbol").agg(F.count("*").alias("_sent"))
    out = per.join(sent, "symbol").join(same, "symbol").join(turned, "symbol", "left")
    return out.select(
        "symbol", "in_session", "measures_whole", "lateness_bounded", "late_rate", "disorder_rate", "seqs_whole", "mean_gap",
        near(F.col("_sent") / F.col("_unique") - 1, NOISY.duplicate_rate).alias("duplicate_rate"),
        F.coalesce(F.col("turned") == 0, F.lit(True)).alias("event_order"), F.coalesce(F.col("first") == F.col("h"), F.lit(True)).alias("same_again"),
    )


def record_engine(spark, sf_dir):
    """Every table of a half-hour feed against plain Python, record by record: cells that disagree, by table and feature."""
    run = Run(generate(spark, ["IDEA", "PNB"], 30.0, NOISY, 0).persist(), 45.0, Grid(60.0))
    found = [records.against_records(run, kind).select(F.lit(kind).alias("table"), "name", (F.col("compared") > 0).alias("compared"), "disagreements") for kind in records.TABLES]
    return reduce(DataFrame.unionByName, found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ticks_from_events, tick_lateness, dedup_first_wins, event_order, distinct_symbols, distinct_keys, redelivered_keys, feed_statistics, out_of_order_pairs,
        lateness_exact_rank, eval_grid, symbol_grid, replay_by_range_join, odd_windows, derived_features, empty_rows, window_shifted_hopping, range_frame_left_open,
        boundary_edges, admission_verdicts, stream_stats, watermark_sweep, boundary_law, exact_watermark, parity_skew, parity_correctness, parity_retrospective,
        parity_worst, parity_report, unmatched_cells, lost_keys_anti, union_feeds, symbols_per_partition, transport_reorder, tick_json_roundtrip, store_roundtrip,
        stream_dedup_late, stream_features_exact, delivered_features, stream_delivered, stream_retained, generator_laws, record_engine,
    )
} | {
    "feat_avg": partial(_features, ("ltq_avg_2m", "ltq_avg_5m", "ltq_avg_20m", "ltp_avg_5m")),
    "feat_sum_zero": partial(_features, ("ltq_sum_2m",)),
    "feat_count_zero": partial(_features, ("tick_count_2m",)),
    "feat_max_min": partial(_features, ("ltp_max_5m", "ltp_min_5m")),
    "feat_last_asof": partial(_features, ("ltp_last",)),
    "naive_features": partial(_table, "naive"),
    "replay_features": partial(_table, "replay"),
    "streaming_features": partial(_table, "streaming"),
    "retrospective_features": partial(_table, "retrospective"),
}
