"""Generated feeds, the laws that relate the tables, statistics, comparison, stores, transport, streaming, commands."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark import cli, session
from tidemark.functions.features import standard_features
from tidemark.operators import admission, parity, records, statistics
from tidemark.operators.grid import Grid
from tidemark.plans.tables import Run
from tidemark.schema import TICK, TICK_COLUMNS, lateness_us
from tidemark.session import shared_folder
from tidemark.sources import codec, store, transport
from tidemark.sources.generator import NOISY, START_S, Profile, generate
from tidemark.streaming import engine

NAMES = standard_features().names


@pytest.fixture(scope="module")
def noisy(spark):
    ticks = generate(spark, ["IDEA"], 40, NOISY, 0).persist()
    worst = admission.deduplicate(ticks).agg(F.max(lateness_us())).first()[0] / 1e6
    return ticks, worst


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- generator


def test_same_seed_same_feed_in_any_partitioning(spark):
    one = rows(generate(spark, ["IDEA"], 5, seed=1))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = rows(generate(spark, ["IDEA"], 5, seed=1))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == again and one != rows(generate(spark, ["IDEA"], 5, seed=2))


def test_symbols_are_independent(spark):
    alone = rows(generate(spark, ["PNB"], 5, seed=1))
    assert alone == rows(generate(spark, ["IDEA", "PNB"], 5, seed=1).filter("symbol = 'PNB'"))


def test_feed_has_its_pathologies(noisy, spark):
    ticks, worst = noisy
    s = statistics.feed_statistics(ticks).first()
    assert s.duplicates > 0 and s.out_of_order > 0 and 30 < worst <= 90 and 38 < s.span_minutes <= 42
    assert 0.01 < s.duplicates / s.unique < 0.06 and s.median_lateness_s == 0 and s.p99_lateness_s > 30
    arrivals = [r.arrival_us for r in ticks.collect()]
    assert arrivals == sorted(arrivals)
    checked = ticks.agg(F.min("ltp"), F.min("ltq"), F.max(F.abs(F.col("ltp") - F.round("ltp", 2))), F.min("event_us")).first()
    assert checked[0] >= 0.05 and checked[1] >= 1 and checked[2] == 0 and checked[3] >= START_S * 1e6
    assert generate(spark, ["IDEA"], 3, Profile(0, 0, 0, 0)).filter(lateness_us() != 0).count() == 0


# --- laws


def test_streaming_equals_replay_where_the_watermark_covers_lateness(noisy):
    ticks, worst = noisy
    report = parity.report(parity.correctness(Run(ticks, worst + 1, Grid(60.0)))).first()
    assert report.agree and report.features == 12 and report.rows_compared > 10


def test_the_exact_threshold(noisy):
    ticks, worst = noisy
    run = Run(ticks)
    threshold = admission.least_exact_watermark_us(run.unique).first().threshold_us / 1e6
    assert threshold <= worst
    drops = {r.watermark_us: r.dropped for r in parity.drops_by_watermark(run, [threshold, threshold + 0.000001]).collect()}
    assert sorted(drops.values()) == [0, 1]


def test_short_watermark_breaks_parity_and_skew_needs_no_drop(noisy):
    ticks, worst = noisy
    assert not parity.report(parity.correctness(Run(ticks, worst - 30, Grid(60.0)))).first().agree
    covering = Run(ticks, worst + 1, Grid(60.0))
    assert admission.stream_stats(ticks, worst + 1).first().dropped_late == 0
    assert not parity.report(parity.skew(covering)).first().agree


def test_retrospective_differs_from_replay(noisy):
    ticks, _ = noisy
    run = Run(ticks, 1000.0, Grid(60.0))
    assert rows(run.retrospective()) == rows(run.naive()) != rows(run.replay())


def test_several_symbols_and_the_late_starter(spark):
    ticks = generate(spark, ["IDEA", "PNB", "SUZLON"], 30, seed=0)
    late = ticks.filter("symbol <> 'PNB'").unionByName(ticks.filter(f"symbol = 'PNB' AND event_us > {int((START_S + 1500) * 1e6)}"))
    run = Run(late, 1000.0, Grid(60.0))
    assert parity.report(parity.correctness(run)).first().agree
    counts = {r.symbol: r["count"] for r in run.streaming().groupBy("symbol").count().collect()}
    assert 0 < counts["PNB"] < counts["IDEA"] == counts["SUZLON"]
    lost = parity.unmatched(run.streaming(), run.naive()).first()
    assert lost.left_only == 0 and lost.right_only == counts["IDEA"] - counts["PNB"]


def test_panes_and_range_joins_agree(noisy):
    ticks, _ = noisy
    for kind in ("naive", "replay", "streaming"):
        a, b = (rows(getattr(Run(ticks, 45.0, Grid(60.0), panes=p), kind)()) for p in (True, False))
        assert a == b and len(a) > 10


def test_input_order_and_partitions_do_not_matter(noisy):
    ticks, _ = noisy
    assert rows(Run(ticks.repartition(7, "ltp"), 45.0, Grid(60.0)).streaming()) == rows(Run(ticks, 45.0, Grid(60.0)).streaming())


def test_sweep_falls_and_boundary_is_found(noisy):
    ticks, worst = noisy
    run = Run(ticks, 45.0, Grid(120.0))
    sweep = parity.watermark_sweep(run).orderBy("watermark_s").collect()
    drops = [r.dropped for r in sweep]
    assert drops == sorted(drops, reverse=True) and drops[0] > 0 and [r.latency_s for r in sweep] == list(parity.SWEEP)
    for r in sweep:
        alone = Run(ticks, r.watermark_s, Grid(120.0))
        per = parity.report(parity.skew(alone)).first()
        assert (per.features_disagreeing, per.worst_rate * 100) == (r.features_disagreeing, pytest.approx(r.worst_feature_rate_pct))
        assert admission.stream_stats(ticks, r.watermark_s).first().dropped_late == r.dropped
    found = {r.watermark_s: r.exact for r in parity.boundary(run, [0.0, round(worst + 1, 1)]).collect()}
    assert found == {0.0: False, round(worst + 1, 1): True}


# --- comparison


def cells(spark, values):
    return spark.createDataFrame([("X", i, v) for i, v in enumerate(values)], "symbol string, at_us long, f double")


def test_compare_rules(spark):
    left, right = cells(spark, [1.0, None, 2.0, None, 5.0, 3.0]), cells(spark, [1.0, None, None, 4.0, 4.0, 0.0])
    r = parity.compare(left, right, ["f"], 0.0).first()
    assert (r.compared, r.disagreements, r.presence_mismatch, r.max_abs, r.max_rel, r.rate) == (6, 4, 2, 3.0, float("inf"), 4 / 6)
    assert r.worst_example.at_us == 5 and parity.compare(left, right, ["f"], 3.0).first().disagreements == 2


def test_of_equal_differences_the_earliest_counts(spark):
    r = parity.compare(cells(spark, [2.0, 4.0]), cells(spark, [1.0, 3.0]), ["f"], 0.0).first()
    assert (r.max_abs, r.max_rel, r.worst_example.at_us) == (1.0, 1.0, 0)


def test_no_rows_is_no_agreement(spark):
    empty = cells(spark, [1.0]).limit(0)
    assert not parity.report(parity.compare(empty, empty, ["f"], 0.0)).first().agree


# --- statistics


def test_exact_ranks(spark):
    at = lambda v: tuple(statistics.ranked(spark.createDataFrame([(x,) for x in v], "v long"), "v", {"p99": statistics.P99, "median": statistics.MEDIAN}).first())
    wide = lambda w: tuple(statistics.ranked(spark.range(-500, 700).select((F.col("id") * 7 % 1200).alias("v")), "v", {"p99": statistics.P99, "median": statistics.MEDIAN}, w).first())
    ordered = sorted(int(math.fmod(i * 7, 1200)) for i in range(-500, 700))
    assert wide(1) == wide(13) == wide(10**6) == (ordered[int(1200 * 0.99) - 1], ordered[600])
    assert at(range(10)) == (8, 5) and at([7]) == (7, 7) and at([1, 1, 1, 2]) == (1, 1) and at([]) == (None, None)


def test_inversions_do_not_depend_on_buckets(noisy):
    ticks, _ = noisy
    unique = admission.deduplicate(ticks)
    counts = {statistics.inversions(unique, bucket_s=b).count() for b in (1.0, 60.0, 1e6)}
    ordered = [r.event_us for r in unique.orderBy("arrival_us", "seq", "symbol").collect()]
    assert counts == {sum(b < a for a, b in zip(ordered, ordered[1:], strict=False))}


def test_empty_feed_has_no_statistics(spark):
    assert statistics.feed_statistics(spark.createDataFrame([], TICK)).count() == 0


# --- stores and transport


def test_stores(noisy, spark):
    ticks, _ = noisy
    run = Run(ticks, 45.0, Grid(300.0))
    schema, table = store.feature_schema(run.features), run.naive()
    lines, columns = shared_folder(spark, "lines"), shared_folder(spark, "columns")
    store.write_lines(table, lines)
    store.write_columns(table, columns)
    assert rows(store.read_lines(spark, lines, schema)) == rows(store.read_columns(spark, columns, schema)) == rows(table)
    text = spark.read.text(lines).first()[0]
    assert "\r" not in text and text.startswith("{")


def test_records(spark):
    raw = [b'{"symbol": "A", "event_time": 1700000000.123456, "ltp": 1.5, "ltq": 2}', b'{"symbol": "B", "event_time": 5, "arrival_time": 6.5, "ltp": 1, "ltq": 2, "seq": 9}']
    got = rows(codec.from_records(spark.createDataFrame([(bytearray(b),) for b in raw], "value binary")))
    assert got == [("A", 1700000000123456, 1700000000123456, 1.5, 2.0, 0), ("B", 5_000_000, 6_500_000, 1.0, 2.0, 9)]


def test_transport_keeps_all_ticks_and_a_symbol_to_a_partition(spark):
    ticks = generate(spark, ["IDEA", "YESBANK", "PNB"], 25, Profile(0.12, 0.06, 45.0, 0.03), 0).persist()
    folder = transport.Folder(shared_folder(spark, "folder"))
    assert folder.ensure(spark) and not folder.ensure(spark)
    got = transport.round_trip(ticks, folder)
    assert rows(transport.strip(got)) == rows(ticks) and transport.lost_keys(ticks, got).count() == 0
    assert {r.partitions for r in transport.partitions_of_symbols(got).collect()} == {1}
    assert statistics.inversions(got, "arrival_us", ("symbol",), ("offset",), 1e12).count() == 0
    a, b = (rows(Run(t, 45.0, Grid(60.0)).streaming()) for t in (ticks, transport.strip(got)))
    assert a == b and len(a) > 3
    assert transport.lost_keys(ticks, got.limit(5)).count() == ticks.select("symbol", "seq").distinct().count() - got.limit(5).select("symbol", "seq").distinct().count()


def test_kafka_says_what_it_needs(spark):
    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        transport.Kafka().read(spark)
    assert dict(transport.Kafka().producer)["kafka.acks"] == "all"


# --- streaming


def test_exact_stream_equals_the_batch_table(noisy, spark):
    ticks, _ = noisy
    run = Run(ticks, 45.0, Grid(60.0))
    for batches in (1, 5):
        admitted = engine.admit_stream(ticks, shared_folder(spark, "exact"), 45.0, batches)
        assert rows(admitted) == rows(run.admitted().select(*TICK_COLUMNS))
    assert rows(engine.served(run, admitted)) == rows(run.streaming())


def test_a_batch_that_runs_again_changes_nothing(noisy, spark):
    ticks, _ = noisy
    folder, sink = shared_folder(spark, "again"), None
    sink = engine.exact_sink(folder, 45.0)
    middle = ticks.agg(F.expr("percentile(arrival_us, 0.5)")).first()[0]
    one, two = ticks.filter(F.col("arrival_us") <= middle), ticks.filter(F.col("arrival_us") > middle)
    for batch_id, batch in ((0, one), (0, one), (1, two), (1, two)):
        sink(batch, batch_id)
    admitted = spark.read.schema(TICK).parquet(f"{folder}/admitted").select(*TICK_COLUMNS)
    assert rows(admitted) == rows(Run(ticks, 45.0).admitted().select(*TICK_COLUMNS))


def test_state_is_bounded_and_retention_lets_go_of_what_no_window_needs(noisy, spark):
    ticks, _ = noisy
    keep = engine.default_retention_s(standard_features(), 45.0)
    assert keep > 1200 + 45
    folder = shared_folder(spark, "retained")
    left = engine.admit_stream(ticks, folder, 45.0, 12, retain_s=keep)
    admitted = Run(ticks, 45.0).admitted()
    now = ticks.agg(F.max("event_us")).first()[0]
    assert rows(left) == rows(admitted.filter(F.col("event_us") > now - keep * 1e6).select(*TICK_COLUMNS))
    assert len(engine._written(spark, f"{folder}/admitted")) < 12
    for name in ("keys", "state"):
        assert len(engine._written(spark, f"{folder}/{name}")) == 2
    last = engine._written(spark, f"{folder}/keys")[-1]
    keys = spark.read.parquet(f"{folder}/keys/batch={last}")
    assert keys.count() < 100 and keys.filter(F.col("event_us") <= now - 45_000_000).count() == 0


def test_deduplication_can_be_switched_off(noisy, spark):
    ticks, _ = noisy
    off = Run(ticks, 1000.0, Grid(60.0), deduplicated=False)
    assert off.unique.count() == ticks.count() > Run(ticks).unique.count()
    streamed = engine.admit_stream(ticks, shared_folder(spark, "off"), 1000.0, deduplicated=False)
    assert rows(streamed) == rows(off.admitted().select(*TICK_COLUMNS))
    assert records.agrees(off, "naive") and records.agrees(off, "streaming")


def test_the_record_engine_tells_a_difference(noisy, monkeypatch):
    ticks, _ = noisy
    run = Run(ticks, 45.0, Grid(60.0))
    assert records.agrees(run, "replay")
    monkeypatch.setattr(Run, "replay", Run.naive)
    assert not records.agrees(run, "replay")


def test_one_symbol_and_one_hour_are_split(spark, monkeypatch):
    """Nearly all ticks are of one symbol and arrive in one hour; buckets stay bounded, and nothing changes."""
    monkeypatch.setattr(admission, "BUCKET_TICKS", 200)
    ticks = generate(spark, ["IDEA"], 50, NOISY, 4).unionByName(generate(spark, ["PNB"], 3, NOISY, 4))
    unique = admission.deduplicate(ticks).persist()
    held = {keys: admission.in_buckets(unique, "arrival_us", keys).groupBy(*keys, "_bucket").count().agg(F.max("count"), F.count("*")).first() for keys in ((), ("symbol",))}
    assert all(most < 230 and n >= unique.count() // 230 for most, n in held.values())
    split = {k: rows(f()) for k, f in (("verdicts", lambda: admission.verdicts(ticks, 20.0)), ("turned", lambda: statistics.inversions(unique)))}
    monkeypatch.setattr(admission, "BUCKET_TICKS", 10**9)
    assert split == {"verdicts": rows(admission.verdicts(ticks, 20.0)), "turned": rows(statistics.inversions(unique))}


def test_native_stream_drops_no_more_than_the_exact_one(noisy, spark):
    ticks, _ = noisy
    passed = engine.native_counts(ticks, shared_folder(spark, "native"), 45.0).first().ticks
    stats = admission.stream_stats(ticks, 45.0).first()
    assert stats.accepted <= passed <= stats.seen


class Stub:
    """An admin client that knows of a topic's leaders after some calls."""

    def __init__(self, topics, leaders_after, fails=None):
        self.topics, self.left, self.fails, self.made = dict.fromkeys(topics, self), leaders_after, fails, []

    def __getattr__(self, name):
        return lambda *a: self

    def get(self, *a):
        return self if a else self.topics

    def createTopics(self, topics):  # noqa: N802
        if self.fails:
            raise RuntimeError(self.fails)
        self.made += topics
        return self

    def describeTopics(self, topics):  # noqa: N802
        self.topics = {t: self for t in topics}
        self.left -= 1
        if self.left > 1:
            raise RuntimeError("UnknownTopicOrPartitionException")
        return self

    def partitions(self):
        return [self, self]

    def leader(self):
        return None if self.left > 0 else self

    def isEmpty(self):  # noqa: N802
        return False


def test_a_topic_is_made_once_and_waited_for():
    ensure = lambda admin, wait=5.0: transport.ensure_topic(admin, "ticks", lambda: "ticks", lambda x: [x], wait, 0.01)
    new = Stub([], 3)
    assert ensure(new) and new.made == ["ticks"] and new.left <= 0
    old = Stub(["ticks"], 1)
    assert not ensure(old) and not old.made
    assert not ensure(Stub([], 1, "TopicExistsException"))
    with pytest.raises(RuntimeError, match="denied"):
        ensure(Stub([], 1, "denied"))
    with pytest.raises(TimeoutError):
        ensure(Stub([], 10**9), 0.05)


def test_kafka_options_reach_reader_and_writer(spark, monkeypatch):
    """The connector isn't here: what would be asked of it is recorded."""
    monkeypatch.setattr(transport, "require_kafka", lambda spark: None)
    asked = {}

    class Asked:
        def __init__(self, way):
            self.way, self.set = way, {}
            asked[way] = self.set

        def format(self, name):
            self.set["format"] = name
            return self

        def options(self, **options):
            self.set.update(options)
            return self

        def load(self):
            return spark.createDataFrame([], "key binary, value binary, partition int, offset long")

        def save(self):
            pass

    class Fake:
        read, readStream = property(lambda s: Asked("read")), property(lambda s: Asked("stream"))

    way = transport.Kafka("broker:1", "t")
    way.read(Fake())
    way.stream(Fake(), latest=True)
    monkeypatch.setattr(type(spark.range(1)), "write", property(lambda df: Asked("write")))
    way.send(generate(spark, ["IDEA"], 1))
    assert asked["read"] == {"format": "kafka", "kafka.bootstrap.servers": "broker:1", "subscribe": "t", "startingOffsets": "earliest", "endingOffsets": "latest"}
    assert asked["stream"]["startingOffsets"] == "latest" and asked["stream"]["subscribe"] == "t"
    assert asked["write"]["topic"] == "t" and asked["write"]["kafka.acks"] == "all" and asked["write"]["format"] == "kafka"


def test_a_cluster_without_a_shared_folder_is_refused():
    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Fake, "x")


def test_what_a_process_wrote_can_be_deleted(spark):
    path = shared_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and session.clean(spark) > 0
    fs, found = session.path_of(spark, path)
    assert not fs.exists(found) and session.clean(spark) == 0


# --- commands


@pytest.mark.parametrize("command", ["spec", "feed", "sweep", "boundary", "records", "transport"])
def test_commands(spark, capsys, command):
    assert cli.main(["--minutes", "25", command], spark) == 0
    assert capsys.readouterr().out.strip()


@pytest.mark.parametrize("watermark", ["20", "95"])
def test_parity_command_fails_only_where_it_should_agree(spark, capsys, watermark):
    assert cli.main(["--minutes", "35", "--max-lateness", "90", "--watermark", watermark, "parity"], spark) == 0
    assert f"streaming equals replay: {watermark == '95'}" in capsys.readouterr().out


def test_a_missing_broker_is_told(spark, capsys):
    assert cli.main(["--minutes", "21", "transport", "--bootstrap", "localhost:1"], spark) == 2
