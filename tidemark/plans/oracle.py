"""The registered queries in DuckDB SQL, stated by plain joins and frames rather than by the engine's plans."""

from __future__ import annotations

from ..functions.features import FeatureSet, standard_features
from ..operators.parity import SKEW_TOLERANCE
from ..operators.records import TABLES
from ..schema import MEASURE_STEPS, micros
from .queries import EDGES, FRAME_S, HOP_S, HOPPING_S, LAWS, STEP_S, SWEEP, UNIT, WARMUP_S, WATERMARK_S

FEED = """
first AS (
  SELECT event_type AS symbol, epoch_us(ts) AS event_us, value AS ltp, CAST(user_id + 1 AS DOUBLE) AS ltq, event_id AS seq,
         epoch_us(ts) + CASE WHEN event_id % 25 = 0 THEN ((event_id * 7919) % 5400 + 1) * 1000000 ELSE 0 END AS arrival_us
  FROM events),
ticks AS (
  SELECT symbol, event_us, arrival_us, ltp, ltq, seq FROM first
  UNION ALL SELECT symbol, event_us, arrival_us + 1500000, ltp, ltq, seq FROM first WHERE seq % 33 = 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, seq ORDER BY arrival_us, event_us) AS nth FROM ticks),
uniq AS (SELECT symbol, event_us, arrival_us, ltp, ltq, seq FROM numbered WHERE nth = 1),
ran AS (
  SELECT *, max(event_us) OVER (ORDER BY arrival_us, seq, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM uniq),
admitted AS (
  SELECT symbol, event_us, arrival_us, ltp, ltq, seq FROM ran WHERE prev_max IS NULL OR event_us > prev_max - {wm})
""".replace("{wm}", str(micros(WATERMARK_S)))


def _grid(step_s: float) -> str:
    step, warm = micros(step_s), micros(WARMUP_S)
    return f"""
instants AS (
  SELECT k, s + k * {step} AS at_us FROM (
    SELECT s, unnest(range(0, CASE WHEN l >= s THEN (l - s) // {step} + 1 ELSE 0 END)) AS k
    FROM (SELECT min(event_us) + {warm} AS s, max(event_us) AS l FROM uniq))),
cells AS (SELECT symbol, k, at_us FROM (SELECT DISTINCT symbol FROM uniq), instants)"""


def _feature_columns(features: FeatureSet) -> tuple[str, str]:
    """(aggregates over joined ticks t at cell c, final select list)"""
    aggregates, final = [], []
    for f in features.features:
        if f.window is None:
            aggregates.append(f"arg_max(t.{f.source}, (t.event_us, t.seq)) AS {f.name}")
            final.append(f.name)
            continue
        where = f"FILTER (WHERE t.event_us > c.at_us - {f.window.us})"
        total = f"sum(CAST(round(t.{f.source} * {MEASURE_STEPS}) AS BIGINT)) {where}"
        count = f"count(t.{f.source}) {where}"
        value = {
            "mean": f"CAST({total} AS DOUBLE) / nullif(CAST({count} AS DOUBLE) * {MEASURE_STEPS}, 0)",
            "sum": f"CAST({total} AS DOUBLE) / {MEASURE_STEPS}",
            "count": f"CAST(nullif({count}, 0) AS DOUBLE)",
            "max": f"max(t.{f.source}) {where}",
            "min": f"min(t.{f.source}) {where}",
        }[f.aggregation]
        aggregates.append(f"{value if f.empty is None else f'coalesce({value}, {f.empty})'} AS {f.name}")
        final.append(f.name)
    names = {d.name for d in features.derived}
    if "ltq_ratio_2_5" in names:
        final.append("ltq_avg_2m / nullif(ltq_avg_5m, 0) AS ltq_ratio_2_5")
    if "ltq_spike_2_20" in names:
        final.append("ltq_avg_2m / nullif(ltq_avg_20m, 0) AS ltq_spike_2_20")
    if "ltp_range_5m" in names:
        final.append("ltp_max_5m - ltp_min_5m AS ltp_range_5m")
    return ", ".join(aggregates), ", ".join(final)


def _table(name: str, ticks: str, arrived: bool, features: FeatureSet | None = None, begun: bool = False, key: str = "", cells: str = "cells") -> str:
    """A CTE of the feature table over CTE `ticks`; `key` is a further key column of both sides."""
    features = features or standard_features(UNIT)
    aggregates, final = _feature_columns(features)
    more = f"c.{key}, " if key else ""
    on = f" AND t.{key} = c.{key}" if key else ""
    known = " AND t.arrival_us <= c.at_us" if arrived else ""
    # A symbol has begun once any accepted tick has arrived, whether or not its event lies before the instant.
    if begun:
        firsts = f"SELECT symbol{', ' + key if key else ''}, min(arrival_us) AS begun FROM {ticks} GROUP BY ALL"
        source = f"(SELECT c.* FROM {cells} c JOIN ({firsts}) b ON b.symbol = c.symbol{' AND b.' + key + ' = c.' + key if key else ''} WHERE c.at_us >= b.begun)"
    else:
        source = cells
    return f"""
{name} AS (
  SELECT {key + ', ' if key else ''}symbol, at_us, {final} FROM (
    SELECT {more}c.symbol, c.at_us, {aggregates}
    FROM {source} c LEFT JOIN {ticks} t ON t.symbol = c.symbol{on} AND t.event_us <= c.at_us{known}
    GROUP BY {more}c.symbol, c.at_us))"""


def _select(names: list[str], table: str, rounded: list[str]) -> str:
    return f"SELECT symbol, at_us, {', '.join(f'round({n}, 6) AS {n}' if n in rounded else n for n in names)} FROM {table}"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join([FEED, *ctes])


def _compare(left: str, right: str, tolerance: float, key: str = "") -> str:
    """CTE `per`: a row per feature (and key)."""
    names = standard_features(UNIT).names
    on = ["symbol", "at_us"] + ([key] if key else [])
    group = f"{key}, " if key else ""
    rows = " UNION ALL ".join(
        f"SELECT {group}{i} AS ordinal, '{n}' AS name, symbol, at_us, l.{n} AS lv, r.{n} AS rv FROM {left} l JOIN {right} r USING ({', '.join(on)})" for i, n in enumerate(names)
    )
    return f"""
pairs AS (
  SELECT *, (lv IS NULL) <> (rv IS NULL) AS presence, abs(lv - rv) AS diff FROM ({rows})),
marked AS (SELECT *, presence OR coalesce(NOT diff <= {tolerance!r}, false) AS wrong FROM pairs),
per AS (
  SELECT {group}ordinal, name, count(*) AS compared, count(*) FILTER (WHERE wrong) AS disagreements, count(*) FILTER (WHERE presence) AS presence_mismatch,
    coalesce(max(diff) FILTER (WHERE wrong AND NOT presence), 0.0) AS max_abs,
    coalesce(arg_min(CASE WHEN rv <> 0 THEN diff / abs(rv) ELSE CAST('inf' AS DOUBLE) END, (-diff, at_us, symbol)) FILTER (WHERE wrong AND NOT presence), 0.0) AS max_rel,
    count(*) FILTER (WHERE wrong) / count(*) AS rate
  FROM marked GROUP BY {group}ordinal, name)"""


def _watermarks() -> str:
    return "wms AS (SELECT unnest([" + ", ".join(str(micros(w)) for w in SWEEP) + "]) AS watermark_us)"


def _by_watermark(other: str, arrived: bool, tolerance: float) -> str:
    return _with(
        _grid(STEP_S),
        _watermarks(),
        "accepted AS (SELECT w.watermark_us, r.* EXCLUDE (prev_max) FROM ran r, wms w WHERE r.prev_max IS NULL OR r.event_us > r.prev_max - w.watermark_us)",
        "wcells AS (SELECT watermark_us, symbol, k, at_us FROM cells, wms)",
        _table("streams", "accepted", True, begun=True, key="watermark_us", cells="wcells"),
        _table(other, "uniq", arrived),
        f"others AS (SELECT watermark_us, o.* FROM {other} o, wms)",
        _compare("streams", "others", tolerance, "watermark_us"),
        "drops AS (SELECT watermark_us, count(*) FILTER (WHERE prev_max IS NOT NULL AND event_us <= prev_max - watermark_us) AS dropped FROM ran, wms GROUP BY watermark_us)",
    )


VERDICTS = f"""
judged AS (
  SELECT symbol, seq, event_us, arrival_us, ltp, ltq, CASE WHEN prev_max IS NOT NULL AND event_us <= prev_max - {micros(WATERMARK_S)} THEN 'late' ELSE 'accepted' END AS verdict FROM ran
  UNION ALL SELECT symbol, seq, event_us, arrival_us, ltp, ltq, 'duplicate' FROM numbered WHERE nth > 1),
verdicts AS (
  SELECT *, verdict = 'accepted' AND coalesce(event_us < max(event_us) OVER (PARTITION BY symbol, verdict ORDER BY arrival_us, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM judged)"""

_SET = standard_features(UNIT)
_ALL = _SET.names
_PER = "SELECT name, compared, disagreements, presence_mismatch, round(max_abs, 6) AS max_abs, round(max_rel, 6) AS max_rel, round(rate, 6) AS rate FROM per"


def _features(*names: str) -> str:
    chosen = _SET.only(*names)
    return _with(_grid(STEP_S), _table("t", "uniq", False, chosen)) + " " + _select(chosen.names, "t", [n for n in chosen.names if "avg" in n])


def _full(ticks: str, arrived: bool, begun: bool = False, step_s: float = STEP_S) -> str:
    return _with(_grid(step_s), _table("t", ticks, arrived, begun=begun)) + " " + _select(_ALL, "t", _ALL)


_STREAMS, _NAIVE, _REPLAY, _RETRO = (
    _table("streams", "admitted", True, begun=True), _table("naive", "uniq", False), _table("replay", "uniq", True), _table("retro", "admitted", False),
)

_DELIVERED = FEED.replace("FROM numbered WHERE nth = 1", "FROM numbered")
_ANY = standard_features(UNIT)
_RETAINED_US = _ANY.longest_us + micros(WATERMARK_S) + 60_000_000

ORACLE_SQL: dict[str, str] = {
    "delivered_features": _full("uniq", False).replace(FEED, _DELIVERED),
    "stream_delivered": f"WITH {_DELIVERED} SELECT symbol, count(*) AS ticks FROM admitted GROUP BY symbol",
    "stream_retained": f"WITH {FEED} SELECT symbol, seq FROM admitted WHERE event_us > (SELECT max(event_us) FROM uniq) - {_RETAINED_US}",
    "generator_laws": f"SELECT unnest(['IDEA', 'YESBANK', 'PNB', 'SUZLON']) AS symbol, {', '.join(f'true AS {n}' for n in LAWS)}",
    "record_engine": f"SELECT t.kind AS \"table\", n.name, true AS compared, 0 AS disagreements FROM (SELECT unnest({list(TABLES)}) AS kind) t, (SELECT unnest({_ANY.names}) AS name) n",
    "ticks_from_events": _with() + " SELECT symbol, event_us, arrival_us, ltp, ltq, seq FROM ticks",
    "tick_lateness": _with() + " SELECT symbol, seq, arrival_us, arrival_us - event_us AS lateness_us FROM ticks",
    "dedup_first_wins": _with() + " SELECT symbol, event_us, arrival_us, ltp, ltq, seq FROM uniq",
    "event_order": _with() + " SELECT symbol, seq, event_us, row_number() OVER (PARTITION BY symbol ORDER BY event_us, seq) AS place FROM uniq",
    "distinct_symbols": _with() + " SELECT DISTINCT symbol FROM ticks",
    "distinct_keys": _with() + " SELECT DISTINCT symbol, seq FROM ticks",
    "redelivered_keys": _with() + " SELECT symbol, seq, count(*) AS deliveries FROM ticks GROUP BY symbol, seq HAVING count(*) > 1",
    "feed_statistics": _with(
        "late AS (SELECT arrival_us - event_us AS late, row_number() OVER (ORDER BY arrival_us - event_us) - 1 AS r, count(*) OVER () AS n FROM uniq)",
        "turned AS (SELECT count(*) FILTER (WHERE event_us < b) AS o FROM (SELECT event_us, lag(event_us) OVER (ORDER BY arrival_us, seq, symbol) AS b FROM uniq))",
        "ends AS (SELECT count(*) AS ticks, arg_min(event_us, (arrival_us, seq, symbol)) AS f, arg_max(event_us, (arrival_us, seq, symbol)) AS l FROM ticks)",
    )
    + """ SELECT CAST(ticks AS DOUBLE) AS ticks, CAST(n AS DOUBLE) AS "unique", CAST(ticks - n AS DOUBLE) AS duplicates, CAST(o AS DOUBLE) AS out_of_order,
      round(o * 100.0 / n, 6) AS out_of_order_pct, round(m / 1e6, 6) AS max_lateness_s, round(p / 1e6, 6) AS p99_lateness_s, round(d / 1e6, 6) AS median_lateness_s,
      round((l - f) / 6e7, 6) AS span_minutes
      FROM (SELECT max(n) AS n, max(late) AS m, max(late) FILTER (WHERE r = CASE WHEN CAST(floor(n * 0.99) AS BIGINT) - 1 < 0 THEN n - 1 ELSE CAST(floor(n * 0.99) AS BIGINT) - 1 END) AS p,
      max(late) FILTER (WHERE r = n // 2) AS d FROM late), turned, ends""",
    "out_of_order_pairs": _with()
    + " SELECT symbol, seq, event_us, arrival_us FROM (SELECT *, lag(event_us) OVER (ORDER BY arrival_us, seq, symbol) AS b FROM uniq) WHERE event_us < b",
    "lateness_exact_rank": _with("late AS (SELECT list(arrival_us - event_us ORDER BY arrival_us - event_us) AS x, count(*) AS n FROM uniq)")
    + " SELECT x[CASE WHEN CAST(floor(n * 0.99) AS BIGINT) - 1 < 0 THEN n ELSE CAST(floor(n * 0.99) AS BIGINT) END] AS p99_us, x[n // 2 + 1] AS median_us FROM late",
    "eval_grid": _with(_grid(STEP_S)) + " SELECT k, at_us FROM instants",
    "symbol_grid": _with(_grid(STEP_S)) + " SELECT symbol, k, at_us FROM cells",
    "feat_avg": _features("ltq_avg_2m", "ltq_avg_5m", "ltq_avg_20m", "ltp_avg_5m"),
    "feat_sum_zero": _features("ltq_sum_2m"),
    "feat_count_zero": _features("tick_count_2m"),
    "feat_max_min": _features("ltp_max_5m", "ltp_min_5m"),
    "feat_last_asof": _features("ltp_last"),
    "naive_features": _full("uniq", False),
    "replay_features": _full("uniq", True),
    "replay_by_range_join": _full("uniq", True),
    "odd_windows": _full("uniq", True, step_s=7 * 3600.0),
    "streaming_features": _full("admitted", True, begun=True),
    "stream_features_exact": _full("admitted", True, begun=True),
    "retrospective_features": _full("admitted", False),
    "store_roundtrip": _full("uniq", False),
    "derived_features": _with(_grid(STEP_S), _REPLAY)
    + """ SELECT symbol, at_us, round(ltq_avg_2m / nullif(ltq_avg_5m, 0), 6) AS ratio, round(ltp_max_5m - ltp_min_5m, 6) AS spread,
      ltq_avg_2m / nullif(ltq_avg_5m - ltq_avg_5m, 0) AS over_zero FROM replay""",
    "empty_rows": "SELECT " + ", ".join(f"{next((f.empty for f in _SET.features if f.name == n and f.empty is not None), 'NULL')}::DOUBLE AS {n}" for n in _ALL),
    "window_shifted_hopping": _with(f"hops AS (SELECT unnest(range(1, {HOPPING_S // HOP_S + 1})) AS h)")
    + f""" SELECT symbol, ((event_us - 1) // {HOP_S * 1000000} + h) * {HOP_S * 1000000} AS end_us, count(*) AS ticks, sum(ltq) AS ltq_sum
      FROM uniq, hops GROUP BY symbol, end_us""",
    "range_frame_left_open": _with()
    + f""" SELECT a.symbol, a.seq, count(*) AS ticks, sum(b.ltq) AS ltq_sum FROM uniq a
      JOIN uniq b ON a.symbol = b.symbol AND b.event_us <= a.event_us AND b.event_us > a.event_us - {FRAME_S * 1000000} GROUP BY a.symbol, a.seq""",
    "boundary_edges": _with("edges AS (SELECT unnest([" + ", ".join(map(str, EDGES)) + "]) AS seconds_before)")
    + f" SELECT CAST(seconds_before AS INTEGER) AS seconds_before, CAST(sum(CASE WHEN seconds_before >= 0 AND seconds_before < {int(120 * UNIT)} THEN 1 ELSE 0 END) AS BIGINT) AS inside, count(*) AS ticks FROM uniq, edges GROUP BY seconds_before",
    "admission_verdicts": _with(VERDICTS) + " SELECT symbol, seq, arrival_us, verdict, out_of_order FROM verdicts",
    "stream_stats": _with(VERDICTS)
    + """ SELECT count(*) AS seen, count(*) FILTER (WHERE verdict = 'accepted') AS accepted, count(*) FILTER (WHERE verdict = 'duplicate') AS duplicates,
      count(*) FILTER (WHERE verdict = 'late') AS dropped_late, count(*) FILTER (WHERE out_of_order) AS out_of_order,
      max(event_us) FILTER (WHERE verdict = 'accepted') AS max_event_us, max(arrival_us - event_us) AS max_lateness_us FROM verdicts""",
    "watermark_sweep": _by_watermark("naive", False, SKEW_TOLERANCE)
    + """ SELECT watermark_us / 1e6 AS watermark_s, CAST(dropped AS DOUBLE) AS dropped, round(dropped * 100.0 / (SELECT count(*) FROM ticks), 6) AS dropped_pct,
      CAST(coalesce(bad, 0) AS DOUBLE) AS features_disagreeing, round(coalesce(worst, 0.0) * 100.0, 6) AS worst_feature_rate_pct, watermark_us / 1e6 AS latency_s
      FROM drops LEFT JOIN (SELECT watermark_us, count(*) FILTER (WHERE disagreements > 0) AS bad, max(rate) AS worst FROM per GROUP BY watermark_us) USING (watermark_us)""",
    "boundary_law": _by_watermark("replay", True, 0.0)
    + """ SELECT watermark_us / 1e6 AS watermark_s, dropped, coalesce(d, 1) = 0 AND coalesce(c, 0) > 0 AS exact
      FROM drops LEFT JOIN (SELECT watermark_us, sum(disagreements) AS d, max(compared) AS c FROM per GROUP BY watermark_us) USING (watermark_us)""",
    "exact_watermark": _with() + " SELECT max(prev_max - event_us) AS threshold_us, max(arrival_us - event_us) AS max_lateness_us FROM ran",
    "parity_skew": _with(_grid(STEP_S), _STREAMS, _NAIVE, _compare("streams", "naive", SKEW_TOLERANCE)) + " " + _PER,
    "parity_correctness": _with(_grid(STEP_S), _STREAMS, _REPLAY, _compare("streams", "replay", 0.0)) + " " + _PER,
    "parity_retrospective": _with(_grid(STEP_S), _RETRO, _REPLAY, _compare("retro", "replay", SKEW_TOLERANCE)) + " " + _PER,
    "parity_worst": _with(_grid(STEP_S), _STREAMS, _NAIVE, _compare("streams", "naive", SKEW_TOLERANCE))
    + " SELECT name, round(rate, 6) AS rate, row_number() OVER (ORDER BY rate DESC, ordinal) AS place FROM per",
    "parity_report": _with(_grid(STEP_S), _STREAMS, _NAIVE, _compare("streams", "naive", SKEW_TOLERANCE))
    + """ SELECT count(*) AS features, count(*) FILTER (WHERE disagreements > 0) AS features_disagreeing, coalesce(max(compared), 0) AS rows_compared,
      round(coalesce(max(rate), 0.0), 6) AS worst_rate, count(*) FILTER (WHERE disagreements > 0) = 0 AND coalesce(max(compared), 0) > 0 AS agree FROM per""",
    "unmatched_cells": _with(_grid(STEP_S), _STREAMS, _NAIVE)
    + """ SELECT count(*) FILTER (WHERE n.symbol IS NULL) AS left_only, count(*) FILTER (WHERE s.symbol IS NULL) AS right_only,
      count(*) FILTER (WHERE s.symbol IS NOT NULL AND n.symbol IS NOT NULL) AS matched
      FROM streams s FULL JOIN naive n ON s.symbol = n.symbol AND s.at_us = n.at_us""",
    "lost_keys_anti": _with() + " SELECT DISTINCT symbol, seq FROM ran WHERE prev_max IS NOT NULL AND event_us <= prev_max",
    "union_feeds": _with() + " SELECT symbol, count(*) AS ticks, sum(ltq) AS ltq_sum, min(arrival_us) AS first_us, max(arrival_us) AS last_us FROM ticks GROUP BY symbol",
    "symbols_per_partition": _with() + " SELECT symbol, 1::BIGINT AS partitions FROM ticks GROUP BY symbol",
    "transport_reorder": _with() + " SELECT symbol, 0::BIGINT AS reordered FROM ticks GROUP BY symbol",
    "tick_json_roundtrip": _with() + " SELECT symbol, event_us, arrival_us, ltp, ltq, seq FROM ticks",
}
