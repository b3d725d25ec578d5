"""Command line: spec, feed, parity, sweep, boundary, records, transport."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from .functions.features import standard_features
from .operators import admission, parity, records, statistics
from .operators.grid import Grid
from .plans.tables import Run
from .session import local_session, shared_folder
from .sources import transport
from .sources.generator import SYMBOLS, Profile, generate


def parser() -> argparse.ArgumentParser:
    # The options and their defaults.
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--minutes", type=float, default=45.0)
    p.add_argument("--symbols", type=int, default=1)
    p.add_argument("--watermark", type=float, default=admission.DEFAULT_WATERMARK_S)
    p.add_argument("--late-rate", type=float, default=0.08)
    p.add_argument("--max-lateness", type=float, default=90.0)
    p.add_argument("--out-of-order", type=float, default=0.15)
    p.add_argument("--duplicates", type=float, default=0.03)
    p.add_argument("--seed", type=int, default=0)
    commands = p.add_subparsers(dest="command", required=True)
    for name, text in (
        ("spec", "print the features"), ("feed", "describe the synthetic feed"), ("parity", "compare streaming with replay and naive"),
        ("sweep", "price watermarks"), ("boundary", "find the first exact watermark"), ("records", "compare the plans with the record engine"),
    ):
        commands.add_parser(name, help=text)
    sent = commands.add_parser("transport", help="send the feed and read it back")
    sent.add_argument("--bootstrap", help="a Kafka broker; without one, a folder")
    sent.add_argument("--topic", default="ticks")
    return p


def table_text(df: DataFrame) -> str:
    """For tables of a row per feature or watermark."""
    rows = [[f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in df.collect()]
    widths = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(df.columns)]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in [df.columns, *rows])


def _feed(args, spark) -> DataFrame:
    profile = Profile(args.out_of_order, args.late_rate, args.max_lateness, args.duplicates)
    return generate(spark, list(SYMBOLS)[: max(1, args.symbols)], args.minutes, profile, args.seed).persist()


_SHOWN = ("name", "compared", "disagreements", "presence_mismatch", "rate", "max_abs", "max_rel")


def _parity(args, spark, say) -> int:
    run = Run(_feed(args, spark), args.watermark, Grid())
    say(table_text(admission.stream_stats(run.ticks, args.watermark)))
    exact = parity.correctness(run).persist()
    say("\nstreaming against replay, exactly\n" + table_text(exact.select(*_SHOWN)))
    say("\nstreaming against naive\n" + table_text(parity.worst_first(parity.skew(run)).select(*_SHOWN)))
    agree = parity.report(exact).first().agree
    limits = admission.least_exact_watermark_us(run.unique).first()
    covered = limits.threshold_us is None or args.watermark * 1e6 > limits.threshold_us
    say(f"\nstreaming equals replay: {agree}; watermark {args.watermark:g} s, drops none above {(limits.threshold_us or 0) / 1e6:g} s, max lateness {(limits.max_lateness_us or 0) / 1e6:g} s")
    # A mismatch is a fault only where the watermark drops nothing.
    return int(covered and not agree)


def _records(args, spark, say) -> int:
    """Fails unless every table agrees, on at least one row, with what plain Python makes of it."""
    run, wrong = Run(_feed(args, spark), args.watermark, Grid(60.0)), 0
    for kind in records.TABLES:
        per = records.against_records(run, kind).persist()
        agree = bool(parity.report(per).first().agree)
        wrong += not agree
        say(f"{kind}, plans against records: {'agree' if agree else 'differ'}\n" + table_text(per.select(*_SHOWN)))
    return int(wrong > 0)


def _boundary(args, spark, say) -> int:
    run = Run(_feed(args, spark), args.watermark, Grid())
    worst = (admission.least_exact_watermark_us(run.unique).first().max_lateness_us or 0) / 1e6
    # What is tried around the greatest lateness.
    tried = sorted({round(w, 1) for w in (*parity.BOUNDARY, worst - 5, worst - 1, worst, worst + 1) if w >= 0})
    rows = parity.boundary(run, tried).orderBy("watermark_s")
    say(table_text(rows))
    first = rows.filter("exact").agg({"watermark_s": "min"}).first()[0]
    say("no watermark tried is exact" if first is None else f"first exact watermark: {first:g} s; greatest lateness {worst:g} s")
    return 0


def _transport(args, spark, say) -> int:
    ticks = _feed(args, spark)
    if args.bootstrap:
        way = transport.Kafka(args.bootstrap, args.topic)
        try:
            transport.require_kafka(spark)
        except RuntimeError as e:
            say(str(e))
            return 2
    else:
        way = transport.Folder(shared_folder(spark, "transport"))
    received = transport.round_trip(ticks, way).persist()
    lost = transport.lost_keys(ticks, received).count()
    say(f"sent {ticks.count()}, received {received.count()}, lost {lost}")
    say(table_text(transport.partitions_of_symbols(received)))
    direct, through = Run(ticks, args.watermark, Grid()), Run(transport.strip(received), args.watermark, Grid())
    same = parity.report(parity.compare(through.streaming(), direct.streaming(), direct.features.names, 0.0)).first().agree
    say(f"features through the transport equal direct ones: {same}")
    return int(lost > 0 or not same)


def main(argv: list[str] | None = None, spark=None) -> int:
    sys.stdout.reconfigure(encoding="utf-8") if hasattr(sys.stdout, "reconfigure") else None
    args, say = parser().parse_args(argv), print
    if args.command == "spec":
        say(standard_features().describe())
        return 0
    spark = spark or local_session()
    if args.command == "feed":
        say(table_text(statistics.feed_statistics(_feed(args, spark))))
        return 0
    if args.command == "sweep":
        say(table_text(parity.watermark_sweep(Run(_feed(args, spark), args.watermark, Grid())).orderBy("watermark_s")))
        return 0
    return {"parity": _parity, "boundary": _boundary, "records": _records, "transport": _transport}[args.command](args, spark, say)


if __name__ == "__main__":
    sys.exit(main())
