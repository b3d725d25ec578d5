"""Mixing sources to target weights.

Words are summed per source; weights follow the sources' code point order; a source's target stops at
`max_repeats` times its size and the excess is shared again by weight until none is above. A document's rate is
target / size of its source: it is emitted floor(rate) times, plus once more if its seeded hash falls below the
fraction.

Null sources form one source, which comes last. Null or empty texts have size 0 and are taken 0 words of. A
document's hash depends on its id and the seed alone, so repeated rows and reruns agree; null ids hash alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Tables, small_batches

#: White space as in the ASCII table: space, and tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Sources whose table is broadcast; beyond, the join is shuffled.
BROADCAST_SOURCES = 50_000
HASH_RANGE = 1 << 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_uniform(key: Column, seed: str) -> Column:
    """A number from 0 up to 1 from 52 bits of an MD5, the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(HASH_RANGE))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> the same with `weight` and `target`.

    Ranks come from a range partitioning and per-partition counts, and the shares from rounds of two sums, so no
    task and no driver list holds all sources.
    """
    spark = sizes.sparkSession
    tables = Tables(spark, "mix")
    ordered = sizes.repartitionByRange(8, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = tables.put("sources", ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())  # a row per partition
    offset, before = F.lit(0), 0
    for p, n in counts:
        offset = F.when(part == p, before).otherwise(offset)
        before += n
    rank = offset + F.col("_at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank % len(weights)) + 1).cast("int"))
    big = "decimal(38,0)"
    table = placed.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_repeats).alias("_cap"))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rest, shares = total, table.agg(F.sum("weight")).first()[0] or 1
    capped_before = -1
    while True:
        # Full where the cap lies below the share; the sums only grow, so the rounds end.
        full = F.col("_cap").cast(big) * F.lit(shares).cast("decimal(18,0)") < F.col("weight").cast("decimal(18,0)") * F.lit(rest).cast("decimal(20,0)")
        n, caps, left = table.agg(F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped_before or not left:
            break
        capped_before, rest, shares = n, total - (caps or 0), left
    target = F.when(full, F.col("_cap").cast("double")).otherwise((F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(shares)))
    return table.select("source", "source_size", "weight", target.alias("target")), before


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix-1", size: Column | None = None) -> DataFrame:
    """`docs` with size, source_size, target and copies (columns of these names are replaced)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = docs.withColumn("size", word_count(F.col("text")) if size is None else size)
    targets, n = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    if n <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = (seeded_uniform(F.col("doc_id"), seed) < rate - whole).cast("long")
    return sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("copies", whole + extra)


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1 in `copy`; documents without copies go."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
