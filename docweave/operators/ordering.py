"""Ordered computations per key that stay bounded per task, and joins to per-key lookups.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. Here a key with more than
``target_rows`` rows is cut into consecutive pieces of its order, each piece is scanned on its own, and what
a piece needs from the pieces before it is put in front of it as one more row. Nulls are a key and an order
value like any other, and come first in the order, whether a key is cut or not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave.streaming.files import stored

TARGET_ROWS = 2_000_000
HOT_KEYS = 10_000       # cut keys whose bounds are broadcast; more are joined by a shuffle
SAMPLES = 200_000       # order values that are gathered of one key at most
PER_PIECE = 50          # order values sampled for each piece


def as_number(df: DataFrame, column: str) -> Column:
    """The order column as a number (timestamps in microseconds)."""
    if dict(df.dtypes)[column].startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join to a lookup with one row per key; null keys match null keys.

    A hot key is hot on the side of the facts alone, so the adaptive skew join can split it as often as it needs.
    """
    renamed = lookup.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    equal = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return facts.join(renamed, equal, how).drop(*[f"_k_{k}" for k in keys])


def _bounds(samples: Column, every: Column, target_rows: int) -> Column:
    """Every so-manieth of the sorted samples, so that pieces hold about ``target_rows`` rows."""
    step = F.greatest(F.lit(1), F.ceil(F.lit(target_rows) / every)).cast("int")
    return F.when(F.size(samples) > step, F.transform(F.sequence(step, F.size(samples) - 1, step), lambda i: F.get(samples, i))).otherwise(
        F.slice(samples, 1, 0))


def cut_pieces(df: DataFrame, keys: list[str], order: list[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add ``_piece``, 0 for ordinary keys, and ``_hot``; the pieces of hot keys follow one another in the full order.

    Bounds are order values of the rows themselves, chosen by a hash, so outliers do not matter and a recomputed
    task cuts the same pieces. Rows that agree in all order columns stay together. Whether any key is hot is
    counted first: mostly none is, and the rows are left as they are. Else they are written once to the shared folder,
    since every scan reads its pieces more than once.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target_rows)
    n_hot = sizes.limit(HOT_KEYS + 1).count()
    if not n_hot:
        return df.withColumns({"_piece": F.lit(0).cast("long"), "_hot": F.lit(False)})
    checked = F.broadcast if n_hot <= HOT_KEYS else (lambda x: x)
    every = F.greatest(F.lit(1), F.lit(target_rows // PER_PIECE), F.ceil(F.col("_n") / SAMPLES)).cast("long")
    sampled = lookup_join(df.select(*keys, *[c for c in order if c not in keys]), checked(sizes.withColumn("_every", every)), keys)
    sampled = sampled.filter(F.pmod(F.xxhash64(*order), F.col("_every")) == 0).withColumn("_row", F.struct(*order))
    bounds = sampled.groupBy(*keys).agg(F.sort_array(F.collect_list("_row")).alias("_s"), F.max("_every").alias("_every"))
    bounds = sizes.select(*keys).transform(lambda x: lookup_join(x, bounds.select(*keys, _bounds(F.col("_s"), F.col("_every"), target_rows).alias("_b")), keys, "left"))
    cut = lookup_join(df, checked(bounds.withColumn("_hot", F.lit(True))), keys, "left")
    cut = cut.withColumns({"_piece": _place(F.col("_b"), order), "_hot": F.coalesce("_hot", F.lit(False))}).drop("_b")
    return stored(cut, "pieces")


def _place(bounds: Column, order: list[str]) -> Column:
    return F.when(bounds.isNotNull(), F.size(F.filter(bounds, lambda b: b <= F.struct(*order)))).otherwise(0).cast("long")


def scan_pieces(cut: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None,
                before: dict[str, Column] | None = None) -> DataFrame:
    """Running sums and last known values over pieces; keeps ``_piece`` and ``_hot`` so that scans can be chained.

    The sums and last values of the pieces before a piece are one row in front of it: no join."""
    sums, before = sums or {}, before or {}
    columns = [*cut.columns, *[n for n in [*sums, *before] if n not in cut.columns]]
    for name, value in {**sums, **before}.items():
        cut = cut.withColumn(f"_v_{name}", value)
    group = [*keys, "_piece"]
    row = F.struct(*order)
    parts = [F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums]
    parts += [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), row)).alias(f"_v_{n}") for n in before]
    earlier = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = cut.filter("_hot").groupBy(*group).agg(*parts).select(
        *group, *[F.sum(f"_v_{n}").over(earlier).alias(f"_v_{n}") for n in sums],
        *[F.last(f"_v_{n}", ignorenulls=True).over(earlier).alias(f"_v_{n}") for n in before], F.lit(0).alias("_own"))
    rows = cut.withColumn("_own", F.lit(1)).unionByName(carried.filter("_piece > 0"), allowMissingColumns=True)
    local = W.partitionBy(*group).orderBy("_own", *order)
    so_far, previous = local.rowsBetween(W.unboundedPreceding, 0), local.rowsBetween(W.unboundedPreceding, -1)
    scanned = {n: F.sum(f"_v_{n}").over(so_far) for n in sums}
    scanned |= {n: F.last(f"_v_{n}", ignorenulls=True).over(previous) for n in before}
    return rows.withColumns(scanned).filter("_own = 1").select(*columns)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Running sums (this row included) and last known values (rows strictly before this one).

    ``sums`` maps a new column to the summed expression, ``before`` to the expression whose latest
    non-null value is carried. Rows are ordered by all ``order`` columns.
    """
    return scan_pieces(cut_pieces(df, keys, order, target_rows), keys, order, sums, before).drop("_piece", "_hot")


def global_scan(df: DataFrame, order: list[str], sums: dict[str, Column], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Running sums over the whole table, which is cut like one hot key; no task sees more than a piece."""
    n = df.count()
    if n > target_rows:
        every = max(1, target_rows // PER_PIECE, -(-n // SAMPLES))
        sampled = df.filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
        samples = sampled.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_s"))
        bounds = samples.select(_bounds(F.col("_s"), F.lit(every), target_rows).alias("_b")).scalar()
        cut = df.withColumn("_b", bounds).withColumns({"_piece": _place(F.col("_b"), order), "_hot": F.lit(True)}).drop("_b")
    else:
        cut = df.withColumns({"_piece": F.lit(0).cast("long"), "_hot": F.lit(False)})
    return scan_pieces(cut, [], order, sums).drop("_piece", "_hot")


def trailing_rows(
    df: DataFrame, keys: list[str], order: list[str], value: Column, rows: int, name: str,
    target_rows: int = TARGET_ROWS, block: int = 100_000,
) -> DataFrame:
    """Collect ``value`` of the last ``rows`` rows before each row.

    Rows are numbered per key, cut into blocks of ``block`` rows, and the last ``rows`` rows of a block
    are copied to the next one, so no task sees more than block + rows rows of a key.
    """
    numbered = ordered_scan(df, keys, order, {"_rn": F.lit(1)}, None, target_rows).withColumn("_value", value)
    at = F.col("_rn") - 1
    home = F.floor(at / block)
    copies = F.when(at % block >= block - rows, F.array(home, home + 1)).otherwise(F.array(home))
    spread = numbered.withColumn("_home", home).withColumn("_block", F.explode(copies))
    frame = W.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(-rows, -1)
    return (
        spread.withColumn(name, F.collect_list("_value").over(frame))
        .filter(F.col("_home") == F.col("_block"))
        .drop("_rn", "_home", "_block", "_value")
    )
