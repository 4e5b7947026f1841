"""Per-key results over skewed keys: eager aggregation below joins, and salted joins.

Both operators keep every row. A key that holds a third of all rows costs one
partial state per map task, never one long task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Compact state of each key: key columns, ``n`` (rows) and ``s_<c>`` (sum of each column of ``sums``).

    The partial aggregate runs inside the map task, so what is shuffled is one row per key and task
    whatever the share of the hottest key. Null is a key like any other here; joins drop it.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in sums])


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    rollup: Sequence[str],
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    left_keys: Sequence[str] = (),
) -> DataFrame:
    """``left JOIN right USING (on) GROUP BY rollup`` without building the join's rows.

    Both inputs are first aggregated to states by the join key (the left one also by ``left_keys``, which a
    roll-up may need); the compact states are joined; counts multiply, a sum of one side is weighted by the
    other side's count; the products are rolled up.

    Result: the ``rollup`` columns, ``n_pairs``, ``sum_<c>`` per column of ``left_sums`` and ``right_sums``.
    Null join keys match nothing. Empty inputs give no rows. Extra columns of the inputs are never read.
    """
    a = key_states(left.select(*dict.fromkeys([*on, *left_keys, *left_sums])), [*dict.fromkeys([*on, *left_keys])], left_sums)
    b = key_states(right.select(*dict.fromkeys([*on, *right_sums])), list(on), right_sums)
    b = b.select(*on, F.col("n").alias("n_right"), *[F.col(f"s_{c}").alias(f"r_{c}") for c in right_sums])
    joined = a.join(b, list(on))
    return joined.groupBy(*rollup).agg(
        F.sum(F.col("n") * F.col("n_right")).alias("n_pairs"),
        *[F.sum(F.col(f"s_{c}") * F.col("n_right")).alias(f"sum_{c}") for c in left_sums],
        *[F.sum(F.col(f"r_{c}") * F.col("n")).alias(f"sum_{c}") for c in right_sums],
    )


def heavy_keys(df: DataFrame, fields: Sequence[str], share: float) -> DataFrame:
    """Values of ``fields`` that hold at least ``share`` of all rows: (key_field, key_value, n, n_rows).

    Each row gives one state per field, combined inside the map task; the number of rows comes from a scan that
    reads no column. The two sides of the final join are states already, one row per (field, value) and one row.
    A null value is no key, but its row counts in the total. An empty table has no heavy keys.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key_value")) for f in fields]))
    states = key_states(df.select(pairs.alias("k")).select("k.*"), ["key_field", "key_value"])
    totals = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*map(F.lit, fields))).alias("key_field"), "n_rows")
    return (
        states.where(F.col("key_value").isNotNull())
        .join(F.broadcast(totals), "key_field")  # one row per field
        .where(F.col("n") >= F.col("n_rows") * F.lit(share))
        .select("key_field", "key_value", "n", "n_rows")
    )


def salt_of(salts: int, *cols: str) -> Column:
    """A stable salt in [0, salts) from the given columns: the same on a retried task."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_semi_join(rows: DataFrame, keys: DataFrame, on: Sequence[str], spread: Sequence[str], salts: int = 16) -> DataFrame:
    """``rows LEFT SEMI JOIN keys USING (on)`` where one key may hold most rows.

    ``keys`` must be distinct; each is repeated once per salt, and the rows of a key go to ``salts`` tasks by a
    hash of ``spread``. Null keys match nothing.
    """
    many = keys.select(*on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt_of(salts, *spread)).join(many, [*on, "_salt"], "left_semi").drop("_salt")
