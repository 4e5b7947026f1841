"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import salted_semi_join


@dataclass(frozen=True)
class MaskRule:
    """What a reference means whose non-null key columns are exactly ``present``.

    match: ``present`` columns to look up, as {reference column: target column}; a partial match names fewer
    columns than are present. target: the rows that exist. field: what an orphan is reported as.
    """

    present: frozenset[str]
    match: dict[str, str]
    target: DataFrame
    field: str


def null_mask(keys: Sequence[str]) -> Column:
    """Bit i is set where key column i is not null."""
    return reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)])


def orphan_references(refs: DataFrame, row_id: str, keys: Sequence[str], rules: Sequence[MaskRule], carry: Sequence[str] = (), salts: int = 16) -> DataFrame:
    """Orphans of ``refs``: (row_id, field, carry...), one row for each row_id and field.

    References are grouped by the null mask of their composite key; each declared mask is anti-joined on its
    non-null columns. A mask without a rule (all null, say) is no reference. The anti-join runs over the
    distinct keys of the mask, combined inside the map tasks, so a key that holds most references is looked up
    once; the orphan keys are then joined back to the rows in salted pieces.

    Empty references give no rows; with an empty target every reference is an orphan. Repeated rows count
    once. Matching is byte for byte. Extra columns are not read.
    """
    where = {k: 1 << i for i, k in enumerate(keys)}
    slim = refs.select(row_id, *keys, *carry).withColumn("_mask", null_mask(keys))
    out = []
    for rule in rules:
        mask = sum(where[k] for k in rule.present)
        cols = list(rule.match)
        held = slim.where(F.col("_mask") == F.lit(mask))
        there = rule.target.select(*[F.col(t).alias(r) for r, t in rule.match.items()])
        lost = held.select(*cols).distinct().join(there, cols, "left_anti")
        rows = salted_semi_join(held.select(row_id, *cols, *carry), lost, cols, [row_id], salts)
        out.append(rows.select(F.col(row_id).alias("row_id"), F.lit(rule.field).alias("field"), *carry).dropDuplicates(["row_id", "field"]))
    return reduce(DataFrame.unionByName, out)
