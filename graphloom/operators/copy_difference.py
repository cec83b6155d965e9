"""Differences between two copies of a dataset, row by row and field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.chunked_keys import number_rows
from graphloom.operators.skew import salted_join
from graphloom.session import cut


def copy_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], left_name: str = "left", right_name: str = "right") -> DataFrame:
    """``(key, field, kind, left_value, right_value)`` for whatever differs.

    Both sides hold the normalised columns ``key`` and ``fields``; further
    columns are ignored. EXCEPT ALL in both directions leaves the rows without
    a twin, so equal rows never reach the join. The rows of a residue are
    counted, and those of one key numbered in order of their fields; the two
    residues are joined in full by key and number. Kinds:

    * ``missing_in_<right>`` / ``missing_in_<left>``: the key is on one side
      only (field ``row``), once for each key;
    * ``differs``: for each pair of rows of a key with one number, one row for
      each field whose values differ, where no value (null) differs from any
      value and equals no value; equal differences of a key come out once;
    * ``repeated_in_<left>`` / ``repeated_in_<right>``: the key is on both
      sides, yet one side has more different rows of it, or more repeats
      (field ``row``), once for each key.

    Rows whose key is null are no records and are left out. Empty sides are
    allowed. Repeats are counted before the shuffle, and rows of a key are
    numbered over all partitions (:mod:`chunked_keys`), so that neither a row
    that occurs very often nor a key with very many rows is left to one task.
    """
    columns = [key, *fields]
    left = left.select(*columns).where(F.col(key).isNotNull())
    right = right.select(*columns).where(F.col(key).isNotNull())
    row = F.struct(*fields)

    def residue(of: DataFrame, without: DataFrame, side: str) -> DataFrame:
        rows = of.exceptAll(without).groupBy(key, row.alias(side)).agg(F.count(F.lit(1)).alias("_n"))
        # most keys have one row; only those with more are numbered
        rows = cut(rows, "residue")
        many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(key)
        single = rows.join(many, key, "left_anti").withColumn("_place", F.lit(0).cast("bigint"))
        if many.isEmpty():
            return rows.select(key, side, F.lit(0).cast("bigint").alias("_place"))
        several = rows.join(many, key, "left_semi")
        # as text, missing values first and numbers by their size
        order = [F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.when(F.col(c).cast("double") < 0, "-").otherwise("0"), F.lit("")), F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 40, "0")) for c in (f"{side}.{f}" for f in fields)]
        text = F.concat_ws("\u0001", F.col(key).cast("string"), F.lit("\u0001"), *order)
        starts = number_rows(several, text, payload=[key, side])
        first = starts.groupBy(key).agg(F.min("row").alias("_first"))
        numbered = salted_join(starts.select(F.col("row"), key, side), first, key, "row", "inner").select(key, side, (F.col("row") - F.col("_first")).alias("_place"))
        return single.select(key, side, "_place").unionByName(numbered)

    both = residue(left, right, "_l").join(residue(right, left, "_r"), [key, "_place"], "full")
    # a residue on one side may still be a repeat of a row that the other side has, or have too few partners there
    lone = both.where("_l is null or _r is null").select(key, F.col("_r").isNull().alias("_left")).distinct()
    other = right.select(key, F.lit(True).alias("_left")).unionByName(left.select(key, F.lit(False).alias("_left")))
    there = lone.join(other.distinct(), [key, "_left"], "left_semi").select(key, F.lit(True).alias("_there"))
    both = both.join(there.distinct(), key, "left").withColumn("_there", F.coalesce("_there", F.lit(False)))

    def text(value: Column) -> Column:
        return value.cast("string")

    nothing = F.lit(None).cast("string")
    item = lambda field, kind, a=nothing, b=nothing: F.struct(F.lit(field).alias("field"), kind.alias("kind"), a.alias("left_value"), b.alias("right_value"))
    sides = [
        item("row", F.when(F.col("_r").isNull() & ~F.col("_there"), F.lit(f"missing_in_{right_name}")).when(F.col("_r").isNull(), F.lit(f"repeated_in_{left_name}"))),
        item("row", F.when(F.col("_l").isNull() & ~F.col("_there"), F.lit(f"missing_in_{left_name}")).when(F.col("_l").isNull(), F.lit(f"repeated_in_{right_name}"))),
    ]
    met = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for name in fields:
        a, b = F.col(f"_l.{name}"), F.col(f"_r.{name}")
        sides.append(item(name, F.when(met & ~a.eqNullSafe(b), F.lit("differs")), text(a), text(b)))
    rows = both.select(F.col(key).alias("key"), F.explode(F.array(*sides)).alias("_d"))
    return rows.where("_d.kind is not null").select("key", "_d.*").distinct()
