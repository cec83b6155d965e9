"""References to records that are missing, deleted or later, and what hangs on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import utc_month
from graphloom.operators.skew import salted_join
from graphloom.session import cut

#: Cascades deeper than this are refused: no foreign-key graph of tables is, and a cycle of records ends by itself.
MAX_DEPTH = 100


@dataclass
class References:
    """Rows of ``name`` that refer to a parent.

    ``rows(ref_key, parent_key, at)``: the row's own key, a struct or text that
    names its parent (null: no reference), and its time.
    """

    name: str
    rows: DataFrame


@dataclass
class Link:
    """Rows of ``child`` that refer to rows of ``parent`` by their key: ``rows(ref_key, parent_ref_key, at)``."""

    child: str
    parent: str
    rows: DataFrame


def parent_state(rows: DataFrame) -> DataFrame:
    """One row for each parent from ``rows(parent_key, created_at, deleted_at)``: repeats and versions are one record.

    It is deleted if any of its rows says so, and was created when the first
    of them says so.
    """
    return rows.where("parent_key is not null").groupBy("parent_key").agg(F.max(F.col("deleted_at").isNotNull()).alias("deleted"), F.min("created_at").alias("created_at"))


def lost_parents(references: list[References], parents: DataFrame) -> DataFrame:
    """``(parent_key, kind, created_at)``: the parents with which a reference is lost, from which the cascade starts.

    A parent that is referred to is ``missing`` or ``deleted``, or was created
    after the first reference to it (``late``, for the references before that
    time). Counted with partial aggregation, so that a hot key is reduced
    where it lies.
    """
    named = None
    for reference in references:
        part = reference.rows.select("parent_key", "at").where("parent_key is not null")
        named = part if named is None else named.unionByName(part)
    state = parent_state(parents).withColumn("_there", F.lit(True))
    asked = named.groupBy("parent_key").agg(F.min("at").alias("first_at")).join(state, "parent_key", "left")
    kind = F.when(F.col("_there").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("created_at") > F.col("first_at"), "late")
    return asked.select("parent_key", kind.alias("kind"), "created_at").where("kind is not null")


def find_orphans(references: list[References], parents: DataFrame, links: list[Link] | None = None) -> DataFrame:
    """``(ref_table, ref_key, kind, origin, depth, period)`` for each orphaned reference.

    A fixpoint down the foreign keys that starts from the :func:`lost_parents`.
    The first step reaches the references to them, the direct orphans
    (``origin`` = direct, depth 0): the parent is ``missing``, ``deleted``, or
    was created later than the reference (``late``; unknown times are not
    late). Then, until nothing new turns up, rows that refer to an orphan by
    one of the ``links`` are orphans too (``origin`` = inherited, depth of the
    link chain) of the kind of their parent. It ends where no link starts from
    what was reached last, so without ``links`` after the first step. All steps
    salt the keys that many rows refer to. ``period`` is the
    month of the row's time in UTC, null without a time. A row comes out once
    for each kind, at its least depth; repeats of a row are one.
    """
    lost = cut(lost_parents(references, parents), "lost-parents")
    found = None
    for reference in references:
        rows = reference.rows.select("ref_key", "parent_key", "at").where("parent_key is not null")
        # one row for each lost parent, so a semi join that brings the kind along;
        # salted with the time, as ref_key may be part of the parent's key
        joined = salted_join(rows, lost, "parent_key", salt_by=F.struct("ref_key", "at"))
        orphaned = joined.where("kind is not null and (kind <> 'late' or created_at > at)")
        part = orphaned.select(F.lit(reference.name).alias("ref_table"), "ref_key", "kind", utc_month("at").alias("period"))
        found = part if found is None else found.unionByName(part)
    frontier = found.distinct().select("ref_table", "ref_key", "kind", F.lit("direct").alias("origin"), F.lit(0).alias("depth"), "period")
    reached_tables, known, depth = {reference.name for reference in references}, frontier, 0
    while live := [link for link in links or [] if link.parent in reached_tables]:
        if not depth:
            known = frontier = cut(frontier, "orphans-0")
        depth += 1
        if depth > MAX_DEPTH:
            raise RuntimeError(f"the cascade goes deeper than {MAX_DEPTH} links")
        reached = None
        for link in live:
            above = frontier.where(F.col("ref_table") == link.parent).select(F.col("ref_key").alias("parent_ref_key"), "kind").distinct()
            rows = link.rows.select("ref_key", "parent_ref_key", "at").where("parent_ref_key is not null")
            # the semi join leaves only what hangs on the frontier; what hangs on one orphan may still be much
            near = rows.join(above.select("parent_ref_key").distinct(), "parent_ref_key", "left_semi")
            rows = salted_join(near, above, "parent_ref_key", F.struct("ref_key", "at"), "inner")
            part = rows.select(F.lit(link.child).alias("ref_table"), "ref_key", "kind", F.lit("inherited").alias("origin"), F.lit(depth).alias("depth"), utc_month("at").alias("period"))
            reached = part if reached is None else reached.unionByName(part)
        fresh = reached.distinct().join(known.select("ref_table", "ref_key", "kind").distinct(), ["ref_table", "ref_key", "kind"], "left_anti")
        fresh = cut(fresh, f"orphans-{depth}")
        if fresh.isEmpty():
            return known
        known, frontier, reached_tables = known.unionByName(fresh), fresh, {link.child for link in live}
    return known
