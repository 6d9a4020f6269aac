"""References to records that do not exist, and what hangs below them.

Method: a foreign-key graph is given as edges (child table, reference expression, parent table). A reference
whose key is in no parent row is a *direct* orphan; a record that refers to an orphaned record is an
*inherited* one. The inherited ones are found as a fixpoint: the frontier of newly orphaned records is
joined with the children of every edge, round by round, until nothing refers to the records a round added. Each round moves
only keys and the frontier, and is checkpointed, so that a lost executor repeats one round at most.

Defined results: null and blank references are no references; ids are compared trimmed, in half width and
upper case; repeated rows of a record are one record; empty tables give no orphans (as children) or make every
reference an orphan (as parents).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import checkpoint, joined_hot

# Full-width ASCII and its half-width forms, in order.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def clean_id(value: Column) -> Column:
    """An id trimmed, in half-width upper case; blank is null."""
    narrow = F.translate(value, WIDE, NARROW)
    bare = F.upper(F.regexp_replace(narrow, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return F.when(bare != "", bare)


@dataclass(frozen=True)
class Edge:
    """child.reference (a string or array of strings) names a key of parent."""

    child: str
    reference: str
    parent: str


@dataclass(frozen=True)
class Orphans:
    """references: (table, record_id, parent, ref, via, period, reason), the broken references; records: (table, record_id, period, kind,
    round, via), every orphaned record, direct (round 0) or inherited."""

    references: DataFrame
    records: DataFrame


def _links(tables: dict[str, DataFrame], keys: dict[str, str], edges: Sequence[Edge]) -> DataFrame:
    """(table, record_id, parent, ref, via, created_at) of every reference, once per record, parent and key."""
    out = []
    for e in edges:
        kind = tables[e.child].schema[e.reference].dataType.typeName()
        refs = F.explode(F.col(e.reference)) if kind == "array" else F.col(e.reference)
        links = tables[e.child].select(clean_id(F.col(keys[e.child])).alias("record_id"), refs.alias("ref"), "created_at")
        named = links.select(F.lit(e.child).alias("table"), "record_id", F.lit(e.parent).alias("parent"), clean_id(F.col("ref")).alias("ref"), F.lit(f"{e.child}.{e.reference}").alias("via"), "created_at")
        out.append(named.where("record_id is not null and ref is not null").groupBy("table", "record_id", "parent", "ref", "via").agg(F.min("created_at").alias("created_at")))
    return reduce(DataFrame.unionByName, out)


def cascade(tables: dict[str, DataFrame], keys: dict[str, str], edges: Sequence[Edge], deletions: dict[str, DataFrame] | None = None, most_rounds: int = 1000) -> Orphans:
    """The orphans of a graph of tables (each with created_at). deletions: a log of deleted keys per parent, under the parent's key name.

    A reference is ``missing`` (no such parent, never deleted), ``deleted`` or ``late`` (the parent came after the child). Late
    references are reported, but their parent is there, so they orphan nobody. Keys are looked up once each, with the number of
    their references, and only the references to broken ones are joined again, those to one key on as many tasks as it takes.
    A chain of orphans longer than most_rounds is an error, not a cut result; references in a circle end the fixpoint by themselves.
    """
    known = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(n).alias("parent"), clean_id(F.col(keys[n])).alias("ref"), F.col("created_at").alias("came")).where("ref is not null").groupBy("parent", "ref").agg(F.min("came").alias("came")) for n, df in tables.items()],
    )
    gone = None
    for parent, log in (deletions or {}).items():
        one = log.select(F.lit(parent).alias("parent"), clean_id(F.col(keys[parent])).alias("ref")).where("ref is not null").distinct()
        gone = one if gone is None else gone.unionByName(one)
    graph = checkpoint(_links(tables, keys, edges))
    # One row per key that is referred to.
    named = checkpoint(graph.groupBy("parent", "ref").agg(F.count("*").alias("n"), F.min("created_at").alias("first_named")))
    checked = named.join(known.withColumn("there", F.lit(True)), ["parent", "ref"], "left")
    checked = checked.join(gone.withColumn("gone", F.lit(True)), ["parent", "ref"], "left") if gone is not None else checked.withColumn("gone", F.lit(None).cast("boolean"))
    doubtful = checkpoint(checked.where("there is null or came > first_named").drop("first_named"))
    reason = (
        F.when(F.col("there").isNull() & F.col("gone").isNull(), "missing")
        .when(F.col("there").isNull(), "deleted")
        .when(F.col("came") > F.col("created_at"), "late")
    )
    checked = joined_hot(graph, doubtful, ["parent", "ref"], "record_id")
    broken = checkpoint(checked.select("table", "record_id", "parent", "ref", "via", F.date_format("created_at", "yyyy-MM").alias("period"), reason.alias("reason")).where("reason is not null"))
    counts = named.select(F.col("parent").alias("table"), F.col("ref").alias("record_id"), "n")

    def frontier_of(orphaned: DataFrame, round_no: int) -> DataFrame:
        """Newly orphaned records, with the number of references to them (null: none)."""
        found = orphaned.groupBy("table", "record_id").agg(F.min("via").alias("via")).withColumn("round", F.lit(round_no))
        return checkpoint(found.join(counts, ["table", "record_id"], "left"))

    frontier = frontier_of(broken.where("reason <> 'late'"), 0)
    found, round_no = frontier, 0
    while not (heads := frontier.where("n is not null")).isEmpty():
        if (round_no := round_no + 1) > most_rounds:
            raise ValueError(f"orphans hang more than {most_rounds} levels deep")
        heads = heads.select(F.col("table").alias("parent"), F.col("record_id").alias("ref"), "n")
        children = joined_hot(graph, heads, ["parent", "ref"], "record_id").join(found, ["table", "record_id"], "left_anti")
        frontier = frontier_of(children, round_no)
        found = found.unionByName(frontier)
    periods = known.select(F.col("parent").alias("table"), F.col("ref").alias("record_id"), F.date_format("came", "yyyy-MM").alias("period"))
    kind = F.when(F.col("round") == 0, "direct").otherwise("inherited").alias("kind")
    return Orphans(broken, found.join(periods, ["table", "record_id"], "left").select("table", "record_id", "period", kind, "round", "via"))


def cascade_report(orphans: Orphans) -> DataFrame:
    """Direct and inherited orphans per table and period."""
    return orphans.records.groupBy("table", "period", "kind").agg(F.count("*").alias("records"))
