"""Registered queries of the general problems 1 and 4, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import orphan_references as orphans
from corpusloom.operators import snapshot_changes as changes
from corpusloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.snapshot_changes(table(spark, sf_dir, "corpus_snapshots"))


def p1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    deliveries = table(spark, sf_dir, "corpus_snapshots")
    return changes.with_values(changes.snapshot_changes(deliveries), deliveries)


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("record_table", "snapshot_no", "change_type").agg(F.count("*").alias("records"))


EDGES = [
    orphans.Edge("work_editions", "canonical_work_id", "canonical_works"),
    orphans.Edge("work_editions", "duplicate_of", "work_editions"),
    orphans.Edge("sources", "edition_id", "work_editions"),
    orphans.Edge("source_chunks", "source_id", "sources"),
    orphans.Edge("thought_cards", "representative_chunk_ids", "source_chunks"),
    orphans.Edge("creative_cards", "evidence_chunk_ids", "source_chunks"),
]
KEYS = {
    "canonical_works": "canonical_work_id",
    "work_editions": "edition_id",
    "sources": "source_id",
    "source_chunks": "chunk_id",
    "thought_cards": "card_id",
    "creative_cards": "card_id",
}


def _orphans(spark: SparkSession, sf_dir: str) -> orphans.Orphans:
    """The whole graph of tables, down from the works, with the log of deleted chunks."""
    tables = {name: table(spark, sf_dir, name) for name in KEYS}
    return orphans.cascade(tables, KEYS, EDGES, {"source_chunks": table(spark, sf_dir, "chunk_deletions")})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _orphans(spark, sf_dir).references.where("table in ('thought_cards', 'creative_cards')")
    return found.select(F.col("table").alias("card_table"), F.col("record_id").alias("card_id"), F.col("ref").alias("chunk_id"), "period", "reason")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p4_found(spark, sf_dir)
    return found.groupBy("card_table", "period", "reason").agg(F.count("*").alias("references"), F.countDistinct("card_id").alias("cards"))


def p4_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans of every table per month; deleted chunks orphan as missing ones do."""
    return orphans.cascade_report(_orphans(spark, sf_dir))


DELIVERED = {"work_editions": None, "sources": "work_editions", "source_chunks": "sources"}


def p4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans inside each delivery: sources whose edition it lacks, chunks whose source it lacks, and what hangs below those."""
    rows = table(spark, sf_dir, "corpus_snapshots").where("snapshot_no is not null and record_id is not null")
    inside = lambda c: F.concat(F.col("snapshot_no").cast("string"), F.lit("/"), orphans.clean_id(F.col(c)))
    keyed = rows.select("record_table", inside("record_id").alias("id"), inside("parent_id").alias("parent"), F.col("taken_at").alias("created_at"))
    tables = {name: keyed.where(F.col("record_table") == name).drop("record_table") for name in DELIVERED}
    edges = [orphans.Edge(child, "parent", parent) for child, parent in DELIVERED.items() if parent]
    found = orphans.cascade(tables, dict.fromkeys(DELIVERED, "id"), edges).records
    return found.groupBy(F.split_part("record_id", F.lit("/"), F.lit(1)).cast("int").alias("snapshot_no"), "table", "period", "kind").agg(F.count("*").alias("records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p1_totals, p4_found, p4_report, p4_cascade, p4_snapshots)}

_CLEAN = r"nullif(regexp_replace(lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '^sha256:\s*', ''), '')"
_P1 = f"""
with h as (
  select snapshot_no, record_table, record_id, delivered_at,
    case when record_table = 'sources' then null
      else coalesce({_CLEAN.format("chunk_hash")}, {_CLEAN.format("content_sha256")}) end as h
  from corpus_snapshots
  where snapshot_no is not null and record_table is not null and record_id is not null
), last as (
  select * exclude (rn) from (
    select *, row_number() over (partition by snapshot_no, record_table, record_id order by delivered_at desc nulls last, h is not null desc, cast('0x' || substr(md5(h), 1, 15) as bigint) desc) as rn from h
  ) where rn = 1
), nos as (
  select snapshot_no as later, lag(snapshot_no) over (order by snapshot_no) as earlier
  from (select distinct snapshot_no from last)
), old as (
  select n.later, l.record_table, l.record_id, l.h from nos n join last l on l.snapshot_no = n.earlier
), new as (
  select n.later, l.record_table, l.record_id, l.h from nos n join last l on l.snapshot_no = n.later where n.earlier is not null
), c as (
  select coalesce(o.record_table, n.record_table) as record_table, coalesce(o.record_id, n.record_id) as record_id,
    cast(coalesce(o.later, n.later) as integer) as snapshot_no,
    case when o.record_id is null then 'added' when n.record_id is null then 'removed' when o.h <> n.h then 'changed' end as change_type,
    o.h as old_hash, n.h as new_hash
  from old o full join new n on o.later = n.later and o.record_table = n.record_table and o.record_id = n.record_id
)
"""


def _id(column: str) -> str:
    narrow = f"translate({column}, '{orphans.WIDE}', '" + orphans.NARROW.replace("'", "''") + "')"
    return rf"nullif(upper(regexp_replace({narrow}, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g')), '')"


_P4 = f"""
with r as (
  select 'thought_cards' as card_table, card_id, created_at, unnest(representative_chunk_ids) as raw from thought_cards
  union all
  select 'creative_cards', card_id, created_at, unnest(evidence_chunk_ids) from creative_cards
), refs as (
  select card_table, card_id, {_id("raw")} as chunk_id, min(created_at) as created_at from r
  where card_id is not null and {_id("raw")} is not null group by all
), there as (
  select {_id("chunk_id")} as chunk_id, min(created_at) as came from source_chunks where chunk_id is not null group by 1
), gone as (
  select distinct {_id("chunk_id")} as chunk_id from chunk_deletions where chunk_id is not null
), f as (
  select card_table, card_id, refs.chunk_id, strftime(created_at, '%Y-%m') as period,
    case when there.chunk_id is null and gone.chunk_id is null then 'missing'
      when there.chunk_id is null then 'deleted' when came > created_at then 'late' end as reason
  from refs left join there on refs.chunk_id = there.chunk_id left join gone on refs.chunk_id = gone.chunk_id
)
"""


def _cascade_sql() -> str:
    records = " union all ".join(f"select '{t}' as tab, {_id(k)} as record_id, min(strftime(created_at, '%Y-%m')) as period from {t} group by 2" for t, k in KEYS.items())
    links = []
    for e in EDGES:
        ref = f"unnest({e.reference})" if e.child.endswith("_cards") else e.reference
        links.append(f"select tab, record_id, parent, {_id('raw')} as ref from (select '{e.child}' as tab, {_id(KEYS[e.child])} as record_id, '{e.parent}' as parent, {ref} as raw from {e.child})")
    return f"""
with recursive records as ({records}), links as (select distinct * from ({" union all ".join(links)}) where ref is not null and record_id is not null),
direct as (select distinct l.tab, l.record_id from links l left join records r on r.tab = l.parent and r.record_id = l.ref where r.record_id is null),
o as (select tab, record_id from direct union select l.tab, l.record_id from links l join o on l.parent = o.tab and l.ref = o.record_id)
select o.tab as "table", r.period, case when d.tab is null then 'inherited' else 'direct' end as kind, count(*) as records
from o left join direct d on o.tab = d.tab and o.record_id = d.record_id
left join records r on o.tab = r.tab and o.record_id = r.record_id group by all
"""


_P4_SNAPSHOTS = f"""
with recursive k as (
  select distinct snapshot_no, record_table as tab, {_id("record_id")} as id, {_id("parent_id")} as parent,
    case record_table when 'sources' then 'work_editions' when 'source_chunks' then 'sources' end as parent_table, taken_at
  from corpus_snapshots where snapshot_no is not null and record_id is not null
), records as (select snapshot_no, tab, id, min(strftime(taken_at, '%Y-%m')) as period from k group by all),
links as (select * from k where parent is not null and parent_table is not null),
direct as (select distinct l.snapshot_no, l.tab, l.id from links l left join records r on r.snapshot_no = l.snapshot_no and r.tab = l.parent_table and r.id = l.parent where r.id is null),
o as (select * from direct union select l.snapshot_no, l.tab, l.id from links l join o on l.snapshot_no = o.snapshot_no and l.parent_table = o.tab and l.parent = o.id)
select o.snapshot_no, o.tab as "table", r.period, case when d.id is null then 'inherited' else 'direct' end as kind, count(*) as records
from o left join direct d using (snapshot_no, tab, id) left join records r using (snapshot_no, tab, id) group by all
"""


SQL = {
    "p4_snapshots": _P4_SNAPSHOTS,
    "p1_found": _P1 + "select record_table, record_id, snapshot_no, change_type from c where change_type is not null",
    "p1_changes": _P1 + "select record_table, record_id, snapshot_no, old_hash, new_hash from c where change_type = 'changed'",
    "p1_totals": _P1 + "select record_table, snapshot_no, change_type, count(*) as records from c where change_type is not null group by all",
    "p4_found": _P4 + "select * from f where reason is not null",
    "p4_report": _P4 + 'select card_table, period, reason, count(*) as "references", count(distinct card_id) as cards from f where reason is not null group by all',
    "p4_cascade": _cascade_sql(),
}
