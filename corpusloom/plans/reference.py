"""Registered queries of the reference's operators over the given tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.vectors import nearest
from corpusloom.operators import chunking, mutations, quality, retrieval
from corpusloom.plans import chunking_sql
from corpusloom.runtime import broadcast_if_small, table
from corpusloom.sources import readers
from corpusloom.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _last(name: str, key: str, time: str = "updated_at") -> str:
    return f"(select * exclude (rn) from (select *, row_number() over (partition by {key} order by {time} desc) as rn from {name} where {key} is not null) where rn = 1)"


# Scans, filters, joins


@query("select source_id, title, corpus_role from sources where source_type = 'book' and status is not null")
def s1_scan_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").where("source_type = 'book' and status is not null").select("source_id", "title", "corpus_role")


@query("select count(*) as chunks from source_chunks where status = 'active' and verbatim")
def s27_count_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_chunks").where("status = 'active' and verbatim").agg(F.count("*").alias("chunks"))


@query("select chunk_id, source_id from source_chunks where source_id in (select source_id from sources where corpus_role = 'core_thought')")
def s3_key_list_semi_join(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "sources").where("corpus_role = 'core_thought'").select("source_id").distinct()
    return table(spark, d, "source_chunks").select("chunk_id", "source_id").join(broadcast_if_small(wanted, 100_000), "source_id", "left_semi").select("chunk_id", "source_id")


@query("select chunk_id, evidence_role_count from (select chunk_id, len(evidence_roles) as evidence_role_count from source_chunks where chunk_id like 'AOZORA\\_%' escape '\\' and chunk_hash not like 'sha256:%' and list_contains(evidence_roles, 'style'))")
def ref_like_and_membership(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "source_chunks")
    return c.where(F.col("chunk_id").startswith("AOZORA_") & ~F.col("chunk_hash").startswith("sha256:") & F.array_contains("evidence_roles", "style")).select("chunk_id", F.size("evidence_roles").cast("long").alias("evidence_role_count"))


@query("select chunk_id from source_chunks where list_has_any(evidence_roles, ['quote', 'definition'])")
def ref_array_overlap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_chunks").where(F.arrays_overlap("evidence_roles", F.array(F.lit("quote"), F.lit("definition")))).select("chunk_id")


@query(f"""select c.chunk_id, s.corpus_role, c.speaker_role from source_chunks c join {_last('sources', 'source_id')} s using (source_id)
left join {_last('work_editions', 'edition_id')} e on s.edition_id = e.edition_id
where s.corpus_role in ('core_thought', 'supporting_thought') and (s.edition_id is null or e.is_primary_retrieval_edition) and c.status = 'active'""")
def v4_filtered_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a logical index: by role of the source, primary editions only, sources of no edition kept."""
    sources = mutations.latest(table(spark, d, "sources").select("source_id", "corpus_role", "edition_id", "updated_at"), ["source_id"], "updated_at").drop("updated_at")
    editions = mutations.latest(table(spark, d, "work_editions").select("edition_id", "is_primary_retrieval_edition", "updated_at"), ["edition_id"], "updated_at").drop("updated_at")
    kept = sources.where(F.col("corpus_role").isin("core_thought", "supporting_thought")).join(editions, "edition_id", "left").where("edition_id is null or is_primary_retrieval_edition")
    return table(spark, d, "source_chunks").where("status = 'active'").select("chunk_id", "source_id", "speaker_role").join(kept, "source_id").select("chunk_id", "corpus_role", "speaker_role")


@query(f"select corpus_role, count(*) as chunks, count(distinct c.source_id) as sources from source_chunks c left join {_last('sources', 'source_id')} s using (source_id) group by 1")
def j1_chunks_by_source_role(spark: SparkSession, d: str) -> DataFrame:
    sources = mutations.latest(table(spark, d, "sources").select("source_id", "corpus_role", "updated_at"), ["source_id"], "updated_at")
    return table(spark, d, "source_chunks").select("source_id").join(sources, "source_id", "left").groupBy("corpus_role").agg(F.count("*").alias("chunks"), F.countDistinct("source_id").alias("sources"))


@query("""with l as (select distinct thought_id, unnest(representative_chunk_ids) as chunk_id from thought_cards where thought_id is not null),
g as (select chunk_id, array_to_string(list_sort(list(distinct thought_id)), ',') as linked from l group by 1),
c as (select chunk_id, max(array_to_string(list_sort(related_thought_ids), ',')) as related from source_chunks group by 1)
select c.chunk_id, coalesce(linked, '') as linked, coalesce(linked, '') is distinct from coalesce(related, '') as changed from c left join g using (chunk_id)""")
def a2_rebuilt_links(spark: SparkSession, d: str) -> DataFrame:
    """The derived list of thoughts of every chunk, and whether it differs from the stored one."""
    links = table(spark, d, "thought_cards").where("thought_id is not null").select("thought_id", F.explode("representative_chunk_ids").alias("chunk_id")).distinct()
    # A chunk's list holds the thoughts that name it.
    linked = links.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("thought_id")), ",").alias("linked"))
    chunks = table(spark, d, "source_chunks").groupBy("chunk_id").agg(F.max(F.array_join(F.array_sort("related_thought_ids"), ",")).alias("related"))
    now = F.coalesce("linked", F.lit(""))
    return chunks.join(linked, "chunk_id", "left").select("chunk_id", now.alias("linked"), (~now.eqNullSafe(F.coalesce("related", F.lit("")))).alias("changed"))


@query("""with e as (select distinct card_id, unnest(evidence_chunk_ids) as chunk_id from creative_cards)
select e.card_id, count(distinct c.source_id) as sources, count(distinct c.chunk_id) as chunks from e join source_chunks c using (chunk_id) group by 1""")
def j11_unnested_evidence(spark: SparkSession, d: str) -> DataFrame:
    evidence = table(spark, d, "creative_cards").select("card_id", F.explode("evidence_chunk_ids").alias("chunk_id")).distinct()
    chunks = table(spark, d, "source_chunks").select("chunk_id", "source_id").distinct()
    return evidence.join(chunks, "chunk_id").groupBy("card_id").agg(F.countDistinct("source_id").alias("sources"), F.countDistinct("chunk_id").alias("chunks"))


@query("""with a as (select unnest(['公園', '手紙', 'Lantern']) as alias, unnest(['park', 'letter', 'lantern']) as label)
select label, count(distinct chunk_id) as chunks from source_chunks join a on contains(text, alias) group by 1""")
def j8_alias_detection(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "source_chunks").select(F.col("chunk_id").alias("id"), "text")
    found = retrieval.matched_aliases(texts, [("公園", "park"), ("手紙", "letter"), ("Lantern", "lantern")])
    return found.groupBy("label").agg(F.countDistinct("id").alias("chunks"))


# Vector and full-text search, fusion

_NEAREST = """with q as (select vec_id as query_id, cast(embedding as double[]) as v from embeddings where vec_id % 50 = 0),
s as (select q.query_id, e.vec_id as id, e.label, list_cosine_similarity(q.v, cast(e.embedding as double[])) as sim from q, embeddings e),
h as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, id) as rank from s),
t as (select * from h where rank <= 20)
"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = nearest(rows, rows.where("id % 50 = 0"), 20)
    return found.join(rows.select("id", "label"), "id")


@query(_NEAREST + "select query_id, id, round(sim, 6) as similarity, rank from t")
def v1_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


_VOTES = _NEAREST + """, v as (select query_id, label, count(*) as votes, max(sim) as best, avg(sim) as mean from t group by all),
r as (select *, row_number() over (partition by query_id order by round(best, 9) desc, label) as rank from v)
"""


@query(_VOTES + "select query_id, label, votes, round(best, 6) as best, round(mean, 6) as mean, rank from r")
def a1_votes(spark: SparkSession, d: str) -> DataFrame:
    v = retrieval.votes(_hits(spark, d), "label")
    return v.select("query_id", "label", "votes", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"), F.col("rank").cast("long").alias("rank"))


@query(_VOTES + "select query_id, label, votes from r where rank = 1 and (round(best, 9) >= 0.6 or (votes >= 2 and round(best, 9) >= 0.5))")
def e8_routed(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.confident(retrieval.votes(_hits(spark, d), "label")).select("query_id", "label", "votes")


_TERMS = {"park": ["公園"], "letter": ["手紙"], "garden": ["庭", "言葉"]}


def _fts_sql(name: str, terms: list[str]) -> str:
    count = " + ".join(f"cast((length(lower(text)) - length(replace(lower(text), '{t.lower()}', ''))) / {len(t)} as integer)" for t in terms)
    every = " and ".join(f"contains(lower(text), '{t.lower()}')" for t in terms)
    return f"(select '{name}' as query, chunk_id, source_id, speaker_role, text, {count} as score from c where {every} order by score desc, chunk_id limit 40)"


_FTS = f"with c as {_last('source_chunks', 'chunk_id')}, " + ", ".join(f"{n} as {_fts_sql(n, t)}" for n, t in _TERMS.items())


def _search(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """The hits of the queries named, scored in one scan of the chunks."""
    found = retrieval.search_latest(table(spark, d, "source_chunks"), {n: _TERMS[n] for n in names}, 40, ["source_id", "speaker_role"])
    return found.select("query", "chunk_id", "source_id", F.col("speaker_role").alias("role"), "score")


@query(_FTS + " " + " union all ".join(f"select query, chunk_id, score from {n}" for n in _TERMS))
def v6_full_text(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, *_TERMS).select("query", "chunk_id", "score")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """One list of three: each query's hits are a list, the earlier one wins."""
    found = _search(spark, d, "garden", "letter", "park")
    # Ranked lists of at most 40 rows.
    placed = found.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id")))
    lists = [placed.where(F.col("query") == name).withColumn("query", F.lit("all")) for name in ("garden", "letter", "park")]
    return retrieval.merged(lists)


@query(_FTS + """, u as (select 0 as list, * from garden union all select 1, * from letter union all select 2, * from park),
k as (select *, row_number() over (partition by chunk_id order by list) as n from u)
select chunk_id, list, score, row_number() over (order by score desc, list, chunk_id) as position from k where n = 1""")
def e1_merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("chunk_id", "list", "score", F.col("position").cast("long").alias("position"))


@query(_FTS + """, u as (select 0 as list, * from garden union all select 1, * from letter union all select 2, * from park),
k as (select *, row_number() over (partition by chunk_id order by list) as n from u),
m as (select 'all' as query, chunk_id, source_id, speaker_role as role, score, list, row_number() over (order by score desc, list, chunk_id) as position from k where n = 1), """ + chunking_sql.diversified("m", "*", "chosen") + " select query, chunk_id, source_id, role, score, list, position from chosen")
def e3_diversified_evidence(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.diversified(_fused(spark, d)).withColumn("position", F.col("position").cast("long"))


# Guards: verbatim reuse

_DRAFTS = """with dr as (select distinct card_id as draft_id, summary as text from creative_cards where cast(right(card_id, 8) as integer) % 50 = 0 and summary is not null),
g as (select distinct draft_id, substr(text, i, 10) as gram from dr, lateral (select unnest(generate_series(1, length(text) - 9)) as i)),
c as (select distinct chunk_id, text from source_chunks where text is not null)
"""


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "creative_cards").where("cast(right(card_id, 8) as int) % 50 = 0 and summary is not null").select(F.col("card_id").alias("draft_id"), F.col("summary").alias("text")).distinct()


@query(_DRAFTS + "select draft_id, chunk_id as id, count(*) as grams from g join c on contains(c.text, g.gram) group by all")
def g3_shared_grams(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "source_chunks").select(F.col("chunk_id").alias("id"), "text").distinct()
    return retrieval.shared_grams(texts, _drafts(spark, d)).select("draft_id", "id", "grams")


@query(chunking_sql.similarity("select card_id as draft_id, summary as text from creative_cards where cast(right(card_id, 8) as integer) % 50 = 0 and summary is not null", "select chunk_id as id, text from source_chunks where text is not null"))
def g4_longest_common_runs(spark: SparkSession, d: str) -> DataFrame:
    """The longest common substring of each draft with the texts, from 10 characters on, its share of n-grams found in any text, and the
    verdict at 20 and 0.05; both sides without white space and punctuation."""
    texts = table(spark, d, "source_chunks").select(F.col("chunk_id").alias("id"), "text")
    return retrieval.similarity_verdicts(texts, _drafts(spark, d))


@query("select chunk_id, contains(text, '�') as replaced, contains(text, '〓') as gaiji, round((length(text) - length(replace(text, '�', ''))) / length(text), 6) as ratio from source_chunks where contains(text, '�') or contains(text, '〓')")
def ref_garble_marks(spark: SparkSession, d: str) -> DataFrame:
    lost, gaiji = F.contains("text", F.lit("�")), F.contains("text", F.lit("〓"))
    ratio = (F.length("text") - F.length(F.replace("text", F.lit("�")))) / F.length("text")
    return table(spark, d, "source_chunks").where(lost | gaiji).select("chunk_id", lost.alias("replaced"), gaiji.alias("gaiji"), F.round(ratio, 6).alias("ratio"))


# Aggregates, windows, set operations


@query("""select field, value, count(*) as records from (
select unnest(['corpus_role', 'document_genre', 'source_type']) as field, unnest([coalesce(corpus_role, 'unknown'), coalesce(document_genre, 'unknown'), coalesce(source_type, 'unknown')]) as value from sources) group by all""")
def a4_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.value_counts(table(spark, d, "sources"), ["corpus_role", "document_genre", "source_type"])


@query("""with c as (select count(*) as n, count(*) filter (text is null or text = '') as empty, count(*) filter (sha256(text) <> regexp_replace(lower(trim(chunk_hash)), '^sha256:', '')) as stale,
count(*) filter (speaker_role is null) as untagged from source_chunks)
select name, hits, round(hits / n, 6) as value, hits / n <= most as passed from (
select n, unnest(['empty', 'stale_hash', 'untagged']) as name, unnest([empty, stale, untagged]) as hits, unnest([0.01, 0.02, 0.05]) as most from c)""")
def a7_quality_report(spark: SparkSession, d: str) -> DataFrame:
    stale = F.sha2("text", 256) != F.regexp_replace(F.lower(F.trim("chunk_hash")), "^sha256:", "")
    tests = {"empty": (F.col("text").isNull() | (F.col("text") == ""), 0.01), "stale_hash": (stale, 0.02), "untagged": (F.col("speaker_role").isNull(), 0.05)}
    return quality.checks(table(spark, d, "source_chunks"), tests)


@query("""select chunk_id, copies from (select chunk_id, count(*) over (partition by chunk_hash) as copies from source_chunks where length(text) >= 30 and chunk_hash is not null) where copies > 1""")
def a8_repeated_hashes(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeated(table(spark, d, "source_chunks").select("chunk_id", "chunk_hash", "text"), "chunk_hash").select("chunk_id", "copies")


@query("""select source_id, count(*) as records, cast(sum(cast(('0x' || substr(md5(concat_ws(chr(9), coalesce(chunk_id, ''), coalesce(chunk_hash, ''))), 1, 12)) as hugeint)) as varchar) as digest from source_chunks group by 1""")
def a9_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return quality.fingerprint(table(spark, d, "source_chunks"), "source_id", "chunk_id", "chunk_hash")


@query("""with t as (select translate(regexp_replace(canonical_title, '[\\s\\p{Z}]+', '', 'g'), '""" + tx.OLD_KANJI + tx.KATAKANA + "', '" + tx.NEW_KANJI + tx.HIRAGANA + """') as norm, canonical_title, canonical_title_reading from canonical_works where canonical_title is not null)
select norm, count(*) as entries, count(distinct canonical_title) as spellings, count(distinct canonical_title_reading) > 1 as needs_review from t group by 1""")
def a11_works_by_title(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "canonical_works").where("canonical_title is not null")
    return works.groupBy(tx.folded_title(F.col("canonical_title")).alias("norm")).agg(
        F.count("*").alias("entries"), F.countDistinct("canonical_title").alias("spellings"), (F.countDistinct("canonical_title_reading") > 1).alias("needs_review")
    )


@query("""select canonical_work_id, edition_id from (select canonical_work_id, edition_id, row_number() over (partition by canonical_work_id order by
case orthography when '新字新仮名' then 0 when '新字旧仮名' then 1 when '旧字旧仮名' then 2 else 3 end, edition_id) as n from work_editions where content_sha256 is not null and canonical_work_id is not null) where n = 1""")
def a12_primary_edition(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("orthography") == "新字新仮名", 0).when(F.col("orthography") == "新字旧仮名", 1).when(F.col("orthography") == "旧字旧仮名", 2).otherwise(3)
    usable = table(spark, d, "work_editions").where("content_sha256 is not null and canonical_work_id is not null")
    return usable.groupBy("canonical_work_id").agg(F.min(F.struct(rank.alias("r"), "edition_id"))["edition_id"].alias("edition_id"))


@query("select coalesce(status, 'all') as status, count(*) as records from thought_cards where status is not null group by rollup (status)")
def a18_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "thought_cards").where("status is not null").rollup("status").agg(F.count("*").alias("records")).withColumn("status", F.coalesce("status", F.lit("all")))


@query("select split_part(source_id, '_', 1) as prefix, count(*) as records, max(source_id) as last_id from sources where source_id is not null group by 1")
def a19_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").where("source_id is not null").groupBy(F.split_part("source_id", F.lit("_"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("records"), F.max("source_id").alias("last_id"))


@query("select coalesce(lang, 'all') as lang, coalesce(doc_kind, 'all') as doc_kind, count(*) as documents from (select lower(lang) as lang, doc_kind from documents where lang is not null and doc_kind is not null) group by cube (lang, doc_kind)")
def a33_cube(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang is not null and doc_kind is not null").select(F.lower("lang").alias("lang"), "doc_kind")
    counted = docs.cube("lang", "doc_kind").agg(F.count("*").alias("documents"))
    return counted.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("doc_kind", F.lit("all")).alias("doc_kind"), "documents")


@query("""select card_id, thought_id, version from (select card_id, thought_id, version, row_number() over (partition by thought_id order by version desc, updated_at desc, card_id) as n from thought_cards where thought_id is not null) where n = 1""")
def w1_latest_version(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "thought_cards").where("thought_id is not null")
    # Of equal versions and times the smallest id: a second step, over the ties only.
    order = ["version", "updated_at"]
    best = cards.groupBy("thought_id").agg(F.max(F.struct(*order)).alias("b")).select("thought_id", "b.*")
    return cards.join(best, ["thought_id", *order]).groupBy("thought_id", "version").agg(F.min("card_id").alias("card_id")).select("card_id", "thought_id", "version")


@query("""select chunk_id, cast(sum(length(text) + 1) over (partition by source_id, chapter_id order by chunk_id, updated_at rows between unbounded preceding and 1 preceding) as bigint) as char_offset,
row_number() over (partition by source_id, chapter_id order by chunk_id, updated_at) as number from source_chunks where text is not null and chapter_id is not null""")
def w5_running_offsets(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "source_chunks").where("text is not null and chapter_id is not null").withColumns({"size": F.length("text") + 1, "one": F.lit(1)})
    summed = chunking.running_totals(chunks, ["source_id", "chapter_id"], ["chunk_id", "updated_at"], F.substring("chunk_id", 1, 21), ["size", "one"])
    before = F.col("size_total") - F.col("size")
    return summed.select("chunk_id", F.when(F.col("one_total") > 1, before).alias("char_offset"), F.col("one_total").alias("number"))


@query("""with l as (select source_id, chapter_id, chunk_id, updated_at, sum(length(text) + 1) over (partition by source_id, chapter_id order by chunk_id, updated_at rows unbounded preceding) as used from source_chunks where text is not null and chapter_id is not null)
select chunk_id, cast(used as bigint) as used from l where used <= 1200""")
def t37_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "source_chunks").where("text is not null and chapter_id is not null")
    return chunking.budget_prefix(chunks, ["source_id", "chapter_id"], ["chunk_id", "updated_at"], F.substring("chunk_id", 1, 21), 1200).select("chunk_id", "used")


@query("""with n as (select min(snapshot_no) as a, max(snapshot_no) as b from corpus_snapshots)
select record_table, record_id from corpus_snapshots, n where snapshot_no = b except select record_table, record_id from corpus_snapshots, n where snapshot_no = a""")
def u4_except(spark: SparkSession, d: str) -> DataFrame:
    """What the last snapshot has and the first has not."""
    s = table(spark, d, "corpus_snapshots")
    first, last = s.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    return s.where(F.col("snapshot_no") == last).select("record_table", "record_id").subtract(s.where(F.col("snapshot_no") == first).select("record_table", "record_id"))


@query("select chunk_id from source_chunks intersect select chunk_id from chunk_deletions")
def u3_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_chunks").select("chunk_id").intersect(table(spark, d, "chunk_deletions").select("chunk_id"))


@query("select source_id from source_chunks where source_id is not null union select source_id from parsed_chunks where source_id is not null")
def u2_union(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "source_chunks").select("source_id").union(table(spark, d, "parsed_chunks").select("source_id"))
    return both.where("source_id is not null").distinct()


@query("select doc_id, title from documents order by added_at desc nulls last, doc_id offset 20 limit 10")
def o5_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").orderBy(F.desc_nulls_last("added_at"), "doc_id").offset(20).limit(10).select("doc_id", "title")


# Mutations


@query(f"""with o as {_last('source_chunks', 'chunk_id')}, n as {_last('parsed_chunks', 'chunk_id', 'parsed_at')}
select coalesce(o.chunk_id, n.chunk_id) as chunk_id, case when o.chunk_id is null then 'new' when n.chunk_id is null then 'stale' when o.chunk_hash is distinct from n.chunk_hash then 'changed' else 'unchanged' end as change
from o full join n on o.chunk_id = n.chunk_id""")
def st6_captured_changes(spark: SparkSession, d: str) -> DataFrame:
    old = mutations.latest(table(spark, d, "source_chunks").select("chunk_id", "updated_at", "chunk_hash"), ["chunk_id"], "updated_at")
    new = mutations.latest(table(spark, d, "parsed_chunks").select("chunk_id", "parsed_at", "chunk_hash"), ["chunk_id"], "parsed_at")
    return mutations.captured_changes(old, new, "chunk_id", "chunk_hash")


@query(f"select source_id, title, corpus_role from {_last('sources', 'source_id')}")
def s19_latest_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sources").select("source_id", "updated_at", "title", "corpus_role")
    return mutations.latest(rows, ["source_id"], "updated_at").select("source_id", "title", "corpus_role")


@query(f"""with o as {_last('source_chunks', 'chunk_id')}, n as {_last('parsed_chunks', 'chunk_id', 'parsed_at')}
select coalesce(o.chunk_id, n.chunk_id) as chunk_id, case when n.chunk_id is not null then n.chunk_hash else o.chunk_hash end as chunk_hash, o.speaker_role from o full join n on o.chunk_id = n.chunk_id""")
def s19_partial_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = mutations.latest(table(spark, d, "source_chunks").select("chunk_id", "updated_at", "chunk_hash", "speaker_role"), ["chunk_id"], "updated_at").drop("updated_at")
    new = mutations.latest(table(spark, d, "parsed_chunks").select("chunk_id", "parsed_at", "chunk_hash"), ["chunk_id"], "parsed_at")
    return mutations.upsert(old, new, ["chunk_id"], ["chunk_hash"])


@query(f"""with o as {_last('source_chunks', 'chunk_id')}, n as {_last('parsed_chunks', 'chunk_id', 'parsed_at')}
select chunk_id, chunk_hash from o union all select chunk_id, chunk_hash from n where chunk_id not in (select chunk_id from o)""")
def s21_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = mutations.latest(table(spark, d, "source_chunks").select("chunk_id", "updated_at", "chunk_hash"), ["chunk_id"], "updated_at").drop("updated_at")
    new = mutations.latest(table(spark, d, "parsed_chunks").select("chunk_id", "parsed_at", "chunk_hash"), ["chunk_id"], "parsed_at").drop("parsed_at")
    return mutations.insert_ignore(old, new, ["chunk_id"])


@query("select chunk_id, source_id from source_chunks where source_id not in (select source_id from chunk_deletions where source_id is not null) or source_id is null")
def s23_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    return mutations.delete_cascade(table(spark, d, "source_chunks").select("chunk_id", "source_id"), table(spark, d, "chunk_deletions").where("source_id is not null"), "source_id").select("chunk_id", "source_id")


@query("select doc_id, case when source = 'salon_minutes' then null else title end as title, case when source = 'salon_minutes' then 'sha256:' || sha256(text) else text end as text from documents")
def t40_erased(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "title", "text")
    return mutations.erased(docs, F.col("source") == "salon_minutes", ["title"], ["text"]).select("doc_id", "title", "text")


# Texts


@query(r"""with a as (select doc_id, text from documents where doc_kind = 'annotated_file' and text is not null)
select doc_id, len(regexp_extract_all(text, '［＃[^］]*］')) as notes, len(regexp_extract_all(text, '《[^《》\n]+》')) as readings,
length(regexp_replace(regexp_replace(regexp_replace(text, '［＃[^］]*］', '', 'g'), '｜([^｜《》\n]+)《([^《》\n]+)》', '\1', 'g'), '《[^《》\n]+》', '', 'g')) as plain_chars from a""")
def t23_ruby_and_notes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_kind = 'annotated_file' and text is not null")
    count = lambda pattern: F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).cast("long")
    return docs.select("doc_id", count(tx.NOTE).alias("notes"), count("《[^《》\\n]+》").alias("readings"), F.length(tx.without_ruby(tx.without_notes(F.col("text")))).cast("long").alias("plain_chars"))


@query("""with n as (select unnest(regexp_extract_all(text, '［＃[^］]*］')) as note from documents where doc_kind = 'annotated_file')
select case when regexp_matches(note, '傍点|太字|強調') then 'emphasis_note' when regexp_matches(note, '水準|Unicode|unicode') then 'gaiji_note' when regexp_matches(note, '字下げ|見出し|地から|改丁|改ページ|字上げ') then 'formatting_note'
when contains(note, 'ページ') then 'page_note' when regexp_matches(note, '底本|ママ') then 'original_text_note' else 'editorial_note' end as kind, count(*) as notes from n group by 1""")
def t25_note_kinds(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "documents").where("doc_kind = 'annotated_file'").select(F.explode(F.regexp_extract_all("text", F.lit(tx.NOTE), F.lit(0))).alias("note"))
    return notes.groupBy(tx.note_kind(F.col("note")).alias("kind")).agg(F.count("*").alias("notes"))


@query(r"""select doc_id, regexp_replace(regexp_replace(text, '｜([^｜《》\n]+)《([^《》\n]+)》', '\1（\2）', 'g'), '([一-鿿々〆ヶ]+)《([^《》\n]+)》', '\1（\2）', 'g') as displayed from documents where doc_kind = 'annotated_file' and text is not null""")
def t24_displayed_ruby(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_kind = 'annotated_file' and text is not null").select("doc_id", tx.displayed_ruby(F.col("text")).alias("displayed"))


@query("select chunk_id, sha256(text) as digest, sha256('v1:' || text) as versioned, 'c_' || substr(sha256(concat_ws(':', source_id, chunk_id)), 1, 12) as stable_id from source_chunks where text is not null and source_id is not null")
def t20_hashes_and_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "source_chunks").where("text is not null and source_id is not null")
    return c.select("chunk_id", F.sha2("text", 256).alias("digest"), F.sha2(F.concat(F.lit("v1:"), "text"), 256).alias("versioned"), tx.hashed_id("c_", F.col("source_id"), F.col("chunk_id")).alias("stable_id"))


@query(chunking_sql.BOOK)
def t15_book_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.book_chunks(table(spark, d, "documents").where("doc_kind = 'book_text'"))


_TURNS = r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as raw from documents where doc_kind = 'qa_transcript' and text is not null),
t as (select doc_id, line, raw, regexp_extract(raw, '^[\s\p{Z}]*([^：:\s]{1,20}?)\s*[：:]', 1) as label from l where regexp_replace(raw, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') <> ''),
s as (select doc_id, line, case when label in ('本人発言', '本人', 'Self') then 'self' when label in ('質問者', '聞き手', 'Interviewer') then 'other' end as speaker,
case when label in ('本人発言', '本人', 'Self', '質問者', '聞き手', 'Interviewer') then regexp_replace(raw, '^[^：:]*[：:]\s*', '') else regexp_replace(raw, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') end as said from t),
h as (select doc_id, line, said, coalesce(last_value(speaker ignore nulls) over (partition by doc_id order by line rows unbounded preceding), 'self') as speaker from s),
n as (select *, case when lag(speaker) over (partition by doc_id order by line) = speaker then 0 else 1 end as fresh from h),
r as (select *, sum(fresh) over (partition by doc_id order by line rows unbounded preceding) as run from n)
select doc_id, cast(run as bigint) as run, speaker, cast(min(line) as integer) as first_line, count(*) as lines, cast(sum(length(said)) as bigint) as chars from r group by doc_id, run, speaker"""


@query(_TURNS)
def t19_speaker_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_kind = 'qa_transcript' and text is not null")
    return chunking.speaker_runs(chunking.turns(docs, ["本人発言", "本人", "Self"], ["質問者", "聞き手", "Interviewer"]))


@query(r"""select doc_id, trim(regexp_extract(text, '(?s)\ntitle:([^\n]*)', 1)) as title, trim(regexp_extract(text, '(?s)\nimportance:([^\n]*)', 1)) as importance, length(trim(regexp_extract(text, '(?s)\n\s*text:\s*(.*)$', 1))) as chars from documents where doc_kind = 'card_note' and text is not null""")
def s14_card_records(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "documents").where("doc_kind = 'card_note' and text is not null").select("doc_id", F.regexp_replace("text", "^=== [A-Z_]+ ===", "").alias("block"))
    r = readers.parsed_records(blocks)
    return r.select("doc_id", F.coalesce(F.col("fields")["title"], F.lit("")).alias("title"), F.coalesce(F.col("fields")["importance"], F.lit("")).alias("importance"), F.length("body").cast("long").alias("chars"))


@query("""select edition_id, json_extract_string(bottom_text, '$."底本名"') as parent, try_cast(regexp_extract(json_extract_string(bottom_text, '$."底本初版発行年"'), '[0-9]{4}', 0) as integer) as parent_year from work_editions where json_valid(bottom_text)""")
def t34_json_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "work_editions")
    parsed = e.withColumn("j", F.from_json("bottom_text", "map<string,string>")).where("j is not null")
    return parsed.select("edition_id", F.col("j")["底本名"].alias("parent"), F.expr("try_cast(regexp_extract(j['底本初版発行年'], '[0-9]{4}', 0) as int)").alias("parent_year"))


@query(r"""select canonical_work_id, coalesce(nullif(regexp_replace(regexp_replace(lower(canonical_title), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'untitled') as slug,
regexp_matches(canonical_title, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]') as japanese from canonical_works where canonical_title is not null""")
def t35_slugs(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "canonical_works").where("canonical_title is not null")
    return w.select("canonical_work_id", tx.slug(F.col("canonical_title"), "untitled").alias("slug"), tx.has_japanese(F.col("canonical_title")).alias("japanese"))


@query(
    f"""select canonical_work_id, translate(regexp_replace({chunking_sql.nfkc("canonical_title")}, '[\\s\\p{{Z}}\\x{{85}}]+', '', 'g'), '{tx.OLD_KANJI + tx.KATAKANA}', '{tx.NEW_KANJI + tx.HIRAGANA}') as folded,
{chunking_sql.without_noise(chunking_sql.nfkc("canonical_title"))} as bare from canonical_works where canonical_title is not null"""
)
def t2_folded_titles(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "canonical_works").where("canonical_title is not null")
    return w.select("canonical_work_id", tx.folded_title(tx.nfkc("canonical_title")).alias("folded"), tx.without_noise(tx.nfkc("canonical_title")).alias("bare"))


# Streams


@query("select time_bucket(interval '6 hours', ts) as window_start, event_type, count(*) as events from events group by all")
def st11_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over the events as one batch."""
    events = table(spark, d, "events")
    return jobs.windowed_counts(events, "6 hours", "40 days").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


@query("select time_bucket(interval '6 hours', ts) as window_start, event_type, count(*) as events, round(sum(value), 2) as total from events where ts is not null group by all")
def st11_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows through a stream: every batch counts its own rows, and the counts are summed, however late or early rows come."""
    found = jobs.run_merged(jobs.table_stream(spark, d, "events"), "windows", lambda rows: jobs.windowed_counts(rows, "6 hours", "1 hour"), jobs.summed_counts)
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 2).alias("total"))


@query("""with s as (select event_type, value, unnest([time_bucket(interval '2 hours', ts), time_bucket(interval '2 hours', ts) - interval '2 hours', time_bucket(interval '2 hours', ts) - interval '4 hours']) as window_start from events where ts is not null)
select window_start, event_type, count(*) as events from s group by all""")
def st11_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of six hours, every two hours."""
    found = jobs.windowed_counts(table(spark, d, "events"), "6 hours", "40 days", "2 hours")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval '12 hours' then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g)
select user_id, min(ts) as session_start, max(ts) + interval '12 hours' as session_end, count(*) as events from s group by user_id, n""")
def st11_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = jobs.sessions(table(spark, d, "events"), "12 hours", "1 day")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events")


@query("select distinct snapshot_no, record_table, record_id, delivered_at as delivered from corpus_snapshots")
def st6_stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot rows through a stream, without those sent twice, however far apart."""

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.select("snapshot_no", "record_table", "record_id", F.col("delivered_at").alias("delivered")).distinct()

    return jobs.run_merged(jobs.table_stream(spark, d, "corpus_snapshots"), "changes", distinct, lambda parts: parts.distinct())


@query("select user_id, max(ts) as last_ts, count(*) as events from events where user_id is not null and ts is not null group by 1")
def st3_last_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    return e.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("events"))


@query("select user_id, max(ts) as last_ts, count(*) as events from events where user_id is not null and ts is not null group by 1")
def st3_stream_state(spark: SparkSession, d: str) -> DataFrame:
    """The same from keyed state of a stream."""
    return jobs.last_states(jobs.table_stream(spark, d, "events"), "heartbeats").withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))
