"""Further queries of the reference's operators: as-of lookups, windows, text structure, relational core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import chunking, quality
from corpusloom.plans import chunking_sql
from corpusloom.plans import reference as ref
from corpusloom.runtime import broadcast_if_small, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query("select source_id from sources where contains(lower(concat_ws(' ', title, document_genre, corpus_role)), 'essay')")
def ref_any_column_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").where(F.contains(F.lower(F.concat_ws(" ", "title", "document_genre", "corpus_role")), F.lit("essay"))).select("source_id")


@query("select chunk_id from source_chunks where verbatim and list_contains(evidence_roles, 'style')")
def ref_verbatim_of_role(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_chunks").where(F.col("verbatim") & F.array_contains("evidence_roles", "style")).select("chunk_id")


@query("""select distinct chunk_id from source_chunks c where (tag_confidence is null or sha256(text) is distinct from chunk_hash)
and not exists (select 1 from (select unnest(representative_chunk_ids) as x from thought_cards) where x = c.chunk_id)""")
def ref_chunks_that_need_work(spark: SparkSession, d: str) -> DataFrame:
    doubtful = F.col("tag_confidence").isNull() | ~F.sha2("text", 256).eqNullSafe(F.col("chunk_hash"))
    cited = table(spark, d, "thought_cards").select(F.explode("representative_chunk_ids").alias("chunk_id")).distinct()
    return table(spark, d, "source_chunks").where(doubtful).select("chunk_id").distinct().join(cited, "chunk_id", "left_anti")


@query("""select source_id, chunk_id, cast(n as integer) as number from (select source_id, chunk_id, row_number() over (partition by source_id order by created_at, chunk_id) as n from (select distinct source_id, chunk_id, created_at from source_chunks)) where n <= 3""")
def w3_first_examples(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy(F.asc_nulls_last("created_at"), "chunk_id")
    chunks = table(spark, d, "source_chunks").select("source_id", "chunk_id", "created_at").distinct()
    return chunks.withColumn("number", F.row_number().over(order)).where("number <= 3").select("source_id", "chunk_id", "number")


@query("""with r as (select source_id, char_start, max(source_page) as source_page from source_chunks where source_id is not null and char_start is not null and source_page is not null group by all)
select l.chunk_id, l.source_id, l.char_start, r.source_page as source_page_at from (select distinct chunk_id, source_id, char_start from parsed_chunks where source_id is not null and char_start is not null) l
asof left join r on l.source_id = r.source_id and l.char_start >= r.char_start""")
def j10_page_of_offset(spark: SparkSession, d: str) -> DataFrame:
    """The page on which a parsed chunk begins: the last page known at or before its offset."""
    left = table(spark, d, "parsed_chunks").where("source_id is not null and char_start is not null").select("chunk_id", "source_id", "char_start").distinct()
    return chunking.as_of(left, table(spark, d, "source_chunks").select("source_id", "char_start", "source_page"), "source_id", "char_start", "source_page", 10_000)


@query("""select thought_id, count(distinct chunk_id) as chunks, count(distinct card_id) as cards from (select thought_id, card_id, unnest(representative_chunk_ids) as chunk_id from thought_cards) where thought_id is not null and chunk_id is not null group by 1 having count(distinct chunk_id) >= 2""")
def a13_evidence_by_thought(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "thought_cards").where("thought_id is not null").select("thought_id", "card_id", F.explode("representative_chunk_ids").alias("chunk_id")).where("chunk_id is not null")
    return cited.groupBy("thought_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("card_id").alias("cards")).where("chunks >= 2")


@query("""with u as (select distinct card_id, unnest(evidence_chunk_ids) as chunk_id from creative_cards), m as (select distinct card_id from u where chunk_id is not null and chunk_id not in (select chunk_id from source_chunks))
select distinct card_id, card_id not in (select card_id from m) as complete from creative_cards""")
def u5_subset(spark: SparkSession, d: str) -> DataFrame:
    """Whether all evidence of a card is there."""
    cards = table(spark, d, "creative_cards")
    cited = cards.select("card_id", F.explode("evidence_chunk_ids").alias("chunk_id")).where("chunk_id is not null")
    lacking = cited.join(table(spark, d, "source_chunks").select("chunk_id").distinct(), "chunk_id", "left_anti").select("card_id").distinct().withColumn("lacks", F.lit(True))
    return cards.select("card_id").distinct().join(lacking, "card_id", "left").select("card_id", F.col("lacks").isNull().alias("complete"))


@query("""with a as (select parent_id, count(*) as n from corpus_snapshots where snapshot_no = (select min(snapshot_no) from corpus_snapshots) group by 1), b as (select parent_id, count(*) as n from corpus_snapshots where snapshot_no = (select max(snapshot_no) from corpus_snapshots) group by 1)
select coalesce(a.parent_id, b.parent_id) as parent_id, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after from a full join b on a.parent_id = b.parent_id where a.n is distinct from b.n and coalesce(a.parent_id, b.parent_id) is not null""")
def u6_count_differences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "corpus_snapshots")
    first, last = s.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    n = s.where("parent_id is not null").groupBy("parent_id").agg(F.count_if(F.col("snapshot_no") == first).alias("before"), F.count_if(F.col("snapshot_no") == last).alias("after"))
    return n.where("before <> after")


@query("select person_id, min(created_at) as created_at, arg_min(card_id, (created_at, card_id)) as card_id from thought_cards where status = 'draft' and created_at is not null group by 1")
def o3_oldest_draft(spark: SparkSession, d: str) -> DataFrame:
    drafts = table(spark, d, "thought_cards").where("status = 'draft' and created_at is not null")
    return drafts.groupBy("person_id").agg(F.min(F.struct("created_at", "card_id")).alias("x")).select("person_id", "x.created_at", "x.card_id")


@query("""select source, doc_id from (select source, doc_id, row_number() over (partition by source order by added_at desc nulls last, doc_id) as n from documents where source is not null) where n <= 6""")
def e21_recent_per_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null").select("source", "doc_id", "added_at")
    order = Window.partitionBy("source").orderBy(F.desc_nulls_last("added_at"), "doc_id")
    return docs.withColumn("n", F.row_number().over(order)).where("n <= 6").select("source", "doc_id")


@query(r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as raw from documents where doc_kind = 'book_text' and text is not null)
select doc_id, cast(line as integer) as line, length(regexp_extract(raw, '^(#+)', 1)) as level, regexp_replace(raw, '^#+\s*', '') as title from l where regexp_matches(raw, '^#{1,2}\s')""")
def t10_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("doc_kind = 'book_text'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return lines.where(F.col("raw").rlike(r"^#{1,2}\s")).select("doc_id", "line", F.length(F.regexp_extract("raw", "^(#+)", 1)).cast("long").alias("level"), F.regexp_replace("raw", r"^#+\s*", "").alias("title"))


@query(r"""select doc_id, regexp_replace(regexp_replace(text, '(?m)^\[\d{1,2}:\d{2}(:\d{2})?\]\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as text from documents where doc_kind = 'qa_transcript' and text is not null""")
def t29_without_timestamps(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_kind = 'qa_transcript' and text is not null")
    return docs.select("doc_id", F.regexp_replace(F.regexp_replace("text", r"(?m)^\[\d{1,2}:\d{2}(:\d{2})?\]\n?", ""), r"\n{3,}", "\n\n").alias("text"))


@query(r"""select doc_id, trim(regexp_extract(text, '底本：([^\n]*)', 1)) as parent, regexp_extract(text, '入力：([^\n]*)', 1) as typed_by, length(split_part(text, '底本：', 1)) as body_chars from documents where doc_kind = 'annotated_file' and contains(text, '底本：')""")
def t22_colophon(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_kind = 'annotated_file' and contains(text, '底本：')")
    return docs.select("doc_id", F.trim(F.regexp_extract("text", r"底本：([^\n]*)", 1)).alias("parent"), F.regexp_extract("text", r"入力：([^\n]*)", 1).alias("typed_by"), F.length(F.split_part("text", F.lit("底本："), F.lit(1))).cast("long").alias("body_chars"))


@query("select card_id, unnest(list_transform(list_filter(string_split(core_claim, '。'), lambda x: trim(x) <> ''), lambda x: x || '。')) as sentence from (select distinct card_id, core_claim from thought_cards where core_claim is not null)")
def t38_sentences(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "thought_cards").where("core_claim is not null").select("card_id", "core_claim").distinct()
    parts = F.filter(F.split("core_claim", "。"), lambda x: F.trim(x) != "")
    return cards.select("card_id", F.explode(F.transform(parts, lambda x: F.concat(x, F.lit("。")))).alias("sentence"))


@query("""select chunk_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '「[^」]*」'), lambda x: length(x))), 0) as quoted, length(text) as chars from source_chunks where text is not null and contains(text, '「')""")
def g12_quoted_share(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "source_chunks").where("text is not null and contains(text, '「')")
    quoted = F.aggregate(F.regexp_extract_all("text", F.lit("「[^」]*」"), F.lit(0)), F.lit(0), lambda n, x: n + F.length(x))
    return c.select("chunk_id", quoted.cast("long").alias("quoted"), F.length("text").cast("long").alias("chars"))


@query(ref._FTS + """ select chunk_id, score, row_number() over (order by coalesce(speaker_role = 'author_direct', false) desc, score desc, chunk_id) as position from garden""")
def e2_direct_first(spark: SparkSession, d: str) -> DataFrame:
    direct = F.coalesce(F.col("role") == "author_direct", F.lit(False))
    found = ref._search(spark, d, "garden")
    # One ranked list, at most 40 rows.
    order = Window.partitionBy("query").orderBy(F.desc(direct), F.desc("score"), "chunk_id")
    return found.select("chunk_id", "score", F.row_number().over(order).cast("long").alias("position"))


@query("select term, count(*) filter (contains(text, term)) > 0 as found from documents, (select unnest(['公園', '羅生門', 'harbour']) as term) group by 1")
def v9_subject_probe(spark: SparkSession, d: str) -> DataFrame:
    terms = ["公園", "羅生門", "harbour"]
    one = table(spark, d, "documents").agg(*[F.coalesce(F.bool_or(F.contains("text", F.lit(t))), F.lit(False)).alias(f"t{k}") for k, t in enumerate(terms)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{k}").alias("found")) for k, t in enumerate(terms)])).alias("x")).select("x.*")


@query(ref._VOTES + "select count(*) as queries, round(avg(case when r.label = e.label then 1.0 else 0.0 end), 6) as accuracy from r join embeddings e on e.vec_id = r.query_id where r.rank = 1")
def a22_routing_accuracy(spark: SparkSession, d: str) -> DataFrame:
    first = ref.retrieval.votes(ref._hits(spark, d), "label").where("rank = 1")
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return first.join(own, "query_id").agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("label") == F.col("own"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query(chunking_sql.CORPUS)
def t28_paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Essays, letters and annotated files; fiction is what a source of the same work calls a novel, short story or sketch."""
    docs = table(spark, d, "documents").where("doc_kind in ('essay', 'letter', 'annotated_file')")
    told = table(spark, d, "sources").where("document_genre in ('novel', 'short_story', 'sketch')").select("edition_id")
    works = table(spark, d, "work_editions").join(told, "edition_id", "left_semi").where("canonical_work_id is not null").select("canonical_work_id").distinct()
    marked = docs.join(broadcast_if_small(works.withColumn("fiction", F.lit(True)), 1_000_000), "canonical_work_id", "left")
    return chunking.corpus_chunks(marked, F.col("doc_kind") == "annotated_file", F.col("fiction"))


@query("""select o_custkey, o_orderkey, rank() over w as position, ntile(4) over w as quarter, round(coalesce(o_totalprice - lag(o_totalprice) over w, 0), 2) as step from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)""")
def w12_ranks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    step = F.round(F.coalesce(F.col("o_totalprice") - F.lag("o_totalprice").over(w), F.lit(0.0)), 2)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("position"), F.ntile(4).over(w).cast("long").alias("quarter"), step.alias("step"))


@query("""select n_name, o_orderpriority, count(distinct o_orderkey) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey where l_shipdate >= timestamp '1995-01-01' and l_returnflag <> 'R' group by all""")
def j4_multiway_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz '1995-01-01 00:00:00' and l_returnflag <> 'R'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    buyers = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name", "o_orderpriority").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("""with h as (select source_id, count(*) as chunks, count(*) filter (status = 'disabled') > 0 as disabled from source_chunks where source_id is not null group by 1)
select s.source_id, s.title, coalesce(h.chunks, 0) as chunks, coalesce(h.disabled, false) as disabled from """ + ref._last("sources", "source_id") + """ s left join h using (source_id)""")
def c26_source_overview(spark: SparkSession, d: str) -> DataFrame:
    sources = quality.first_of(table(spark, d, "sources").where("source_id is not null"), ["source_id"], "updated_at").select("source_id", "title")
    seen = table(spark, d, "source_chunks").where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("chunks"), (F.count_if(F.col("status") == "disabled") > 0).alias("disabled"))
    return sources.join(seen, "source_id", "left").select("source_id", "title", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("disabled", F.lit(False)).alias("disabled"))
