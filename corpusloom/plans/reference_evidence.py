"""Registered queries of evidence: linked, vector and keyword hits, their fusion, selection and judgement, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import nearest
from corpusloom.operators import mutations, retrieval
from corpusloom.plans import chunking_sql
from corpusloom.plans import reference as ref
from corpusloom.plans.registering import Registered
from corpusloom.runtime import table

query = Registered()
QUERIES, SQL = query.queries, query.sql

# Vectors


@query("""with q as (select vec_id as query_id, label, cast(embedding as double[]) as v from embeddings where vec_id % 50 = 0),
h as (select q.query_id, e.vec_id as id, list_cosine_similarity(q.v, cast(e.embedding as double[])) as sim from q join embeddings e on e.label in (q.label, (q.label + 1) % 10)),
r as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, id) as rank from h)
select query_id, id, round(sim, 6) as similarity, rank from r where rank <= 20""")
def v2_nearest_of_tags(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rows among those that share a tag with the query."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    asked = rows.where("id % 50 = 0").withColumn("tags", F.array("label", ((F.col("label") + 1) % 10).cast("int")))
    found = nearest(rows.withColumn("tags", F.array("label")), asked, 20)
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(ref._NEAREST + "select query_id, count(*) filter (sim >= 0.4) as relevant, count(*) as hits from t group by 1")
def p14_relevant_hits(spark: SparkSession, d: str) -> DataFrame:
    return ref._hits(spark, d).groupBy("query_id").agg(F.count_if(F.col("similarity") >= 0.4).alias("relevant"), F.count("*").alias("hits"))


@query(ref._NEAREST + "select query_id, id, floor(round(sim, 9) * 1000 + 0.5) / 1000 as score, label from t where rank <= 3")
def e15_top_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first hits with scores of three digits."""
    score = F.floor(F.round("similarity", 9) * 1000 + 0.5) / 1000
    return ref._hits(spark, d).where("rank <= 3").select("query_id", "id", score.alias("score"), "label")


@query(ref._VOTES + "select query_id, label, rank from r where rank in (2, 3) and round(best, 9) >= 0.5")
def w9_secondary_routes(spark: SparkSession, d: str) -> DataFrame:
    voted = retrieval.votes(ref._hits(spark, d), "label")
    return voted.where((F.col("rank") > 1) & (F.col("rank") <= 3) & (F.round("best", 9) >= 0.5)).select("query_id", "label", F.col("rank").cast("long").alias("rank"))


# Evidence of cards: every card whose number is divisible by 50 asks with the first word of its title

_CHUNKS, _SOURCES = ref._last("source_chunks", "chunk_id"), ref._last("sources", "source_id")
_CARDS = f"""with cards as {ref._last("thought_cards", "card_id")}, chunks as {_CHUNKS}, sources as {_SOURCES},
q as (select card_id as query, thought_id, person_id, core_claim, string_split(title, 'と') as terms from cards where cast(right(card_id, 8) as integer) % 50 = 0 and title is not null),
term as (select distinct query, person_id, unnest(terms[1:1]) as term from q), wanted as (select query, person_id, term, count(*) over (partition by query) as n from term where term <> ''),
k as (select w.query, w.person_id, c.chunk_id, c.source_id, c.speaker_role, c.person_id as chunk_person, sum(cast((length(text) - length(replace(text, term, ''))) / length(term) as bigint)) as score
from wanted w join chunks c on contains(c.text, w.term) group by all having count(*) = any_value(w.n))
"""
_LINKED = """, links as (select distinct thought_id, importance, unnest(representative_chunk_ids) as chunk_id from thought_cards where status = 'approved' and thought_id is not null),
linked as (select l.thought_id, c.chunk_id, c.source_id, c.speaker_role, s.corpus_role, max(case importance when 'high' then 1.0 when 'medium' then 0.8 when 'low' then 0.6 else 0.7 end) as score
from links l join chunks c on l.chunk_id = c.chunk_id join sources s on c.source_id = s.source_id where c.status = 'active' group by all)
"""
_RANKED = """, ranked as (select query, k.chunk_id, k.source_id, k.speaker_role, s.corpus_role, k.score, row_number() over (partition by query order by k.score desc, k.chunk_id) as position from k left join sources s on k.source_id = s.source_id),
hits as (select * from ranked where position <= 40)
"""
_MERGED = _RANKED + _LINKED + """, lists as (select 0 as list, q.query, l.chunk_id, l.source_id, l.speaker_role, l.corpus_role, cast(l.score as double) as score from linked l join q using (thought_id)
union all select 1, query, chunk_id, source_id, speaker_role, corpus_role, cast(score as double) from hits),
first as (select * exclude (n) from (select *, row_number() over (partition by query, chunk_id order by list) as n from lists) where n = 1),
merged as (select *, row_number() over (partition by query order by score desc, list, chunk_id) as position from first)
"""
_DIRECT = "(coalesce(speaker_role not in ('character', 'narrator', 'quoted_person'), true) and coalesce(corpus_role not in ('narrative_reference', 'character_judgment', 'style_reference'), true))"


def _sources(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return mutations.latest(table(spark, d, "sources").select("source_id", "updated_at", *columns), ["source_id"], "updated_at").drop("updated_at")


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """(query, thought_id, person_id, core_claim, terms)"""
    cards = mutations.latest(table(spark, d, "thought_cards").select("card_id", "updated_at", "thought_id", "person_id", "core_claim", "title"), ["card_id"], "updated_at")
    asked = cards.where("cast(right(card_id, 8) as int) % 50 = 0 and title is not null")
    return asked.select(F.col("card_id").alias("query"), "thought_id", "person_id", "core_claim", F.slice(F.split("title", "と"), 1, 1).alias("terms"))


def _keyword(spark: SparkSession, d: str, k: int = 40, same: tuple[str, ...] = ()) -> DataFrame:
    chunks = table(spark, d, "source_chunks").select("chunk_id", "updated_at", "source_id", "speaker_role", "person_id", "text")
    found = retrieval.keyword_hits(chunks, _cards(spark, d), k, same)
    return found.join(_sources(spark, d, "corpus_role"), "source_id", "left")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """(thought_id, chunk_id, source_id, speaker_role, corpus_role, score) of approved links to active chunks."""
    cards = table(spark, d, "thought_cards").where("status = 'approved' and thought_id is not null")
    links = cards.select("thought_id", "importance", F.explode("representative_chunk_ids").alias("chunk_id")).distinct()
    weight = F.when(F.col("importance") == "high", 1.0).when(F.col("importance") == "medium", 0.8).when(F.col("importance") == "low", 0.6).otherwise(0.7)
    links = links.groupBy("thought_id", "chunk_id").agg(F.max(weight).alias("score"))
    chunks = mutations.latest(table(spark, d, "source_chunks").select("chunk_id", "updated_at", "source_id", "speaker_role", "status"), ["chunk_id"], "updated_at")
    found = links.join(chunks.where("status = 'active'"), "chunk_id").join(_sources(spark, d, "corpus_role"), "source_id")
    return found.select("thought_id", "chunk_id", "source_id", "speaker_role", "corpus_role", "score")


_EVIDENCE = ["query", "chunk_id", "source_id", "speaker_role", "corpus_role", "score", "position"]


def _merged(spark: SparkSession, d: str) -> DataFrame:
    own = _cards(spark, d).select("query", "thought_id").join(_linked(spark, d), "thought_id").withColumn("position", F.lit(1))
    keyword = _keyword(spark, d).withColumn("score", F.col("score").cast("double"))
    return retrieval.merged([own.select(_EVIDENCE), keyword.select(_EVIDENCE)])


@query(_CARDS + _LINKED + "select thought_id, chunk_id, source_id, cast(score as double) as score from linked")
def v10_linked_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select("thought_id", "chunk_id", "source_id", "score")


@query(_CARDS + "select query, chunk_id, score, position from (select *, row_number() over (partition by query order by score desc, chunk_id) as position from k where chunk_person = person_id) where position <= 10")
def v5_keywords_of_a_person(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the card's person with the word of its title."""
    return _keyword(spark, d, 10, ("person_id",)).select("query", "chunk_id", "score", F.col("position").cast("long").alias("position"))


@query(_CARDS + _RANKED + "select query, chunk_id, cast(score as bigint) as score, position from hits")
def v11_keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d).select("query", "chunk_id", "score", F.col("position").cast("long").alias("position"))


@query(_CARDS + _RANKED + "select query, chunk_id, position from (select query, chunk_id, row_number() over (partition by query order by position) as position from hits where corpus_role in ('core_thought', 'supporting_thought')) where position <= 10")
def v14_core_passages(spark: SparkSession, d: str) -> DataFrame:
    """Of the first forty hits those of core books, ten at most: the filter comes behind the limit."""
    kept = _keyword(spark, d).where("corpus_role in ('core_thought', 'supporting_thought')")
    again = kept.withColumn("again", F.row_number().over(Window.partitionBy("query").orderBy("position")))
    return again.where("again <= 10").select("query", "chunk_id", F.col("again").cast("long").alias("position"))


@query(_CARDS + _MERGED + "select query, chunk_id, list, score, position from merged")
def v12_merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Linked evidence and keyword hits as one list: a chunk in both keeps its link's score."""
    return _merged(spark, d).select("query", "chunk_id", "list", "score", F.col("position").cast("long").alias("position"))


@query(_CARDS + _MERGED + f"select query, chunk_id, row_number() over (partition by query order by {_DIRECT} desc, score desc, chunk_id) as position from merged")
def e2_ranked_evidence(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.ranked_by_directness(_merged(spark, d)).select("query", "chunk_id", F.col("position").cast("long").alias("position"))


@query(_CARDS + _MERGED + f", o as (select query, chunk_id, source_id, corpus_role as role, row_number() over (partition by query order by {_DIRECT} desc, score desc, chunk_id) as position from merged), " + chunking_sql.diversified("o", "*", "chosen") + " select query, chunk_id, source_id, role, position from chosen")
def e4_selected_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Ranked first, then cut: ten at most, five of a source, three of a role."""
    ranked = retrieval.ranked_by_directness(_merged(spark, d)).withColumn("role", F.col("corpus_role"))
    return retrieval.diversified(ranked).select("query", "chunk_id", "source_id", "role", F.col("position").cast("long").alias("position"))


@query(_CARDS + _MERGED + f"select query, source_id, min(position) as position from merged where {_DIRECT} group by all")
def e10_direct_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that speak for the author, in the order in which they are first seen."""
    own = _merged(spark, d).where(retrieval.direct(F.col("speaker_role"), F.col("corpus_role")))
    return own.groupBy("query", "source_id").agg(F.min("position").cast("long").alias("position"))


@query(_CARDS + _MERGED + f""", g as (select query, bool_or({_DIRECT}) as direct, count(*) as hits from merged group by 1),
s as (select query, terms[1] as subject from q), there as (select s.query, bool_or(contains(c.text, s.subject)) as known from s, chunks c group by 1)
select s.query, coalesce(g.direct, false) as direct, case when not there.known then 'subject not found' when g.direct then 'none' when g.hits is null then 'no source' else 'only fiction' end as abstention
from s join there using (query) left join g using (query)""")
def e11_abstentions(spark: SparkSession, d: str) -> DataFrame:
    """Why a query should not be answered: its subject is unknown, nothing was found, or only what isn't the author's word."""
    asked = _cards(spark, d).select("query", F.get("terms", 0).alias("term"))
    chunks = mutations.latest(table(spark, d, "source_chunks").select("chunk_id", "updated_at", "text"), ["chunk_id"], "updated_at")
    known = retrieval.named_terms(chunks.select(F.col("chunk_id").alias("id"), "text"), asked).select("term").distinct().withColumn("known", F.lit(True))
    judged = _merged(spark, d).groupBy("query").agg(F.bool_or(retrieval.direct(F.col("speaker_role"), F.col("corpus_role"))).alias("direct"))
    both = asked.join(known, "term", "left").join(judged, "query", "left")
    why = F.when(F.col("known").isNull(), "subject not found").when(F.col("direct"), "none").when(F.col("direct").isNull(), "no source").otherwise("only fiction")
    return both.select("query", F.coalesce("direct", F.lit(False)).alias("direct"), why.alias("abstention"))


@query("select distinct card_id, trim(string_split(title, 'と')[1]) as subject, contains(core_claim, trim(string_split(title, 'と')[1])) and trim(string_split(title, 'と')[1]) <> '' as usable from thought_cards where title is not null")
def e12_usable_subjects(spark: SparkSession, d: str) -> DataFrame:
    subject = F.trim(F.get(F.split("title", "と"), 0))
    usable = F.contains("core_claim", subject) & (subject != "")
    return table(spark, d, "thought_cards").where("title is not null").select("card_id", subject.alias("subject"), usable.alias("usable")).distinct()


@query(f"""with cards as {ref._last("thought_cards", "card_id")}, p as (select card_id, generate_subscripts(representative_chunk_ids, 1) - 1 as position, unnest(representative_chunk_ids) as chunk_id from cards where status = 'approved'),
c as {_CHUNKS} select card_id, cast(position as integer) as position, chunk_id, source_id from p join c using (chunk_id)""")
def e13_chunks_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of approved cards in the order in which the card names them."""
    cards = mutations.latest(table(spark, d, "thought_cards").select("card_id", "updated_at", "status", "representative_chunk_ids"), ["card_id"], "updated_at").where("status = 'approved'")
    chunks = mutations.latest(table(spark, d, "source_chunks").select("chunk_id", "updated_at", "source_id"), ["chunk_id"], "updated_at").drop("updated_at")
    return cards.select("card_id", F.posexplode("representative_chunk_ids").alias("position", "chunk_id")).join(chunks, "chunk_id").select("card_id", "position", "chunk_id", "source_id")


@query(f"""with cards as {ref._last("thought_cards", "card_id")}, n as (select distinct card_id, unnest(string_split(title, 'と')) as name from cards where title is not null), c as (select distinct chunk_id, text from source_chunks)
select chunk_id, min(card_id) as card_id, count(distinct card_id) as entries from c join n on name <> '' and contains(text, name) group by 1""")
def j9_named_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first card, in order of id, one of whose names stands in a chunk."""
    cards = mutations.latest(table(spark, d, "thought_cards").select("card_id", "updated_at", "title"), ["card_id"], "updated_at").where("title is not null")
    names = cards.select(F.col("card_id").alias("entry"), F.explode(F.split("title", "と")).alias("term"))
    found = retrieval.named_entries(table(spark, d, "source_chunks").select(F.col("chunk_id").alias("id"), "text"), names)
    return found.select(F.col("id").alias("chunk_id"), F.col("first").alias("card_id"), "entries")


@query("""select label, count(distinct chunk_id) as chunks from (select chunk_id, unnest([case when (contains(text, '公園') or contains(text, '庭園')) and not contains(text, '遊園地') then 'park' end,
case when (contains(text, '手紙') or contains(text, '便り')) and not contains(text, '絵葉書') and not contains(text, '電報') then 'letter' end]) as label from source_chunks) where label is not null group by 1""")
def j8_aliases_and_negatives(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "source_chunks").select(F.col("chunk_id").alias("id"), "text")
    found = retrieval.matched_aliases(texts, [("公園", "park"), ("庭園", "park"), ("手紙", "letter"), ("便り", "letter")], {"park": ["遊園地"], "letter": ["絵葉書", "電報"]})
    return found.groupBy("label").agg(F.countDistinct("id").alias("chunks"))


# Filters of the corpus

#: The logical indexes, by roles of the source and, where they matter, of the speaker.
INDEXES = {
    "author_thought_core": (["core_thought"], ["author_direct"]),
    "author_thought_support": (["supporting_thought"], ["author_direct"]),
    "creative_grammar": (["creative_grammar"], None),
    "character_judgment": (["character_judgment", "narrative_reference"], ["character"]),
    "narrative_reference": (["narrative_reference"], None),
    "style_reference": (["style_reference"], None),
    "biographical_context": (["biographical_context"], None),
    "validation_only": (["validation_only"], None),
}
_INDEX = " ".join(
    f"union all select '{name}', chunk_id from b where corpus_role in ({', '.join(map(repr, roles))})" + (f" and speaker_role in ({', '.join(map(repr, speakers))})" if speakers else "")
    for name, (roles, speakers) in INDEXES.items()
).removeprefix("union all ")


def _based(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "source_chunks").select("chunk_id", "source_id", "speaker_role", "verbatim", "thought_eligibility", "evidence_roles")
    return chunks.join(_sources(spark, d, "corpus_role"), "source_id")


_BASE = f"with b as (select c.*, s.corpus_role from source_chunks c join {_SOURCES} s on c.source_id = s.source_id)"


@query(f'{_BASE}, i as ({_INDEX}) select index_name, count(*) as chunks, count(distinct chunk_id) as distinct_chunks from i as i(index_name, chunk_id) group by 1')
def p10_logical_indexes(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks each logical index holds, in one pass."""
    hits = F.array(*[F.when(retrieval.any_of(F.col("corpus_role"), r) & retrieval.any_of(F.col("speaker_role"), s), F.lit(name)) for name, (r, s) in INDEXES.items()])
    each = _based(spark, d).select("chunk_id", F.explode(F.array_compact(hits)).alias("index_name"))
    return each.groupBy("index_name").agg(F.count("*").alias("chunks"), F.countDistinct("chunk_id").alias("distinct_chunks"))


@query(_BASE + " select chunk_id from b where corpus_role = 'core_thought' and speaker_role = 'author_direct' and thought_eligibility <> 'excluded'")
def p11_thought_core(spark: SparkSession, d: str) -> DataFrame:
    roles, speakers = INDEXES["author_thought_core"]
    return _based(spark, d).where(retrieval.any_of(F.col("corpus_role"), roles) & retrieval.any_of(F.col("speaker_role"), speakers) & (F.col("thought_eligibility") != "excluded")).select("chunk_id")


@query(_BASE + " select chunk_id from b where corpus_role = 'creative_grammar' or source_id in (select source_id from chunk_deletions)")
def p12_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of sources in a scope (here those with deletions); creative grammar is exempt."""
    scope = table(spark, d, "chunk_deletions").where("source_id is not null").select("source_id").distinct().withColumn("in_scope", F.lit(True))
    return _based(spark, d).join(scope, "source_id", "left").where("corpus_role = 'creative_grammar' or in_scope").select("chunk_id")


@query("select chunk_id from source_chunks where list_contains(evidence_roles, 'definition') and verbatim and status = 'active'")
def p13_quotable(spark: SparkSession, d: str) -> DataFrame:
    """What may be quoted: of a role (here definitions, as no chunk is marked as a quote), word for word, active."""
    return table(spark, d, "source_chunks").where(F.array_contains("evidence_roles", "definition") & F.col("verbatim") & (F.col("status") == "active")).select("chunk_id")


@query(_BASE + f" select {_DIRECT} as direct, speaker_role, count(*) as chunks from b group by all")
def p15_author_direct(spark: SparkSession, d: str) -> DataFrame:
    marked = _based(spark, d).withColumn("direct", retrieval.direct(F.col("speaker_role"), F.col("corpus_role")))
    return marked.groupBy("direct", "speaker_role").agg(F.count("*").alias("chunks"))


@query(_BASE + " select 'none' as filter, count(*) as chunks from b union all select 'core_thought', count(*) from b where corpus_role in ('core_thought')")
def p3_optional_filter(spark: SparkSession, d: str) -> DataFrame:
    """A filter that no value switches off."""
    based = _based(spark, d)
    counted = [based.where(retrieval.any_of(F.col("corpus_role"), v)).agg(F.count("*").alias("chunks")).select(F.lit(n).alias("filter"), "chunks") for n, v in (("none", None), ("core_thought", ["core_thought"]))]
    return counted[0].unionByName(counted[1])


@query("""select chunk_id, 1 as asked from source_chunks where (contains(text, '公園') or contains(text, '手紙')) and not contains(text, '庭')
union all select chunk_id, 2 from source_chunks where contains(lower(text), 'the ') and (contains(lower(text), 'letter') or contains(lower(text), 'harbour')) union all select chunk_id, 3 from source_chunks where contains(text, '静かに') and contains(text, 'ものだと')""")
def p8_web_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries with OR, minus and quotes, in one pass."""
    asked = ["公園 OR 手紙 -庭", '"the " letter OR Harbour', "静かに ものだと"]
    hits = F.array(*[F.when(retrieval.web_query(F.col("text"), q), F.lit(k)) for k, q in enumerate(asked, 1)])
    return table(spark, d, "source_chunks").where("text is not null").select("chunk_id", F.explode(F.array_compact(hits)).alias("asked"))
