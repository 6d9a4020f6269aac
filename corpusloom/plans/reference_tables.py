"""Registered queries on keyed tables: reports, mutations, revisions, rosters, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import mutations, quality
from corpusloom.plans import reference as ref
from corpusloom.plans.registering import Registered
from corpusloom.runtime import fresh_path, table
from corpusloom.sources import readers

query = Registered()
QUERIES, SQL = query.queries, query.sql

_CARDS, _SOURCES = ref._last("thought_cards", "card_id"), ref._last("sources", "source_id")


def _latest(spark: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    return mutations.latest(table(spark, d, name).select(key, "updated_at", *columns), [key], "updated_at")


# Reports


@query("""with h as (select unnest([case when speaker_role is null then 'untagged' end, case when status = 'disabled' then 'disabled' end, case when text is null or text = '' then 'empty' end, case when tag_confidence < 0.7 then 'unsure' end]) as name, chunk_id from source_chunks),
k as (select distinct name, chunk_id from h where chunk_id is not null), n as (select name, chunk_id, row_number() over (partition by name order by chunk_id) as n from k)
select h.name, count(*) as rows, coalesce(any_value(s.sample), '') as sample from h left join (select name, string_agg(chunk_id, ',' order by chunk_id) as sample from n where n <= 20 group by 1) s using (name) where h.name is not null group by 1""")
def a5_samples(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks fail each check, with the first twenty ids."""
    empty = F.col("text").isNull() | (F.col("text") == "")
    tests = {"untagged": F.col("speaker_role").isNull(), "disabled": F.col("status") == "disabled", "empty": empty, "unsure": F.col("tag_confidence") < 0.7}
    return quality.samples(table(spark, d, "source_chunks"), "chunk_id", tests)


@query(f"""with e as (select distinct c.card_id, e.chunk_id from creative_cards c, (select card_id, unnest(evidence_chunk_ids) as chunk_id from creative_cards) e where e.card_id = c.card_id),
x as (select 'fiction in core' as name, count(*) filter (document_genre in ('novel', 'short_story', 'sketch') and corpus_role in ('core_thought', 'supporting_thought')) as hits, count(*) as n from {_SOURCES}
union all select 'no edition', count(*) filter (edition_id is null), count(*) from {_SOURCES}
union all select 'open reviews', count(*) filter (tag_review_status = 'needs_review'), count(*) from source_chunks
union all select 'evidence missing', count(*) filter (chunk_id is not null and chunk_id not in (select chunk_id from source_chunks where chunk_id is not null)), count(*) from e
union all select 'no hash', count(*) filter (content_sha256 is null), count(*) from work_editions
union all select 'cards without evidence', count(*) filter (coalesce(len(evidence_chunk_ids), 0) = 0), count(*) from creative_cards
union all select 'several primaries', count(*) filter (p > 1), count(*) from (select count(distinct edition_id) filter (is_primary_retrieval_edition) as p from work_editions where canonical_work_id is not null group by canonical_work_id)
union all select 'repeated texts', count(*) filter (k > 1), count(*) from (select count(*) as k from documents where length(text) >= 30 group by md5(text)))
select name, hits, n, round(case when n > 0 then hits / n else 0 end, 6) as value, case when n > 0 then hits / n else 0 end <= 0.05 as passed from x""")
def a7_checks_of_all_tables(spark: SparkSession, d: str) -> DataFrame:
    """Shares of faulty records over the whole corpus, against a twentieth."""
    sources = _latest(spark, d, "sources", "source_id", "document_genre", "corpus_role", "edition_id")
    chunks, cards, editions = (table(spark, d, t) for t in ("source_chunks", "creative_cards", "work_editions"))
    evidence = cards.select("card_id", F.explode("evidence_chunk_ids").alias("chunk_id")).where("card_id is not null").distinct()
    known = chunks.where("chunk_id is not null").select("chunk_id").distinct().withColumn("there", F.lit(True))
    primaries = editions.where("canonical_work_id is not null").groupBy("canonical_work_id").agg(F.countDistinct(F.when(F.col("is_primary_retrieval_edition"), F.col("edition_id"))).alias("p"))
    copies = table(spark, d, "documents").where(F.length("text") >= 30).groupBy(F.md5("text")).agg(F.count("*").alias("k"))
    fiction = F.col("document_genre").isin("novel", "short_story", "sketch") & F.col("corpus_role").isin("core_thought", "supporting_thought")
    judged = [
        ("fiction in core", sources, fiction), ("no edition", sources, F.col("edition_id").isNull()), ("open reviews", chunks, F.col("tag_review_status") == "needs_review"),
        ("evidence missing", evidence.join(known, "chunk_id", "left"), F.col("chunk_id").isNotNull() & F.col("there").isNull()), ("no hash", editions, F.col("content_sha256").isNull()),
        ("cards without evidence", cards, F.coalesce(F.size("evidence_chunk_ids"), F.lit(0)) <= 0), ("several primaries", primaries, F.col("p") > 1), ("repeated texts", copies, F.col("k") > 1),
    ]
    out = None
    for name, df, fault in judged:
        one = df.agg(F.count_if(fault).alias("hits"), F.count("*").alias("n")).select(F.lit(name).alias("name"), "hits", "n")
        out = one if out is None else out.unionByName(one)
    value = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    return out.select("name", "hits", "n", F.round(value, 6).alias("value"), (value <= 0.05).alias("passed"))


@query("""select snapshot_no, record_table, count(*) as records, cast(sum(cast(('0x' || substr(md5(concat_ws(chr(9), coalesce(record_id, ''), coalesce(parent_id, ''), coalesce(chunk_hash, ''), coalesce(content_sha256, ''))), 1, 12)) as hugeint)) as varchar) as digest from corpus_snapshots group by all""")
def a10_snapshot_digests(spark: SparkSession, d: str) -> DataFrame:
    """One digest per delivery and table, whatever the order of its rows."""
    return quality.fingerprint(table(spark, d, "corpus_snapshots"), ["snapshot_no", "record_table"], "record_id", "parent_id", "chunk_hash", "content_sha256")


_NORM = "translate(regexp_replace(canonical_title, '[\\s\\p{Z}\\x{85}]+', '', 'g'), '" + tx.OLD_KANJI + tx.KATAKANA + "', '" + tx.NEW_KANJI + tx.HIRAGANA + "')"


@query(f"""with t as (select {_NORM} as norm, canonical_work_id, canonical_title, nullif(trim(canonical_title_reading), '') as reading from canonical_works where canonical_title is not null)
select norm, min(canonical_work_id) as work_id, array_to_string(list_sort(list(distinct canonical_title)), '／') as variants, case when count(distinct reading) = 1 and count(reading) = count(*) then 'reading' else 'title' end as method, count(distinct reading) > 1 as needs_review from t group by 1""")
def a11_work_groups(spark: SparkSession, d: str) -> DataFrame:
    """Works by folded title: their spellings, and whether the readings agree."""
    works = table(spark, d, "canonical_works").where("canonical_title is not null").withColumn("reading", F.nullif(F.trim("canonical_title_reading"), F.lit("")))
    same = (F.countDistinct("reading") == 1) & (F.count("reading") == F.count("*"))
    return works.groupBy(tx.folded_title(F.col("canonical_title")).alias("norm")).agg(
        F.min("canonical_work_id").alias("work_id"), F.array_join(F.array_sort(F.collect_set("canonical_title")), "／").alias("variants"), F.when(same, "reading").otherwise("title").alias("method"), (F.countDistinct("reading") > 1).alias("needs_review")
    )


@query("""with c as (select source_id, coalesce(chapter_id, '-') as chapter, min(chunk_id) as first_id, count(*) as chunks, sum(length(text)) as chars from source_chunks group by all)
select source_id, chapter, first_id, chunks, cast(chars as bigint) as chars, row_number() over (partition by source_id order by first_id, chapter) as position from c""")
def a14_chapters_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of a source in the order in which they are first seen; the window sees chapters, not chunks."""
    chapters = table(spark, d, "source_chunks").groupBy("source_id", F.coalesce("chapter_id", F.lit("-")).alias("chapter")).agg(F.min("chunk_id").alias("first_id"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return chapters.withColumn("position", F.row_number().over(Window.partitionBy("source_id").orderBy("first_id", "chapter")).cast("long"))


@query(f"""with c as (select person_id, card_id, representative_chunk_ids as ids, row_number() over (partition by person_id order by updated_at desc, card_id) as n from {_CARDS} where person_id is not null),
u as (select person_id, n, generate_subscripts(ids, 1) as place, unnest(ids) as chunk_id from c where n <= 3), f as (select person_id, chunk_id, min((n, place)) as first from u group by all)
select person_id, chunk_id, row_number() over (partition by person_id order by first) as position from f""")
def a26_united_lists(spark: SparkSession, d: str) -> DataFrame:
    """What the three latest cards of a person name, each once, in order of first mention."""
    cards = _latest(spark, d, "thought_cards", "card_id", "person_id", "representative_chunk_ids").where("person_id is not null")
    n = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("updated_at"), "card_id"))
    named = cards.withColumn("n", n).where("n <= 3").select("person_id", "n", F.posexplode("representative_chunk_ids").alias("at", "chunk_id"))
    first = named.groupBy("person_id", "chunk_id").agg(F.min(F.struct("n", "at")).alias("first"))
    return first.select("person_id", "chunk_id", F.row_number().over(Window.partitionBy("person_id").orderBy("first")).cast("long").alias("position"))


@query(r"""select regexp_replace(source_id, '\d+$', '') as prefix, max(source_id) as last_id, regexp_replace(max(source_id), '\d+$', '') || lpad(cast(cast(regexp_extract(max(source_id), '(\d+)$', 1) as bigint) + 1 as varchar), 8, '0') as next_id from sources where regexp_matches(source_id, '\d+$') group by 1""")
def a31_next_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id behind the last one of each prefix."""
    digits = r"(\d+)$"
    last = table(spark, d, "sources").where(F.col("source_id").rlike(digits)).groupBy(F.regexp_replace("source_id", digits, "").alias("prefix")).agg(F.max("source_id").alias("last_id"))
    following = F.lpad((F.regexp_extract("last_id", digits, 1).cast("long") + 1).cast("string"), 8, "0")
    return last.select("prefix", "last_id", F.concat(F.regexp_replace("last_id", digits, ""), following).alias("next_id"))


@query("""with e as (select distinct card_id, unnest(evidence_chunk_ids) as chunk_id from creative_cards), c as (select distinct chunk_id, source_id from source_chunks where source_id is not null)
select e.card_id, array_to_string(list_sort(list(distinct c.source_id)), ',') as sources, count(distinct e.chunk_id) as chunks from e join c on e.chunk_id = c.chunk_id group by 1""")
def c15_card_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The sources behind a card's evidence; a list holds one card's."""
    evidence = table(spark, d, "creative_cards").select("card_id", F.explode("evidence_chunk_ids").alias("chunk_id")).distinct()
    chunks = table(spark, d, "source_chunks").where("source_id is not null").select("chunk_id", "source_id").distinct()
    return evidence.join(chunks, "chunk_id").groupBy("card_id").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"), F.countDistinct("chunk_id").alias("chunks"))


@query("""select edition_id, parent from (select edition_id, json_extract_string(bottom_text, '$."底本名"') as parent from (select * from work_editions order by created_at desc, edition_id, updated_at desc limit 30)) where parent is not null""")
def c18_recent_parents(spark: SparkSession, d: str) -> DataFrame:
    """A field of the JSON of the thirty latest editions; empty ones are left out behind the limit."""
    last = table(spark, d, "work_editions").orderBy(F.desc("created_at"), "edition_id", F.desc("updated_at")).limit(30)
    return last.select("edition_id", F.get_json_object("bottom_text", "$.底本名").alias("parent")).where("parent is not null")


@query(f"select source_type, title, row_number() over (partition by source_type order by title, source_id) as position from {_SOURCES} where title is not null and source_type is not null")
def c23_titles_by_kind(spark: SparkSession, d: str) -> DataFrame:
    sources = _latest(spark, d, "sources", "source_id", "title", "source_type").where("title is not null and source_type is not null")
    w = Window.partitionBy("source_type").orderBy("title", "source_id")
    return sources.select("source_type", "title", F.row_number().over(w).cast("long").alias("position"))


@query("""with v as (select canonical_work_id, person_id, unnest(list_concat(title_variants, [canonical_title])) as name from canonical_works where person_id is not null)
select person_id, name, min(canonical_work_id) as work_id, count(distinct canonical_work_id) as works from v where name is not null group by all""")
def c30_name_roster(spark: SparkSession, d: str) -> DataFrame:
    """Every name of a person's works and the first work that bears it."""
    names = F.concat(F.coalesce("title_variants", F.array().cast("array<string>")), F.array("canonical_title"))
    each = table(spark, d, "canonical_works").where("person_id is not null").select("person_id", "canonical_work_id", F.explode(names).alias("name")).where("name is not null")
    return each.groupBy("person_id", "name").agg(F.min("canonical_work_id").alias("work_id"), F.countDistinct("canonical_work_id").alias("works"))


@query("""with e as (select distinct card_id, summary, unnest(evidence_chunk_ids) as chunk_id from creative_cards where summary is not null), c as (select distinct chunk_id, text from source_chunks where text is not null)
select e.card_id, e.chunk_id, bool_or(contains(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g'), substr(regexp_replace(summary, '[\\s\\p{Z}]+', '', 'g'), 1, 12))) as grounded from e join c on e.chunk_id = c.chunk_id group by all""")
def g24_grounded_cards(spark: SparkSession, d: str) -> DataFrame:
    """Whether the beginning of a card's summary stands in its evidence, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"[\s\p{Z}]+", "")
    evidence = table(spark, d, "creative_cards").where("summary is not null").select("card_id", "summary", F.explode("evidence_chunk_ids").alias("chunk_id")).distinct()
    texts = table(spark, d, "source_chunks").where("text is not null").select("chunk_id", "text").distinct()
    return evidence.join(texts, "chunk_id").groupBy("card_id", "chunk_id").agg(F.bool_or(F.contains(bare("text"), F.substring(bare("summary"), 1, 12))).alias("grounded"))


@query("""select user_id, case when age < interval '1 hour' then 'active' when age < interval '1 day' then 'idle' else 'absent' end as presence from (select user_id, (select max(ts) from events) - max(ts) as age from events where user_id is not null group by 1) where age is not null""")
def st4_presence(spark: SparkSession, d: str) -> DataFrame:
    """How long each user has been silent at the last event of all."""
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    now = events.agg(F.max("t")).first()[0]
    last = events.where("user_id is not null").groupBy("user_id").agg((F.lit(now) - F.max("t")).alias("age")).where("age is not null")
    return last.select("user_id", F.when(F.col("age") < 3600, "active").when(F.col("age") < 86400, "idle").otherwise("absent").alias("presence"))


# Mutations and sinks


@query("""select chunk_id, case when chunk_id in (select chunk_id from chunk_deletions where chunk_id is not null) then 'disabled' else status end as status, source_id from source_chunks where chunk_id is not null""")
def s4_flagged_update(spark: SparkSession, d: str) -> DataFrame:
    """A batch update: chunks in the log of deletions are disabled."""
    chunks = table(spark, d, "source_chunks").where("chunk_id is not null").select("chunk_id", "status", "source_id")
    return mutations.updated(chunks, table(spark, d, "chunk_deletions").where("chunk_id is not null"), "chunk_id", {"status": F.lit("disabled")})


@query("select source_id, title from sources union all select source_id, text as title from parsed_chunks where chunk_type = 'qa_pair'")
def s18_appended(spark: SparkSession, d: str) -> DataFrame:
    """Rows inserted into a written table."""
    path = fresh_path(spark, "appended")
    table(spark, d, "sources").select("source_id", "title").write.parquet(path)
    table(spark, d, "parsed_chunks").where("chunk_type = 'qa_pair'").select("source_id", F.col("text").alias("title")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("""with o as (select person_id, canonical_title, max(ndc) as ndc from canonical_works where person_id is not null and canonical_title is not null group by all),
n as (select person_id, title as canonical_title, max(document_genre) as genre from sources where person_id is not null and title is not null group by all)
select coalesce(o.person_id, n.person_id) as person_id, coalesce(o.canonical_title, n.canonical_title) as canonical_title, case when n.person_id is not null then n.genre else o.ndc end as ndc from o full join n on o.person_id = n.person_id and o.canonical_title = n.canonical_title""")
def s20_composite_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An upsert on person and title."""
    keys = ["person_id", "canonical_title"]
    old = table(spark, d, "canonical_works").where("person_id is not null and canonical_title is not null").groupBy(*keys).agg(F.max("ndc").alias("ndc"))
    new = table(spark, d, "sources").where("person_id is not null and title is not null").groupBy("person_id", F.col("title").alias("canonical_title")).agg(F.max("document_genre").alias("ndc"))
    return mutations.upsert(old, new, keys, ["ndc"])


@query("""with gone as (select distinct source_id from chunk_deletions where source_id is not null)
select chunk_id, source_id, text from source_chunks where source_id is null or source_id not in (select source_id from gone) union all select chunk_id, source_id, text from parsed_chunks where source_id in (select source_id from gone)""")
def s23_replaced_children(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of sources with deletions go, and those parsed anew come in their place."""
    rows = [table(spark, d, t).select("chunk_id", "source_id", "text") for t in ("source_chunks", "parsed_chunks")]
    gone = table(spark, d, "chunk_deletions").where("source_id is not null")
    return mutations.replaced_children(rows[0], gone, "source_id", rows[1])


@query("select source_type as value, count(*) as records from sources where source_type is not null group by 1")
def s24_json_report(spark: SparkSession, d: str) -> DataFrame:
    """A report written as JSON and read again."""
    path = fresh_path(spark, "report")
    counted = table(spark, d, "sources").where("source_type is not null").groupBy(F.col("source_type").alias("value")).agg(F.count("*").alias("records"))
    counted.coalesce(1).write.json(path)
    return spark.read.schema("value string, records long").json(path)


@query("""with gone as (select list(distinct chunk_id) as ids from chunk_deletions where chunk_id is not null)
select card_id, array_to_string(list_transform(representative_chunk_ids, lambda x: case when list_contains(gone.ids, x) then 'DEL_' || x else x end), ',') as ids from thought_cards, gone""")
def t41_renamed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of deleted chunks renamed in the lists of the cards."""
    gone = table(spark, d, "chunk_deletions").where("chunk_id is not null").select("chunk_id").distinct()
    pairs = gone.select(F.col("chunk_id").alias("old"), F.concat(F.lit("DEL_"), "chunk_id").alias("new"))
    cards = table(spark, d, "thought_cards").select("card_id", "representative_chunk_ids")
    return mutations.replaced("representative_chunk_ids", pairs, cards, "card_id").select("card_id", F.array_join("representative_chunk_ids", ",").alias("ids"))


@query(f"""select card_id, case when status = 'reviewing' then version + 1 else version end as version, case when status = 'reviewing' then 'approved' else status end as status, 'current' as part from {_CARDS}
union all select card_id, version, status, 'history' from {_CARDS} where status = 'reviewing'""")
def g31_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Cards under review approved: the next version, and the rows as they were."""
    cards = _latest(spark, d, "thought_cards", "card_id", "version", "status").drop("updated_at")
    now, before = mutations.revisions(cards, "card_id", "version", F.coalesce(F.col("status") == "reviewing", F.lit(False)), {"status": F.lit("approved")})
    return now.withColumn("part", F.lit("current")).unionByName(before.withColumn("part", F.lit("history")))


@query("select 'txt' as kind, cast(sum(length(text) + 1) as bigint) as chars, count(*) as texts from documents where doc_kind = 'letter' and text is not null")
def s8_read_text_files(spark: SparkSession, d: str) -> DataFrame:
    """Letters written as text files and read as files."""
    path = fresh_path(spark, "letters")
    letters = table(spark, d, "documents").where("doc_kind = 'letter' and text is not null").select("text")
    letters.write.text(path)
    files = readers.read_files(spark, f"{path}/*.txt")
    return files.groupBy("kind").agg(F.sum(F.length("text")).alias("chars"), F.lit(letters.count()).alias("texts"))


@query("select edition_id, nullif(trim(orthography), '') as orthography, nullif(trim(work_status), '') as work_status from work_editions")
def s11_read_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Editions written as CSV and read as a manifest, blanks as null."""
    path = fresh_path(spark, "manifest")
    table(spark, d, "work_editions").select("edition_id", "orthography", "work_status").write.csv(path, header=True, escape='"', emptyValue="")
    return readers.read_manifest(spark, path)


# Relations and counts


@query("""with e as (select distinct canonical_work_id, edition_id, orthography from work_editions where edition_id is not null)
select w.canonical_work_id, coalesce(string_agg(edition_id || ':' || coalesce(orthography, ''), ',' order by edition_id, orthography), '') as editions, count(edition_id) as number from (select distinct canonical_work_id from canonical_works) w left join e using (canonical_work_id) group by 1""")
def j3_works_with_editions(spark: SparkSession, d: str) -> DataFrame:
    """Each work with the list of its editions, empty for none."""
    named = F.concat("edition_id", F.lit(":"), F.coalesce("orthography", F.lit("")))
    editions = table(spark, d, "work_editions").where("edition_id is not null").select("canonical_work_id", "edition_id", "orthography").distinct()
    lists = editions.groupBy("canonical_work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edition_id", named.alias("name")))), lambda x: x["name"]), ",").alias("editions"), F.count("*").alias("number"))
    works = table(spark, d, "canonical_works").select("canonical_work_id").distinct()
    return works.join(lists, "canonical_work_id", "left").select("canonical_work_id", F.coalesce("editions", F.lit("")).alias("editions"), F.coalesce("number", F.lit(0)).alias("number"))


@query("""with c as (select distinct card_id, unnest(evidence_chunk_ids) as chunk_id from creative_cards), t as (select distinct card_id, unnest(representative_chunk_ids) as chunk_id from thought_cards),
s as (select distinct chunk_id, source_id, chapter_id from source_chunks where chapter_id is not null), a as (select source_id, chapter_id, count(distinct card_id) as creative, count(distinct chunk_id) as cited from c join s using (chunk_id) group by all),
b as (select source_id, chapter_id, count(distinct card_id) as thought from t join s using (chunk_id) group by all) select source_id, chapter_id, creative, thought, cited from a join b using (source_id, chapter_id)""")
def j12_chapters_of_both_cards(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that creative and thought cards draw on: cards per chapter, no pairs of cards."""
    chunks = table(spark, d, "source_chunks").where("chapter_id is not null").select("chunk_id", "source_id", "chapter_id").distinct()
    cited = lambda name, ids: table(spark, d, name).select("card_id", F.explode(ids).alias("chunk_id")).distinct().join(chunks, "chunk_id")
    creative = cited("creative_cards", "evidence_chunk_ids").groupBy("source_id", "chapter_id").agg(F.countDistinct("card_id").alias("creative"), F.countDistinct("chunk_id").alias("cited"))
    thought = cited("thought_cards", "representative_chunk_ids").groupBy("source_id", "chapter_id").agg(F.countDistinct("card_id").alias("thought"))
    return creative.join(thought, ["source_id", "chapter_id"]).select("source_id", "chapter_id", "creative", "thought", "cited")


@query(" union all ".join(f"select '{t}' as name, count(*) as rows, count(*) > 0 as passed from {t}" for t in ("canonical_works", "work_editions", "sources", "source_chunks", "thought_cards", "creative_cards")))
def a6_count_checks(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("canonical_works", "work_editions", "sources", "source_chunks", "thought_cards", "creative_cards"):
        one = table(spark, d, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", (F.col("rows") > 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select person_id, count(*) filter (importance = 'high') as high, count(*) filter (importance = 'normal') as normal, count(*) filter (importance = 'low') as low, count(*) filter (importance is null) as unrated from thought_cards group by 1")
def a20_ratings(spark: SparkSession, d: str) -> DataFrame:
    """A histogram of ratings per person, the unrated counted apart."""
    rated = [F.count_if(F.col("importance") == x).alias(x) for x in ("high", "normal", "low")]
    return table(spark, d, "thought_cards").groupBy("person_id").agg(*rated, F.count_if(F.col("importance").isNull()).alias("unrated"))


@query("with s as (select o_custkey, cast(substr(o_orderpriority, 1, 1) as integer) as score from orders where o_orderpriority is not null) select o_custkey, round(sum(score) / (5.0 * count(*)), 6) as share, bool_or(score <= 2) as low from s group by 1")
def a21_scores(spark: SparkSession, d: str) -> DataFrame:
    """The share of all points, and whether any score is low."""
    scored = table(spark, d, "orders").where("o_orderpriority is not null").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("score"))
    return scored.groupBy("o_custkey").agg(F.round(F.sum("score") / (F.count("*") * 5.0), 6).alias("share"), F.bool_or(F.col("score") <= 2).alias("low"))


@query(ref._VOTES + "select e.label as own, r.label as found, count(*) as queries, e.label = r.label as passed from r join embeddings e on e.vec_id = r.query_id where r.rank = 1 group by all")
def a23_confusions(spark: SparkSession, d: str) -> DataFrame:
    """How often a query of each label is routed to each label."""
    first = ref.retrieval.votes(ref._hits(spark, d), "label").where("rank = 1").select("query_id", F.col("label").alias("found"))
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return first.join(own, "query_id").groupBy("own", "found").agg(F.count("*").alias("queries")).withColumn("passed", F.col("own") == F.col("found"))


@query("select status, count(*) as cards, case status when 'rejected' then 1 when 'deprecated' then 2 when 'reviewing' then 3 when 'draft' then 4 else 5 end as place from thought_cards where status is not null group by 1")
def a24_verdicts_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Cards by verdict, the worst first."""
    order = F.create_map(*[F.lit(x) for pair in (("rejected", 1), ("deprecated", 2), ("reviewing", 3), ("draft", 4)) for x in pair])
    counted = table(spark, d, "thought_cards").where("status is not null").groupBy("status").agg(F.count("*").alias("cards"))
    return counted.withColumn("place", F.coalesce(F.try_element_at(order, F.col("status")), F.lit(5))).orderBy("place")


@query("select card_id, unnest(evidence_chunk_ids) as chunk_id from creative_cards")
def s17_json_rules(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON, loaded and spread."""
    path = fresh_path(spark, "rules")
    table(spark, d, "creative_cards").select("card_id", "evidence_chunk_ids").write.json(path)
    return spark.read.schema("card_id string, evidence_chunk_ids array<string>").json(path).select("card_id", F.explode("evidence_chunk_ids").alias("chunk_id"))


@query(f"select person_id, lpad(regexp_extract(source_id, '(\\d+)$', 1), 10, '0') as work_id, title from {_SOURCES} where person_id is not null and title is not null and status = 'active' and regexp_matches(source_id, '\\d+$')")
def s13_listed_in_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of persons, made of the sources, read again: the rows of one section, up to the next heading."""
    sources = _latest(spark, d, "sources", "source_id", "person_id", "title", "status").where("person_id is not null and title is not null").where(F.col("source_id").rlike(r"\d+$"))
    row = F.concat(F.lit('<li><a href="card'), F.regexp_extract("source_id", r"(\d+)$", 1), F.lit('.html"><b>'), readers.escaped(F.col("title")), F.lit("</b></a></li>"))
    # A page is one section of each kind; here a source's own row, so that no page grows with the data.
    page = F.concat(
        F.lit('<h2><a name="others">x</a></h2>'), F.when(F.col("status") != "active", row).otherwise(""), F.lit('<h2><a name="sakuhin_list_2">y</a></h2><ol>'),
        F.when(F.col("status") == "active", row).otherwise(""), F.lit('</ol><h2>z</h2><li><a href="card9.html">no</a></li>'),
    )
    found = readers.section_links(sources.select("person_id", page.alias("html")), "sakuhin_list_2")
    return found.select("person_id", F.lpad("number", 10, "0").alias("work_id"), F.col("label").alias("title"))


_PLAIN = "^[ぁ-んァ-ン一-龠。、「」\\n　]+$"


@query(f"""select doc_id, unnest(['txt', 'zip', 'docx', 'txt']) as kind, unnest([1, 2, 3, 4]) as form, length(text) > 0 and unnest([true, true, true, false]) as same from documents where doc_kind in ('letter', 'essay') and regexp_matches(text, '{_PLAIN}')""")
def s10_decoded_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts packed as text, zip and word files and decoded again; the last is UTF-16 read as UTF-8."""
    docs = table(spark, d, "documents").where("doc_kind in ('letter', 'essay')").where(F.col("text").rlike(_PLAIN)).select("doc_id", "text")
    name = F.col("doc_id").cast("string")
    packed = F.array(
        *[F.struct(F.concat(name, F.lit(f"_{form}.{kind}")).alias("path"), content.alias("content")) for form, kind, content in (
            (1, "txt", F.encode("text", "UTF-8")), (2, "zip", readers.zipped(name, "text", F.lit("zip"))), (3, "docx", readers.zipped(name, "text", F.lit("docx"))), (4, "txt", F.encode("text", "UTF-16")),
        )]
    )
    read = readers.decoded(docs.select(F.explode(packed).alias("x")).select("x.*"))
    part = lambda k: F.regexp_extract("path", r"^(\d+)_(\d)", k)
    found = read.select(part(1).cast("long").alias("doc_id"), "kind", part(2).cast("int").alias("form"), F.col("text").alias("again"), "garbled")
    return found.join(docs, "doc_id").select("doc_id", "kind", "form", (F.col("again") == F.col("text")).alias("same")).distinct()
