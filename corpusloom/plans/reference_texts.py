"""Registered queries on the structure of texts: transcripts, annotated files, titles, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, transcripts
from corpusloom.plans import chunking_sql
from corpusloom.plans.registering import Registered
from corpusloom.runtime import table

query = Registered()
QUERIES, SQL = query.queries, query.sql

OWN, OTHER = ["本人発言", "本人", "Self"], ["質問者", "聞き手", "Interviewer"]
_B = r"[\s\p{Z}\x{85}]"


def _documents(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "documents").where((F.col("doc_kind") == kind) & F.col("text").isNotNull())


# Transcripts

_STAMP = r"^\[(\d{1,2}:\d{2}(?::\d{2})?)\]$"
_TURNS = rf"""with raw as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as raw from documents where doc_kind = 'qa_transcript' and text is not null),
b as (select doc_id, line, regexp_replace(raw, '^{_B}+|{_B}+$', '', 'g') as bare from raw),
l as (select *, nullif(regexp_extract(bare, '{_STAMP}', 1), '') as stamp, regexp_extract(bare, '^([^：:\s]{{1,20}}?)\s*[：:]', 1) as label from b where bare <> ''),
m as (select *, case when stamp is not null then null when label in ('本人発言', '本人', 'Self') then 'self' when label in ('質問者', '聞き手', 'Interviewer') then 'other' end as speaker,
last_value(stamp ignore nulls) over (partition by doc_id order by line) as stamped from l),
n as (select *, sum(case when speaker is not null then 1 else 0 end) over (partition by doc_id order by line) as turn from m where stamp is null),
t as (select doc_id, turn, max(speaker) as speaker, min(stamped) filter (speaker is not null) as stamped, min(line) as line,
string_agg(case when speaker is null then bare else regexp_replace(bare, '^[^：:]*[：:]\s*', '') end, '' order by line) as said from n where turn > 0 group by all)
"""
_PAIRS = _TURNS + """, r as (select *, case when speaker = 'other' and coalesce(lag(speaker) over w, 'self') = 'self' then 1 else 0 end as fresh from t window w as (partition by doc_id order by turn)),
p as (select *, sum(fresh) over (partition by doc_id order by turn) as pair from r),
q as (select doc_id, pair, string_agg(said, ' ' order by turn) filter (speaker = 'other') as question, string_agg(said, ' ' order by turn) filter (speaker = 'self') as answer,
arg_min(stamped, turn) filter (speaker = 'other') as timestamp_start, max_by(stamped, turn) filter (speaker = 'self' and stamped is not null) as timestamp_end from p where pair > 0 group by all)
"""


@query(_TURNS + "select doc_id, turn, speaker, stamped, said from t")
def t19_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of transcripts: labelled lines with the lines that go on, and the time stamp before them."""
    return transcripts.turns(_documents(spark, d, "qa_transcript"), OWN, OTHER).select("doc_id", "turn", "speaker", "stamped", "said")


@query(_PAIRS + "select doc_id, pair, question, answer, timestamp_start, timestamp_end from q where answer is not null")
def t19_question_answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.pairs(transcripts.turns(_documents(spark, d, "qa_transcript"), OWN, OTHER))


@query(_PAIRS + "select doc_id, turn, said, stamped from p where pair = 0")
def t19_monologues(spark: SparkSession, d: str) -> DataFrame:
    """What is said before the first question, turn by turn."""
    return transcripts.monologues(transcripts.turns(_documents(spark, d, "qa_transcript"), OWN, OTHER))


@query(chunking_sql.answers(_PAIRS))
def t18_interview_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Answers packed into chunks, each with its question."""
    found = transcripts.pairs(transcripts.turns(_documents(spark, d, "qa_transcript"), OWN, OTHER))
    return transcripts.answer_chunks(found)


@query(chunking_sql.SEGMENTS)
def t30_segments(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts in segments of at most 3,000 characters, cut at lines and, in long ones, at sentences."""
    return transcripts.segments(_documents(spark, d, "qa_transcript").select("doc_id", "text"), 3000)


_WORDS = [w.replace("ー", "") for w in transcripts.FILLERS]
_EATEN = " ".join(f"when starts_with(s, '{w}') then substr(s, {len(w) + 1})" for w in _WORDS)


@query(rf"""with b as (select distinct chunk_id, text, regexp_replace(text, '[\s\p{{Z}}\p{{P}}ー]+', '', 'g') as bare from parsed_chunks where text is not null)
select chunk_id from b where length(bare) between 1 and {transcripts.MOST_FILLER} and list_reduce(list_transform(generate_series(1, {transcripts.MOST_FILLER}), lambda i: ''), lambda s, x: case {_EATEN} else s end, bare) = ''""")
def t31_fillers(spark: SparkSession, d: str) -> DataFrame:
    """Parsed chunks that say nothing but short replies."""
    chunks = table(spark, d, "parsed_chunks").where("text is not null").select("chunk_id", "text").distinct()
    return chunks.where(transcripts.is_filler(F.col("text"))).select("chunk_id")


@query(r"""with x as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as raw from documents where doc_kind = 'qa_transcript' and text is not null)
select doc_id, count(*) filter (regexp_matches(raw, '^\[\d{1,2}:\d{2}(:\d{2})?\]$')) as stamps, count(*) filter (trim(raw) = '') as blanks, max(length(raw)) as longest, count(*) as lines from x group by 1""")
def t12_line_kinds(spark: SparkSession, d: str) -> DataFrame:
    lines = _documents(spark, d, "qa_transcript").select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    stamp = F.col("raw").rlike(r"^\[\d{1,2}:\d{2}(:\d{2})?\]$")
    return lines.groupBy("doc_id").agg(F.count_if(stamp).alias("stamps"), F.count_if(F.trim("raw") == "").alias("blanks"), F.max(F.length("raw")).cast("long").alias("longest"), F.count("*").alias("lines"))


_LINES = r"""with s as (select chunk_id, text, cast(regexp_extract(timestamp_start, '(\d+):(\d+)$', 1) as integer) as m, cast(regexp_extract(timestamp_start, '(\d+):(\d+)$', 2) as integer) as sec from parsed_chunks where regexp_matches(timestamp_start, '\d+:\d+$') and text is not null),
l as (select chunk_id, unnest([printf('%d:%02d', m, sec) || ' ' || m || '分' || sec || '秒 ' || text, printf('[%d:%02d]', m, sec) || (m + 1) || '分の話', printf('%d:%02d', m, sec), m || '分' || sec || '秒']) as line, unnest([1, 2, 3, 4]) as form, m, sec, text from s)
"""


@query(_LINES + rf"""select distinct chunk_id, form, case form when 1 then regexp_replace(text, '^{_B}+|{_B}+$', '', 'g') else (m + 1) || '分の話' end as text from l where form = 2 or form = 1 and regexp_replace(text, '{_B}+', '', 'g') <> ''""")
def t29_spoken_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their time stamp and its spoken form, of which only a form that names the same time goes; stamps alone are no lines."""
    chunks = table(spark, d, "parsed_chunks").where(F.col("timestamp_start").rlike(r"\d+:\d+$") & F.col("text").isNotNull())
    at = lambda k: F.regexp_extract("timestamp_start", r"(\d+):(\d+)$", k).cast("int")
    stamp = F.format_string("%d:%02d", "m", "s")
    said = F.format_string("%d分%d秒", "m", "s")
    forms = F.array(F.concat(stamp, F.lit(" "), said, F.lit(" "), "text"), F.concat(F.lit("["), stamp, F.lit("]"), F.format_string("%d分の話", F.col("m") + 1)), stamp, said)
    lines = chunks.select("chunk_id", "text", at(1).alias("m"), at(2).alias("s")).select("chunk_id", F.posexplode(forms).alias("form", "line"))
    return lines.select("chunk_id", (F.col("form") + 1).alias("form"), tx.without_stamp(F.col("line")).alias("text")).where("text is not null").distinct()


@query(_TURNS + """, z as (select *, case when lag(speaker) over (partition by doc_id order by turn) = speaker then 0 else 1 end as fresh from t),
r as (select *, sum(fresh) over (partition by doc_id order by turn) as run from z), y as (select doc_id, run, any_value(speaker) as speaker, string_agg(said, ' ' order by turn) as said from r group by all)
select doc_id, string_agg(speaker || '：' || said, chr(10) order by run) as text, count(*) as turns from y group by 1""")
def t32_rendered_turns(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns of one speaker merged, and the transcript written again."""
    return transcripts.rendered(transcripts.turns(_documents(spark, d, "qa_transcript"), OWN, OTHER))


_HEADING = r"^(#+ )?(第[0-9一二三四五六七八九十百]+[章回節]|(?i:chapter|chapitre|part|partie|section) +(\d+|[IVXLCDM]+)\b)"


@query(f"with l as (select doc_id, unnest(string_split(text, chr(10))) as raw from documents where text is not null) select doc_id, count(*) as headings, min(raw) as first_of_all from l where regexp_matches(raw, '{_HEADING}') group by 1")
def t10_detected_headings(spark: SparkSession, d: str) -> DataFrame:
    """Lines that look like the heading of a chapter or section, marked or not."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    return lines.where(F.col("raw").rlike(_HEADING)).groupBy("doc_id").agg(F.count("*").alias("headings"), F.min("raw").alias("first_of_all"))


_DASHED, _ENDED = "^[—―─━－]{1,3} *[^ ]", "[。!?！？、]$"


@query(rf"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line, regexp_replace(unnest(string_split(text, chr(10))), '^{_B}+|{_B}+$', '', 'g') as bare from documents where doc_kind in ('essay', 'letter', 'book_text') and text is not null),
k as (select *, lag(bare) over (partition by doc_id order by line) as above from l)
select doc_id, count(*) filter (regexp_matches(bare, '{_DASHED}')) as asked, count(*) filter (length(bare) between 2 and 24 and not regexp_matches(bare, '{_ENDED}') and not regexp_matches(bare, '{_DASHED}') and coalesce(above, '') = '') as sections, count(*) filter (bare <> '') as lines from k group by 1""")
def t11_interview_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a dash marks as questions, and short lines behind a blank one that may be headings."""
    docs = table(spark, d, "documents").where("doc_kind in ('essay', 'letter', 'book_text') and text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("bare", tx.strip(F.col("raw")))
    above = F.coalesce(F.lag("bare").over(Window.partitionBy("doc_id").orderBy("line")), F.lit(""))
    asked = F.col("bare").rlike(_DASHED)
    short = F.length("bare").between(2, 24) & ~F.col("bare").rlike(_ENDED) & ~asked & (F.col("above") == "")
    return lines.withColumn("above", above).groupBy("doc_id").agg(F.count_if(asked).alias("asked"), F.count_if(short).alias("sections"), F.count_if(F.col("bare") != "").alias("lines"))


@query(f"""select 'book_text' as chunker, doc_id, count(*) as chunks, sum(length(text)) as chars from ({chunking_sql.BOOK}) group by all union all select 'qa_transcript', doc_id, count(*), sum(length(text)) from ({chunking_sql.answers(_PAIRS)}) group by all
union all select 'other', doc_id, count(*), sum(length(text)) from ({chunking_sql.CORPUS}) group by all""")
def t14_chunks_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Every document by the chunker of its kind."""
    from corpusloom.plans.reference_more import t28_paragraph_chunks

    parts = [
        ("book_text", chunking.book_chunks(_documents(spark, d, "book_text"))),
        ("qa_transcript", transcripts.answer_chunks(transcripts.pairs(transcripts.turns(_documents(spark, d, "qa_transcript"), OWN, OTHER)))),
        ("other", t28_paragraph_chunks(spark, d)),
    ]
    every = [p.select(F.lit(name).alias("chunker"), "doc_id", F.length("text").cast("long").alias("size")) for name, p in parts]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("chunker", "doc_id").agg(F.count("*").alias("chunks"), F.sum("size").alias("chars"))


@query(r"""with h as (select doc_id, list_transform(string_split(text, chr(10))[1:6], lambda x: trim(x)) as head from documents where text is not null),
t as (select doc_id, nullif(trim(regexp_extract(list_filter(head, lambda x: regexp_matches(x, '^(?i:title|題名|動画名)\s*[:：]'))[1], '^[^:：]*[:：](.*)$', 1)), '') as title, list_filter(head, lambda x: regexp_matches(x, 'https?://[^\s]+'))[1] as url from h)
select doc_id, regexp_replace(title, '^[「『【](.*)[」』】]$', '\1') as title, regexp_extract(url, 'https?://[^\s]+', 0) as url from t where title is not null or url is not null""")
def s15_headers(spark: SparkSession, d: str) -> DataFrame:
    """Title and address in the first six lines; brackets around the whole title go."""
    head = F.transform(F.slice(F.split("text", "\n"), 1, 6), F.trim)
    title = F.get(F.filter(head, lambda x: x.rlike(r"^(?i:title|題名|動画名)\s*[:：]")), 0)
    address = F.get(F.filter(head, lambda x: x.rlike(r"https?://[^\s]+")), 0)
    found = table(spark, d, "documents").where("text is not null").select("doc_id", F.nullif(F.trim(F.regexp_extract(title, "^[^:：]*[:：](.*)$", 1)), F.lit("")).alias("title"), F.regexp_extract(address, r"https?://[^\s]+", 0).alias("url"))
    return found.where("title is not null or url is not null").select("doc_id", F.regexp_replace("title", "^[「『【](.*)[」』】]$", "$1").alias("title"), "url")


# Annotated files

_FILES = r"""with f as (select doc_id, text, regexp_extract(text, '(?s)^[^\n]*\n[^\n]*\n.*?\n-{10,}\n.*?\n-{10,}(.*)$', 1) as behind from documents where doc_kind = 'annotated_file' and text is not null),
s as (select doc_id, text, split_part(text, chr(10), 1) as title, split_part(text, chr(10), 2) as author, regexp_replace(behind, '(?s)\n底本[：:].*$', '') as body, regexp_extract(text, '(?s)\n(底本[：:].*)$', 1) as colophon from f)
"""


@query(_FILES + "select doc_id, title, author, length(body) as body_chars, length(colophon) as colophon_chars, sha256(body) as body_hash from s")
def t21_split_files(spark: SparkSession, d: str) -> DataFrame:
    """Title, author, body between the second rule and the colophon, and the colophon."""
    behind = F.regexp_extract("text", r"(?s)^[^\n]*\n[^\n]*\n.*?\n-{10,}\n.*?\n-{10,}(.*)$", 1)
    body, colophon = F.regexp_replace(behind, r"(?s)\n底本[：:].*$", ""), F.regexp_extract("text", r"(?s)\n(底本[：:].*)$", 1)
    part = lambda n: F.split_part("text", F.lit("\n"), F.lit(n))
    return _documents(spark, d, "annotated_file").select(
        "doc_id", part(1).alias("title"), part(2).alias("author"), F.length(body).cast("long").alias("body_chars"), F.length(colophon).cast("long").alias("colophon_chars"), F.sha2(body, 256).alias("body_hash")
    )


@query(_FILES + rf""", l as (select doc_id, generate_subscripts(string_split(colophon, chr(10)), 1) as line, unnest(string_split(colophon, chr(10))) as raw from s where colophon <> ''),
k as (select *, regexp_extract(raw, '^([^：:]{{1,20}})[：:]', 1) as key, sum(case when regexp_matches(raw, '^[^：:]{{1,20}}[：:]') then 1 else 0 end) over (partition by doc_id order by line) as entry from l where regexp_replace(raw, '{_B}+', '', 'g') <> '')
select doc_id, entry, max(key) as key, string_agg(regexp_replace(regexp_replace(raw, '^[^：:]{{1,20}}[：:]', ''), '^{_B}+|{_B}+$', '', 'g'), ' ' order by line) as value from k group by all""")
def t22_colophon_fields(spark: SparkSession, d: str) -> DataFrame:
    """The colophon's fields; a line without a key goes on."""
    colophon = F.regexp_extract("text", r"(?s)\n(底本[：:].*)$", 1)
    lines = _documents(spark, d, "annotated_file").select("doc_id", F.posexplode(F.split(colophon, "\n")).alias("line", "raw")).where(tx.strip(F.col("raw")) != "")
    key = F.regexp_extract("raw", "^([^：:]{1,20})[：:]", 1)
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    entries = lines.select("doc_id", "line", key.alias("key"), tx.strip(F.regexp_replace("raw", "^[^：:]{1,20}[：:]", "")).alias("value")).withColumn("entry", F.sum((F.col("key") != "").cast("long")).over(w))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"])
    return entries.groupBy("doc_id", "entry").agg(F.max("key").alias("key"), F.array_join(ordered, " ").alias("value"))


_RUBY = r"(?:｜([^｜《》\n]+)|([一-鿿々〆ヶ]+))《([^《》\n]+)》"


@query(rf"""with a as (select doc_id, unnest(regexp_extract_all(text, '{_RUBY}', 1)) as marked, unnest(regexp_extract_all(text, '{_RUBY}', 2)) as run, unnest(regexp_extract_all(text, '{_RUBY}', 3)) as reading from documents where doc_kind = 'annotated_file' and text is not null)
select coalesce(nullif(marked, ''), run) as base, reading, count(*) as uses, count(distinct doc_id) as documents from a group by all""")
def t23_ruby_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every base and reading: the base is what the mark begins, else the run of kanji."""
    group = lambda n: F.regexp_extract_all("text", F.lit(_RUBY), F.lit(n))
    pairs = _documents(spark, d, "annotated_file").select("doc_id", F.explode(F.arrays_zip(group(1).alias("marked"), group(2).alias("run"), group(3).alias("reading"))).alias("x"))
    named = pairs.select("doc_id", F.coalesce(F.nullif("x.marked", F.lit("")), "x.run").alias("base"), "x.reading")
    return named.groupBy("base", "reading").agg(F.count("*").alias("uses"), F.countDistinct("doc_id").alias("documents"))


@query(chunking_sql.TABLE)
def t26_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of annotated files, cut at notes that name a heading."""
    chapters = chunking.annotated_chapters(_documents(spark, d, "annotated_file").select("doc_id", "text"))
    return chapters.select("doc_id", "chapter", "title", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


@query(r"""with t as (select doc_id, text, regexp_replace(text, '［＃[^］]*］', '', 'g') as bare from documents where doc_kind = 'annotated_file' and text is not null),
n as (select doc_id, text, regexp_replace(regexp_replace(bare, '｜([^｜《》\n]+)《([^《》\n]+)》', '\1', 'g'), '《[^《》\n]+》', '', 'g') as normalized, regexp_replace(regexp_replace(bare, '｜([^｜《》\n]+)《([^《》\n]+)》', '\1（\2）', 'g'), '([一-鿿々〆ヶ]+)《([^《》\n]+)》', '\1（\2）', 'g') as display from t)
select doc_id, sha256(text) as raw_hash, sha256(normalized) as normalized_hash, sha256(display) as display_hash, length(normalized) as normalized_chars, length(display) as display_chars from n""")
def t27_three_forms(spark: SparkSession, d: str) -> DataFrame:
    """Raw, normalized and display form of annotated files, by hash and length."""
    bare = tx.without_notes(F.col("text"))
    forms = _documents(spark, d, "annotated_file").select("doc_id", "text", tx.without_ruby(bare).alias("normalized"), tx.displayed_ruby(bare).alias("display"))
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return forms.select("doc_id", F.sha2("text", 256).alias("raw_hash"), F.sha2("normalized", 256).alias("normalized_hash"), F.sha2("display", 256).alias("display_hash"), chars("normalized"), chars("display"))


# Lines and titles


@query(r"""select chunk_type, count(*) as chunks, count(*) filter (regexp_matches(text, '[。．！？!?.…”」』][\s\p{Z}]*$')) as ended from source_chunks where text is not null group by 1""")
def t8_sentence_ends(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks end with a sentence."""
    ended = F.col("text").rlike(rf"[{tx.SENTENCE_ENDS}][\s\p{{Z}}]*$")
    return table(spark, d, "source_chunks").where("text is not null").groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.count_if(ended).alias("ended"))


_JA = r"[\x{3000}-\x{30ff}\x{3400}-\x{9fff}\x{ff00}-\x{ff60}]"


@query(rf"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([a-zà-ÿ])-\n([a-zà-ÿ])', '\1\2', 'g'), '({_JA})\n({_JA})', '\1\2', 'g'), '([^\n])\n([^\n])', '\1 \2', 'g') as text from documents where doc_kind in ('essay', 'letter') and text is not null""")
def t9_joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """Broken lines joined: a hyphen goes between small letters, Japanese needs nothing, the rest a blank; blank lines part paragraphs."""
    docs = table(spark, d, "documents").where("doc_kind in ('essay', 'letter') and text is not null")
    return docs.select("doc_id", tx.joined_lines(F.col("text")).alias("text"))


@query(r"""select doc_id, coalesce(nullif(trim(title), ''), nullif(trim(regexp_extract(text, '^#+ ([^\n]*)', 1)), ''), regexp_replace(source || '_' || doc_id, '^\d+[_\s]+', '')) as title from documents""")
def t39_titles(spark: SparkSession, d: str) -> DataFrame:
    """The title given, else that of the heading, else a name without its number in front."""
    heading = F.trim(F.regexp_extract("text", r"^#+ ([^\n]*)", 1))
    name = F.regexp_replace(F.concat("source", F.lit("_"), F.col("doc_id").cast("string")), r"^\d+[_\s]+", "")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(heading, F.lit("")), name).alias("title"))


@query(r"""select canonical_work_id, canonical_title_reading as reading, regexp_replace(regexp_replace(canonical_title_reading, '[\s\p{Z}\x{85}]+', '', 'g'), 'ー', '', 'g') as bare from canonical_works where canonical_title_reading is not null""")
def t3_bare_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings without white space and long marks (their width is normalised by ``nfkc`` where it is wanted)."""
    works = table(spark, d, "canonical_works").where("canonical_title_reading is not null")
    return works.select("canonical_work_id", F.col("canonical_title_reading").alias("reading"), tx.bare_reading(F.col("canonical_title_reading")).alias("bare"))


@query(rf"""select chunk_id, nullif(regexp_replace(regexp_replace(section_title, '\p{{Cc}}', '', 'g'), '^{_B}+|{_B}+$', '', 'g'), '') as title from parsed_chunks""")
def t4_clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_chunks").select("chunk_id", tx.blank_to_null(tx.without_controls(F.col("section_title"))).alias("title"))


@query("select card_id, array_to_string(representative_chunk_ids[1:2], ',') as first_ids, substr(core_claim, 1, 10) as claim from thought_cards")
def o8_slices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "thought_cards").select("card_id", F.array_join(F.slice("representative_chunk_ids", 1, 2), ",").alias("first_ids"), F.substring("core_claim", 1, 10).alias("claim"))


@query(r"""select chunk_id, list_sum(list_transform(regexp_extract_all(text, '「[^」]*」'), lambda x: length(x))) >= 30 and 10 * list_sum(list_transform(regexp_extract_all(text, '「[^」]*」'), lambda x: length(x))) >= 6 * length(text) as block from source_chunks where contains(text, '「') and len(regexp_extract_all(text, '「[^」]*」')) > 0""")
def g12_block_quotations(spark: SparkSession, d: str) -> DataFrame:
    """Whether at least 30 characters and three fifths of a chunk are quoted."""
    quotes = F.regexp_extract_all("text", F.lit("「[^」]*」"), F.lit(0))
    quoted = F.length(F.array_join(quotes, ""))
    found = table(spark, d, "source_chunks").where(F.contains("text", F.lit("「")) & (F.size(quotes) > 0))
    return found.select("chunk_id", ((quoted >= 30) & (quoted * 10 >= F.length("text") * 6)).alias("block"))
