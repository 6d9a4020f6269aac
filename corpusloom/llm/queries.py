"""Registered queries of the llm problems, with their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import evaluation_leaks as leaks
from corpusloom.llm import formatting_duplicates as formatting
from corpusloom.llm import look_alikes, shared_spans, source_mixture, subject_areas, wrong_encodings
from corpusloom.runtime import table


def _chunk_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    source = table(spark, sf_dir, "source_chunks").where("chunker_version is null or chunker_version <> 'aozora_v0'")
    return {"source_chunks": source, "parsed_chunks": table(spark, sf_dir, "parsed_chunks")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.records_with_shared_spans(_chunk_tables(spark, sf_dir))


def p2_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each chunk stands elsewhere."""
    return shared_spans.shared_report(_chunk_tables(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alikes.look_alike_works(table(spark, sf_dir, "canonical_works"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title, reading and variant with its consistent form."""
    return look_alikes.consistent_forms(look_alikes.work_values(table(spark, sf_dir, "canonical_works")))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of values that look the same, with their spellings and works."""
    return look_alikes.look_alike_classes(table(spark, sf_dir, "canonical_works")).where("spellings > 1").drop("form")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.duplicate_members(table(spark, sf_dir, "parsed_chunks"))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.collapsed(table(spark, sf_dir, "parsed_chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_encodings.garbled_records(table(spark, sf_dir, "source_chunks"), table(spark, sf_dir, "work_editions"))


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled texts with their original text, where possible."""
    records = wrong_encodings.records_of(table(spark, sf_dir, "source_chunks"), table(spark, sf_dir, "work_editions"))
    return wrong_encodings.garbled(records).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents"))


def p7_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.reparameterised(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of copies."""
    return source_mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual shares of the mixture."""
    return source_mixture.shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas.subjects_of_documents(*(table(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_labels")))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject."""
    return subject_areas.composition(*(table(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_labels")))


QUERIES = {f.__name__: f for f in (p2_found, p2_shared, p3_found, p3_forms, p3_classes, p5_found, p5_collapsed, p6_found, p6_restored, p7_found, p7_reparameterised, p8_mixture, p8_shares, p9_found, p9_composition)}

_LETTERS = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_FIELDS = (
    r"array_to_string(list_sort(list_filter(list_transform(string_split_regex(text, '[\n\r／]'), lambda x: "
    + _LETTERS.format("x")
    + r"), lambda x: x <> '')), chr(10))"
)
_P5 = f"""
with c as (
  select chunk_id as id, coalesce(chunk_type = 'qa_pair', false) as q,
    case when coalesce(chunk_type = 'qa_pair', false) then {_FIELDS} else {_LETTERS.format("text")} end as canon
  from parsed_chunks where chunk_id is not null
), k as (select distinct id, q, canon from c where length(replace(canon, chr(10), '')) >= 30),
g as (select id, min(id) over (partition by q, canon) as kept_id from k)
"""
# Width is all that compatibility composition changes in letters and digits here; DuckDB has canonical composition only.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _canonical(column: str) -> str:
    bare = rf"regexp_replace({column}, '《[\x{{3040}}-\x{{30ff}}\s\p{{Z}}・]{{0,60}}》|[［\[][＃#][^］\]]*[］\]]', '', 'g')"
    return rf"lower(regexp_replace(nfc_normalize(translate({bare}, '{_WIDE}', '{_NARROW}')), '[^\p{{L}}\p{{N}}]+', '', 'g'))"


_P7 = f"""
with i as (select item_id, min({_canonical("text")}) as c from eval_items where item_id is not null and text is not null group by 1),
d as (select distinct doc_id, {_canonical("text")} as c from documents where doc_id is not null and text is not null),
ig as (select item_id, length(c) as chars, k, substr(c, k, 20) as s from i, lateral (select unnest(generate_series(1, length(c) - 19)) as k)),
dg as (select distinct doc_id, substr(c, k, 20) as s from d, lateral (select unnest(generate_series(1, length(c) - 19)) as k)),
m as (select distinct item_id, doc_id, chars, k from ig join dg using (s)),
r as (select *, lead(k) over (partition by item_id, doc_id order by k) as later from m)
"""
#: The look-alikes of the SQL, a class to a line; the operator has its own, larger table.
_LOOK_ALIKES = """
A Α А
B Β В
C С Ϲ
E Ε Е
H Η Н
I Ι І
J Ј
K Κ К
M Μ М
N Ν
O Ο О
P Ρ Р
S Ѕ
T Τ Т
X Χ Х
Y Υ Ү
Z Ζ
a а α
c с ϲ
e е
i і ι
j ј
o ο о
p р ρ
s ѕ
v ν
x х
y у
ト 卜
ニ 二
タ 夕
カ 力
ハ 八
エ 工
ロ 口
へ ヘ
べ ベ
ぺ ペ
チ 千
ミ 三
オ 才
ヌ 又
ー 一 ― — – ‐ ‑ ‒ − - ─ ━
・ · ‧ • ∙ ⋅
~ 〜 ∼
' ’ ‘ ʼ ′
" “ ” ″
"""


def _form(column: str) -> str:
    """The look-alike form for characters that compose to one character; width and compatibility characters by rule from the Unicode tables."""
    single = {}
    for c in map(chr, [*range(0xA1, 0xD800), *range(0xF900, 0x10000)]):
        tag, *codes = unicodedata.decomposition(c).split() or [""]
        tag, codes = (tag, codes) if tag.startswith("<") else ("", [tag, *codes])
        if len(codes) == 1 and codes[0] and tag in ("", "<wide>", "<narrow>", "<compat>"):
            k = chr(int(codes[0], 16))
            if not k.isspace() and c not in "ﾠㅤᅠ":
                single[c] = k
    quoted = lambda chars: "".join(chars).replace("'", "''")
    # A base letter before its accents are composed, a composed one after.
    classes = {c: line.split()[0] for line in _LOOK_ALIKES.strip().splitlines() for c in line.split()[1:]}
    fold = lambda x, table: f"translate({x}, '{quoted(table)}', '{quoted(table.values())}')"
    blanks = rf"regexp_replace({column}, '[\s\p{{Z}}\x{{85}}\x1c-\x1f]', ' ', 'g')"
    visible = rf"regexp_replace({blanks}, '[\p{{Cf}}\p{{Cc}}\x{{fe00}}-\x{{fe0f}}\x{{34f}}\x{{115f}}\x{{1160}}\x{{3164}}\x{{ffa0}}]', '', 'g')"
    return f"trim(regexp_replace({fold(f'nfc_normalize({fold(fold(visible, single), classes)})', classes)}, ' +', ' ', 'g'))"


_P3_FORMS = f"""
with v as (
  select 'canonical_title' as field, person_id, canonical_work_id as work, canonical_title as value from canonical_works
  union select 'canonical_title_reading', person_id, canonical_work_id, canonical_title_reading from canonical_works
  union select 'title_variants', person_id, canonical_work_id, unnest(title_variants) from canonical_works
), f as (select *, {_form("value")} as form from v where value is not null and person_id is not null and work is not null)
"""
_P3 = _P3_FORMS + """
select distinct a.field, a.work as work_a, b.work as work_b from f a join f b on a.field = b.field and a.person_id = b.person_id and a.form = b.form and a.work < b.work and a.value <> b.value
where a.form <> ''
"""
_P2 = """
with t as (
  select 'source_chunks' as record_table, chunk_id, text from source_chunks where (chunker_version is null or chunker_version <> 'aozora_v0') and length(text) >= 60 and chunk_id is not null
  union select 'parsed_chunks', chunk_id, text from parsed_chunks where length(text) >= 60 and chunk_id is not null
), g as (
  select record_table, chunk_id, length(text) as chars, i, substr(text, i, 60) as s from t, lateral (select unnest(generate_series(1, length(text) - 59)) as i)
), d as (select s from g group by s having min(chunk_id) < max(chunk_id)),
h as (select distinct record_table, chunk_id, chars, i from g where s in (select s from d)),
r as (select *, lead(i) over w as later, lag(i) over w as earlier from h window w as (partition by record_table, chunk_id order by i))
"""
SQL = {
    "p2_found": _P2 + "select distinct record_table, chunk_id from h",
    "p2_shared": _P2
    + "select record_table, chunk_id, chars, cast(sum(least(60, coalesce(later - i, 60))) as bigint) as shared_chars, count(*) filter (earlier is null or i > earlier + 60) as passages, "
    + "sum(least(60, coalesce(later - i, 60))) / chars as share from r group by record_table, chunk_id, chars",
    "p3_found": _P3,
    "p3_classes": _P3_FORMS + "select field, person_id, min(value) as first_value, count(distinct value) as spellings, count(distinct work) as works from f where form <> '' group by field, person_id, form having count(distinct value) > 1",
    "p7_found": _P7 + "select item_id, doc_id from r group by item_id, doc_id, chars having 2 * sum(least(20, coalesce(later - k, 20))) >= chars",
    "p5_found": _P5 + "select distinct kept_id, id as copy_id from g where id <> kept_id",
    "p5_collapsed": _P5 + "select min(id) as kept_id, count(*) as copies from k group by q, canon",
}
