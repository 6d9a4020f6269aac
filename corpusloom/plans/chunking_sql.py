"""The SQL of the chunking queries: the same folds, written for lists."""

from __future__ import annotations

import unicodedata

from corpusloom.functions import text as tx
from corpusloom.operators import chunking as ch

_B = r"[\s\p{Z}\x{85}]"


def bare(column: str) -> str:
    return f"regexp_replace({column}, '^{_B}+|{_B}+$', '', 'g')"


def _begins(most: int, least: int | None = None, joint: int = 0) -> str:
    """Where the chunks of the list ``parts`` (text, kind) begin, and its end."""
    new = f"(s.held < 0 or s.held + p.held > {most} or s.kind is distinct from p.kind)"
    held = f"(case when {new} then p.held else s.held + p.held + {joint} end)"
    full = f"case when {held} >= {least} then -1 else {held} end" if least is not None else held
    state = "list_transform(parts, lambda v: {'begins': []::int[], 'at': 0, 'held': length(v.text), 'kind': v.kind})"
    step = f"lambda s, p: {{'begins': case when {new} then list_append(s.begins, s.at) else s.begins end, 'at': s.at + 1, 'held': {full}, 'kind': p.kind}}"
    return f"list_reduce({state}, {step}, {{'begins': []::int[], 'at': 1, 'held': -1::bigint, 'kind': null::varchar}})"


def cut(name: str, source: str, keys: str, most: int, least: int | None = None, joint: int = 0, number: str = "number") -> str:
    """CTE ``name``: the keys, the number of a chunk (from 0) and its own list ``mine``, of a source with a list ``parts``."""
    return f"""{name}_f as (select {keys}, parts, {_begins(most, least, joint)} as f from {source}), {name}_b as (select {keys}, parts, list_append(f.begins, f.at) as b from {name}_f),
{name}_n as (select {keys}, parts, b, unnest(generate_series(1, len(b) - 1)) as n from {name}_b), {name} as (select {keys}, n - 1 as {number}, parts[b[n]:b[n + 1] - 1] as mine from {name}_n)"""


def joined(by: str) -> str:
    return f"array_to_string(list_transform(mine, lambda x: x.text), {by})"


def sentences(name: str, source: str, keys: str, most: int, pattern: str) -> str:
    """CTE ``name``: the keys, piece and text of a source with a text."""
    found = f"case when length(text) > {most} then regexp_extract_all(text, '{pattern}') else [text] end"
    parts = f"{name}_p as (select {keys}, list_transform({found}, lambda x: {{'text': x, 'kind': null::varchar}}) as parts from {source})"
    return parts + ", " + cut(f"{name}_c", f"{name}_p", keys, most, number="piece") + f", {name} as (select {keys}, piece, {joined(chr(39) * 2)} as text from {name}_c)"


def lines(kinds: str, more: str = "") -> str:
    return f"select doc_id{more}, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as raw from {kinds}"


_PLACE = "doc_id, chapter, part, title, section"
BOOK = (
    f"""with l as ({lines("documents where doc_kind = 'book_text' and text is not null")}), m as (select doc_id, line, {bare("raw")} as raw from l),
v as (select *, length(regexp_extract(raw, '^(##?) ', 1)) as level, {bare("regexp_replace(raw, '^##? ', '')")} as named from m),
w as (select *, sum(case when level = 1 then 1 else 0 end) over o as chapter, sum(case when level > 0 then 1 else 0 end) over o as part, sum(case when raw = '' then 1 else 0 end) over o as gap from v window o as (partition by doc_id order by line)),
t as (select *, max(case when level = 1 then named end) over (partition by doc_id, chapter) as title, max(case when level = 2 then named end) over (partition by doc_id, part) as section from w),
paras as (select {_PLACE}, gap, string_agg(raw, '' order by line) as text from t where level = 0 and raw <> '' group by all),
"""
    + sentences("pieces", "paras", _PLACE + ", gap", ch.MOST, ch.SENTENCE)
    + f", listed as (select {_PLACE}, list({{'text': text, 'kind': null::varchar}} order by gap, piece) as parts from pieces group by all), "
    + cut("packed", "listed", _PLACE, ch.MOST, ch.LEAST, 1, "cut")
    + f""", numbered as (select *, {joined("chr(10)")} as text, row_number() over (partition by doc_id, chapter order by part, cut) as number from packed),
kept as (select *, max(case when number = 1 or length(text) >= {ch.SMALL} then number end) over (partition by doc_id, chapter order by number) as k from numbered),
c as (select doc_id, cast(chapter as integer) as chapter, cast(k as integer) as number, arg_min(title, number) as title, arg_min(section, number) as section, string_agg(text, chr(10) order by number) as text from kept group by doc_id, chapter, k)
select printf('%d_CH%02d_%03d', doc_id, chapter, number) as chunk_id, doc_id, chapter, number, (select any_value(t.title) from t where t.doc_id = c.doc_id and t.chapter = c.chapter) as title, section, text, sha256(text) as chunk_hash from c"""
)

_RULES = r"(?s)\A.*?(?m:^-{10,}$).*?(?m:^-{10,}$)"
_SPLIT = tx.HEADING_NOTE.replace("([^」]+)", "[^」]+")
#: CTE chapters (doc_id, fiction, chapter, title, text) of the rows f (doc_id, fiction, text).
CHAPTERS = rf"""n as (select doc_id, fiction, replace(text, chr(13) || chr(10), chr(10)) as text from f),
b as (select doc_id, fiction, regexp_replace(regexp_replace(case when len(regexp_extract_all(text, '(?m)^-{{10,}}$')) >= 2 then regexp_replace(text, '{_RULES}', '') else regexp_replace(text, '\A[^\n]*\n?[^\n]*\n?', '') end, '(?ms)^底本[：:].*\z', ''), '\A\n+|\n+\z', '', 'g') as body from n),
h as (select doc_id, fiction, body, regexp_extract_all(body, '{tx.HEADING_NOTE}', 1) as titles, string_split_regex(body, '{_SPLIT}') as texts from b),
e as (select doc_id, fiction, unnest(generate_series(1, greatest(len(titles), 1))) as chapter, titles, texts, body from h),
p as (select doc_id, fiction, chapter, titles[chapter] as title, titles[chapter + 1] as later, case when len(titles) = 0 then {bare("body")} else texts[chapter + 1] end as text from e),
q as (select doc_id, fiction, chapter, title, case when later is not null then regexp_replace(text, '{tx.NOTE}\s*\Q' || later || '\E\s*\z', '') else text end as text from p),
r as (select doc_id, fiction, chapter, title, case when title is not null then regexp_replace(text, '\A[\n 　]+|[\n 　]+\z', '', 'g') else text end as text from q),
chapters as (select doc_id, fiction, chapter, title, regexp_replace(regexp_replace(regexp_replace(text, '{tx.RUBY_MARKED}', '\1', 'g'), '《[^《》\n]+》', '', 'g'), '{tx.NOTE}', '', 'g') as text from r)""".replace("\\\\n", "\\n")

TABLE = f"""with f as (select doc_id, false as fiction, text from documents where doc_kind = 'annotated_file' and text is not null), {CHAPTERS}
select doc_id, cast(chapter as integer) as chapter, title, cast(length(text) as integer) as chars, sha256(text) as digest from chapters"""

_KEYS = "doc_id, fiction, chapter, title"
CORPUS = (
    f"""with told as (select distinct canonical_work_id from work_editions where canonical_work_id is not null and edition_id in (select edition_id from sources where document_genre in ('novel', 'short_story', 'sketch') and edition_id is not null)),
d as (select doc_id, doc_kind, text, coalesce(canonical_work_id in (select canonical_work_id from told), false) as fiction from documents where doc_kind in ('essay', 'letter', 'annotated_file') and text is not null),
f as (select doc_id, fiction, text from d where doc_kind = 'annotated_file'), {CHAPTERS},
every as (select {_KEYS}, text from chapters union all select doc_id, fiction, 1, null, text from d where doc_kind <> 'annotated_file'),
l as ({lines("every", ", fiction, chapter, title")}),
placed as (select {_KEYS}, line, raw as text, coalesce(sum(length(raw) + 1) over (partition by doc_id, chapter order by line rows between unbounded preceding and 1 preceding), 0) as at_line from l),
held as (select * from placed where {bare("text")} <> ''),
"""
    + sentences("pieces", "held", _KEYS + ", line, at_line", ch.MOST_OF_LINES, ch.CLOSED_SENTENCE)
    + f""", started as (select *, at_line + coalesce(sum(length(text)) over (partition by doc_id, chapter, line order by piece rows between unbounded preceding and 1 preceding), 0) as start from pieces),
listed as (select {_KEYS}, list({{'text': text, 'kind': case when not fiction then 'body' when regexp_matches(text, '^[　 ]*[「『]') then 'dialogue' else 'narration' end, 'start': start}} order by start) as parts from started group by all), """
    + cut("packed", "listed", _KEYS, ch.MOST_OF_LINES)
    + f""" select doc_id, cast(chapter as integer) as chapter, cast(number + 1 as integer) as number, title, cast(mine[1].start as integer) as char_start, cast(mine[-1].start + length(mine[-1].text) as integer) as char_end, mine[1].kind as kind, {joined("chr(10)")} as text from packed"""
)

SEGMENTS = (
    f"""with l as ({lines("documents where doc_kind = 'qa_transcript' and text is not null")}), e as (select doc_id, line, raw || case when line < max(line) over (partition by doc_id) then chr(10) else '' end as text from l),
held as (select * from e where text <> ''), """
    + sentences("pieces", "held", "doc_id, line", 3000, ch.SENTENCE)
    + ", listed as (select doc_id, list({'text': text, 'kind': null::varchar} order by line, piece) as parts from pieces group by all), "
    + cut("packed", "listed", "doc_id", 3000)
    + f" select doc_id, cast(number + 1 as integer) as number, {joined(chr(39) * 2)} as text from packed"
)


def answers(pairs: str) -> str:
    """Of the SQL that gives the pairs as q."""
    return (
        pairs
        + ", a as (select doc_id, pair, question, answer as text from q where answer is not null), "
        + sentences("pieces", "a", "doc_id, pair, question", ch.MOST, ch.SENTENCE)
        + ", listed as (select doc_id, pair, question, list({'text': text, 'kind': null::varchar} order by piece) as parts from pieces group by all), "
        + cut("packed", "listed", "doc_id, pair, question", ch.MOST, ch.LEAST)
        + f" select doc_id, pair, cast(number + 1 as integer) as number, question, {joined(chr(39) * 2)} as text from packed"
    )


def diversified(rows: str, keys: str, out: str, most: int = 10, per_source: int = 5, per_role: int = 3) -> str:
    """The rows (keys, query, chunk_id, source_id, role, position) that are kept, as ``out``."""
    take = (
        f"(len(s.kept) < {most} and len(list_filter(s.sources, lambda x: x is not distinct from p.source)) < {per_source} and "
        f"(p.role is null or len(list_filter(s.roles, lambda x: x is not distinct from p.role)) < {per_role}))"
    )
    step = f"lambda s, p: {{'kept': case when {take} then list_append(s.kept, p.id) else s.kept end, 'sources': case when {take} then list_append(s.sources, p.source) else s.sources end, 'roles': case when {take} then list_append(s.roles, p.role) else s.roles end, 'id': p.id, 'source': p.source, 'role': p.role}}"
    empty = "'kept': []::varchar[], 'sources': []::varchar[], 'roles': []::varchar[]"
    return f"""{out}_l as (select query, list({{{empty}, 'id': chunk_id, 'source': source_id, 'role': role}} order by position) as parts from {rows} group by 1),
{out}_f as (select query, unnest(list_reduce(parts, {step}, {{{empty}, 'id': null::varchar, 'source': null::varchar, 'role': null::varchar}}).kept) as chunk_id from {out}_l),
{out} as (select {keys} from {rows} join {out}_f using (query, chunk_id))"""


def nfkc(column: str) -> str:
    """Compatibility composition for characters that have one counterpart, by rule from the Unicode tables, and the ellipsis; DuckDB has only the canonical one."""
    single = {c: k for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]) if len(k := unicodedata.normalize("NFKC", c)) == 1 and k != c}
    quoted = lambda chars: "".join(chars).replace("'", "''")
    return f"nfc_normalize(replace(translate({column}, '{quoted(single)}', '{quoted(single.values())}'), '…', '...'))"


def without_noise(column: str) -> str:
    noise = tx.NOISE.replace("'", "''")
    return f"regexp_replace({column}, '{noise}', '', 'g')"


def comparable(column: str) -> str:
    return f"regexp_replace({without_noise(nfkc(column))}, '[\\x1c-\\x1f\\x{{85}}]', '', 'g')"


def similarity(drafts: str, texts: str, n: int = 10, longest: int = 20, most: float = 0.05) -> str:
    """Verdicts of drafts (draft_id, text) against texts (id, text)."""
    return f"""with dr as (select distinct draft_id, {comparable("text")} as text from ({drafts})), c as (select row_number() over () as cid, id, text from (select distinct id, {comparable("text")} as text from ({texts}))),
g as (select draft_id, k, substr(text, k, {n}) as gram from dr, lateral (select unnest(generate_series(1, length(text) - {n - 1})) as k)),
t as (select cid, j, substr(text, j, {n}) as gram from c, lateral (select unnest(generate_series(1, length(text) - {n - 1})) as j)),
m as (select draft_id, cid, k, j, gram from g join t using (gram)),
r as (select *, k - row_number() over (partition by draft_id, cid, k - j order by k) as run from m),
l as (select draft_id, max(size) as longest from (select draft_id, count(*) + {n - 1} as size from r group by draft_id, cid, k - j, run) group by 1),
s as (select draft_id, count(distinct cid) as chunks, count(distinct gram) as shared from m group by 1), a as (select draft_id, count(distinct gram) as grams from g group by 1)
select dr.draft_id, coalesce(l.longest, 0) as longest, coalesce(s.chunks, 0) as chunks, round(coalesce(shared / grams, 0), 4) as ratio, coalesce(l.longest, 0) < {longest} and coalesce(shared / grams, 0) <= {most} as passed
from dr left join l using (draft_id) left join s using (draft_id) left join a using (draft_id)"""
