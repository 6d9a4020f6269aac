"""Column expressions for text; Unicode white space throughout, as Spark's trim and Java's \\s know ASCII only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"[\s\p{Z}\x{85}]"
SENTENCE_ENDS = "。．！？!?.…”」』"

#: Old and new forms of kanji, in pairs.
OLD_KANJI, NEW_KANJI = "藝體學國會來圓廣戀櫻澤眞祕續萬號變驅", "芸体学国会来円広恋桜沢真秘続万号変駆"
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
#: Fixed value: white space and punctuation that comparison ignores.
NOISE = "[\\s、。，．・「」『』（）()\\[\\]〔〕【】…―ー−—’'\"“”！？!?：:；;\\p{Z}]"

#: Kinds of editor's notes, the first that matches counts.
NOTE_KINDS = [
    ("emphasis_note", "傍点|太字|強調"),
    ("gaiji_note", "水準|Unicode|unicode"),
    ("formatting_note", "字下げ|見出し|地から|改丁|改ページ|字上げ"),
    ("page_note", "ページ"),
    ("original_text_note", "底本|ママ"),
]
#: Notes, notes that name a heading, ruby with and without the mark at which its base begins.
NOTE = "［＃[^］]*］"
HEADING_NOTE = "［＃「([^」]+)」は(?:大|中|小)見出し］"
RUBY_MARKED = "｜([^｜《》\\n]+)《([^《》\\n]+)》"
RUBY_KANJI = "([一-鿿々〆ヶ]+)《([^《》\\n]+)》"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def without_controls(c: Column) -> Column:
    """A line without control characters, trimmed."""
    return strip(F.regexp_replace(c, r"\p{Cc}", ""))


def occurrences(text: Column, term: str) -> Column:
    """How often a term stands in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term)))) / len(term)).cast("int")


def folded_title(c: Column) -> Column:
    """A title for comparison, of half-width input: no white space, new kanji, hiragana."""
    return F.translate(F.regexp_replace(c, f"{BLANK}+", ""), OLD_KANJI + KATAKANA, NEW_KANJI + HIRAGANA)


def without_noise(c: Column) -> Column:
    return F.regexp_replace(c, NOISE, "")


def note_kind(c: Column) -> Column:
    kind = F.lit("editorial_note")
    for name, pattern in reversed(NOTE_KINDS):
        kind = F.when(c.rlike(pattern), name).otherwise(kind)
    return kind


def without_notes(c: Column) -> Column:
    return F.regexp_replace(c, NOTE, "")


def without_ruby(c: Column) -> Column:
    """The surface stays, readings go."""
    return F.regexp_replace(F.regexp_replace(c, RUBY_MARKED, "$1"), "《[^《》\\n]+》", "")


def displayed_ruby(c: Column) -> Column:
    """Readings in brackets behind their surface."""
    return F.regexp_replace(F.regexp_replace(c, RUBY_MARKED, "$1（$2）"), RUBY_KANJI, "$1（$2）")


def bare_reading(c: Column) -> Column:
    """A reading without white space and long marks."""
    return F.regexp_replace(F.regexp_replace(c, f"{BLANK}+", ""), "ー", "")


def joined_lines(c: Column) -> Column:
    """Single line breaks taken out of a text: with the hyphen between small letters, alone between Japanese, else for a blank."""
    ja = r"[\x{3000}-\x{30ff}\x{3400}-\x{9fff}\x{ff00}-\x{ff60}]"
    whole = F.regexp_replace(c, r"([a-zà-ÿ])-\n([a-zà-ÿ])", "$1$2")
    return F.regexp_replace(F.regexp_replace(whole, rf"({ja})\n({ja})", "$1$2"), r"([^\n])\n([^\n])", "$1 $2")


def has_japanese(c: Column) -> Column:
    return c.rlike("[\\u3040-\\u30ff\\u3400-\\u9fff]")


def slug(c: Column, fallback: str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.when(bare != "", bare), F.lit(fallback))


def hashed_id(prefix: str, *parts: Column, digits: int = 12) -> Column:
    """prefix and the first hex digits of the SHA-256 of the parts, joined by a colon."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, digits))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def comparable(c: Column) -> Column:
    """NFKC without white space (control characters that Python counts as such, too) and punctuation."""
    return F.regexp_replace(without_noise(nfkc(c)), r"[\x1c-\x1f\x85]", "")


def without_stamp(line: Column) -> Column:
    """A trimmed line without the time stamp at its head, and without its spoken form behind it (``3:08 3分8秒``) if that names the same time;
    null if nothing else stands there."""
    bare = strip(line)
    head = r"^\[?(\d{1,2}):(\d{2})\]?\s*"
    spoken = r"^\s*(?:(\d+)\s*分)?\s*(?:(\d+)\s*秒)?"
    rest = F.regexp_replace(bare, head, "")
    number = lambda c, pattern, k: F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("int")
    minutes, seconds = number(bare, head, 1), number(bare, head, 2)
    said_minutes, said_seconds = number(rest, spoken, 1), number(rest, spoken, 2)
    same = (
        ((said_minutes == minutes) & (said_seconds == seconds))
        | (said_minutes.isNull() & (said_seconds == seconds) & (minutes == 0))
        | ((said_minutes == minutes) & said_seconds.isNull() & (seconds == 0))
    )
    text = F.when(minutes.isNull(), bare).when(F.coalesce(same, F.lit(False)), strip(F.regexp_replace(rest, spoken, ""))).otherwise(strip(rest))
    return F.when(~bare.rlike(r"^\d+\s*(分\s*(\d+\s*秒)?|秒)$") & (text != ""), text)
