"""Visually identical text with different characters.

Two values look the same if they differ only in character width, composed or decomposed accents, invisible
characters, the width of white space, or look-alike letters.

Method: the vocabulary of all values (their tokens between white space, with counts) is put into tries, one
per bucket of about BUCKET_TOKENS tokens; a token's bucket is hashed from its atoms, so all tokens that can match share one, and buckets
stay even however often a token is used. The tries hold the spellings as they were typed. Each token is run through its bucket's
trie with a weighted edit automaton: ignorables, width and composition, and look-alikes cost nothing, any other edit of an atom
costs 1, and only cost 0 is accepted. All spellings reached form one class, whose canonical spelling is
the most frequent (ties: the one nearest its table form, then the smallest). A token that only reaches itself is
written in its table form. A value's consistent form is the sequence of the canonical spellings of its tokens.

Look-alikes are those of the Unicode confusables data (the library for it comes with Spark), as far as one letter is taken for one letter, or
one other character for another. ASCII characters are never taken for one another, and forms that a reader tells apart (encircled, raised,
squared, spelled-out numerals) are different: only width, single compatibility forms and canonical equivalents count.

Defined results: null values, and values of ignorables and white space only, have no form; null persons match
nobody; repeated rows are one; two values with the same code points are no pair; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.runtime import checkpoint

BUCKET_TOKENS = 2000
HOT_FORM = 1000  # works of one form that one task pairs with the others
#: What the table keeps apart though one is typed for the other, a class to a line.
TYPED_FOR = """
ー - ‐ ‑ ‒ – — ― − ─ ━
〜 ~ ∼
"""


def ignorable(c: str) -> bool:
    """Zero-width and other invisible characters."""
    return unicodedata.category(c) in ("Cf", "Cc") or "︀" <= c <= "️" or c in "͏ᅟᅠㅤﾠ"


@lru_cache(None)
def parts(c: str) -> str:
    """A character in full or half width as the usual one, in its canonical parts."""
    kind, _, code = unicodedata.decomposition(c).partition("> ")
    if kind in ("<wide", "<narrow") or kind == "<compat" and " " not in code:
        c = chr(int(code, 16))
    return unicodedata.normalize("NFD", c)


def _class_of(c: str, prototype: str, ascii_of: dict[str, str]) -> str | None:
    """The character for which a look-alike stands; None if it is none."""
    kind = unicodedata.category(c)
    if prototype in ascii_of:
        # Of ASCII characters with one prototype (I, l, 1) that of the same kind.
        return min(ascii_of[prototype], key=lambda a: (unicodedata.category(a) != kind, unicodedata.category(a)[0] != kind[0], a))
    return prototype if len(prototype) == 1 else None


def look_alike_table(spark: SparkSession) -> dict[str, str]:
    """Every character of the basic plane that looks like another, and the first of those it looks like.

    The data come from the library in one call; the result has a few thousand entries.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    single = [c for c in map(chr, [*range(0x20, 0xD800), *range(0xF900, 0x10000)]) if unicodedata.category(c)[0] in "LNPSM" and parts(c) == c]
    prototypes = dict(zip(single, checker.getSkeleton("\n".join(single)).split("\n"), strict=True))
    ascii_of: dict[str, str] = defaultdict(str)
    for c in single:
        if c < "\x7f":
            ascii_of[prototypes[c]] += c
    classes: dict[str, list[str]] = defaultdict(list)
    for c in single:
        one = c if c < "\x7f" else _class_of(c, prototypes[c], ascii_of)
        if one is not None:
            # Letters and numerals are no look-alikes of signs.
            word = unicodedata.category(one)[0] in "LN"
            classes[one if (unicodedata.category(c)[0] in "LN") == word else c].append(c)
    out = {c: min(members) for members in classes.values() for c in members if len(members) > 1}
    for first, *others in map(str.split, TYPED_FOR.strip().splitlines()):
        joined = {out.get(c, c) for c in (first, *others)}
        out = {c: first if k in joined else k for c, k in out.items()} | dict.fromkeys((first, *others), first)
    return out


def atoms(token: str, table: dict[str, str]) -> list[str]:
    """What a reader sees of a token: visible parts of its characters, look-alikes as one."""
    text = unicodedata.normalize("NFD", "".join(parts(c) for c in token if not ignorable(c)))
    return [table.get(c, c) for c in text if not ignorable(c)]


def table_form(token: str, table: dict[str, str]) -> str:
    """The token with every look-alike replaced by the first of its class."""
    return unicodedata.normalize("NFC", "".join(atoms(token, table)))


class Trie:
    """Spellings below their characters, each arc with its atoms; walked by the edit automaton."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.arcs: dict[str, tuple[list[str], Trie]] = {}
        self.by_atom: dict[str, list[tuple[list[str], Trie]]] = {}  # the same arcs by their first atom, "" if they have none
        self.spellings: list[tuple[str, int]] = []

    def insert(self, spelling: str, count: int) -> None:
        node = self
        for c in unicodedata.normalize("NFD", spelling):
            if c not in node.arcs:
                arc = node.arcs[c] = (atoms(c, self.table), Trie(self.table))
                node.by_atom.setdefault(arc[0][0] if arc[0] else "", []).append(arc)
            node = node.arcs[c][1]
        node.spellings.append((spelling, count))

    def reach(self, token: str, most: int = 0) -> list[tuple[str, int]]:
        """All spellings at a cost up to ``most``. A state is a node with the least cost of having read i atoms of the token; arcs without
        atoms (ignorables) and equal atoms cost nothing, other, missing and additional atoms 1 each."""
        wanted = atoms(token, self.table)
        found, open_ = [], [(self, _skipping({0: 0}, len(wanted), most))]
        while open_:
            node, states = open_.pop()
            if len(wanted) in states:
                found += node.spellings
            arcs = node.arcs.values()
            if min(states.values()) == most:
                # Nothing is left to spend: only arcs of an atom wanted now.
                arcs = [arc for a in {"", *(wanted[i] for i in states if i < len(wanted))} for arc in node.by_atom.get(a, ())]
            for own, child in arcs:
                after = states
                for a in own:
                    step: dict[int, int] = {}
                    for i, cost in after.items():
                        for at, price in ((i, cost + 1), (i + 1, cost + (i >= len(wanted) or wanted[i] != a))):
                            if price <= most and at <= len(wanted):
                                step[at] = min(price, step.get(at, price))
                    after = _skipping(step, len(wanted), most)
                if after:
                    open_.append((child, after))
        return found


def _skipping(states: dict[int, int], length: int, most: int) -> dict[int, int]:
    """With the states that leave out atoms of the token."""
    for i in sorted(states):
        cost = states[i]
        while cost < most and i < length:
            i, cost = i + 1, cost + 1
            if states.get(i, most + 1) <= cost:
                break
            states[i] = cost
    return states


def canonical_spellings(rows: list[tuple[str, int]], table: dict[str, str]) -> list[tuple[str, str]]:
    """(token, canonical spelling) of one bucket."""
    trie, out = Trie(table), []
    for token, count in rows:
        trie.insert(token, count)
    for token, _ in rows:
        form = table_form(token, table)
        reached = trie.reach(token)
        if len(reached) > 1:
            best = min(reached, key=lambda s: (-s[1], s[0] != form, s[0]))
            out.append((token, best[0]))
        else:
            out.append((token, form))
    return out


def _buckets(batches: Iterator[pd.DataFrame], table: dict[str, str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket; a bucket may begin in one batch and end in the next."""
    held: list[tuple[str, int]] = []
    bucket = None
    for pdf in batches:
        out: list[tuple[str, str]] = []
        for b, token, count in zip(pdf["bucket"], pdf["token"], pdf["count"]):
            if b != bucket:
                out += canonical_spellings(held, table)
                held, bucket = [], b
            held.append((token, count))
        yield pd.DataFrame(out, columns=["token", "spelling"])
    yield pd.DataFrame(canonical_spellings(held, table), columns=["token", "spelling"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_of(values: pd.Series) -> pd.Series:
    """Tokens between white space of any width; invisible characters stay in their token, which has some visible one."""
    out = []
    for v in values:
        words = "".join(" " if c.isspace() else c for c in v).split() if v is not None else []
        out.append([w for w in words if not all(map(ignorable, w))])
    return pd.Series(out)


def _formed(batches: Iterator[pd.DataFrame], table: dict[str, str]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(form=[table_form(t, table) for t in pdf["token"]])


def vocabulary(pieces: DataFrame, values: int) -> DataFrame:
    """(token, spelling): the canonical spelling of every token of the pieces given (columns token and count)."""
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(look_alike_table(spark))
    counted = pieces.groupBy("token").agg(F.sum("count").alias("count"))
    formed = counted.mapInPandas(lambda it: _formed(it, shared.value), "token string, count long, form string")
    buckets = max(1, values // BUCKET_TOKENS)
    placed = formed.select("token", "count", F.pmod(F.xxhash64("form"), F.lit(buckets)).alias("bucket"))
    sorted_rows = placed.repartition("bucket").sortWithinPartitions("bucket", "token")
    return sorted_rows.mapInPandas(lambda it: _buckets(it, shared.value), "token string, spelling string")


def consistent_forms(values: DataFrame) -> DataFrame:
    """The values given (column value) with their consistent form (column form), one row per distinct value."""
    counted = checkpoint(values.where("value is not null").groupBy("value").agg(F.count("*").alias("count")).withColumn("tokens", tokens_of("value")))
    pieces = counted.select("value", "count", F.posexplode("tokens").alias("at", "token"))
    spelled = pieces.join(vocabulary(pieces.select("token", "count"), counted.count()), "token")
    # A group is the tokens of one value.
    return spelled.groupBy("value").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "spelling"))), lambda x: x["spelling"]), " ").alias("form")
    )


def work_values(works: DataFrame) -> DataFrame:
    """(field, person_id, work, value) of titles, readings and variants, once each."""
    one = [
        works.select(F.lit(f).alias("field"), "person_id", F.col("canonical_work_id").alias("work"), (F.explode(f) if f == "title_variants" else F.col(f)).alias("value"))
        for f in ("canonical_title", "canonical_title_reading", "title_variants")
    ]
    rows = one[0].unionByName(one[1]).unionByName(one[2])
    return rows.where("value is not null and person_id is not null and work is not null").distinct()


KEY = ["field", "person_id", "form"]


def look_alike_classes(works: DataFrame) -> DataFrame:
    """(field, person_id, form, first_value, spellings, works): what looks the same, with its smallest spelling and the number of spellings and of works."""
    values = checkpoint(work_values(works))
    formed = values.join(consistent_forms(values), "value")
    return formed.groupBy(*KEY).agg(F.min("value").alias("first_value"), F.countDistinct("value").alias("spellings"), F.countDistinct("work").alias("works"))


def look_alike_works(works: DataFrame) -> DataFrame:
    """(field, work_a, work_b): works of one person whose values look the same but differ in code points.

    Only classes of several spellings are paired, last of all. The key is person, field and form, so a person with a third of all rows
    is spread over its forms; a form of many works is salted on one side and repeated on the other, in tasks of HOT_FORM works.
    """
    values = checkpoint(work_values(works))
    formed = checkpoint(values.join(consistent_forms(values), "value"))
    mixed = formed.groupBy(*KEY).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")).where("low <> high")
    side = formed.join(mixed.select(*KEY, F.ceil(F.col("n") / HOT_FORM).cast("int").alias("salts")), KEY)
    a = side.select(*KEY, F.col("work").alias("work_a"), F.col("value").alias("value_a"), F.pmod(F.xxhash64("work"), F.col("salts")).cast("int").alias("salt"))
    b = side.select(*KEY, F.col("work").alias("work_b"), F.col("value").alias("value_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = a.join(b, [*KEY, "salt"]).where("work_a < work_b and value_a <> value_b")
    return pairs.select("field", "work_a", "work_b").distinct()
