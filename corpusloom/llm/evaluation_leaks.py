"""Evaluation texts leaking into training text.

Method: template canonicalisation. Texts are reduced to their letters and digits (ruby readings, notes, white
space, punctuation, case and width gone), and numbers, names and units are replaced by typed
placeholders. Windows of the template of WINDOW characters are hash-joined between items and documents; a
matching window is then checked for its slots. With equal slots it is a verbatim run (``leaks``); with other slots, each
value of the item always replaced by the same value of the document, a re-parameterised question (``reparameterised``).

In ``leaks`` placeholders keep the length, so that runs can be measured, and names are katakana, as letter case doesn't count there; in
``reparameterised`` a number, unit or name is one placeholder, and capitalised words within a sentence are names, too.

The items are a stated query set: they are taken to the tasks in blocks of at most BLOCK_WINDOWS windows (about
100 MB), one pass over the documents for a block, so for about 40,000 items of usual length; an item is never split. Every document is
held against every item whole, in numpy, inside mapInPandas; nothing of a document is shuffled. A wide-spread instruction matches many
items in one document, but only (item, document) sums leave the task.

Defined results: null or empty texts, and items shorter than WINDOW letters and digits, match nothing; repeated
rows of a document or an item are one; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import Grams, code_points, mix

WINDOW = 20
BLOCK_WINDOWS = 4_000_000
BITS = 25
#: Ruby readings (kana) and editor's notes of annotated files.
RUBY_OR_NOTE = re.compile(r"《[぀-ヿ\s・]{0,60}》|[［\[][＃#][^］\]]*[］\]]")
NOT_LETTER = re.compile(r"[\W_]+")
#: Units that follow a number.
UNITS = "円 銭 年 月 日 時 分 秒 人 個 枚 冊 里 町 間 尺 寸 貫 匁 km cm mm kg g m l percent yen dollars francs years days hours minutes".split()


SLOT = re.compile(
    r"(?P<number>[0-9][0-9,.]*)(?:\s*(?P<unit>" + "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True)) + r")(?![a-z]))?"
    r"|(?P<name>[ァ-ヺ][ァ-ー]+|(?<=[^\s.!?。！？“\"]\s)[A-Z][a-zà-ÿ]+)"
)
#: Letters that no text here uses, one for each kind of slot.
SLOT_MARKS = {"number": "\ua000", "unit": "\ua001", "name": "\ua002"}


def canonical(text: str | None) -> str:
    """The letters and digits of a text in half width and lower case, without ruby readings and notes."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKC", RUBY_OR_NOTE.sub("", text))
    return NOT_LETTER.sub("", text).casefold()


UNIT = re.compile("(?<=[0-9])(?:" + "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True)) + ")")
LONGEST_UNIT = max(map(len, UNITS))
ZERO, NINE, FIRST_NAME, LAST_NAME = ord("0"), ord("9"), 0x30A1, 0x30FA


class Batch:
    """The windows of many canonical texts: hashes of template and slots, text number and position.

    Each character of a number, unit or katakana name is replaced by the mark of its type; what it was is hashed apart. Two windows of
    equal characters have equal templates and slots wherever they stand: a unit that the window cuts from its number, or that might go on
    behind the window, is no slot of it.
    """

    def __init__(self, texts: list[str], window: int = WINDOW, typed: bool = True):
        joined = "".join(texts)
        points = code_points(joined)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.lengths = lengths
        if len(points) < window:
            self.template = self.slots = np.zeros(0, np.uint64)
            self.text = self.position = np.zeros(0, np.int64)
            return
        number = np.repeat(np.arange(len(texts)), lengths)[: len(points) - window + 1]
        position = np.arange(len(points) - window + 1) - starts[number]
        inside = np.flatnonzero(position + window <= lengths[number])
        self.text, self.position = number[inside], position[inside]
        if not typed:
            self.template, self.slots = Grams(points).hashes(window)[inside], None
            return
        digit = (points >= ZERO) & (points <= NINE)
        name = (points >= FIRST_NAME) & (points <= LAST_NAME)
        unit = np.zeros(len(points), bool)
        # Where the slots of a window begin if it begins here, and end if it ends here.
        begin, end = np.arange(len(points) + 1), np.arange(len(points) + 1)
        first = set(starts.tolist())
        for m in UNIT.finditer(joined):
            if m.start() not in first:
                unit[m.start() : m.end()] = True
                begin[m.start() : m.end()] = m.end()
        after = np.flatnonzero(digit[:-1] & ~digit[1:]) + 1
        for k in range(LONGEST_UNIT, 0, -1):
            at = after[after + k <= len(points)]
            end[at + k] = at
        slot = digit | name | unit
        marks = np.select([digit, unit, name], [np.uint32(ord(SLOT_MARKS[k])) for k in ("number", "unit", "name")], points)
        raw, masked, filled = Grams(points), Grams(marks), Grams(points, slot)
        p, e = inside, inside + window
        lo = np.minimum(begin[p], e)
        hi = np.maximum(end[e], lo)
        with np.errstate(over="ignore"):
            total = masked.sums[hi] - masked.sums[lo] + raw.sums[lo] - raw.sums[p] + raw.sums[e] - raw.sums[hi]
            self.template = mix(total * raw.back[p])
            self.slots = mix((filled.sums[hi] - filled.sums[lo]) * raw.back[p])


def _items(ids: list[int], b: Batch) -> dict[str, np.ndarray]:
    """Item windows sorted by template hash, with a bitmap over their low bits (4 MB)."""
    order = np.argsort(b.template, kind="stable")
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[(b.template & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
    bitmap = np.packbits(bitmap, bitorder="little")
    return {
        "id": np.array(ids, np.int64),
        "length": b.lengths,
        "template": b.template[order],
        "slots": None if b.slots is None else b.slots[order],
        "item": b.text[order].astype(np.int32),
        "position": b.position[order].astype(np.int32),
        "bitmap": bitmap,
    }


def _covered(group: np.ndarray, position: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For groups (ascending, with ascending distinct positions): group numbers and the characters their windows cover."""
    gap = np.full(len(group), window, np.int64)
    same = group[1:] == group[:-1]
    gap[:-1][same] = np.minimum(window, (position[1:] - position[:-1])[same])
    numbers, first = np.unique(group, return_index=True)
    return numbers, np.add.reduceat(gap, first) if len(first) else gap


def _matches(docs: Batch, items: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (document window, item window) of equal template hash."""
    low = (docs.template & np.uint64((1 << BITS) - 1)).astype(np.int64)
    maybe = np.flatnonzero(items["bitmap"][low >> 3] >> (low & 7).astype(np.uint8) & 1)
    low = np.searchsorted(items["template"], docs.template[maybe], "left")
    high = np.searchsorted(items["template"], docs.template[maybe], "right")
    count = high - low
    at_doc = np.repeat(maybe, count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return at_doc, np.repeat(low, count) + offset


def _leaks(batches: Iterator[pd.DataFrame], items: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    n_items = len(items["id"])
    for pdf in batches:
        docs = Batch([canonical(t) for t in pdf["text"]])
        d, i = _matches(docs, items)
        same_slots = docs.slots[d] == items["slots"][i]
        exact = _pair_cover(docs, items, d[same_slots], i[same_slots], n_items)
        yield pd.DataFrame(
            {
                "item_id": items["id"][exact[0] % n_items],
                "doc_id": pdf["doc_id"].to_numpy()[exact[0] // n_items],
                "covered": exact[1],
                "length": items["length"][exact[0] % n_items],
            }
        )


def _pair_cover(docs, items, d, i, n_items):
    span = int(items["position"].max(initial=0)) + 1
    key = np.unique((docs.text[d] * n_items + items["item"][i]) * span + items["position"][i])
    return _covered(key // span, key % span)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded number of windows; one block at a time is on the driver."""
    rows = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    windows = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(windows // BLOCK_WINDOWS) + 1
    for k in range(n):
        block = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]
        if block:
            yield block


def leaked_runs(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, doc_id, covered, length): how many of an item's letters and digits stand in a document in runs of WINDOW or more."""
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    parts = []
    for block in _blocks(items):
        table = docs.sparkSession.sparkContext.broadcast(_items([i for i, _ in block], Batch([canonical(t) for _, t in block])))
        parts.append(docs.mapInPandas(lambda it, table=table: _leaks(it, table.value), "item_id long, doc_id long, covered long, length long"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, doc_id long, covered long, length long")
    return reduce(DataFrame.unionByName, parts)


def leaks(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, doc_id): at least half of the item stands in the document."""
    return leaked_runs(items, documents).where("covered * 2 >= length").select("item_id", "doc_id").distinct()


def collapse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The letters and digits of a text with one placeholder per number, unit and name, and these slots (position, value).

    Names are runs of katakana, and capitalised words that don't begin a sentence.
    """
    text = unicodedata.normalize("NFKC", RUBY_OR_NOTE.sub("", text or ""))
    out, slots, last, size = [], [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for m in SLOT.finditer(text):
        put(NOT_LETTER.sub("", text[last : m.start()]).casefold())
        for kind, mark in SLOT_MARKS.items():
            if m[kind]:
                slots.append((size, m[kind].casefold()))
                put(mark)
        last = m.end()
    put(NOT_LETTER.sub("", text[last:]).casefold())
    return "".join(out), slots


def consistent(item: list[tuple[int, str]], doc: list[tuple[int, str]], shifts: Iterable[int], within: dict[int, np.ndarray] | None = None) -> int:
    """Slots of the item that the document fills, if each value is always filled by one value; else 0. -1 if none differs.

    within: for each shift the ascending item positions of its windows; slots outside them are then left alone.
    """
    there, filled, differs = dict(doc), {}, False
    for position, value in item:
        for shift in shifts:
            if within is not None:
                k = int(np.searchsorted(within[shift], position, "right"))
                if not k or position - within[shift][k - 1] >= WINDOW:
                    continue
            if (other := there.get(position + shift)) is not None:
                if filled.setdefault(value, other) != other:
                    return 0
                differs |= value != other
                break
    return len(filled) if differs else -1


def filled_slots(item: list[tuple[int, str]], doc: list[tuple[int, str]], item_at: np.ndarray, doc_at: np.ndarray, length: int) -> int:
    """The slots of the first alignment that covers half of the item and is consistent; 0 or less if none is.

    An alignment is one shift between item and document, else shifts that differ by small insertions, else all windows of the pair, as
    its parts may stand apart. Only slots in matching windows count, as others are foreign text. A shift over the place of a verbatim copy isn't another copy, only the item's own likeness to itself.
    """
    shift = doc_at - item_at
    values, one = np.unique(shift, return_inverse=True)
    near = np.cumsum(np.concatenate(([0], np.diff(values) > WINDOW)))[one]
    span, verbatim, found = int(item_at.max()) + 1, np.zeros(0, np.int64), 0
    for level, group in enumerate((one, near, np.zeros_like(one))):
        key = np.unique(group * span + item_at)
        numbers, covered = _covered(key // span, key % span)
        for g in numbers[np.argsort(-covered, kind="stable")][: int((covered * 2 >= length).sum())]:
            mine = group == g
            if level == 0 and np.isin(doc_at[mine], verbatim).mean() > 0.5:
                continue
            shifts, often = np.unique(shift[mine], return_counts=True)
            shifts = shifts[np.argsort(-often, kind="stable")].tolist()
            within = {x: np.unique(item_at[mine & (shift == x)]) for x in shifts}
            found = consistent(item, doc, shifts, within)
            if found > 0:
                return found
            if level == 0 and found < 0:
                verbatim = np.concatenate((verbatim, doc_at[mine]))
    return found


def _reworded(batches: Iterator[pd.DataFrame], items: dict[str, np.ndarray], slots: list[list[tuple[int, str]]]) -> Iterator[pd.DataFrame]:
    n = len(items["id"])
    for pdf in batches:
        doc_templates = [collapse(t) for t in pdf["text"]]
        docs = Batch([t for t, _ in doc_templates], typed=False)
        d, i = _matches(docs, items)
        pairs, covered = _pair_cover(docs, items, d, i, n)
        whole = pairs[covered * 2 >= items["length"][pairs % n]]
        pair_of = docs.text[d] * n + items["item"][i]
        order = np.argsort(pair_of, kind="stable")
        low, high = (np.searchsorted(pair_of[order], whole, side) for side in ("left", "right"))
        rows = []
        for p, a, b in zip(whole, low, high):
            at = order[a:b]
            filled = filled_slots(slots[p % n], doc_templates[p // n][1], items["position"][i[at]].astype(np.int64), docs.position[d[at]], int(items["length"][p % n]))
            if filled > 0:
                rows.append((items["id"][p % n], pdf["doc_id"].iloc[p // n], filled))
        yield pd.DataFrame(rows, columns=["item_id", "doc_id", "slots"])


def reparameterised(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, doc_id, slots): documents that hold at least half of an item's template, numbers and foreign names consistently replaced."""
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    schema = "item_id long, doc_id long, slots long"
    parts = []
    for block in _blocks(items):
        collapsed = [collapse(t) for _, t in block]
        items_of = _items([i for i, _ in block], Batch([t for t, _ in collapsed], typed=False))
        table = docs.sparkSession.sparkContext.broadcast((items_of, [x for _, x in collapsed]))
        parts.append(docs.mapInPandas(lambda it, table=table: _reworded(it, *table.value), schema))
    return (reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)).distinct()
