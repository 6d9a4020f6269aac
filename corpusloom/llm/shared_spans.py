"""Long exact spans shared between records.

Method: compact windows. The tokens of a text are its GRAM-character grams. For each of HASHES hash functions the Cartesian tree over
the tokens' hashes is built; the subtree of a token is the range in which it is the minimum. All spans of SPAN characters whose minimum
is the same token form one compact window, of which there are about 2/(SPAN-GRAM+2) a character and hash. A span that stands in
two records has the same minimum in both under every hash, so its windows have equal signatures.

1. Windows are reduced to their signatures (partial minima and maxima per task): which stand in two records, and whether all windows
   of a signature have the same content. Then they are whole: every span in them is shared, and nothing more is looked up.
2. Windows are joined with the repeated signatures; what is left of a text is a short list of intervals.
3. Interval join: of the windows that are not whole, only spans covered under every hash can be shared. These spans, mostly the
   edges of copied passages, are hashed and verified by their 64-bit hash in the same way: minimum and maximum of the record per span.

Everything is one plan at every size. No pairs of records are formed, no group is gathered (lists are of one text), and signatures or spans
of many records are salted (``joined_hot``). Records are told apart by a 64-bit hash of their id, texts by one of id and text.

Defined results: null and short texts share nothing; repeated rows of a record (one id, in either table) are one
record and don't share with themselves; a span shared only within one record doesn't count; empty tables give an
empty result. Line breaks are characters as any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import Grams, code_points, mix
from corpusloom.runtime import checkpoint, joined_hot

SPAN = 60
GRAM = 16
HASHES = 2  # at most 4: see _place


def cartesian_tree(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of the nearest one before it that is not greater, and of the nearest after it that is smaller.

    The nearer to the root of the two is its parent in the Cartesian tree, and what lies between them is its subtree. Zeros are
    barriers: they have no subtree, and none reaches over them. Places reach from -1 to len(values).
    """
    v = np.concatenate(([0], values, [0]))
    inner = np.flatnonzero(v)
    before, after = np.arange(len(v)) - 1, np.arange(len(v)) + 1
    for at, ends in ((before, np.less_equal), (after, np.less)):
        # All between i and at[i] is greater than i's value; a value that is greater, too, hands on its own place.
        left = inner
        while len(left):
            left = left[~ends(v[at[left]], v[left])]
            at[left] = at[at[left]]
    return before[1:-1] - 1, after[1:-1] - 1


class CompactWindows:
    """The compact windows of many texts (one array for all) under every hash: text number, place, signature, content."""

    def __init__(self, texts: list[str], span: int = SPAN, gram: int = GRAM, hashes: int = HASHES):
        points = code_points("".join(texts))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        none = np.zeros(0, np.int64)
        self.text = self.place = none
        self.signature = self.content = none.astype(np.uint64)
        if len(points) < span:
            return
        grams = Grams(points)
        tokens = grams.hashes(gram)
        number = np.repeat(np.arange(len(texts)), lengths)[: len(tokens)]
        inside = np.arange(len(tokens)) - starts[number] + gram <= lengths[number]
        width = span - gram + 1
        parts = []
        for k in range(hashes):
            values = np.where(inside, np.maximum(mix(tokens + np.uint64(k + 1)), np.uint64(1)), np.uint64(0))
            before, after = cartesian_tree(values)
            node = np.flatnonzero((after - before > width) & inside)
            first = np.maximum(before[node] + 1, node - width + 1)
            spans = np.minimum(node, after[node] - width) - first + 1
            text = number[node]
            parts.append((text, _place(first - starts[text], spans, k), values[node], grams.at(first, spans + span - 1)))
        self.text, self.place, self.signature, self.content = (np.concatenate(x) for x in zip(*parts))


def _place(first: np.ndarray, spans: np.ndarray, k: int) -> np.ndarray:
    """Where the first span of a window begins, how many spans it has (at most 64) and its hash function, as one number."""
    return (first << 8) | ((spans - 1) << 2) | k


def _spread(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> 8, ((place >> 2) & 63) + 1


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        w = CompactWindows(pdf["text"].tolist())
        yield pd.DataFrame({"signature": w.signature.astype(np.int64), "rid": pdf["rid"].to_numpy()[w.text], "content": w.content.astype(np.int64)})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        w = CompactWindows(pdf["text"].tolist())
        yield pd.DataFrame({"signature": w.signature.astype(np.int64), "tid": pdf["tid"].to_numpy()[w.text], "place": w.place})


def _open_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The spans of texts covered by a window under every hash, but by no whole one, each with its hash."""
    for pdf in batches:
        texts = pdf["text"].tolist()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        count = np.zeros((2, int(lengths.sum()) + 1), np.int64)
        for row, column in enumerate(("mixed", "whole")):
            number = np.repeat(np.arange(len(texts)), pdf[column].map(len))
            first, spans = _spread(np.concatenate([np.zeros(0, np.int64), *pdf[column]]).astype(np.int64))
            np.add.at(count[row], first + starts[number], 1)
            np.add.at(count[row], first + starts[number] + spans, -1)
        mixed, whole = np.cumsum(count, axis=1)
        at = np.flatnonzero((mixed == HASHES) & (whole == 0))
        number = np.searchsorted(starts, at, "right") - 1
        hashes = Grams(code_points("".join(texts))).at(at, SPAN) if len(at) else np.zeros(0, np.uint64)
        yield pd.DataFrame({"span": hashes.astype(np.int64), "rid": pdf["rid"].to_numpy()[number], "tid": pdf["tid"].to_numpy()[number], "start": (at - starts[number]).astype(np.int32)})


def _text_id(df: DataFrame) -> DataFrame:
    return df.where("chunk_id is not null and text is not null").withColumn("tid", F.xxhash64("chunk_id", "text"))


def _records(tables: list[DataFrame]) -> DataFrame:
    rows = None
    for df in tables:
        one = _text_id(df).where(F.length("text") >= SPAN).select(F.xxhash64("chunk_id").alias("rid"), "tid", "text")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _repeated(rows: DataFrame, key: str, *more) -> DataFrame:
    """The values of key that stand in two records, with the number of their rows."""
    agg = [F.min("rid").alias("low"), F.max("rid").alias("high"), F.count("*").alias("n"), *more]
    return rows.groupBy(key).agg(*agg).where("low < high").drop("low", "high")


def shared_windows(tables: list[DataFrame]) -> DataFrame:
    """(tid, start, end): ranges of a text made of spans that stand in other records too."""
    texts = _records(tables)
    contents = [F.min("content").alias("one"), F.max("content").alias("other")]
    signatures = texts.select("rid", "text").mapInPandas(_signatures, "signature long, rid long, content long")
    repeated = checkpoint(_repeated(signatures, "signature", *contents).select("signature", "n", (F.col("one") == F.col("other")).alias("same")))
    windows = texts.select("tid", "text").mapInPandas(_windows, "signature long, tid long, place long")
    # Lists of one text: as sets, since a text may be delivered many times.
    found = joined_hot(windows, repeated, ["signature"], "tid").groupBy("tid")
    lists = {name: F.collect_set(F.when(cond, F.col("place"))).alias(name) for name, cond in (("whole", F.col("same")), ("mixed", ~F.col("same")))}
    found = checkpoint(found.agg(*lists.values()))
    doubtful = found.where(F.size("mixed") > 0)
    once = texts.groupBy("tid").agg(F.any_value("rid").alias("rid"), F.any_value("text").alias("text"))
    # A span is in one window per hash: whole under one, it needs no look under the others.
    spans = checkpoint(once.join(doubtful, "tid").mapInPandas(_open_spans, "span long, rid long, tid long, start int"))
    parts = joined_hot(spans, checkpoint(_repeated(spans, "span")), ["span"], "tid").select("tid", "start", F.lit(1).alias("spans"))
    whole = found.select("tid", F.explode("whole").alias("place"))
    whole = whole.select("tid", F.shiftright("place", 8).cast("int").alias("start"), (F.shiftright("place", 2).bitwiseAND(63) + 1).cast("int").alias("spans"))
    return whole.unionByName(parts).select("tid", "start", (F.col("start") + F.col("spans") - 1 + SPAN).alias("end"))


def shared_lengths(tables: list[DataFrame]) -> DataFrame:
    """(tid, shared_chars, passages): how many characters of a text stand in shared spans, in how many passages."""
    # One text's ranges at a time: bounded by its length.
    order = Window.partitionBy("tid").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = shared_windows(tables).distinct().withColumn("before", before)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", "start")))
    return ranges.groupBy("tid").agg(
        F.sum(fresh).alias("shared_chars"), F.sum(F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)).alias("passages")
    )


def _named(tables: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    ids = None
    for name, df in tables.items():
        one = _text_id(df).select(F.lit(name).alias("record_table"), "chunk_id", "tid", F.length("text").alias("chars"))
        ids = one if ids is None else ids.unionByName(one)
    return ids.distinct().join(found, "tid")


def records_with_shared_spans(tables: dict[str, DataFrame]) -> DataFrame:
    """(record_table, chunk_id) of every record with a span of SPAN characters that stands in another record."""
    found = shared_windows(list(tables.values())).select("tid").distinct()
    return _named(tables, found).select("record_table", "chunk_id").distinct()


def shared_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(record_table, chunk_id, chars, shared_chars, passages, share) of those records."""
    named = _named(tables, shared_lengths(list(tables.values())))
    return named.select("record_table", "chunk_id", "chars", "shared_chars", "passages", (F.col("shared_chars") / F.col("chars")).alias("share")).distinct()
