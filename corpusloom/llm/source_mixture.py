"""Mixing sources to target weights.

Method: entropy balancing. Each document gets a rate w >= 0 (how often it is taken), as near to 1 as possible in
relative entropy, such that every source reaches its share of the total tokens. The convex dual has one
multiplier l per source, and w = min(cap, exp(l * tokens / scale)). Newton's iterations on the dual are
distributed: each is one aggregation over (source, tokens, documents) for the gradient and the
curvature, of one row per source; a step that leaves the bracket known so far halves it instead. The rates
are rounded into copies by systematic rounding along the token count, in strata of about STRATUM documents, so no
task orders a whole source; copies never exceed the cap. What a source then lacks or has too much in tokens is made good by
documents that were rounded the other way, stratum by stratum, the last of them chosen to fit: as long as it has such documents, a
source misses its tokens by less than one of them.

The total is the largest at which every source that has tokens can still reach its share under its cap
(``total_tokens`` sets another; it is an error if out of reach). Shares are those of the sources that
have tokens, in proportion; sources without tokens are reported with share 0.

Defined results: sources are compared trimmed, in lower case; documents of no source or of a source without target
are not taken; null and empty texts have no tokens and are not taken; without any usable source nothing is
taken; caps null mean no cap; a target given twice is an error.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import checkpoint

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
STRATUM = 4096
MOST_STEPS = 60
TOLERANCE = 1e-9
NO_CAP = 1e9


def clean_source(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _count_tokens(batches: Iterator[pd.DataFrame], file: str) -> Iterator[pd.DataFrame]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(file))
    for pdf in batches:
        counts = [len(ids) for ids in model.encode(pdf["text"].tolist(), num_threads=1)]
        yield pdf[["doc_id", "source"]].assign(tokens=counts)


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of whole texts by a public tokenizer."""
    docs = documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text").where("source is not null and source <> '' and text is not null and text <> ''")
    documents.sparkSession.sparkContext.addFile(tokenizer)  # executors need not have it
    return docs.mapInPandas(lambda it: _count_tokens(it, os.path.basename(tokenizer)), "doc_id long, source string, tokens long")


def _target_rows(targets: DataFrame) -> dict[str, tuple[float, float]]:
    """source -> (share, cap); targets are one row per source, a table of settings."""
    out: dict[str, tuple[float, float]] = {}
    for source, share, cap in targets.select(clean_source(F.col("source")), "target_share", F.col("max_repeats").cast("double")).where("source is not null").collect():
        if source in out:
            raise ValueError(f"two targets for {source}")
        out[source] = (share or 0.0, NO_CAP if cap is None else cap)
    return out


def balance(counted: DataFrame, targets: dict[str, tuple[float, float]], total_tokens: float | None = None) -> list[tuple[str, float, float, float, float]]:
    """(source, multiplier, scale, cap, tokens to reach) of every source that can be used."""
    spark = counted.sparkSession
    hist = checkpoint(counted.where("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("n")))
    sums = {r["source"]: r for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t"), F.sum("n").alias("n")).collect() if r["source"] in targets}
    usable = {s: r for s, r in sums.items() if targets[s][0] > 0 and targets[s][1] > 0}
    if not usable:
        return []
    share = sum(targets[s][0] for s in usable)
    most = min(r["t"] * targets[s][1] * share / targets[s][0] for s, r in usable.items())
    total = total_tokens or (most if most < NO_CAP * share else float(sum(r["t"] for r in usable.values())))
    if total > most * (1 + 1e-9):
        raise ValueError(f"at most {most:.0f} tokens can be reached under the caps")
    goal = {s: min(targets[s][0] / share * total, r["t"] * targets[s][1]) for s, r in usable.items()}
    scale = {s: r["t"] / r["n"] for s, r in usable.items()}
    low, high, at = dict.fromkeys(usable, -700.0), dict.fromkeys(usable, 700.0), {s: math.log(goal[s] / r["t"]) for s, r in usable.items()}
    for _ in range(MOST_STEPS):
        state = spark.createDataFrame([(s, at[s], scale[s], targets[s][1]) for s in usable], "source string, l double, scale double, cap double")
        free = F.exp(F.least(F.lit(600.0), F.col("l") * F.col("tokens") / F.col("scale")))
        w, x = F.least("cap", free), F.col("tokens") / F.col("scale")
        step = (
            hist.join(F.broadcast(state), "source")
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("tokens") * w).alias("taken"), F.sum(F.when(free < F.col("cap"), F.col("n") * F.col("tokens") * x * w).otherwise(0.0)).alias("slope"))
            .collect()
        )
        worst = 0.0
        for r in step:
            s, miss = r["source"], r["taken"] - goal[r["source"]]
            worst = max(worst, abs(miss) / goal[s])
            if miss > 0:
                high[s] = at[s]
            else:
                low[s] = at[s]
            newton = at[s] - miss / r["slope"] if r["slope"] > 0 else float("nan")
            if abs(miss) / goal[s] > TOLERANCE:
                at[s] = newton if low[s] < newton < high[s] else (low[s] + high[s]) / 2
        if worst <= TOLERANCE:
            break
    return [(s, at[s], scale[s], targets[s][1], goal[s]) for s in usable]


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, rate, copies) of every document of a usable source; copies may be 0."""
    counted = checkpoint(token_counts(documents, tokenizer))
    state = balance(counted, _target_rows(targets), total_tokens)
    spark = documents.sparkSession
    duals = spark.createDataFrame(state, "source string, l double, scale double, cap double, goal double")
    strata = counted.groupBy("source").agg(F.ceil(F.count("*") / STRATUM).alias("strata"))
    rated = (
        counted.where("tokens > 0")
        .join(F.broadcast(duals), "source")
        .join(F.broadcast(strata.join(F.broadcast(duals.select("source")), "source", "left_semi")), "source")
        .withColumn("rate", F.least("cap", F.exp(F.least(F.lit(600.0), F.col("l") * F.col("tokens") / F.col("scale")))))
        .withColumn("stratum", F.pmod(F.xxhash64("doc_id"), "strata"))
    )
    order = Window.partitionBy("source", "stratum").orderBy("tokens", "doc_id")
    part = F.col("rate") - F.floor("rate")
    until = F.sum(part).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The strata begin at different phases, so that their rounding errors don't add up.
    phase = F.pmod(F.xxhash64("source", "stratum"), F.lit(1 << 20)) / (1 << 20)
    copies = F.floor("rate") + F.floor(F.col("until") + phase) - F.floor(F.col("until") - part + phase)
    rounded = rated.withColumn("until", until).withColumn("copies", F.least(copies, F.col("cap").cast("long")))
    rounded = checkpoint(rounded.select("doc_id", "source", "tokens", "rate", "copies", "stratum", "cap", "goal"))
    return rounded.join(_corrections(rounded), ["source", "stratum", "doc_id"], "left").select(
        "doc_id", "source", "tokens", "rate", (F.col("copies") + F.coalesce("step", F.lit(0))).alias("copies")
    )


def _corrections(rounded: DataFrame) -> DataFrame:
    """(source, stratum, doc_id, step): documents that get one copy more (or less), so that their source has its tokens.

    Whole strata of candidates are taken as long as they are needed, then documents of the next, then the one that fits best.
    """
    miss = rounded.groupBy("source").agg((F.first("goal") - F.sum(F.col("copies") * F.col("tokens"))).alias("miss"))
    lower = F.floor("rate")
    up = (F.col("miss") > 0) & (F.col("copies") == lower) & (F.col("rate") > lower) & (F.col("copies") + 1 <= F.col("cap"))
    down = (F.col("miss") < 0) & (F.col("copies") > lower)
    step = F.when(up, 1).when(down, -1)
    free = rounded.join(F.broadcast(miss), "source").withColumn("step", step).where("step is not null").select("source", "stratum", "doc_id", "tokens", "step", F.abs("miss").alias("miss"))
    strata = Window.partitionBy("source").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    before = free.groupBy("source", "stratum").agg(F.sum("tokens").alias("t")).select("source", "stratum", F.coalesce(F.sum("t").over(strata), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "stratum").orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = checkpoint(free.join(before, ["source", "stratum"]).where("before < miss").withColumn("until", F.col("before") + F.sum("tokens").over(inside)))
    taken = placed.where("until <= miss")
    left = placed.groupBy("source").agg(F.first("miss").alias("miss"), F.max(F.when(F.col("until") <= F.col("miss"), F.col("until"))).alias("until"))
    left = left.select("source", (F.col("miss") - F.coalesce("until", F.lit(0))).alias("rest"))
    others = placed.where("until > miss").join(F.broadcast(left), "source").withColumn("off", F.abs(F.col("tokens") - F.col("rest"))).where("off < rest")
    best = others.groupBy("source").agg(F.min_by(F.struct("stratum", "doc_id", "step"), F.struct("off", "doc_id")).alias("x")).select("source", "x.*")
    return taken.select("source", "stratum", "doc_id", "step").unionByName(best)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, copies, most_copies): one row per target."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
        F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("documents"),
        F.sum("copies").alias("copies"),
        F.max("copies").alias("most_copies"),
    )
    total = got.agg(F.sum("tokens").alias("total"))
    goals = targets.select(clean_source(F.col("source")).alias("source"), "target_share").where("source is not null")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "copies", "most_copies")]
    return goals.join(got, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), *zero
    )
