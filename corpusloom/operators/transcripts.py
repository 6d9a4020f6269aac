"""Transcripts: turns, questions and answers, segments, fillers.

Windows and groups are within one transcript. Defined results: null texts have no turns; what stands before the first labelled line is
nobody's and dropped; questions that nobody answers are dropped; equal lines are lines each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.chunking import LEAST, MOST, SENTENCE, chunks_of, sentence_pieces

STAMP = r"^\[(\d{1,2}:\d{2}(?::\d{2})?)\]$"
#: Words that alone are no statement, the first that fits is taken.
FILLERS = "なるほど そうそう そうです そうですね はいはい はい ええ うん ああ おお まあ えーと えー あの その いや ふむ 何ですって まったくです".split()
MOST_FILLER = 15


def _so_far(*by: str):
    return Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)


def turns(documents: DataFrame, own: list[str], other: list[str]) -> DataFrame:
    """(doc_id, turn, speaker, stamped, said): labelled lines, self or other, with the unlabelled lines behind them and the time stamp before them."""
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("bare", strip(F.col("raw"))).where("bare <> ''")
    stamp = F.nullif(F.regexp_extract("bare", STAMP, 1), F.lit(""))
    label = F.regexp_extract("bare", r"^([^：:\s]{1,20}?)\s*[：:]", 1)
    lines = lines.withColumns({"stamp": stamp, "speaker": F.when(stamp.isNotNull(), None).when(label.isin(own), "self").when(label.isin(other), "other")})
    lines = lines.withColumn("stamped", F.last("stamp", ignorenulls=True).over(_so_far("doc_id"))).where("stamp is null")
    lines = lines.withColumn("turn", F.sum(F.col("speaker").isNotNull().cast("long")).over(_so_far("doc_id"))).where("turn > 0")
    said = F.when(F.col("speaker").isNull(), F.col("bare")).otherwise(F.regexp_replace("bare", r"^[^：:]*[：:]\s*", ""))
    return lines.groupBy("doc_id", "turn").agg(
        F.max("speaker").alias("speaker"),
        F.min(F.when(F.col("speaker").isNotNull(), F.col("stamped"))).alias("stamped"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", said.alias("said")))), lambda x: x["said"]), "").alias("said"),
    )


def _paired(spoken: DataFrame) -> DataFrame:
    """With the number of the pair a turn belongs to: a question behind an answer begins one."""
    w = Window.partitionBy("doc_id").orderBy("turn")
    fresh = (F.col("speaker") == "other") & (F.coalesce(F.lag("speaker").over(w), F.lit("self")) == "self")
    return spoken.withColumn("_fresh", fresh.cast("long")).withColumn("pair", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def pairs(spoken: DataFrame) -> DataFrame:
    """(doc_id, pair, question, answer, timestamp_start, timestamp_end): neighbouring questions, then neighbouring answers, joined by blanks."""

    def joined(who: str) -> Column:
        said = F.collect_list(F.when(F.col("speaker") == who, F.struct("turn", "said")))
        return F.when(F.size(said) > 0, F.array_join(F.transform(F.array_sort(said), lambda x: x["said"]), " "))

    answered = (F.col("speaker") == "self") & F.col("stamped").isNotNull()
    found = _paired(spoken).where("pair > 0").groupBy("doc_id", "pair").agg(
        joined("other").alias("question"),
        joined("self").alias("answer"),
        F.min(F.when(F.col("speaker") == "other", F.struct("turn", "stamped")))["stamped"].alias("timestamp_start"),
        F.max(F.when(answered, F.struct("turn", "stamped")))["stamped"].alias("timestamp_end"),
    )
    return found.where("answer is not null")


def monologues(spoken: DataFrame) -> DataFrame:
    """(doc_id, turn, said, stamped) of what is said before the first question."""
    return _paired(spoken).where("pair = 0").select("doc_id", "turn", "said", "stamped")


def rendered(spoken: DataFrame) -> DataFrame:
    """(doc_id, text, turns): a line for each run of turns of one speaker."""
    w = Window.partitionBy("doc_id").orderBy("turn")
    fresh = F.coalesce(F.lag("speaker").over(w) != F.col("speaker"), F.lit(True)).cast("int")
    runs = spoken.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = lambda order, text: F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    merged = runs.groupBy("doc_id", "run").agg(F.any_value("speaker").alias("speaker"), F.array_join(in_order("turn", "said"), " ").alias("said"))
    lines = merged.withColumn("line", F.concat("speaker", F.lit("："), "said"))
    return lines.groupBy("doc_id").agg(F.array_join(in_order("run", "line"), "\n").alias("text"), F.count("*").alias("turns"))


def answer_chunks(found: DataFrame) -> DataFrame:
    """(doc_id, pair, number, question, text): answers in chunks of LEAST to MOST characters, cut at ends of sentences, each with its question."""
    keys = ["doc_id", "pair", "question"]
    pieces = sentence_pieces(found.select(*keys, F.col("answer").alias("text")), keys, MOST, SENTENCE)
    listed = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("parts"))
    sized = F.transform("parts", lambda x: F.struct(x["text"].alias("text"), F.length(x["text"]).alias("size"), F.lit(None).cast("string").alias("kind")))
    cut = listed.select(*keys, F.posexplode(chunks_of(sized, MOST, LEAST)).alias("number", "parts"))
    return cut.select("doc_id", "pair", (F.col("number") + 1).alias("number"), "question", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))


def segments(documents: DataFrame, most: int) -> DataFrame:
    """(doc_id, number, text): lines with their breaks joined up to ``most`` characters; longer lines are cut at ends of sentences."""
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "(?<=\n)")).alias("line", "text")).where("text <> ''")
    pieces = sentence_pieces(lines, ["doc_id", "line"], most, SENTENCE)
    listed = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "piece", "text"))).alias("parts"))
    sized = F.transform("parts", lambda x: F.struct(x["text"].alias("text"), F.length(x["text"]).alias("size"), F.lit(None).cast("string").alias("kind")))
    cut = listed.select("doc_id", F.posexplode(chunks_of(sized, most)).alias("number", "parts"))
    return cut.select("doc_id", (F.col("number") + 1).alias("number"), F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))


def is_filler(text: Column) -> Column:
    """Whether nothing but fillers is left without white space and punctuation, in at most MOST_FILLER characters; a word taken isn't given back."""
    bare = F.regexp_replace(text, r"[\s\p{Z}\p{P}ー]+", "")
    words = "|".join(w.replace("ー", "") for w in FILLERS)
    return (F.length(bare) <= MOST_FILLER) & bare.rlike(f"^(?>{words})+$")
