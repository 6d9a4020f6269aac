"""Duplicates hidden by formatting differences.

Two chunks are the same if their letters and digits agree in order, ignoring letter case, white space and
punctuation; of a question-and-answer chunk the fields are compared so, in any order.

Method: the canonical text is reduced to a 128-bit key, once. Partial counts (one row per key and task before the
shuffle) find exactly the keys of more than HOT_ROWS rows, a bound that doesn't grow with the data. Hot keys are aggregated in two
levels, salted by the row; all other keys in one. The representative of a group is its smallest identifier. Members take it by a
join in which a hot key is salted again, so no task gets a whole hot group, and no group is ever gathered.

Defined results: null texts and texts of fewer than MIN_LETTERS letters and digits belong to no group; rows
repeated under the same identifier are one record; rows without identifier are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small, checkpoint, joined_hot

MIN_LETTERS = 30
HOT_ROWS = 64  # rows of one key that are aggregated, or joined, in one task


def letters(text: Column) -> Column:
    """The letters and digits of a text in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def canonical_text(text: Column, is_fields: Column) -> Column:
    """Letters and digits; of a list of fields, each field's, sorted."""
    fields = F.transform(F.split(text, r"[\n\r／]"), letters)
    fields = F.array_sort(F.filter(fields, lambda x: x != ""))
    return F.when(is_fields, F.array_join(fields, "\n")).otherwise(letters(text))


def keyed(chunks: DataFrame) -> DataFrame:
    """(id, key): each record that counts, once, with its 128-bit canonical key."""
    is_fields = F.coalesce(F.col("chunk_type") == "qa_pair", F.lit(False))
    canon = F.col("canon")
    return (
        chunks.select(F.col("chunk_id").alias("id"), is_fields.alias("is_fields"), canonical_text(F.col("text"), is_fields).alias("canon"))
        .where((F.length(F.regexp_replace(canon, "\n", "")) >= MIN_LETTERS) & F.col("id").isNotNull())
        .select("id", F.unhex(F.md5(F.concat(F.when(F.col("is_fields"), "q").otherwise("t"), canon))).alias("key"))
        .distinct()
    )


def groups(rows: DataFrame) -> DataFrame:
    """(key, kept_id, copies) of every key; rows is read twice."""
    hot = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS))
    salts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    # Fewer hot keys than rows over HOT_ROWS: up to a million go to the tasks, more are joined.
    marked = rows.join(broadcast_if_small(hot.select("key", salts.alias("salts")), 1_000_000), "key", "left")
    agg = [F.min("id").alias("kept_id"), F.count("*").alias("copies")]
    light = marked.where("salts is null").groupBy("key").agg(*agg)
    salted = marked.where("salts is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    heavy = salted.groupBy("key", "salt").agg(*agg).groupBy("key").agg(F.min("kept_id").alias("kept_id"), F.sum("copies").alias("copies"))
    return light.unionByName(heavy)


def duplicate_members(chunks: DataFrame) -> DataFrame:
    """(kept_id, copy_id) of every record that repeats another."""
    rows = checkpoint(keyed(chunks))
    kept = checkpoint(groups(rows).where("copies > 1").withColumnRenamed("copies", "n"))
    return joined_hot(rows, kept, ["key"], "id", HOT_ROWS).where(F.col("id") != F.col("kept_id")).select("kept_id", F.col("id").alias("copy_id")).distinct()


def collapsed(chunks: DataFrame) -> DataFrame:
    """(kept_id, copies): one record per group with the number of records it stands for."""
    return groups(checkpoint(keyed(chunks))).select("kept_id", "copies")
