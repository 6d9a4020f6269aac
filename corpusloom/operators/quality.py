"""Counts, ratios and fingerprints by which a corpus snapshot is judged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, records) of several columns in one pass (grouping sets); null is ``unknown``."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns]
    sets = [[F.col(c)] for c in columns]
    counted = df.select(*known).groupingSets(sets, *columns).agg(F.count("*").alias("records"), F.grouping_id().alias("_set"))
    # A column's bit in the grouping id is 0 in its own set.
    whole = (1 << len(columns)) - 1
    own = {c: whole - (1 << (len(columns) - 1 - k)) for k, c in enumerate(columns)}
    field = reduce(lambda acc, c: F.when(F.col("_set") == own[c], c).otherwise(acc), columns, F.lit(None).cast("string"))
    value = reduce(lambda acc, c: F.when(F.col("_set") == own[c], F.col(c)).otherwise(acc), columns, F.lit(None).cast("string"))
    return counted.select(field.alias("field"), value.alias("value"), "records")


def checks(df: DataFrame, tests: dict[str, tuple[Column, float]]) -> DataFrame:
    """(name, hits, value, passed): the share of rows for which each test is true, against the most allowed; one pass. Null is no hit; no rows give 0."""
    hits = [F.sum(F.when(t, 1).otherwise(0)).alias(n) for n, (t, _) in tests.items()]
    one = df.agg(F.count("*").alias("_all"), *hits)
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(0)).alias("hits"), F.lit(float(m)).alias("most")) for n, (_, m) in tests.items()])
    value = F.when(F.col("_all") > 0, F.col("x.hits") / F.col("_all")).otherwise(0.0)
    return one.select("_all", F.explode(rows).alias("x")).select("x.name", "x.hits", F.round(value, 6).alias("value"), (value <= F.col("x.most")).alias("passed"))


def repeated(df: DataFrame, key: str, least_chars: int = 30) -> DataFrame:
    """Rows whose digest stands more than once among texts of some length. Counts first, so a hot digest is one row a task."""
    long = df.where((F.length("text") >= least_chars) & F.col(key).isNotNull())
    often = long.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")
    return long.join(often, key)


def fingerprint(df: DataFrame, group: str | list[str], *parts: str) -> DataFrame:
    """(group, records, digest): does not depend on the order of rows, and is summed per task, so no group is gathered."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    number = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*([group] if isinstance(group, str) else group)).agg(F.count("*").alias("records"), F.sum(number).cast("string").alias("digest"))


def first_of(df: DataFrame, group: list[str], *order: Column | str) -> DataFrame:
    """The row of each group with the greatest values of order (nulls lowest); partial maxima per task, ties by the other columns."""
    rest = [c for c in df.columns if c not in group]
    best = df.groupBy(*group).agg(F.max(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"_{k}") for k, c in enumerate(order)], *rest)).alias("_best"))
    return best.select(*group, *[F.col(f"_best.{c}").alias(c) for c in rest])


def samples(df: DataFrame, key: str, tests: dict[str, Column], most: int = 20) -> DataFrame:
    """(name, rows, sample): for each test the number of rows for which it is true, and their ``most`` smallest keys, joined by commas."""
    hits = F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])
    each = df.select(F.explode(F.array_compact(hits)).alias("name"), F.col(key).alias("key"))
    counted = each.groupBy("name").agg(F.count("*").alias("rows"))
    ranked = each.where("key is not null").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("key"))).where(F.col("_n") <= most)
    listed = ranked.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("sample"))
    return counted.join(listed, "name", "left").select("name", "rows", F.coalesce("sample", F.lit("")).alias("sample"))
