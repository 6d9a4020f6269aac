"""Documents to chapters, paragraphs and chunks.

Everything is Spark's: lines by posexplode, chapters and paragraphs by windows within one document, texts by aggregation. Where a chunk
ends depends on what it holds already; that is a fold over the lengths of one section's parts (``chunks_of``), which finds where each chunk begins.

Defined results: null texts have no chunks, empty paragraphs are dropped, an overlong sentence stays whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.text import strip

LEAST, MOST, SMALL, MOST_OF_LINES = 600, 1500, 200, 800
#: Sentences of books end here; those of paragraph chunks at full-width marks, too, with the brackets that close them.
SENTENCE = "[^。!?]*[。!?]|[^。!?]+"
CLOSED_SENTENCE = "[^。！？!?]*[。！？!?][」』）)]*|[^。！？!?]+"


def chunks_of(parts: Column, most: int, least: int | None = None, joint: int = 0) -> Column:
    """Parts in order (an array of structs with size and kind) as an array of chunks, each an array of its parts.

    A chunk is closed before a part that would take it over ``most`` or is of another kind, and behind a part with which it has
    ``least``. ``joint`` is what a part behind another adds to its own size.
    """
    # What is held is -1 in front of a new chunk; only places where one begins are kept.
    start = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(1).alias("at"), F.lit(-1).alias("held"), F.lit(None).cast("string").alias("kind"))

    def take(state: Column, part: Column) -> Column:
        new = (state["held"] < 0) | (state["held"] + part["size"] > most) | ~state["kind"].eqNullSafe(part["kind"])
        held = F.when(new, part["size"]).otherwise(state["held"] + part["size"] + joint)
        return F.struct(
            F.when(new, F.array_append(state["begins"], state["at"])).otherwise(state["begins"]).alias("begins"),
            (state["at"] + 1).alias("at"),
            (F.when(held >= least, -1).otherwise(held) if least is not None else held).alias("held"),
            part["kind"].alias("kind"),
        )

    begins = F.aggregate(parts, start, take, lambda state: F.array_append(state["begins"], state["at"]))
    return _sliced(parts, begins)


def _sliced(parts: Column, ends: Column) -> Column:
    """The parts from each of the places given to the next."""
    pairs = F.arrays_zip(F.slice(ends, 1, F.size(ends) - 1).alias("a"), F.slice(ends, 2, F.size(ends) - 1).alias("b"))
    return F.transform(pairs, lambda x: F.slice(parts, x["a"], x["b"] - x["a"]))


def _joined(parts: Column, by: str) -> Column:
    return F.array_join(F.transform(parts, lambda x: x["text"]), by)


def _lines(documents: DataFrame, *more: str) -> DataFrame:
    return documents.where("text is not null").select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("line", "raw"))


def _sum(value: Column, *by: str) -> Column:
    """Running sum by line."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))


def _part(text: Column, kind: Column | None = None, *more: Column) -> Column:
    return F.struct(*more, text.alias("text"), F.length(text).alias("size"), (kind if kind is not None else F.lit(None).cast("string")).alias("kind"))


def sentence_pieces(rows: DataFrame, keys: list[str], most: int, pattern: str) -> DataFrame:
    """rows (keys, text) with ``piece`` and ``text``: texts over ``most`` in runs of sentences of at most that, others whole."""
    found = F.when(F.length("text") > most, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array("text"))
    cut = rows.select(*keys, F.transform(found, lambda x: _part(x)).alias("found")).select(*keys, chunks_of(F.col("found"), most).alias("pieces"))
    return cut.select(*keys, F.posexplode("pieces").alias("piece", "parts")).select(*keys, "piece", _joined(F.col("parts"), "").alias("text"))


def book_chunks(documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, chapter, number, title, section, text, chunk_hash) of texts in which ``# …`` begins a chapter and ``## …`` a section.

    Paragraphs are parted by blank lines; those over MOST are cut at ends of sentences. Neighbours of a section fill a chunk until it
    has LEAST characters, without going over MOST. Then a chunk under SMALL joins the one before it in its chapter, and its
    number stays unused.
    """
    lines = _lines(documents).select("doc_id", "line", strip(F.col("raw")).alias("raw"))
    level = F.length(F.regexp_extract("raw", "^(##?) ", 1))
    named = strip(F.regexp_replace("raw", "^##? ", ""))
    marked = lines.withColumns({"level": level, "blank": (F.col("raw") == "").cast("int")})
    marked = marked.withColumns({"chapter": _sum((F.col("level") == 1).cast("int"), "doc_id").cast("int"), "part": _sum((F.col("level") > 0).cast("int"), "doc_id"), "gap": _sum(F.col("blank"), "doc_id")})
    # The one heading line of a part, and of a chapter.
    whole = lambda *by: Window.partitionBy("doc_id", *by)
    marked = marked.withColumns({
        "title": F.max(F.when(F.col("level") == 1, named)).over(whole("chapter")),
        "section": F.max(F.when(F.col("level") == 2, named)).over(whole("part")),
    })
    place = ["doc_id", "chapter", "part", "title", "section"]
    in_order = lambda order, text: F.array_sort(F.collect_list(F.struct(order, text)))
    paragraphs = marked.where("level = 0 and blank = 0").groupBy(*place, "gap").agg(F.array_join(F.transform(in_order("line", "raw"), lambda x: x["raw"]), "").alias("text"))
    pieces = sentence_pieces(paragraphs, [*place, "gap"], MOST, SENTENCE)
    # A list is one section of one document.
    listed = pieces.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("gap", "piece", "text"))).alias("parts"))
    listed = listed.withColumn("parts", F.transform("parts", lambda x: _part(x["text"])))
    packed = listed.select(*place, F.posexplode(chunks_of(F.col("parts"), MOST, LEAST, 1)).alias("cut", "parts")).withColumn("text", _joined(F.col("parts"), "\n")).drop("parts")
    order = Window.partitionBy("doc_id", "chapter").orderBy("part", "cut")
    numbered = packed.withColumn("number", F.row_number().over(order))
    kept = (F.col("number") == 1) | (F.length("text") >= SMALL)
    numbered = numbered.withColumn("kept", F.max(F.when(kept, F.col("number"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = numbered.groupBy("doc_id", "chapter", F.col("kept").alias("_kept")).agg(
        F.min_by("title", "number").alias("title"), F.min_by("section", "number").alias("section"), F.array_join(F.transform(in_order("number", "text"), lambda x: x["text"]), "\n").alias("text")
    )
    chunks = chunks.withColumnRenamed("_kept", "number")
    name = F.format_string("%d_CH%02d_%03d", "doc_id", "chapter", "number")
    return chunks.select(name.alias("chunk_id"), "doc_id", "chapter", "number", "title", "section", "text", F.sha2("text", 256).alias("chunk_hash"))


def turns(documents: DataFrame, own: list[str], other: list[str]) -> DataFrame:
    """(doc_id, line, speaker, said): labelled lines of transcripts; speaker is self, other or null (goes on)."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).where(strip(F.col("raw")) != "")
    label = F.regexp_extract("raw", r"^[\s\p{Z}]*([^：:\s]{1,20}?)\s*[：:]", 1)
    speaker = F.when(label.isin(own), "self").when(label.isin(other), "other")
    said = F.when(speaker.isNotNull(), F.regexp_replace("raw", r"^[^：:]*[：:]\s*", "")).otherwise(strip(F.col("raw")))
    return lines.select("doc_id", "line", speaker.alias("speaker"), said.alias("said"))


def speaker_runs(spoken: DataFrame) -> DataFrame:
    """(doc_id, run, speaker, first_line, lines, chars): neighbouring lines of one speaker; a line without label goes on.

    Windows and groups are within one document.
    """
    w = Window.partitionBy("doc_id").orderBy("line")
    who = F.last("speaker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = spoken.withColumn("speaker", F.coalesce(who, F.lit("self")))
    new = F.when(F.coalesce(F.lag("speaker").over(w) == F.col("speaker"), F.lit(False)), 0).otherwise(1)
    numbered = held.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "run", "speaker").agg(F.min("line").alias("first_line"), F.count("*").alias("lines"), F.sum(F.length("said")).alias("chars"))


def running_totals(rows: DataFrame, group: list[str], order: list[str], block: Column, values: list[str]) -> DataFrame:
    """rows with ``<value>_total``, the running sum within each group in the order given.

    block is a column that doesn't decrease in that order (a prefix of the first order column). A window sees one block, or
    one group's sums of blocks, never a whole group, so a group may hold a large part of all rows.
    """
    marked = rows.withColumn("_block", block)
    w = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(*group, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = sums.select(*group, "_block", *[F.coalesce(F.sum(f"_{v}").over(w), F.lit(0)).alias(f"_{v}") for v in values])
    own = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Null groups are a group, too.
    same = reduce(Column.__and__, [marked[c].eqNullSafe(before[c]) for c in (*group, "_block")])
    joined = marked.join(before, same).drop(*[before[c] for c in (*group, "_block")])
    return joined.withColumns({f"{v}_total": F.sum(v).over(own) + F.col(f"_{v}") for v in values}).drop("_block", *[f"_{v}" for v in values])


def budget_prefix(lines: DataFrame, group: list[str], order: list[str], block: Column, most: int) -> DataFrame:
    """The lines of each group up to the first that would go over the budget of characters (a prefix, no filter)."""
    summed = running_totals(lines.withColumn("_size", F.length("text") + 1), group, order, block, ["_size"])
    return summed.withColumnRenamed("_size_total", "used").where(F.col("used") <= most).drop("_size")


def annotated_chapters(documents: DataFrame) -> DataFrame:
    """(…, chapter, title, text) of annotated files (doc_id, text, …), cut at notes that name a heading; without head, colophon, readings and notes.

    The head ends at the second rule of ten dashes, else after two lines. What stands before the first heading is no chapter; without headings the
    body is one.
    """
    text = F.regexp_replace("text", "\r\n", "\n")
    ruled = F.regexp_count(text, F.lit("(?m)^-{10,}$")) >= 2
    body = F.when(ruled, F.regexp_replace(text, r"(?s)\A.*?(?m:^-{10,}$).*?(?m:^-{10,}$)", "")).otherwise(F.regexp_replace(text, r"\A[^\n]*\n?[^\n]*\n?", ""))
    body = F.regexp_replace(F.regexp_replace(body, r"(?ms)^底本[：:].*\z", ""), r"\A\n+|\n+\z", "")
    rest = [c for c in documents.columns if c != "text"]
    bodies = documents.where("text is not null").select(*rest, body.alias("body"))
    found = bodies.withColumns({"titles": F.regexp_extract_all("body", F.lit(tx.HEADING_NOTE), F.lit(1)), "texts": F.split("body", tx.HEADING_NOTE)})
    alone = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("next"), strip(F.col("body")).alias("text")))
    each = F.transform("titles", lambda t, k: F.struct(t.alias("title"), F.get("titles", k + 1).alias("next"), F.get("texts", k + 1).alias("text")))
    chapters = found.select(*rest, F.posexplode(F.when(F.size("titles") > 0, each).otherwise(alone)).alias("chapter", "x"))
    # The line of the next heading, whose note came behind its words.
    heading = F.concat(F.lit(f"{tx.NOTE}\\s*\\Q"), F.replace("x.next", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\s*\\z"))
    part = F.when(F.col("x.next").isNotNull(), F.regexp_replace(F.col("x.text"), heading, "")).otherwise(F.col("x.text"))
    part = F.when(F.col("x.title").isNotNull(), F.regexp_replace(part, "\\A[\\n 　]+|[\\n 　]+\\z", "")).otherwise(part)
    return chapters.select(*rest, (F.col("chapter") + 1).alias("chapter"), "x.title", tx.without_notes(tx.without_ruby(part)).alias("text"))


def line_chunks(texts: DataFrame, keys: list[str], most: int = MOST_OF_LINES) -> DataFrame:
    """(keys, number, char_start, char_end, kind, text) of texts (keys, fiction, text): neighbouring lines, joined until the next would go over
    ``most`` (line breaks not counted). Of fiction, dialogue and narration are parted; else the kind is body. Lines over ``most`` are
    cut at ends of sentences. A chunk is the text between its positions, but that blank lines within it are dropped.
    """
    lines = texts.where("text is not null").select(*keys, "fiction", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    before = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where(strip(F.col("text")) != "")
    row = [*keys, "fiction", "line", "at"]
    pieces = sentence_pieces(lines, row, most, CLOSED_SENTENCE)
    behind = Window.partitionBy(*keys, "line").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", (F.col("at") + F.coalesce(F.sum(F.length("text")).over(behind), F.lit(0))).cast("int"))
    kind = F.when(~F.col("fiction"), "body").when(F.col("text").rlike("^[　 ]*[「『]"), "dialogue").otherwise("narration")
    # A list is one chapter of one document.
    listed = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(_part(F.col("text"), kind, F.col("start")))).alias("parts"))
    cut = listed.select(*keys, F.posexplode(chunks_of(F.col("parts"), most)).alias("number", "parts"))
    first, last = F.get("parts", 0), F.element_at("parts", -1)
    return cut.select(
        *keys, (F.col("number") + 1).alias("number"), first["start"].alias("char_start"), (last["start"] + last["size"]).alias("char_end"), first["kind"].alias("kind"), _joined(F.col("parts"), "\n").alias("text")
    )


def corpus_chunks(documents: DataFrame, annotated: Column, fiction: Column, most: int = MOST_OF_LINES) -> DataFrame:
    """(doc_id, chapter, number, title, char_start, char_end, kind, text): lines packed chapter by chapter (``line_chunks``); positions are
    those in the chapter's text, after readings and notes are taken out of annotated files."""
    no = F.lit(False)
    rows = documents.where("text is not null").select("doc_id", "text", F.coalesce(annotated, no).alias("annotated"), F.coalesce(fiction, no).alias("fiction"))
    plain = rows.where("not annotated").select("doc_id", "annotated", "fiction", F.lit(1).alias("chapter"), F.lit(None).cast("string").alias("title"), "text")
    chapters = annotated_chapters(rows.where("annotated")).unionByName(plain)
    chunks = line_chunks(chapters, ["doc_id", "chapter", "title"], most)
    return chunks.select("doc_id", "chapter", "number", "title", "char_start", "char_end", "kind", "text")


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, value: str, block: int) -> DataFrame:
    """left with the value of the right row of its group with the greatest ``at`` not above its own (of equal ones the greatest value;
    right rows without value are none).

    Positions are cut into blocks; a window sees the rows of one block, or one row per block of a group, so a group may hold a large
    part of all rows. Rows of null group or position get null.
    """
    number = F.floor(F.col(at) / block)
    right = right.where(F.col(group).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(group, at).agg(F.max(value).alias("_value"))
    both = left.withColumn("_value", F.lit(None).cast(right.schema["_value"].dataType)).withColumn("_left", F.lit(True))
    rows = both.unionByName(right.withColumn("_left", F.lit(False)), allowMissingColumns=True).withColumn("_block", number)
    lasts = right.withColumn("_block", number).groupBy(group, "_block").agg(F.max(F.struct(at, "_value"))["_value"].alias("_last"))
    # Every block that has left rows needs the last value of any block before it.
    places = rows.select(group, "_block").distinct().join(lasts, [group, "_block"], "left")
    order = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = places.select(group, "_block", F.last("_last", ignorenulls=True).over(order).alias("_before"))
    own = Window.partitionBy(group, "_block").orderBy(F.col(at), F.col("_left")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(before, [group, "_block"], "left").withColumn(f"{value}_at", F.coalesce(F.last("_value", ignorenulls=True).over(own), "_before"))
    return found.where("_left").drop("_left", "_value", "_before", "_block")
