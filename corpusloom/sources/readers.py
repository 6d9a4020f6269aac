"""Readers for the formats corpora arrive in. Files are split over tasks by Spark; decoding happens there."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _texts(kind: str, content: bytes, extractors: dict[str, Callable[[bytes], str]]) -> str:
    if kind in extractors:
        return extractors[kind](content)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = next((n for n in sorted(z.namelist()) if n.lower().endswith(".txt")), None)
            return "" if name is None else z.read(name).decode("cp932", "replace")
    if kind == "docx":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = z.read("word/document.xml").decode("utf-8", "replace")
        out = []
        for p in re.findall(r"<w:p[ >].*?</w:p>", body, re.S):
            level = re.search(r'<w:pStyle w:val="Heading ?(\d)"', p)
            words = "".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S))
            out.append(("#" * int(level[1]) + " " if level else "") + words)
        return "\n".join(out)
    return content.decode("utf-8", "replace")


def decoded(files: DataFrame, encoding: str | None = None, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, kind, text, garbled) of files (path, content): text files, zipped texts and word files; other kinds by the extractors given.

    garbled is the share of replacement marks. A file that can't be read has a null text and stays in the result.
    """
    given = extractors or {}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                kind = p.rsplit(".", 1)[-1].lower()
                try:
                    text = bytes(content).decode(encoding, "replace") if encoding and kind == "txt" else _texts(kind, bytes(content), given)
                except (zipfile.BadZipFile, KeyError, ValueError):
                    text = None
                rows.append((p, kind, text, None if text is None else text.count("�") / max(1, len(text))))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "garbled"])

    return files.where("path is not null and content is not null").select("path", "content").mapInPandas(decode, "path string, kind string, text string, garbled double")


def read_files(spark: SparkSession, path: str, encoding: str | None = None, extractors: dict[str, Callable[[bytes], str]] | None = None, pattern: str = "*") -> DataFrame:
    """The files of a folder whose names fit the pattern, ``decoded``."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path), encoding, extractors)


@F.pandas_udf(T.BinaryType())
def zipped(names: pd.Series, texts: pd.Series, kinds: pd.Series) -> pd.Series:
    """A zip file with one CP932 text (kind zip), or a word file of plain paragraphs (kind docx)."""
    out = []
    for name, text, kind in zip(names, texts, kinds):
        content = io.BytesIO()
        with zipfile.ZipFile(content, "w") as z:
            if kind == "docx":
                body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in text.split("\n"))
                z.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
            else:
                z.writestr(f"{name}.txt", text.encode("cp932", "replace"))
        out.append(content.getvalue())
    return pd.Series(out)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, all strings, blanks as null, without a byte order mark."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.select(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`"))).alias(c) for c in df.columns])


def read_records(spark: SparkSession, path: str, mark: str = "=== THOUGHT_CARD ===") -> DataFrame:
    """(path, number, fields map, body) of text files of blocks: ``key: value`` lines, then ``text:`` and a body."""
    blocks = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", re.escape(mark))).alias("number", "block")).where("number > 0")
    return parsed_records(blocks)


def parsed_records(blocks: DataFrame) -> DataFrame:
    """block to fields and body."""
    head = F.regexp_extract("block", r"(?s)^\s*(.*?)(?:\n\s*text:|$)", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\s*[A-Za-z_]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([A-Za-z_]+)\s*:", 1)), F.trim(F.regexp_extract(x, r"^\s*[A-Za-z_]+\s*:(.*)$", 1))))
    body = F.trim(F.regexp_extract("block", r"(?s)\n\s*text:\s*(.*)$", 1))
    return blocks.withColumn("fields", F.map_from_entries(F.array_distinct(pairs))).withColumn("body", body).drop("block")


def escaped(text: Column) -> Column:
    """A text for HTML."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def section_links(pages: DataFrame, anchor: str) -> DataFrame:
    """(…, number, label) of the links to cards in one section of pages (html, …): from the heading of that anchor to the next heading; tags
    within a label go. Pages without the section have no links."""
    section = F.split_part(F.regexp_extract("html", f'(?s)<h2><a name="{anchor}".*?</h2>(.*)$', 1), F.lit("<h2"), F.lit(1))
    link = r'(?s)<a href="[^"]*?card(\d+)\.html">(.*?)</a>'
    group = lambda k: F.regexp_extract_all(section, F.lit(link), F.lit(k))
    rest = [c for c in pages.columns if c != "html"]
    links = pages.select(*rest, F.explode(F.arrays_zip(group(1).alias("number"), group(2).alias("label"))).alias("x"))
    bare = F.trim(F.regexp_replace("x.label", "<[^>]*>", ""))
    plain = F.replace(F.replace(F.replace(bare, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return links.select(*rest, "x.number", plain.alias("label"))


def lenient_json(text: str | None) -> str | None:
    """The JSON object in an answer: a fenced block, else from the first brace to the last; null if there is none."""
    if not text:
        return None
    m = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    body = m[1] if m else text
    try:
        return json.dumps(json.loads(body[body.index("{") : body.rindex("}") + 1], strict=False), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None
