"""Folders of Markdown: a document a file, with YAML-like frontmatter, and a table of its sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.functions.text import HEADING, path_ident

DOCUMENT = "rel_path string, ident string, front map<string,string>, preamble string"
SECTION = "rel_path string, ord int, level int, heading string, body string, parent int"
_HEAD = re.compile(HEADING)
_FENCE = re.compile(r"^ {0,3}(```|~~~)")


def parse(text: str) -> tuple[dict[str, str], str, list[tuple[int, int, str, str, int | None]]]:
    """Frontmatter, the text before the first heading, and sections (ord, level, heading, body, parent's ord)."""
    lines, front = text.replace("\r\n", "\n").split("\n"), {}
    if lines and lines[0].strip() == "---" and "---" in (rest := [x.strip() for x in lines[1:]]):
        end = rest.index("---")
        for x in lines[1 : end + 1]:
            key, colon, value = x.partition(":")
            if colon:
                front[key.strip()] = value.strip()
        lines = lines[end + 2 :]
    parts: list[list] = [[0, "", []]]
    fenced = False
    for x in lines:
        fenced ^= bool(_FENCE.match(x))
        m = None if fenced else _HEAD.match(x)
        if m:
            parts.append([len(m[1]), (m[2] or "").strip(), []])
        else:
            parts[-1][2].append(x)
    sections, open_ = [], []
    for i, (level, heading, body) in enumerate(parts[1:]):
        while open_ and open_[-1][0] >= level:
            open_.pop()
        sections.append((i, level, heading, "\n".join(body).strip("\n"), open_[-1][1] if open_ else None))
        open_.append((level, i))
    return front, "\n".join(parts[0][2]).strip("\n"), sections


def _files(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """(rel_path, value) of the folder's .md files; a prefix narrows what is listed."""
    df = spark.read.text(f"{folder}/{prefix}" if prefix else folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    start = F.regexp_replace(F.lit(folder), r"^file:/*|/+$", "")
    at = F.regexp_replace(F.url_decode(F.input_file_name()), "^file:/*", "")
    return df.select(F.regexp_replace(at, F.concat(F.lit("^/?\\Q"), F.regexp_replace(start, "^/", ""), F.lit("\\E/")), "").alias("rel_path"), "value")


def documents_from(files: DataFrame) -> DataFrame:
    """Documents of (rel_path, value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse(v or "") for v in b.value]
            yield pd.DataFrame({"rel_path": b.rel_path, "front": [g[0] for g in got], "preamble": [g[1] for g in got]})

    out = files.select("rel_path", "value").mapInPandas(run, "rel_path string, front map<string,string>, preamble string")
    return out.select("rel_path", path_ident(F.col("rel_path")).alias("ident"), "front", "preamble")


def sections_from(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *s) for p, v in zip(b.rel_path, b.value, strict=True) for s in parse(v or "")[2]]
            out = pd.DataFrame(rows, columns=["rel_path", "ord", "level", "heading", "body", "parent"])
            yield out.astype({"parent": "Int32"})

    return files.select("rel_path", "value").mapInPandas(run, SECTION)


def read_markdown_corpus(spark: SparkSession, folder: str, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(documents, sections) of all .md files below a folder, or of a table that write_corpus_table() wrote there."""
    tables = spark.read.schema("rel_path string, value string").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(folder)
    files = tables.where(F.col("rel_path").startswith(prefix)) if tables.inputFiles() else _files(spark, folder, prefix)
    return documents_from(files), sections_from(files)


def corpus_text(documents: DataFrame, sections: DataFrame, to: Column | None = None) -> DataFrame:
    """(rel_path, value): each document as Markdown; sections in order of ord. to: a Column over the documents that gives each its path, instead of rel_path."""
    head = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("heading"), F.lit("\n"), F.when(F.col("body") != "", F.concat(F.lit("\n"), F.col("body"), F.lit("\n"))).otherwise(""))
    body = sections.groupBy("rel_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", head.alias("t")))), lambda s: s["t"]), "\n").alias("body"))
    entries = F.sort_array(F.map_entries("front"))
    lines = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    front = F.when(F.size("front") > 0, F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"))).otherwise("")
    preamble = F.when(F.coalesce("preamble", F.lit("")) != "", F.concat("preamble", F.lit("\n\n"))).otherwise("")
    value = F.concat(front, preamble, F.coalesce("body", F.lit("")))
    # readers leave empty files out, so an empty document is one newline
    path = F.col("rel_path") if to is None else to
    return documents.join(body, "rel_path", "left").select(path.alias("rel_path"), F.when(value == "", "\n").otherwise(value).alias("value"))


def write_corpus_table(documents: DataFrame, sections: DataFrame, folder: str, to: Column | None = None) -> None:
    """The corpus as a table (rel_path, value), in any store."""
    corpus_text(documents, sections, to).write.mode("overwrite").parquet(folder)


def write_markdown_corpus(documents: DataFrame, sections: DataFrame, folder: str, to: Column | None = None) -> None:
    """One .md file for each relative path, written over what is there. The folder is one that all executors share."""
    text = corpus_text(documents, sections, to)
    if not folder.startswith(("file:", "/")):
        raise ValueError("single named files are written to mounted folders only; for other stores there is write_corpus_table()")
    root = re.sub("^file:/*", "/", folder)

    def put(rows) -> None:
        import os

        for r in rows:
            path = os.path.join(root, r.rel_path)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".tmp", "w", encoding="utf-8", newline="\n") as f:
                f.write(r.value)
            os.replace(path + ".tmp", path)

    text.foreachPartition(put)


def corpus_filter(documents: DataFrame, sections: DataFrame, where: Column | None = None, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents that meet all conditions, and their sections."""
    documents = documents if where is None else documents.where(where)
    documents = documents if prefix is None else documents.where(F.col("rel_path").startswith(prefix))
    return documents, sections.join(documents.select("rel_path"), "rel_path", "left_semi")


def corpus_roundtrip_check(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(side, rel_path, ord) of sections that differ after being written out as text and parsed again; none if all is well."""
    back = sections_from(corpus_text(documents, sections))
    columns = ["rel_path", "ord", "level", "heading", "body", "parent"]
    lost = sections.select(*columns).exceptAll(back.select(*columns)).select(F.lit("lost").alias("side"), "rel_path", "ord")
    return lost.union(back.select(*columns).exceptAll(sections.select(*columns)).select(F.lit("new").alias("side"), "rel_path", "ord"))
