"""Token tables: reading, writing and deriving them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN = "text string, conf double, bbox array<int>, line_id int, _bad string"
TOKENS = "case_id string, doc_id string, pos int, text string, conf double, x int, y int, w int, h int, line_id int"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, doc_id, pos, text, conf, x, y, w, h, line_id`` from JSON arrays ``<case>/<doc>_tokens.json``; malformed files give no rows."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*_tokens.json").withColumn("file", F.input_file_name())
    entries = whole.select("file", F.posexplode(F.from_json("value", "array<struct<text:string,conf:double,bbox:array<int>,line_id:int>>")).alias("pos", "t"))
    box = lambda k: F.get("t.bbox", F.lit(k))
    return entries.select(
        F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("case_id"), F.regexp_extract("file", r"([^/]+)_tokens\.json$", 1).alias("doc_id"), "pos", F.col("t.text").alias("text"), F.col("t.conf").alias("conf"),
        box(0).alias("x"), box(1).alias("y"), box(2).alias("w"), box(3).alias("h"), F.col("t.line_id").alias("line_id"),
    ).filter("text is not null")


def write_tokens(tokens: DataFrame, path: str, kind: str = "parquet") -> None:
    """A token table as Parquet or JSON lines, one folder a case."""
    tokens.write.mode("overwrite").partitionBy("case_id").format(kind).save(path)


ENGINES: dict[str, Callable] = {}


def register_engine(name: str, recognise: Callable[[bytes], list[dict]]) -> None:
    """An OCR engine: image bytes to dictionaries ``text, conf, x, y, w, h, line_id``."""
    ENGINES[name] = recognise


def engine(name: str) -> Callable:
    """The engine of that name; any other name gives the default one, which finds nothing where no library is installed."""
    return ENGINES.get(name, ENGINES.get("default", lambda image: []))


def recognise(images: DataFrame, engine_name: str = "default") -> DataFrame:
    """Tokens of ``images(case_id, doc_id, content)``; an engine's failure gives no tokens. Boxes are at least one wide and high."""
    find = engine(engine_name)

    def run(batches):
        for pdf in batches:
            rows = []
            for case, doc, content in zip(pdf.case_id, pdf.doc_id, pdf.content):
                try:
                    found = find(content)
                except Exception:  # an unreadable image has no tokens
                    found = []
                rows += [(case, doc, k, t["text"], round(float(t["conf"]), 3), t["x"], t["y"], max(1, t["w"]), max(1, t["h"]), t.get("line_id", k)) for k, t in enumerate(found) if str(t["text"]).strip() and t["conf"] >= 0]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOKENS.split(", ")])

    return images.select("case_id", "doc_id", "content").mapInPandas(run, TOKENS)


def cached_tokens(images: DataFrame, cache: DataFrame, engine_name: str = "default") -> DataFrame:
    """Tokens from the cache where it has the document, else recognised."""
    have = cache.select("case_id", "doc_id").distinct()
    return cache.join(images.select("case_id", "doc_id"), ["case_id", "doc_id"], "left_semi").unionByName(recognise(images.join(have, ["case_id", "doc_id"], "left_anti"), engine_name))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, doc_id, content``: image files by folder; pages of a PDF are for the engine that takes its bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,pdf}").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("case_id"), F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("doc_id"), "content")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, case_type, doc_key, filename, doc_type, field, value`` from ``truth.json`` files."""
    schema = "case_id string, case_type string, is_heldout boolean, documents map<string, struct<filename:string, type:string, fields_truth:map<string,string>>>, injected_changes array<struct<field:string, docs:array<string>, type:string, desc:string>>"
    cases = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="truth.json")
    docs = cases.select("case_id", "case_type", F.explode("documents").alias("doc_key", "d"))
    return docs.select("case_id", "case_type", "doc_key", "d.filename", F.col("d.type").alias("doc_type"), F.explode("d.fields_truth").alias("field", "value"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of Markdown tables in a results file: ``metric, cells``; rule and heading lines are left out."""
    line = F.trim("value")
    cells = F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), F.trim)
    return spark.read.text(path).filter(line.startswith("|") & ~line.rlike(r"^\|[\s:|-]+\|$")).select(F.regexp_replace(F.get(cells, F.lit(0)), r"\*", "").alias("metric"), F.slice(cells, 2, 50).alias("cells"))


def text_tokens(docs: DataFrame) -> DataFrame:
    """A token a word of whole texts, laid out on a page by rule: nine units a character, twenty a text line and a jitter."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("row", "line"))
    cells = lines.select("doc_id", "row", F.posexplode(F.filter(F.split("line", r"[\x20\x09-\x0D]+"), lambda t: t != "")).alias("col", "text"))
    width = F.greatest(F.lit(20), F.length("text") * 9)
    w = Window.partitionBy("doc_id", "row").orderBy("col")
    return cells.select(
        "doc_id", "row", "col", "text", width.alias("w"), F.lit(18).alias("h"), (F.sum(width + 6).over(w) - width - 6).cast("int").alias("x"), (F.col("row") * 20 + (F.col("col") * 7) % 3).alias("y"),
        (F.lit(60) + (F.col("col") * 13 + F.col("row") * 7) % 40).cast("double").alias("c"),
    ).withColumn("conf", F.col("c") / 100).drop("c")
