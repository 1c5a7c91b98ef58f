"""Sources: connectors that give documents in a stable order."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.config import DEFAULT
from loomledger.functions.text import WS
from loomledger.operators.prepare import document_id, source_id


def local_files(spark: SparkSession, root: str, group: str, label: str | None = None, limit: int = DEFAULT.max_file_bytes) -> DataFrame:
    """Every .md and .txt file directly below ``root``: id, source, source_id, title, text and ord (by name).

    Links that lead out of the root, folders and files over ``limit`` bytes are left out; a file that is not UTF-8 is an error that names it. The
    title is that of a first non-blank line beginning '# ', else the file's stem. An empty folder gives no rows.
    """
    here = Path(root).resolve(strict=True)
    label = (label if label is not None else root).replace(os.sep, "/").rstrip("/")
    inside = sorted(str(p) for p in here.iterdir() if p.suffix in (".md", ".txt") and p.resolve().is_relative_to(here) and p.is_file())
    schema = "id string, source struct<connector:string,locator:string,independence_group:string>, source_id string, title string, text string, ord bigint"
    if not inside:
        return spark.createDataFrame([], schema)
    # names are shipped as a table, not as a list in the plan
    names = spark.createDataFrame([(os.path.basename(p), i) for i, p in enumerate(inside)], "name string, ord bigint")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.{md,txt}").load(str(here)).where(F.col("length") <= limit)
    rows = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(names, "name")
    text = F.when(F.is_valid_utf8(F.col("content")), F.decode("content", "utf-8")).otherwise(F.raise_error(F.concat(F.lit("not valid UTF-8: "), F.col("path"))))
    rows = rows.withColumn("text", text)
    first = F.regexp_extract("text", rf"\A(?:{WS}*\n)?([^\n]*)", 1)
    title = F.when(first.startswith("# "), F.trim(F.substring(first, 3, 2**31 - 1))).otherwise(F.regexp_replace("name", r"\.[^.]*$", ""))
    locator = F.concat(F.lit(label + "/"), F.col("name"))
    source = F.struct(F.lit("local_files").alias("connector"), locator.alias("locator"), F.lit(group).alias("independence_group"))
    return rows.select(document_id(F.lit("local_files"), locator, F.col("text")).alias("id"), source.alias("source"), source_id(F.lit("local_files"), locator).alias("source_id"), title.alias("title"), "text", "ord")


def checked(docs: DataFrame) -> DataFrame:
    """``docs`` unless two of them have one id but different sources, which is an error."""
    twice = docs.groupBy("id").agg(F.count_distinct("source").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"documents of different sources share the id {twice[0]['id']}")
    return docs


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """The documents of several sources, in the order of the sources, then of their files."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("ord", F.col("ord") + i * (1 << 40))
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no sources")
    return checked(out)
