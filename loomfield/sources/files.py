"""Readers: files of any kind to text units (document_id, source, position, text).

`read_files` lists a folder with Spark's binary reader, so any store that Spark
reads will do, and routes each file by type.  Text kinds stay in the JVM;
scripts and notebooks are parsed by small per-file helpers in Arrow batches, archives
are unpacked to a row a member first (`archives`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import image_unit, paragraphs, source_type, transcript_segments
from .archives import members

UNITS = "document_id string, source string, position long, text string"
SIZE_CAP = 50 * 1024 * 1024

# What a script's units are cut by.
_BLOCK = re.compile(r"/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''")
_BLOCK_EDGE = re.compile(r"^[/*\"'\s]+|[/*\"'\s]+$")
_LINE = re.compile(r"(?:^|\n)(?:\s*(?://|#)[^\n]*\n?)+")
_LINE_MARK = re.compile(r"^\s*(?://|#)\s?", re.M)
_SIGNATURE = re.compile(r"(?:function|class|def|const|interface|type)\s+[A-Za-z_$][\w$]*[^\n{(]*", re.A)


def script_units(text: str) -> list[str]:
    """Block comments, runs of line comments, signatures; lines where there is nothing of these."""
    out = [c for c in (_BLOCK_EDGE.sub("", m[0]).strip() for m in _BLOCK.finditer(text)) if len(c) > 10]
    out += [c for c in (_LINE_MARK.sub("", m[0]).strip() for m in _LINE.finditer(text)) if len(c) > 10]
    out += [m[0].strip() for m in _SIGNATURE.finditer(text)][:200]
    return out or [s for s in (p.strip() for p in text.split("\n")) if len(s) > 5][:300]


def notebook_units(text: str) -> list[str]:
    """Authored cells, tagged by kind; what isn't JSON is one unit of its first 4000 characters."""
    try:
        book = json.loads(text)
    except ValueError:
        return [text[:4000]]
    cells = book.get("cells") if isinstance(book, dict) else None
    out = []
    for cell in cells if isinstance(cells, list) else []:
        said = cell.get("source")
        said = ("".join(map(str, said)) if isinstance(said, list) else str(said if said is not None else "")).strip()
        if len(said) >= 5:
            out.append({"code": "[code] ", "markdown": "[md] "}.get(cell.get("cell_type"), "[raw] ") + said)
    return out


def _cut(how: Callable[[str], list[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, s, i, t) for d, s, raw in zip(pdf["document_id"], pdf["source"], pdf["content"], strict=True) for i, t in enumerate(how(bytes(raw).decode("utf-8", "replace")))]
            yield pd.DataFrame(rows, columns=["document_id", "source", "position", "text"])

    return run


def _texts(rows: DataFrame) -> DataFrame:
    units = rows.select("document_id", "source", F.posexplode(paragraphs(F.make_valid_utf8(F.col("content").cast("string")))).alias("position", "text"))
    return units.select("document_id", "source", F.col("position").cast("long").alias("position"), "text")


def pictures(images: DataFrame) -> DataFrame:
    """images(document_id, source, ocr, caption) -> one unit each; the name where a model told nothing."""
    return images.select("document_id", "source", F.lit(0).cast("long").alias("position"), image_unit(F.col("source"), F.col("ocr"), F.col("caption")).alias("text"))


def _untold(images: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return images.withColumns({"ocr": nothing, "caption": nothing})


def read_files(spark: SparkSession, folder: str, recurse_archives: bool = False, size_cap: int = SIZE_CAP, archive_images: bool = False, describe: Callable[[DataFrame], DataFrame] = _untold) -> tuple[DataFrame, DataFrame]:
    """(files, units) of a folder.  Files above the cap are listed but not read; media need a model's output (see providers).

    archive_images: images inside archives are units too, by the columns ocr and caption that `describe` adds to their
    rows (source, content); without a model by their name.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    files = raw.withColumn("source", name).withColumn("document_id", F.sha2("path", 256)).withColumn("source_type", source_type(name, F.lit(None).cast("string")))
    able = files.where(F.col("length") <= size_cap)
    pick = lambda *kinds: able.where(F.col("source_type").isin(*kinds)).select("document_id", "source", "content")
    inside = members(pick("zip"), recurse_archives, archive_images)
    within = lambda kind: inside.where(F.col("kind") == kind).select("document_id", "source", "content")
    units = _texts(pick("text", "json").unionByName(within("text")))
    for kind, how in (("script", script_units), ("notebook", notebook_units)):
        units = units.unionByName(pick(kind).unionByName(within(kind)).mapInPandas(_cut(how), UNITS))
    if archive_images:
        units = units.unionByName(pictures(describe(within("image"))))
    return files.drop("content"), units


def transcript_units(transcripts: DataFrame) -> DataFrame:
    """transcripts(document_id, filename, transcript) -> a unit for each time mark, its source name@time."""
    seg = transcripts.select("document_id", "filename", F.posexplode(transcript_segments(F.col("transcript"))).alias("position", "s"))
    source = F.when(F.col("s.ts").isNotNull(), F.concat("filename", F.lit("@"), "s.ts")).otherwise(F.col("filename"))
    return seg.select("document_id", source.alias("source"), F.col("position").cast("long").alias("position"), F.col("s.text").alias("text"))


FIELD = "units array<struct<id:string,text:string,clusterId:int,type:string,fz:double,fy:double,cti:double>>, clusters array<struct<id:int,label:string,unitCount:long,avgFZ:double,avgFY:double,description:string>>, stats struct<totalUnits:long,boundaryUnits:long,avgFZ:double,avgFY:double>"


def read_field(spark: SparkSession, path: str) -> DataFrame:
    """Exported fields; what lacks units, clusters or stats is passed over."""
    return spark.read.schema(FIELD).option("multiLine", "true").json(path).where("units IS NOT NULL AND clusters IS NOT NULL AND stats IS NOT NULL")


def write_field(field: DataFrame, path: str) -> None:
    """One JSON object a row."""
    field.write.mode("overwrite").json(path)


def corpus_map(params: dict[str, float], **sections: DataFrame) -> DataFrame:
    """Rows of the corpus map export: (section, body as JSON), one row a row of each section, so that no section is one string."""
    part = lambda name, df: df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("body"))
    first = next(iter(sections.values())).sparkSession
    head = [("schema_version", '"corpus-map/2.0"'), ("params", json.dumps(params))]
    out = first.createDataFrame(head, "section string, body string")
    for name, df in sections.items():
        out = out.unionByName(part(name, df))
    return out
