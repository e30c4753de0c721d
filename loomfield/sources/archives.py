"""Archives as rows: members are listed, chosen by expressions, and only the chosen ones are unpacked.

A task lists the names in an archive's directory; Spark leaves out noise, routes by
ending and hands back the names to unpack.  What comes out is a row a member, so
cutting into units is spread over members, not over archives.  Archives inside
archives are the next level's rows, `DEPTH` levels below the first.

Members are in the order of the directory, those of an inner archive at its place.
Of an archive the first `most` readable members count; encrypted, damaged or unknown
ones are passed over and use up no place.  Positions are those within a member.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import excluded_path
from ..operators.shared import stash

# Levels of archives inside archives, members of an archive.
DEPTH, MOST = 3, 500

_LISTED = "document_id string, place array<int>, path string"
_MEMBER = "document_id string, place array<int>, source string, name string, prefix string, kind string, content binary"
_UNREADABLE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError)


def _rows(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _opened(content: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except _UNREADABLE:
        return None


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names in each archive, without folders."""
    for pdf in batches:
        for document, place, content in pdf[["document_id", "place", "content"]].itertuples(index=False):
            z = _opened(content)
            names = [(document, [*place, i], e.filename) for i, e in enumerate(z.infolist()) if not e.is_dir()] if z else []
            yield _rows(names, _LISTED)


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chosen members of each archive, a frame each, so that one is in memory at a time."""
    for pdf in batches:
        for document, place, name, prefix, content, chosen in pdf[["document_id", "place", "name", "prefix", "content", "chosen"]].itertuples(index=False):
            z = _opened(content)
            for pick in chosen if z else []:
                entry = z.infolist()[pick["number"]]
                try:
                    body = z.read(entry)
                except _UNREADABLE:
                    continue
                path = entry.filename
                below = f"{prefix}{name}/{path}::" if pick["kind"] == "zip" else prefix
                yield _rows([(document, [*place, pick["number"]], prefix + path, path, below, pick["kind"], body)], _MEMBER)


def routed(path: Column, inner: bool, images: bool) -> Column:
    """What a member is read as: zip, notebook, script, text, image; null for what is left out."""
    picture = path.rlike(lexicon.ARCHIVE_IMAGE) & F.lit(images)
    archive = F.lower(path).endswith(".zip") & F.lit(inner)
    kind = F.when(archive, "zip").when(F.lower(path).endswith(".ipynb"), "notebook").when(path.rlike(lexicon.ARCHIVE_SCRIPT), "script").when(path.rlike(lexicon.ARCHIVE_TEXT), "text").when(picture, "image")
    return F.when(archive | picture | ~excluded_path(path), kind)


def members(archives: DataFrame, inner: bool = False, images: bool = False, most: int = MOST) -> DataFrame:
    """archives(document_id, source, content) -> (document_id, place, source, name, kind, content) of their readable members.

    inner: open archives inside, whose members' source is `archive/inner::member`.  What isn't an archive has none.
    """
    level = archives.select("document_id", F.array().cast("array<int>").alias("place"), "source", F.col("source").alias("name"), F.lit("").alias("prefix"), F.lit("zip").alias("kind"), "content")
    found = None
    for _ in range(DEPTH + 1 if inner else 1):
        names = level.mapInPandas(_list, _LISTED).withColumn("kind", routed(F.col("path"), inner, images)).where("kind IS NOT NULL")
        of = F.slice("place", 1, F.size("place") - 1)
        chosen = names.groupBy("document_id", of.alias("place")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("place", -1).alias("number"), "kind"))).alias("chosen"))
        out = level.join(chosen, ["document_id", "place"]).mapInPandas(_unpack, _MEMBER)
        if inner:
            # Read by the next level as well: unpacked once.
            out = stash(out)
            level = out.where("kind = 'zip'")
        here = out.where("kind <> 'zip'")
        found = here if found is None else found.unionByName(here)
        if inner and not level.limit(1).count():
            break
    first = W.partitionBy("document_id").orderBy("place")
    return found.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= most).drop("_rank", "prefix")
