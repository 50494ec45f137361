"""Writers: JSON, CSV, HTML, XML, model tables and the seal of a run."""

from __future__ import annotations

import platform

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomar.functions.text import html_escape


def json_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_feedback(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def html_report(title: Column | str, sections: dict[str, Column]) -> Column:
    """A page of one record: a heading and a section for each field that isn't blank, everything escaped."""
    parts = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"<section><h2>{name}</h2><p>"), html_escape(v), F.lit("</p></section>"))).otherwise("") for name, v in sections.items()]
    head = F.concat(F.lit('<!doctype html><html lang="tr"><meta charset="utf-8"><title>'), html_escape(title), F.lit("</title><h1>"), html_escape(title), F.lit("</h1>"))
    return F.concat(head, *parts, F.lit("</html>"))


def file_name(c: Column | str, suffix: str) -> Column:
    """A name for a record's file: what can't stand in one becomes an underscore, a hash keeps names apart."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), F.lit("_"), F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 8), F.lit(f".{suffix}"))


def metadata(c: dict[str, Column]) -> Column:
    """The metadata record of a document."""
    return F.struct(*[v.alias(k) for k, v in c.items()])


def metadata_xml(record: Column | str, tag: str = "Ustveri") -> Column:
    """The metadata record as XML."""
    return F.to_xml(record, {"rowTag": tag})


def metadata_agrees(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Whether every field of the metadata is that of the document, and the fields that differ."""
    differing = F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, (a, b) in pairs.items()]))
    return F.struct((F.size(differing) == 0).alias("uyumlu"), differing.alias("farkli"))


def write_model(model, folder: str) -> None:
    for name in ("prior", "idf", "likelihood"):
        getattr(model, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def seal(files: DataFrame) -> DataFrame:
    """One row (platform, files, seal) of files(file, text): the same for the same names and contents in any order.

    Each file is hashed by itself and the hashes of bounded groups are hashed again, so contents are never gathered.
    """
    each = files.select("file", F.sha2(F.concat_ws("\x00", "file", F.coalesce("text", F.lit(""))), 256).alias("h"))
    grouped = each.groupBy(F.substring("h", 1, 3).alias("g")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return grouped.agg(F.lit(platform.system()).alias("platform"), F.sum("n").alias("files"), F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("g", "h"))), ""), 256), 1, 16).alias("seal"))
