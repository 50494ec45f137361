"""Readers: text folders, labels, line-delimited JSON, legislation files, reports, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.functions.text import article_references, tokens

LABEL = "struct<tur:string,birim_kodu:string,eksik_alanlar:array<string>,aciklama:string,mevzuat_beklenen:array<string>>"
FEEDBACK = "zaman string, dosya string, tahmin_tur string, dogru_tur string, tahmin_birim string, dogru_birim string"
#: Suffixes that are read as text, and those that need an engine outside of Spark.
TEXT_SUFFIXES, OTHER_SUFFIXES = ("txt", "md"), ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")


def text_folder(spark: SparkSession, *folders: str, pattern: str = "*.txt") -> DataFrame:
    """(file, text) of whole text files; an empty folder gives no rows."""
    frame = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(list(folders), wholetext=True)
    return frame.select(F.regexp_extract(F.input_file_name(), r"[^/]+$", 0).alias("file"), F.col("value").alias("text"))


def by_suffix(path: Column | str) -> Column:
    """How a file is read: 'text', 'engine' (a scan) or null for an unknown kind."""
    c = F.col(path) if isinstance(path, str) else path
    suffix = F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))
    return F.when(suffix.isin(*TEXT_SUFFIXES), "text").when(suffix.isin(*OTHER_SUFFIXES), "engine")


def inline(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(source, text, characters, words) of texts given directly."""
    frame = spark.createDataFrame(rows, "source string, text string")
    return frame.withColumn("characters", F.length("text")).withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, tur, birim_kodu, eksik_alanlar, aciklama, mevzuat_beklenen) of a label file; entries without a type are left out."""
    frame = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{LABEL}>").alias("m"))
    return frame.select(F.explode("m").alias("file", "x")).select("file", "x.*").where("tur is not null")


def training_pairs(spark: SparkSession, folder: str, label_file: str = "etiketler.json") -> DataFrame:
    """(file, text, tur) for training; folders of held-out documents are refused."""
    if "heldout" in folder:
        raise ValueError("held-out documents aren't for training")
    return text_folder(spark, folder).join(labels(spark, f"{folder}/{label_file}").select("file", "tur"), "file")


def json_lines(spark: SparkSession, path: str, schema: str = FEEDBACK) -> DataFrame:
    """Rows of a line-delimited file; lines that aren't objects are skipped."""
    lines = spark.read.text(path).where(F.trim("value").rlike(r"^\{.*\}$"))
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x")).where("x is not null")
    return parsed.select("x.*").where(" or ".join(f"`{f.strip().split()[0]}` is not null" for f in schema.split(",")))


def legislation(files: DataFrame) -> DataFrame:
    """(doc_id, title, source, keywords, section, body, articles, tokens) of files(file, text): '# Key: value' lines, then '## ' sections."""
    header = lambda name: F.nullif(F.trim(F.regexp_extract("text", rf"(?mid)^#\s*{name}\s*:\s*([^\n]+)", 1)), F.lit(""))
    own = files.select(
        F.regexp_replace("file", r"\.[^.]+$", "").alias("doc_id"), header("(?:Başlık|Title)").alias("title"), header("(?:Kaynak|Source)").alias("source"),
        F.filter(F.transform(F.split(F.coalesce(header("(?:Anahtar|Keywords)[^:]*"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("keywords"), F.posexplode(F.split("text", r"(?m)^\s*## ")).alias("pos", "part"),
    ).where("pos > 0")
    shaped = own.select("doc_id", "title", "source", "keywords", "pos", F.trim(F.regexp_extract("part", r"^[^\n]*", 0)).alias("section"), F.trim(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"))
    return shaped.select("*", article_references(F.concat_ws(" ", "section", "body")).alias("articles"), tokens(F.concat_ws(" ", "title", "section", "body", F.array_join("keywords", " "))).alias("tokens"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """A report as one row."""
    return spark.read.json(path, multiLine=True)


def model_tables(spark: SparkSession, folder: str):
    """A Naive Bayes model from its three tables; missing columns are an error."""
    from tomar.operators.naive_bayes import Model

    wanted = {"prior": ["class", "log_prior", "unseen"], "idf": ["feature", "idf"], "likelihood": ["class", "feature", "ll"]}
    parts = {}
    for name, columns in wanted.items():
        parts[name] = spark.read.parquet(f"{folder}/{name}")
        missing = set(columns) - set(parts[name].columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
    return Model(**parts)


def scan_quality(rows: DataFrame, *by: str) -> DataFrame:
    """Mean confidence, share below 60 and grade of rows(confidence) with a confidence of 0 or more."""
    own = rows.where("confidence >= 0")
    mean, poor = F.avg("confidence"), F.avg((F.col("confidence") < 60).cast("int"))
    return (own.groupBy(*by) if by else own).agg(F.count("*").alias("n"), mean.alias("mean"), poor.alias("poor"), F.when(mean >= 80, "iyi").when(mean >= 60, "orta").when(mean.isNotNull(), "zayif").alias("grade"))
