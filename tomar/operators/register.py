"""The append-only audit register: shaping, appending, filters, counts and the latest rows.

Rows are never changed. A record with missing parts gives a row with nulls. Texts are cut to the register's widths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomar.functions.text import contains_literal, safe_number

SUMMARY, TEXT, REASONS = 200, 2000, 1000
LEAST_ROWS, MOST_ROWS, DEFAULT_ROWS = 1, 500, 50
COLUMNS = {
    "id": "bigint", "zaman": "string", "kaynak": "string", "tur": "string", "tur_guven": "double", "birim": "string", "birim_guven": "double", "oncelik": "string", "son_tarih": "string", "eksik_sayisi": "int",
    "kritik_eksik": "int", "format_skoru": "double", "sure_saniye": "double", "insan_onayi": "int", "insan_onayi_gerekce": "string", "ozet_ilk_200": "string", "metin_ozu": "string", "yazi_turu": "string",
}


def flattened(results: DataFrame) -> DataFrame:
    """Register rows without id of nested results; columns that a record lacks become null."""

    def part(path: str) -> Column:
        node = results.schema
        for name in path.split("."):
            if not hasattr(node, "names") or name not in node.names:
                return F.lit(None)
            node = node[name].dataType
        return F.col(path)

    missing = part("eksik_bilgiler")
    known = "eksik_bilgiler" in results.columns
    return results.select(
        F.date_format(part("zaman").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("zaman"), part("input_file").cast("string").alias("kaynak"), part("siniflandirma.tur").cast("string").alias("tur"),
        safe_number(part("siniflandirma.guven").cast("string")).alias("tur_guven"), part("yonlendirme.birim").cast("string").alias("birim"), safe_number(part("yonlendirme.guven").cast("string")).alias("birim_guven"),
        part("onceliklendirme.oncelik").cast("string").alias("oncelik"), part("onceliklendirme.son_tarih").cast("string").alias("son_tarih"),
        (F.coalesce(F.size(missing), F.lit(0)) if known else F.lit(0)).cast("int").alias("eksik_sayisi"),
        (F.coalesce(F.exists(missing, lambda x: F.lower(F.trim(x["oncelik"])) == "kritik"), F.lit(False)) if known else F.lit(False)).cast("int").alias("kritik_eksik"),
        safe_number(part("format_denetimi.skor").cast("string")).alias("format_skoru"), safe_number(part("islem_suresi_saniye").cast("string")).alias("sure_saniye"),
        F.coalesce(part("insan_onayi.gerekli").cast("int"), F.lit(0)).alias("insan_onayi"),
        (F.substring(F.array_join(part("insan_onayi.gerekceler"), "; "), 1, REASONS) if "insan_onayi" in results.columns else F.lit(None).cast("string")).alias("insan_onayi_gerekce"),
        F.substring(part("ozet").cast("string"), 1, SUMMARY).alias("ozet_ilk_200"), F.substring(part("metin").cast("string"), 1, TEXT).alias("metin_ozu"), part("yazi_turu").cast("string").alias("yazi_turu"),
    )


def numbered(rows: DataFrame, start: int) -> DataFrame:
    """The rows with ids from start on that rise with time: partitions are ranges of zaman, rows within them are in its order."""
    rows = rows.repartitionByRange("zaman").sortWithinPartitions("zaman") if "zaman" in rows.columns else rows
    return rows.select((F.monotonically_increasing_id() + start).alias("id"), *rows.columns)


def append(rows: DataFrame, path: str) -> None:
    """Append register rows to a parquet register, with ids above those it has."""
    spark = rows.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max("id")).first()[0] or 0
    except Exception as error:  # no register yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        last = 0
    migrated(numbered(rows, last + 1)).write.mode("append").parquet(path)


def migrated(register: DataFrame) -> DataFrame:
    """A register of any age in today's columns: missing ones are null."""
    return register.select(*[(F.col(c) if c in register.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def query(register: DataFrame, tur: str | None = None, birim: str | None = None, oncelik: str | None = None, text: str | None = None, approval: bool | None = None, limit: object = DEFAULT_ROWS) -> DataFrame:
    """The latest rows that meet all given conditions; a limit out of range is clamped, a wrong one is the default."""
    conditions = [F.col(c) == v for c, v in (("tur", tur), ("birim", birim), ("oncelik", oncelik)) if v]
    if approval is not None:
        conditions.append(F.col("insan_onayi") == int(approval))
    if text:
        conditions.append(F.coalesce(contains_literal("ozet_ilk_200", text), F.lit(False)) | F.coalesce(contains_literal("metin_ozu", text), F.lit(False)))
    own = register.where(reduce(lambda a, b: a & b, conditions)) if conditions else register
    return own.orderBy(F.desc("id")).limit(clamped(limit))


def clamped(limit: object) -> int:
    """A row limit between 1 and 500."""
    try:
        return max(LEAST_ROWS, min(MOST_ROWS, int(limit)))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return DEFAULT_ROWS


def totals(register: DataFrame) -> DataFrame:
    """One row: count, mean confidence and duration, sums."""
    return register.agg(
        F.count("*").alias("toplam"), F.avg("tur_guven").alias("ortalama_guven"), F.avg("sure_saniye").alias("ortalama_sure"), F.coalesce(F.sum("insan_onayi"), F.lit(0)).alias("insan_onayi"), F.coalesce(F.sum("eksik_sayisi"), F.lit(0)).alias("eksik")
    )


def distribution(register: DataFrame, *columns: str) -> DataFrame:
    """(alan, deger, n): counts of the values of each column, blanks left out, in one pass over grouping sets."""
    if not columns:
        raise ValueError("name a column")
    names = [F.lit(c) for c in columns]
    long = register.select(F.explode(F.arrays_zip(F.array(*names).alias("alan"), F.array(*[F.col(c).cast("string") for c in columns]).alias("deger"))).alias("x")).select("x.alan", "x.deger")
    return long.where("deger <> ''").groupBy("alan", "deger").agg(F.count("*").alias("n"))


def delivered_once(register: DataFrame) -> DataFrame:
    """The rows without those that were delivered twice whole, which have the same id.

    Only the columns that a query reads are shuffled, so counts never move the texts. Rows without id count as one.
    """
    return register.dropDuplicates(["id"])


def pending(register: DataFrame, handled: DataFrame) -> DataFrame:
    """The rows that need approval and whose id isn't among handled(id)."""
    return register.where("insan_onayi = 1").join(handled.select("id"), "id", "left_anti")


def cockpit(register: DataFrame, manual_minutes: float = 12.0) -> DataFrame:
    """One row of counts, rates and the estimated saving against manual work, between 0 and 1."""
    n, spent = F.count("*"), F.coalesce(F.sum("sure_saniye"), F.lit(0.0))
    manual = n * manual_minutes * 60
    return register.agg(
        n.alias("toplam"), F.count_if(F.col("eksik_sayisi") > 0).alias("eksikli"), F.avg((F.col("eksik_sayisi") > 0).cast("int")).alias("eksik_orani"), F.avg("tur_guven").alias("ortalama_guven"),
        F.countDistinct("kaynak").alias("kaynak_sayisi"), F.when(manual > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - spent / manual))).alias("tasarruf_orani"),
    )


def top_per(register: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The n rows of each group with the greatest order value; ties go to the smaller id."""
    own = Window.partitionBy(group).orderBy(F.desc(order), "id")
    return register.withColumn("sira", F.row_number().over(own)).where(F.col("sira") <= n)


def cited(register: DataFrame) -> DataFrame:
    """The eight columns that precedent search reads, nulls as empty text."""
    return register.select("id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("kaynak", "tur", "birim", "ozet_ilk_200", "metin_ozu", "zaman", "yazi_turu")])
