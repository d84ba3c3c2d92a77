"""Movement ledgers as CSV: reading, header aliases, validation, ingestion log, preview.

A ledger "file" ``Movimientos_*.csv`` may also be a folder of that name written by Spark.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demand_engine.functions.expressions import to_day, to_number
from demand_engine.schema import LEDGER_HEADERS, MOVEMENTS, QUANTITIES
from demand_engine.session import keep_table, shuffles_dropped

ENCODING = "ISO-8859-1"
REQUIRED = ("fecha", "entrada", "salida")
NAME_PATTERN = r"(?i)^Movimientos_.*\.csv$"
LOG_SIZE = 50
# Lower-case headers that stand for a canonical one.
ALIASES = {
    "salida": "Salida",
    "entrada": "Entrada",
    "documento": "Documento",
    "número": "Número",
    "código": "Código",
    "fecha": "Fecha",
    "saldo": "Saldo",
}


def canonical_headers(names: list[str]) -> list[str]:
    """Trimmed headers; an alias becomes canonical only where the canonical header is absent."""
    trimmed = [n.strip() for n in names]
    return [ALIASES[n] if n in ALIASES and ALIASES[n] not in trimmed else n for n in trimmed]


def normalize_headers(df: DataFrame) -> DataFrame:
    """A2."""
    return df.toDF(*canonical_headers(df.columns))


def file_named(pattern: str, path: Column | None = None) -> Column:
    """What ``pattern`` finds in a path (that of a row's file if none is given); the path's escapes (of blanks and the like) are undone."""
    path = F.col("_metadata.file_path") if path is None else path
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), pattern, 1)


def separator(header: str) -> str:
    return ";" if ";" in header else ","


ENTRY = r"/([^/]+\.[cC][sS][vV])(/part-[^/]*)?$"  # the file, or the folder of parts, that a path belongs to


def first_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, file, header``: the first line that isn't blank of each CSV file below the folder.

    One text scan in tasks; a file's first line is the least of its first block. Any file system Spark reads will do.
    All lines pass here, so what can be told from the path, or of the first line alone, is left for after the grouping.
    """
    raw = spark.read.option("recursiveFileLookup", "true")
    try:
        text = raw.text(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"Data directory not found: {path}") from error
    lines = text.where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != "")).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("place"))
    # collecting the (one) path makes this an aggregate by hash, lines are not sorted; and no condition on it is asked of every line
    first = lines.groupBy("_path").agg(F.min_by("value", "place").alias("value"), F.collect_set("_path")[0].alias("path"))
    return first.select(
        "path", F.decode(F.col("value").cast("binary"), ENCODING).alias("header"), file_named(ENTRY, F.col("path")).alias("file")
    ).where(F.col("file").rlike(pattern))


def layouts(first: DataFrame) -> DataFrame:
    """Adds ``sep``, ``width`` (columns of the file) and ``at``: the place of every ledger column among them, 0 where it is missing."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    sep = F.when(F.col("header").contains(";"), ";").otherwise(",")
    named = first.withColumn("sep", sep).withColumn(
        "_trimmed", F.transform(F.split("header", F.col("sep"), -1), lambda n: F.regexp_replace(n, r'^[\s"]+|[\s"]+$', "")))
    renamed = F.transform("_trimmed", lambda n: F.when(~F.array_contains("_trimmed", known[n]), known[n]).otherwise(n))
    places = F.array(*[F.array_position("_names", h).cast("int") for h in LEDGER_HEADERS.values()])
    return named.withColumn("_names", renamed).select("path", "file", "sep", F.size("_names").alias("width"), places.alias("at"))


def _cells(spark: SparkSession, path: str, sep: str, width: int) -> DataFrame:
    """All CSV files below the folder as an array of text cells, with their ``path``."""
    places = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.schema(places).csv(path, header=True, sep=sep, encoding=ENCODING, recursiveFileLookup=True)
    return raw.select(F.array(*[F.col(f.name) for f in places]).alias("cells"), F.col("_metadata.file_path").alias("path"), file_named(ENTRY).alias("file"))


def read_movements(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """A1: all ``Movimientos_*.csv`` of a folder but backups, united by column name and typed.

    Where each file has its columns is a table of one row per file, joined to the rows by the file's path (Spark broadcasts
    it while it is small). There is one scan for each of the two separators that occurs; missing columns are null.
    ``header`` states the header line where all files share it, and saves the look into the files and the join.
    Quantities that do not parse are 0, days that do not parse are null.
    """
    pattern = r"^Movimientos_(?!.*(?i:backup)).*\.csv$"
    if header is not None:
        names = canonical_headers([n.strip('"') for n in header.split(separator(header))])
        cells = _cells(spark, path, separator(header), len(names)).where(F.col("file").rlike(pattern))
        return typed(_placed(cells, F.array(*[F.lit(names.index(h) + 1 if h in names else 0) for h in LEDGER_HEADERS.values()])))
    found = keep_table(layouts(first_lines(spark, path, pattern)), "layouts")
    kinds = found.groupBy("sep").agg(F.max("width").alias("width")).collect()  # two rows at most
    if not kinds:
        raise FileNotFoundError(f"No Movimientos_*.csv files found in {path}")
    parts = []
    for kind in kinds:
        own = found.where(F.col("sep") == kind["sep"]).select("path", "at")
        parts.append(_placed(_cells(spark, path, kind["sep"], kind["width"]).join(own, "path"), F.col("at")))
    return typed(reduce(DataFrame.unionByName, parts))


def _placed(cells: DataFrame, at: Column) -> DataFrame:
    """The ledger's columns as text, taken from their places."""
    columns = [F.get("cells", at[i] - 1).alias(c) for i, c in enumerate(LEDGER_HEADERS)]
    return cells.select(*columns, F.col("file").alias("archivo"))


def typed(df: DataFrame) -> DataFrame:
    """Projection to the ledger's columns and types; ``archivo`` stays if it is there."""

    def column(field: T.StructField):
        if field.name not in df.columns:
            empty = F.lit(0.0) if field.name in QUANTITIES else F.lit(None)
            return empty.cast(field.dataType).alias(field.name)
        if field.name in QUANTITIES:
            return to_number(field.name).alias(field.name)
        if field.name == "fecha":
            return to_day("fecha").alias("fecha")
        if isinstance(field.dataType, T.DoubleType):
            return F.col(field.name).try_cast("double").alias(field.name)
        return F.col(field.name)

    extra = [F.col("archivo")] if "archivo" in df.columns else []
    return df.select(*[column(f) for f in MOVEMENTS], *extra)


def write_movements(df: DataFrame, path: str, header_case=str, compression: str = "none") -> None:
    """A ledger as CSV in the file layout; ``header_case`` maps each header, ``compression`` is that of the parts (as Spark names it)."""
    present = [c for c in LEDGER_HEADERS if c in df.columns]
    named = df.select(*[F.col(c).alias(header_case(LEDGER_HEADERS[c])) for c in present])
    with shuffles_dropped(df.sparkSession):
        out = named.write.mode("overwrite").option("zlib.compress.level", "BEST_SPEED")  # gzip's default level: a quarter fewer bytes, but a third more CPU in all
        out.csv(path, header=True, sep=";", encoding=ENCODING, compression=compression)


def validate_ingest(spark: SparkSession, path: str) -> DataFrame:
    """A4 per file: does the name fit, which required columns are missing, is it acceptable.

    A header matches when it contains the required word after dropping everything but letters.
    """
    files = first_lines(spark, path, r"(?i)\.csv$")
    sep = F.when(F.col("header").contains(";"), ";").otherwise(",")
    columns = F.transform(F.split("header", sep), lambda c: F.lower(F.regexp_replace(c, "[^a-zA-Z]", "")))
    needed = F.array(*[F.lit(r) for r in REQUIRED])
    missing = F.filter(needed, lambda r: ~F.exists(F.col("_c"), lambda c: c.contains(r)))
    one_each = files.groupBy("file").agg(F.min("header").alias("header"))
    return one_each.withColumn("_c", columns).select(
        "file",
        F.col("file").rlike(NAME_PATTERN).alias("valid_name"),
        missing.alias("missing"),
        (F.col("file").rlike(NAME_PATTERN) & (F.size(missing) == 0)).alias("valid"),
    )


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """Data rows per ledger file: its non-blank lines without the header."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    per_part = lines.where(F.trim("value") != "").groupBy("path").agg((F.count("*") - 1).alias("rows"))
    name = file_named(ENTRY, F.col("path"))
    return per_part.groupBy(name.alias("filename")).agg(F.sum("rows").alias("rows"))


def ingest_log(counts: DataFrame, previous: DataFrame | None, at: str, size: int = LOG_SIZE) -> DataFrame:
    """A5: newest entries first, ``size`` kept; ``replaced`` where the file was logged before.

    ``counts``: filename, rows of the files just received at time ``at``. ``previous``: the log.
    """
    new = counts.withColumn("fecha", F.lit(at).cast("timestamp"))
    if previous is None:
        return new.withColumn("replaced", F.lit(False)).orderBy(F.desc("fecha"), "filename").limit(size)
    seen = previous.select("filename").distinct().withColumn("_seen", F.lit(True))
    entries = new.join(seen, "filename", "left").withColumn("replaced", F.coalesce("_seen", F.lit(False))).drop("_seen")
    return entries.unionByName(previous).orderBy(F.desc("fecha"), "filename").limit(size)


def _plain(name: str) -> str:
    text = unicodedata.normalize("NFD", name.lower())
    return re.sub(r"[^a-z]", "", "".join(c for c in text if not unicodedata.combining(c)))


def preview(spark: SparkSession, path: str, n: int = 25) -> tuple[DataFrame, DataFrame]:
    """(first n rows of a ledger file, one row with the total and whether all columns exist).

    A folder of parts is read in the order of their names; its first part tells the columns.
    """
    header = first_lines(spark, path, r"(?i)\.csv$").agg(F.min_by("header", "path").alias("header")).first()["header"]
    if header is None:
        raise FileNotFoundError(path)
    names = [_plain(h) for h in header.split(separator(header))]

    def place(word: str) -> int | None:
        return next((i for i, h in enumerate(names) if word in h), None)

    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = spark.read.schema(schema).csv(path, header=True, sep=separator(header), encoding=ENCODING, recursiveFileLookup=True)
    wanted = {"codigo": "codigo", "fecha": "fecha", "doc": "documento", "entrada": "entrada", "salida": "salida"}
    found = {alias: place(word) for alias, word in wanted.items()}

    def text(alias: str):
        i = found[alias]
        value = F.lit("") if i is None else F.trim(F.coalesce(F.col(f"c{i}"), F.lit("")))
        return (F.substring(value, 1, 30) if alias == "doc" else value).alias(alias)

    complete = all(found[a] is not None for a in ("codigo", "fecha", "entrada", "salida"))
    total = rows.agg(F.count("*").alias("total_rows")).withColumn("has_required", F.lit(complete))
    order = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    first = rows.select(*[text(a) for a in wanted], *order).orderBy("_path", "_block", "_line").limit(n)
    return first.drop("_path", "_block", "_line"), total
