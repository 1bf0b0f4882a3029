"""Feeds on disk: finding and reading their tables, fingerprints, and built tables kept for the next run.

Paths go through Spark's readers, so a feed may lie in any store that these can open."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Endings of a table's file, in the order in which they are tried; delimiters.
ENDINGS, DELIMITERS = (".txt.gz", ".csv.gz", ".txt", ".csv"), (",", ";", "\t")
#: Bytes that mean something else in Windows-1254, the encoding of feeds that aren't UTF-8, than in ISO-8859-1, which Spark's CSV
#: reader knows, and what they mean: Turkish letters, quotes, dashes and other signs. The few bytes without a meaning stay.
OTHER = {chr(b): sign for b in range(0x80, 0x100) if (sign := bytes([b]).decode("cp1254", "ignore")) not in ("", chr(b))}
LATIN, TURKISH = "".join(OTHER), "".join(OTHER.values())
#: Version of the built tables; a new one makes old ones stale.
BUILD = "1"


def own_name(folder: str) -> Column:
    """Of a file's ``path`` its name in ``folder``; a file of a folder there has that folder's name."""
    at = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).rstrip("/") + "/"
    return F.substring_index(F.element_at(F.split("path", re.escape(at), 2), -1), "/", 1)


def contents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def feed_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Path by name of the tables' files in ``folder``; only names are read. A table may also be a folder of part files, each with
    the header. Files without a byte don't count."""
    names = contents(spark, folder).select(own_name(folder).alias("name")).distinct().collect()  # a dozen of tables
    return {r.name: f"{folder.rstrip('/')}/{r.name}" for r in names}


def write_table(table: DataFrame, folder: str, name: str) -> None:
    """``table`` as a folder ``name``.csv of part files, UTF-8, each with the header; null values are written as ''."""
    blank = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in table.columns]
    table.select(*blank).write.option("header", "true").option("escape", '"').option("emptyValue", "").csv(f"{folder.rstrip('/')}/{name}.csv")


def locate(files: dict[str, str], table: str, optional: bool = False, endings: tuple[str, ...] = ENDINGS) -> str | None:
    """The path of a table's first file in the order of ``endings``; without one an error, or None if it is optional."""
    for ending in endings:
        if f"{table}{ending}" in files:
            return files[f"{table}{ending}"]
    if optional:
        return None
    raise FileNotFoundError(f"the feed has no table {table}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All values as trimmed texts, missing ones at the end of a row as ''; rows without any value are left out. The
    delimiter is that of the header; the encoding is UTF-8 (with or without a mark), else Windows-1254. An empty file and a
    row with too many values are errors (the latter when the rows are read)."""
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0][0].lstrip("﻿").strip():
        raise ValueError(f"{path} is empty")
    unicode = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    lines = spark.read.option("encoding", "UTF-8" if unicode else "ISO-8859-1")
    head = first[0][0].lstrip("﻿")
    delimiter = max(DELIMITERS, key=head.count) if any(d in head for d in DELIMITERS) else ","
    names = [n.strip().strip('"').strip() for n in head.split(delimiter)]
    schema = StructType([StructField(n, StringType()) for n in names] + [StructField("_rest", StringType()), StructField("_corrupt", StringType())])
    options = {"sep": delimiter, "header": "true", "enforceSchema": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "multiLine": "false"}
    found = lines.options(**options).schema(schema).csv(path)
    letters = (lambda c: c) if unicode else (lambda c: F.translate(c, LATIN, TURKISH))
    value: list[Column] = [letters(F.trim(F.coalesce(F.col(f"`{n}`"), F.lit("")))).alias(n) for n in names]
    checked = F.when(F.col("_rest").isNotNull(), F.raise_error(F.lit(f"{path}: a row has too many values"))).otherwise(F.lit(True))
    some = F.concat(*(F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))) for n in names)) != ""
    return found.where(some & checked.cast("boolean")).select(*value)


def fingerprint(spark: SparkSession, folder: str) -> str:
    """SHA-256 of the names and contents of the folder's files and of BUILD; line ends count alike, but in packed files.
    Files are hashed where they are read; only their hashes meet."""
    name = own_name(folder)
    plain = F.encode(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n"), "ISO-8859-1")
    content = F.when(name.endswith(".gz"), F.col("content")).otherwise(plain)
    each = contents(spark, folder).select(F.concat_ws(":", name, F.sha2(content, 256)).alias("file"))
    whole = F.concat_ws("\n", F.lit(BUILD), F.array_sort(F.collect_list("file")))
    return each.agg(F.sha2(whole, 256)).first()[0]


def built(spark: SparkSession, folder: str, store: str, build) -> dict[str, DataFrame]:
    """The tables that ``build()`` gives (name: DataFrame), kept in ``store``. They are read again while the fingerprint of
    ``folder`` is that of the kept ones, else built and written anew; the manifest is written last."""
    mark = fingerprint(spark, folder)
    place = f"{store.rstrip('/')}/{mark[:16]}"
    try:
        kept = json.loads(spark.read.text(f"{place}/manifest").first()[0])
    except Exception as missing:  # the store has no manifest for this feed
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        kept = {}
    if kept.get("fingerprint") != mark:
        tables = build()
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{place}/{name}")
        kept = {"fingerprint": mark, "tables": sorted(tables)}
        spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/manifest")
    return {name: spark.read.parquet(f"{place}/{name}") for name in kept["tables"]}
