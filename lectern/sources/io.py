"""Readers and writers of catalogue tables, raw and staging JSON, manifests, lists, exports and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scalars import nonblank
from lectern.operators.upsert import numbered
from lectern.schemas import MANIFEST_ITEM, TABLE_NAMES, table_schema


def read_catalog(spark: SparkSession, folder: str, kind: str = "parquet", names: tuple[str, ...] = TABLE_NAMES) -> dict[str, DataFrame]:
    """The catalogue tables with their fixed schemas, from ``folder/name`` in Parquet, JSON or ORC."""
    return {n: spark.read.schema(table_schema(n)).format(kind).load(f"{folder}/{n}") for n in names}


def read_catalog_jdbc(spark: SparkSession, url: str, driver: str, names: tuple[str, ...] = TABLE_NAMES) -> dict[str, DataFrame]:
    """The same over JDBC, where the driver's jar is on the class path; columns take the fixed types."""
    out = {}
    for n in names:
        rows = spark.read.format("jdbc").options(url=url, dbtable=n, driver=driver).load()
        out[n] = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table_schema(n)])
    return out


def parse_json_columns(df: DataFrame, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """JSON text columns to typed values: {column: (DDL, default)}; null, empty and bad texts give the default."""
    return df.withColumns({c: F.coalesce(F.from_json(nonblank(F.col(c)), ddl), default.cast(ddl)) for c, (ddl, default) in columns.items()})


def read_raw_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """``folder/{id}/{source}.json`` -> (item_id, source, payload, valid); unreadable files stay as rows with valid false."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return raw_snapshots(rows.select(F.col("_metadata.file_path").alias("path"), "value"))


def raw_snapshots(files: DataFrame) -> DataFrame:
    """(path, value) of files as ``read_raw_snapshots`` gives them."""
    return files.select(
        F.regexp_extract("path", r"/([^/]+)/[^/]+\.json$", 1).alias("item_id"), F.regexp_extract("path", r"/([^/]+)\.json$", 1).alias("source"), F.col("value").alias("payload")
    ).withColumn("valid", F.coalesce(F.try_parse_json("payload").isNotNull() & (F.trim("payload") != ""), F.lit(False)))


def read_staging(spark: SparkSession, folder: str, id_key: str = "id") -> DataFrame:
    """``folder/{id}.json`` -> (id, payload) of the files whose inner id is the file's."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return staged_items(rows.select(F.col("_metadata.file_path").alias("path"), "value"), id_key)


def staged_items(files: DataFrame, id_key: str = "id") -> DataFrame:
    """(path, value) of files as ``read_staging`` gives them."""
    out = files.select(F.regexp_extract("path", r"/([^/]+)\.json$", 1).alias("id"), F.col("value").alias("payload"))
    return out.where(F.get_json_object("payload", f"$.{id_key}") == F.col("id"))


def manifest_items(manifests: DataFrame, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(run, payload) manifests -> one row per item with a 1-based position; a manifest without items raises."""
    parsed = manifests.select("run", F.from_json("payload", f"struct<items: array<struct<{MANIFEST_ITEM}>>>").alias("m"))
    checked = F.when(F.coalesce(F.size("m.items"), F.lit(0)) <= 0, F.raise_error(F.concat(F.lit("manifest without items: "), "run"))).otherwise(F.col("m.items"))
    out = parsed.select("run", F.posexplode(checked).alias("pos", "item")).select("run", (F.col("pos") + 1).alias("position"), "item.*")
    if only is not None:
        out = out.where(F.col("bookId").isin(only))
    return out.where(F.col("position") <= limit) if limit is not None else out


def read_manifest(spark: SparkSession, path: str, **options) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.col("value").alias("payload"))
    return manifest_items(rows, **options)


def title_list(lines: DataFrame) -> DataFrame:
    """(file, pos, value) lines -> titles: blank lines and those that begin with ``#`` skipped."""
    return lines.select("file", "pos", nonblank(F.col("value")).alias("title")).where(F.col("title").isNotNull() & ~F.col("title").startswith("#"))


def read_title_list(spark: SparkSession, path: str) -> DataFrame:
    """Titles of ``.txt`` files (one per line) and ``.json`` files (a list, or an object with ``titles``)."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    as_list, as_object = F.from_json("value", "array<string>"), F.from_json("value", "struct<titles: array<string>>")["titles"]
    parts = F.when(F.col("file").endswith(".json"), F.coalesce(as_list, as_object)).otherwise(F.split("value", r"\r?\n"))
    return title_list(rows.select("file", F.posexplode(parts).alias("pos", "value")))


def read_labelled_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of a TSV file without header."""
    return spark.read.schema("label int, text string").csv(path, sep="\t", header=False, quote="")


def write_entries(entries: DataFrame, folder: str) -> None:
    """Entries as JSON lines laid out by module and submodule."""
    entries.write.mode("overwrite").partitionBy("module", "submodule").json(f"{folder}/entries")


def write_indexes(index: DataFrame, folder: str) -> None:
    """The list index by module and submodule, and the search index over all."""
    index.write.mode("overwrite").partitionBy("module", "submodule").json(f"{folder}/lists")
    index.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(f"{folder}/search")


def export_csv(works: DataFrame, folder: str, columns: list[str]) -> None:
    """Completed rows with the columns chosen, by id, UTF-8 with a byte order mark before the header."""
    rows = export_rows(works, columns)
    rows.toDF("﻿" + columns[0], *columns[1:]).write.mode("overwrite").csv(folder, header=True)


def export_rows(works: DataFrame, columns: list[str]) -> DataFrame:
    return works.where(F.col("status") == "published").orderBy("id").select(*columns)


def export_ratings(works: DataFrame, column: str = "scores") -> DataFrame:
    """(id, douban, imdb, tmdb, rotten_tomatoes, metacritic, avg) from a ratings JSON text."""
    s = F.from_json(column, "avg double, douban double, imdb double, tmdb double, rottenTomatoes double, metacritic double")
    return works.select("id", *[s[k].alias(n) for k, n in (("douban", "douban"), ("imdb", "imdb"), ("tmdb", "tmdb"), ("rottenTomatoes", "rotten_tomatoes"), ("metacritic", "metacritic"), ("avg", "avg"))])


def snapshot_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Copy every table out before a change."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def restore_tables(spark: SparkSession, folder: str, expected: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Read a snapshot back; a row count that differs from the expected table's raises."""
    out = {name: spark.read.parquet(f"{folder}/{name}") for name in expected}
    for name, df in expected.items():
        if (a := out[name].count()) != (b := df.count()):
            raise ValueError(f"{name}: {a} rows in the snapshot, {b} expected")
    return out


def read_transliterations(spark: SparkSession, path: str) -> DataFrame:
    """(place, latin, local) from files that are one JSON object {latin: local} each, or lines ``latin,local`` (comma or tab; # begins a note), in their order.

    Files come one after another by name; blank entries are left out.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    pairs = F.from_json("text", "map<string,string>", {"allowComments": "true"})
    rows = F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].alias("latin"), e["value"].alias("local")))
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: ~F.trim(x).startswith("#") & x.rlike("[,\\t]"))
    cells = F.transform(lines, lambda x: F.struct(F.split(x, "[,\\t]", 2)[0].alias("latin"), F.split(x, "[,\\t]", 2)[1].alias("local")))
    entries = F.when(F.ltrim("text").startswith("{"), rows).otherwise(cells)
    each = whole.select("file", F.posexplode(entries).alias("line", "e")).select("file", "line", F.lower(F.trim("e.latin")).alias("latin"), F.trim("e.local").alias("local"))
    each = each.where((F.col("latin") != "") & (F.col("local") != ""))
    return numbered(each, F.col("file"), F.col("line")).select((F.col("n") - 1).cast("long").alias("place"), "latin", "local")
