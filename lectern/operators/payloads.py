"""Landed JSON payloads to source records and current columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import nonblank, year_from_text


def payload_field(payload: Column, field: str) -> Column:
    """A field of a payload that is nested under ``detail`` or flat; the nested one counts first."""
    return F.coalesce(nonblank(F.get_json_object(payload, f"$.detail.{field}")), nonblank(F.get_json_object(payload, f"$.{field}")))


def normalize_source_payload(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select("id", "source", *[payload_field(F.col("payload"), f).alias(f) for f in fields])


def text_or_value(c: Column) -> Column:
    """A JSON text that is a plain string, an object with ``value``, or a list, whose first item counts."""
    return nonblank(
        F.when(c.startswith("{"), F.get_json_object(c, "$.value")).when(c.startswith("["), F.get_json_object(c, "$[0]")).otherwise(c)
    )


def project_api_payload(rows: DataFrame, scale: float = 2.0) -> DataFrame:
    """(id, payload) -> (id, title, description, rating, roles): first of lists, value of objects, ratings on the target scale, distinct roles joined."""
    p = F.col("payload")
    roles = F.array_distinct(F.transform(F.coalesce(F.from_json(F.get_json_object(p, "$.roles"), "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)))
    return rows.select(
        "id",
        text_or_value(F.get_json_object(p, "$.title")).alias("title"),
        text_or_value(F.get_json_object(p, "$.description")).alias("description"),
        (F.get_json_object(p, "$.rating").try_cast("double") * scale).alias("rating"),
        F.nullif(F.array_join(F.filter(roles, lambda x: x != ""), " / "), F.lit("")).alias("roles"),
    )


def first_videos(rows: DataFrame) -> DataFrame:
    """(id, lang_rank, pos, site, key) -> videos of one site, one per key: the first by language, then position."""
    return rows.where(F.lower("site") == "youtube").groupBy("id", "key").agg(F.min(F.struct("lang_rank", "pos")).alias("f")).select("id", "key", "f.lang_rank", "f.pos")


def legacy_projection(rows: DataFrame) -> DataFrame:
    """(id, payload) of an old record -> quotes as texts joined by '|', scores, and sources built from ids and links."""
    p = F.col("payload")
    objects = F.from_json(F.get_json_object(p, "$.quotes"), "array<struct<text: string>>")
    texts = F.from_json(F.get_json_object(p, "$.quotes"), "array<string>")
    quotes = F.coalesce(F.when(F.exists(objects, lambda q: q["text"].isNotNull()), F.transform(objects, lambda q: q["text"])), texts)
    ids = [F.when(nonblank(F.get_json_object(p, f"$.{k}Id")).isNotNull(), F.concat(F.lit(f"{k}:"), F.get_json_object(p, f"$.{k}Id"))) for k in ("douban", "imdb")]
    return rows.select(
        "id", F.array_join(F.array_compact(quotes), "|").alias("quotes"), F.get_json_object(p, "$.ratings.douban").try_cast("double").alias("douban"), F.array_join(F.array_compact(F.array(*ids)), "|").alias("sources")
    )


def migrate_categories(rows: DataFrame) -> DataFrame:
    """Old (id, kind, label) -> (id, group, name): genre becomes type, all else tag."""
    return rows.select("id", F.when(F.col("kind") == "genre", "type").otherwise("tag").alias("group"), F.trim("label").alias("name"), F.lit(None).cast("string").alias("note"))


def normalize_credit_person(p: Column) -> Column:
    """(name, role): trimmed, blank to null, ``name`` falling back to the Latin one."""
    return F.struct(F.coalesce(nonblank(p["name"]), nonblank(p["name_en"])).alias("name"), nonblank(p["role"]).alias("role"))


def normalize_related(r: Column) -> Column:
    """(title, year, rating): year from a date text, rating as number, blank titles null."""
    return F.struct(nonblank(r["title"]).alias("title"), year_from_text(r["date"]).alias("year"), r["rating"].try_cast("double").alias("rating"))


def normalize_character(c: Column) -> Column:
    return F.struct(nonblank(c["name"]).alias("name"), nonblank(c["actor"]).alias("actor"))
