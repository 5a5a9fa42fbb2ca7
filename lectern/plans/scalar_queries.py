"""One query per scalar rule, and those of the readers that a table can be written for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.functions import scalars as S
from lectern.operators import merge as G
from lectern.operators import payloads as L
from lectern.plans.catalog_queries import CUT, ZH
from lectern.plans.registry import query
from lectern.plans.text_queries import _folder
from lectern.sources import io as IO


def _text(t, **cols):
    return t.texts.select("id", *[c.alias(n) for n, c in cols.items()])


@query("SELECT id, coalesce(regexp_matches(txt, '[\\x{4e00}-\\x{9fff}]'), false) AS x FROM texts")
def has_cjk(t):
    return _text(t, x=S.has_cjk(F.col("txt")))


@query("SELECT id, coalesce(regexp_full_match(txt, '[\\x{4e00}-\\x{9fa5}]+'), false) AS x FROM texts")
def is_chinese(t):
    return _text(t, x=S.is_chinese(F.col("txt")))


@query(f"SELECT id, coalesce({ZH}, false) AS x FROM texts")
def is_chinese_text(t):
    return _text(t, x=S.is_chinese_text(F.col("txt")))


@query(f"SELECT id, coalesce({CUT}, false) AS x FROM texts")
def has_truncation(t):
    return _text(t, x=S.has_truncation(F.col("txt")))


@query("SELECT id, nullif(regexp_extract(replace(txt, ',', ''), '(\\d+)', 1), '')::BIGINT AS x FROM texts")
def parse_int(t):
    return _text(t, x=S.parse_int(F.col("txt")))


@query("SELECT id, nullif(replace(regexp_extract(txt, '页码\\s*[：:\\s]*([0-9][0-9,]*)', 1), ',', ''), '')::BIGINT AS x FROM texts")
def labeled_int(t):
    return _text(t, x=S.labeled_int(F.col("txt"), "页码"))


@query("SELECT id, round(nullif(regexp_extract(replace(txt, ',', ''), '(\\d+(?:\\.\\d+)?)', 1), '')::DOUBLE * CASE WHEN contains(txt, '万') THEN 10000 WHEN contains(txt, '千') THEN 1000 ELSE 1 END)::BIGINT AS x FROM texts")
def cjk_number(t):
    return _text(t, x=S.cjk_number(F.col("txt")))


@query("SELECT id, nullif(regexp_extract(txt, '第\\s*(\\d+)\\s*[集话話回]', 1), '')::INTEGER AS x FROM texts")
def episode_number(t):
    return _text(t, x=S.episode_number(F.col("txt")))


@query("SELECT id, CASE country WHEN '中' THEN '中国' WHEN '香港' THEN '中国' WHEN '苏联' THEN '俄罗斯' ELSE country END AS x FROM names")
def normalize_country(t):
    return t.names.select("id", S.normalize_country(F.col("country")).alias("x"))


@query("SELECT num, lower(replace(studio, '#', '')) || replace(title, ' ', '') AS x FROM titles")
def normalize_title(t):
    return t.titles.select("num", S.normalize_title(F.concat("studio", F.lit("： "), "title")).alias("x"))


@query("SELECT num, lower(studio) AS x FROM titles")
def series_key(t):
    return t.titles.select("num", S.series_key(F.concat(F.lit("《"), "studio", F.lit("》 · "))).alias("x"))


@query("SELECT num, replace(title, ' ', '') AS x FROM titles")
def text_key(t):
    return t.titles.select("num", S.text_key(F.concat(F.lit(" \n"), "title")).alias("x"))


@query("SELECT num, year AS x FROM titles")
def first_publish_year(t):
    return t.titles.select("num", S.first_publish_year(F.lit("first, n.d."), F.concat(F.lit("in "), F.col("year").cast("string"))).alias("x"))


@query("SELECT num, runtime AS x FROM titles")
def runtime_minutes(t):
    return t.titles.select("num", S.runtime_minutes(F.concat(F.lit("about "), F.col("runtime").cast("string"), F.lit(" min"))).alias("x"))


@query("SELECT num, CASE WHEN num % 3 > 0 THEN studio END AS x FROM titles")
def clean_value(t):
    return t.titles.select("num", S.clean_value(F.when(F.col("num") % 3 == 0, "N/A").otherwise(F.concat("studio", F.lit(" ")))).alias("x"))


@query("SELECT num, CASE num % 4 WHEN 0 THEN '好书 ' || title WHEN 2 THEN '目录 好书 ' || title WHEN 3 THEN '第二 ' || title END AS x FROM titles")
def clean_store_summary(t):
    """Marks in an order that differs from the list's, a stop mark at the beginning, a second text."""
    n = F.col("num") % 4
    shop = F.concat(F.lit("x 编辑推荐：别的 内容简介"), F.when(n == 0, "：好书  ").when(n == 2, "目录 好书  ").otherwise("：only Latin "), "title", F.lit("\n作者简介 y"))
    return t.titles.select("num", S.clean_store_summary(shop, F.when(n == 3, F.concat(F.lit("重磅推荐 第二\r"), "title"))).alias("x"))


@query("SELECT num, num % 2 = 0 AS x FROM titles")
def is_reversed_name(t):
    other = F.when(F.col("num") % 2 == 0, F.concat("title", F.lit(""))).otherwise("a b")
    return t.titles.select("num", S.is_reversed_name(F.concat(F.element_at(F.split("title", " "), 2), F.lit(" "), F.element_at(F.split("title", " "), 1)), other).alias("x"))


@query("SELECT num, num % 3 = 1 AS x FROM titles")
def transliteration_match(t):
    return t.titles.select("num", N.transliteration_match(F.when(F.col("num") % 3 == 1, "布鲁斯·").otherwise("大卫"), F.lit("布鲁斯")).alias("x"))


@query("SELECT num, num % 4 = 0 AS x FROM titles")
def is_placeholder_cover(t):
    return t.titles.select("num", S.is_placeholder_cover(F.when(F.col("num") % 4 == 0, "http://h/no-cover.png").otherwise(F.col("title"))).alias("x"))


@query("SELECT id, md5(text) AS x FROM reviews")
def content_hash(t):
    return t.reviews.select("id", S.content_hash(F.col("text")).alias("x"))


@query("SELECT id, CASE WHEN trim(poster) <> '' THEN '/assets/' || concat_ws('/', module, submodule, id, poster) ELSE '/assets/poster-placeholder.svg' END AS poster, CASE WHEN num % 3 = 0 THEN '' ELSE '/assets/' || concat_ws('/', module, submodule, id, 'a.jpg') || ' /assets/' || concat_ws('/', module, submodule, id, title) END AS stills, CASE WHEN num % 5 = 0 THEN '' ELSE 'shop=/assets/book/' || id || '/' || title || '.png' END AS covers FROM works")
def asset_urls(t):
    n, place = F.col("num"), [F.col(c) for c in ("module", "submodule", "id")]
    stills = S.asset_urls(F.when(n % 3 > 0, F.array(F.lit("a.jpg"), F.col("title"))), *place)
    covers = S.cover_gallery(F.when(n % 5 > 0, F.create_map(F.lit("shop"), F.concat("title", F.lit(".png")))), F.col("id"))
    return t.works.select(
        "id", S.poster_url(F.col("poster"), *place).alias("poster"), F.array_join(stills, " ").alias("stills"), F.array_join(F.transform(covers, lambda x: F.concat(x["source"], F.lit("="), x["url"])), " ").alias("covers")
    )


@query("SELECT id, CASE WHEN num % 2 = 0 THEN studio ELSE title END AS x FROM titles")
def normalize_credit_person(t):
    p = L.normalize_credit_person(F.struct(F.when(F.col("num") % 2 == 0, " ").otherwise(F.col("title")).alias("name"), F.col("studio").alias("name_en"), F.lit("").alias("role")))
    return t.titles.select("id", p["name"].alias("x"))


@query("SELECT id, year AS x FROM titles")
def normalize_related(t):
    r = L.normalize_related(F.struct("title", F.concat(F.col("year").cast("string"), F.lit("-05")).alias("date"), F.lit("1").alias("rating")))
    return t.titles.select("id", r["year"].alias("x"))


@query("SELECT id, CASE WHEN num % 2 = 0 THEN studio END AS x FROM titles")
def normalize_character(t):
    c = L.normalize_character(F.struct(F.when(F.col("num") % 2 == 0, F.concat("studio", F.lit(" "))).alias("name"), F.lit("").alias("actor")))
    return t.titles.select("id", c["name"].alias("x"))


@query("""SELECT work_id, id, CASE WHEN o < 10 THEN 'cast' ELSE 'other' END AS slot, o AS "order" FROM (SELECT work_id, id, (row_number() OVER (PARTITION BY work_id ORDER BY "order", id) - 1)::INTEGER AS o FROM work_person WHERE department = 'cast')""")
def merge_cast(t):
    rows = t.work_person.where("department = 'cast'").select("work_id", F.col("order").alias("pos"), F.col("id").alias("name"))
    out = G.cast_slices(rows)
    return out.select("work_id", F.col("name").alias("id"), F.when(F.col("is_primary"), "cast").otherwise("other").alias("slot"), "order")


@query("SELECT id, title, year FROM titles")
def read_catalog(t):
    folder = _folder(t)
    t.titles.select("id", "title", "year").write.json(f"{folder}/works")
    return IO.read_catalog(t.spark, folder, "json", ("works",))["works"].select("id", "title", "year")


@query("SELECT (num % 2)::INTEGER AS label, title || ' ' || num AS text FROM titles")
def read_labelled_reviews(t):
    folder = _folder(t)
    t.titles.select(F.concat((F.col("num") % 2).cast("string"), F.lit("\t"), "title", F.lit(" "), F.col("num").cast("string"))).write.text(folder)
    return IO.read_labelled_reviews(t.spark, folder)


@query("SELECT id, title FROM titles")
def restore_tables(t):
    folder, table = _folder(t), {"titles": t.titles.select("id", "title")}
    IO.snapshot_tables(table, folder)
    return IO.restore_tables(t.spark, folder, table)["titles"]
