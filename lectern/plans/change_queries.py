"""Queries of catalogue change, validation, reports and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.functions import scalars as S
from lectern.operators import importing as I
from lectern.operators import matching as M
from lectern.operators import reports as R
from lectern.operators import upsert as U
from lectern.operators import validate as V
from lectern.plans.catalog_queries import CUT, REFS, SIDES, ZH, sides
from lectern.plans.registry import query
from lectern.sources.scratch import scratch_folder
from lectern.sources.versions import VersionedTables


@query("SELECT num AS position, prefix || format('{:06d}', (top + row_number() OVER (PARTITION BY prefix ORDER BY num))) AS id FROM (SELECT num, CASE WHEN num % 2 = 0 THEN '0101' ELSE '0201' END AS prefix FROM titles) n JOIN (SELECT substr(id, 1, 4) AS p, max(substr(id, 5, 6)::BIGINT) AS top FROM (SELECT id FROM works UNION ALL SELECT id FROM titles) GROUP BY 1) ON p = prefix")
def allocate_ids(t):
    new = t.titles.select(F.when(F.col("num") % 2 == 0, "0101").otherwise("0201").alias("prefix"), F.col("num").alias("position"))
    return U.allocate_ids(new, t.works.select("id").unionByName(t.titles.select("id"))).select("position", "id")


@query("SELECT 'p' || format('{:06d}', (coalesce(max(try_cast(substr(person_id, 2) AS BIGINT)), 0) + 1)) AS next_id FROM person")
def next_person_id(t):
    return U.next_person_id(t.person)


@query("SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title || '+' ELSE o.title END AS title, coalesce(n.year, o.year) AS year, coalesce(o.status, n.status) AS status FROM new_w n FULL JOIN old_w o ON n.id = o.id", SIDES)
def upsert_works(t):
    new, old = sides(t)
    wide = lambda w: w.select("id", "title", "year", "status", "updated_at", F.lit(None).cast("string").alias("country"), F.col("updated_at").alias("created_at"))
    return U.upsert_works(wide(old), wide(new).withColumn("title", F.concat("title", F.lit("+")))).select("id", "title", "year", "status")


@query(
    """SELECT coalesce(n.id, o.id) AS id, coalesce(nullif(n.title, ' '), o.title) AS title, coalesce(n.isbn, o.isbn) AS isbn, coalesce(nullif(n.scores, '[]'), o.scores) AS scores FROM old_b o FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY u DESC, title DESC) AS r FROM (
      SELECT coalesce(i.id, n.id) AS id, n.title, n.isbn, n.scores, n.u FROM new_b n LEFT JOIN (SELECT isbn, min(id) AS id FROM old_b WHERE isbn IS NOT NULL GROUP BY isbn) i ON i.isbn = n.isbn)) WHERE r = 1) n ON n.id = o.id""",
    """old_b AS (SELECT id, title, isbn, '{1}' AS scores FROM titles WHERE num % 2 = 0), new_b AS (SELECT '9' || substr(id, 2) AS id, CASE WHEN num % 4 = 0 THEN ' ' ELSE title || num END AS title, isbn, CASE WHEN num % 3 = 0 THEN '[]' ELSE '{2}' END AS scores, lpad(num::VARCHAR, 9, '0') AS u FROM titles WHERE num % 3 < 2)""",
)
def upsert_books(t):
    n, nul = F.col("num"), F.lit(None).cast("string")
    old = t.titles.where("num % 2 = 0").select("id", "title", "isbn", F.lit("{1}").alias("scores"), F.lit("x").alias("status"), F.lit("").alias("updated_at"), nul.alias("publisher"))
    new = t.titles.where("num % 3 < 2").select(
        F.concat(F.lit("9"), F.substring("id", 2, 20)).alias("id"), F.when(n % 4 == 0, " ").otherwise(F.concat("title", n.cast("string"))).alias("title"), "isbn", F.when(n % 3 == 0, "[]").otherwise("{2}").alias("scores"),
        F.lit("y").alias("status"), F.lpad(n.cast("string"), 9, "0").alias("updated_at"), nul.alias("publisher"),
    )
    return U.upsert_books(old, new).select("id", "title", "isbn", "scores")


IDENT = """ident AS (SELECT DISTINCT 'Name ' || (l_suppkey % 97) AS name, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') END AS name_en FROM lineitem),
known AS (SELECT name, name_en, min(id) AS known_id FROM person GROUP BY name, name_en),
people AS (SELECT i.*, known_id FROM ident i LEFT JOIN known k ON i.name = k.name AND i.name_en IS NOT DISTINCT FROM k.name_en),
ided AS (SELECT name, name_en, coalesce(known_id, (SELECT max(id) FROM person) + row_number() OVER (PARTITION BY known_id IS NULL ORDER BY name, name_en NULLS FIRST)) AS id, known_id IS NULL AS is_new FROM people)"""


def _credit_people(t):
    k = F.col("l_suppkey")
    return t.lineitem.select(
        F.concat(F.lit("Name "), (k % 97).cast("string")).alias("name"), F.when(k % 4 == 0, None).otherwise(F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))).alias("name_en"),
        F.lit(None).cast("string").alias("avatar"), F.col("l_orderkey").alias("pos"),
    )


@query("SELECT name, name_en, id, is_new FROM ided", IDENT)
def upsert_persons(t):
    return U.upsert_persons(_credit_people(t), t.person).select("name", "name_en", "id", "is_new")


@query("SELECT id, 'avatars/' || id || '.png' AS path, CASE WHEN num % 3 = 0 THEN 'avatars/' || id || '-tmdb.png' END AS western, CASE WHEN num % 3 = 1 THEN 'avatars/' || id || '-douban.png' END AS local FROM titles")
def avatar_paths(t):
    url = F.concat(F.lit("http://"), F.when(F.col("num") % 3 == 0, "tmdb").when(F.col("num") % 3 == 1, "douban").otherwise("x"), F.lit("/a.PNG?x=1"))
    path, western, local = U.avatar_paths(url, F.col("id"))
    return t.titles.select("id", path.alias("path"), western.alias("western"), local.alias("local"))


WANTED = """wanted AS (SELECT DISTINCT 'type' AS "group", CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || '2' END AS name, 'video' AS module, NULL::VARCHAR AS submodule FROM part UNION SELECT DISTINCT 'tag', p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'book' END, NULL FROM part),
fresh AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM category c WHERE c."group" = w."group" AND c.name = w.name AND c.module IS NOT DISTINCT FROM w.module AND c.submodule IS NOT DISTINCT FROM w.submodule))"""


def _wanted(t):
    even, none = F.col("p_partkey") % 2 == 0, F.lit(None).cast("string")
    types = t.part.select(F.lit("type").alias("group"), F.when(even, F.col("p_type")).otherwise(F.concat("p_type", F.lit("2"))).alias("name"), F.lit("video").alias("module"), none.alias("submodule"))
    return types.unionByName(t.part.select(F.lit("tag").alias("group"), F.col("p_brand").alias("name"), F.when(even, "book").alias("module"), none.alias("submodule")))


@query("SELECT * FROM fresh", WANTED)
def upsert_categories(t):
    return U.upsert_categories(_wanted(t), t.category)


IMPORT = """ow AS (SELECT * FROM works WHERE num % 10 < 8), bw AS (SELECT * FROM works WHERE num % 10 IN (7, 8)),
nw AS (SELECT coalesce(b.id, o.id) AS id, CASE WHEN b.id IS NULL THEN o.title ELSE b.title || '+' END AS title, coalesce(b.year, o.year) AS year FROM ow o FULL JOIN bw b ON b.id = o.id),
bc AS (SELECT w.id AS work_id, 'Name ' || (l_suppkey % 97) AS name, CASE WHEN l_suppkey % 4 > 0 THEN 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') END AS name_en,
  CASE l_returnflag WHEN 'A' THEN 'direction' WHEN 'R' THEN 'other' ELSE 'cast' END AS department, l_linenumber AS pos FROM lineitem JOIN bw w ON w.num = l_orderkey),
ident AS (SELECT DISTINCT name, name_en FROM bc),
tops AS (SELECT max(id) AS top, coalesce(max(try_cast(substr(person_id, 2) AS BIGINT)), 0) AS code FROM person),
known AS (SELECT name, name_en, min(id) AS known_id FROM person GROUP BY name, name_en),
people AS (SELECT i.*, known_id FROM ident i LEFT JOIN known k ON i.name = k.name AND i.name_en IS NOT DISTINCT FROM k.name_en),
ided AS (SELECT name, name_en, coalesce(known_id, top + row_number() OVER (PARTITION BY known_id IS NULL ORDER BY name, name_en NULLS FIRST)) AS id, known_id IS NULL AS is_new FROM people, tops),
np AS (SELECT id, name, name_en, person_id FROM person UNION ALL SELECT id, name, name_en, 'p' || format('{:06d}', code + id - top) FROM ided, tops WHERE is_new),
wp AS (SELECT work_id, person_id, department, "order", is_primary FROM work_person WHERE work_id IN (SELECT id FROM ow) AND work_id NOT IN (SELECT id FROM bw) UNION ALL
  SELECT work_id, id, department, o, department <> 'cast' OR o < 10 FROM (SELECT bc.*, i.id, row_number() OVER (PARTITION BY work_id ORDER BY CASE department WHEN 'direction' THEN 1 WHEN 'cast' THEN 4 ELSE 6 END, pos, i.id) - 1 AS o
    FROM bc JOIN ided i ON i.name = bc.name AND i.name_en IS NOT DISTINCT FROM bc.name_en)),
bcat AS (SELECT w.id AS work_id, 'type' AS g, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || '2' END AS name, 'video' AS m, 0 AS r, l_linenumber AS pos FROM lineitem JOIN part ON p_partkey = l_partkey JOIN bw w ON w.num = l_orderkey UNION ALL
  SELECT w.id, 'tag', p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'book' END, 1, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey JOIN bw w ON w.num = l_orderkey WHERE l_linenumber > 2),
ncat AS (SELECT id, "group" AS g, name, module AS m FROM category UNION ALL
  SELECT DISTINCT concat(g, ':', name, ':', coalesce(m, ''), ':'), g, name, m FROM bcat b WHERE NOT EXISTS (SELECT 1 FROM category c WHERE c."group" = g AND c.name = b.name AND c.module IS NOT DISTINCT FROM m)),
wc AS (SELECT work_id, category_id, "order" FROM work_category WHERE work_id IN (SELECT id FROM ow) AND work_id NOT IN (SELECT id FROM bw) UNION ALL
  SELECT work_id, id, row_number() OVER (PARTITION BY work_id ORDER BY p, id) - 1 FROM (SELECT work_id, n.id, min({'r': r, 'pos': pos}) AS p FROM bcat b JOIN ncat n ON n.g = b.g AND n.name = b.name AND n.m IS NOT DISTINCT FROM b.m GROUP BY ALL))"""


def _catalogue(t, links_of_all_works: bool) -> dict:
    none = F.lit(None).cast("string")
    works = t.works.where("num % 10 < 8")
    held = lambda df: df if links_of_all_works else df.join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi")
    return {
        "works": works.select("id", "title", "year", none.alias("country"), "status", F.col("updated_at").alias("created_at"), "updated_at"),
        "person": t.person.select("id", "name", "name_en", none.alias("avatar"), "person_id"),
        "work_person": held(t.work_person.select("work_id", "person_id", "department", F.col("order").cast("int").alias("order"), "is_primary", "character")),
        "category": t.category.select("id", "group", "name", "module", "submodule"), "work_category": held(t.work_category.withColumn("order", F.col("order").cast("int"))),
    }


def _batch(t) -> dict:
    none, k = F.lit(None).cast("string"), F.col("l_suppkey")
    works = t.works.where("num % 10 in (7, 8)")
    rows = t.lineitem.join(works.select("num", F.col("id").alias("work_id")), F.col("num") == F.col("l_orderkey"))
    credits = rows.select(
        "work_id", F.concat(F.lit("Name "), (k % 97).cast("string")).alias("name"), F.when(k % 4 > 0, F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))).alias("name_en"), none.alias("avatar"),
        F.when(F.col("l_returnflag") == "A", "direction").when(F.col("l_returnflag") == "R", "other").otherwise("cast").alias("department"), F.col("l_linenumber").alias("pos"),
        F.lit(None).cast("boolean").alias("is_primary"), none.alias("character"),
    )
    parts, even = rows.join(t.part, F.col("p_partkey") == F.col("l_partkey")), F.col("p_partkey") % 2 == 0
    kind = lambda df, group, name, module, rank: df.select("work_id", F.lit(group).alias("group"), name.alias("name"), module.alias("module"), none.alias("submodule"), F.lit(rank).alias("group_rank"), F.col("l_linenumber").alias("pos"))
    types = kind(parts, "type", F.when(even, F.col("p_type")).otherwise(F.concat("p_type", F.lit("2"))), F.lit("video"), 0)
    tags = kind(parts.where("l_linenumber > 2"), "tag", F.col("p_brand"), F.when(even, "book"), 1)
    new = works.select("id", F.concat("title", F.lit("+")).alias("title"), "year", none.alias("country"), "status", F.col("updated_at").alias("created_at"), "updated_at")
    return {"works": new, "credits": credits, "categories": types.unionByName(tags)}


@query(
    """SELECT 'works' AS relation, id AS key, title || '/' || coalesce(year::VARCHAR, '') AS value FROM nw UNION ALL SELECT 'person', id::VARCHAR, name || '/' || coalesce(name_en, '') || '/' || coalesce(person_id, '') FROM np UNION ALL
    SELECT 'work_person', work_id || '/' || "order", person_id || '/' || department || '/' || is_primary::VARCHAR FROM wp UNION ALL SELECT 'category', id, g || '/' || name || '/' || coalesce(m, '') FROM ncat UNION ALL
    SELECT 'work_category', work_id || '/' || "order", category_id FROM wc""",
    IMPORT,
)
def import_batch(t):
    store = VersionedTables(t.spark, scratch_folder(t.spark, "catalogue"))
    I.begin_catalog(store, _catalogue(t, False))
    for _ in range(2):  # replayed, it changes nothing
        I.import_batch(store, _batch(t), "batches", 0)
    new, text = store.tables(), lambda *c: F.concat_ws("/", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    rows = [
        ("works", text("id"), text("title", "year")), ("person", text("id"), text("name", "name_en", "person_id")), ("work_person", text("work_id", "order"), text("person_id", "department", "is_primary")),
        ("category", text("id"), text("group", "name", "module")), ("work_category", text("work_id", "order"), text("category_id")),
    ]
    parts = [new[name].select(F.lit(name).alias("relation"), key.alias("key"), value.alias("value")) for name, key, value in rows]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


@query(
    """SELECT 'works' AS relation, (SELECT count(*) FROM ow) AS n_before, (SELECT count(*) FROM nw) AS n_after UNION ALL SELECT 'person', (SELECT count(*) FROM person), (SELECT count(*) FROM np) UNION ALL
    SELECT 'work_person', (SELECT count(*) FROM work_person), (SELECT count(*) FROM work_person WHERE work_id NOT IN (SELECT id FROM bw)) + (SELECT count(*) FROM bc) UNION ALL
    SELECT 'category', (SELECT count(*) FROM category), (SELECT count(*) FROM ncat) UNION ALL
    SELECT 'work_category', (SELECT count(*) FROM work_category), (SELECT count(*) FROM work_category WHERE work_id NOT IN (SELECT id FROM bw)) + (SELECT count(*) FROM wc WHERE work_id IN (SELECT id FROM bw)) UNION ALL
    SELECT * FROM (SELECT 'work_person.work_id', NULL, count(DISTINCT work_id) AS n FROM work_person WHERE work_id NOT IN (SELECT id FROM nw) UNION ALL SELECT 'work_category.work_id', NULL, count(DISTINCT work_id) FROM work_category WHERE work_id NOT IN (SELECT id FROM nw)) WHERE n > 0""",
    IMPORT,
)
def dry_run_import(t):
    return I.dry_run_import(_catalogue(t, True), _batch(t))


@query(
    """SELECT work_id, category_id, "order" FROM work_category WHERE work_id NOT IN (SELECT work_id FROM newl) UNION ALL
    SELECT work_id, category_id, (row_number() OVER (PARTITION BY work_id ORDER BY p, category_id) - 1)::INTEGER FROM (SELECT work_id, category_id, min({'g': g, 'o': "order"}) AS p FROM newl GROUP BY work_id, category_id)""",
    """newl AS (SELECT work_id, category_id, CASE WHEN starts_with(category_id, 'type') THEN 1 ELSE 0 END AS g, "order" FROM work_category WHERE right(work_id, 1) IN ('1', '2'))""",
)
def rebuild_relations(t):
    new = t.work_category.where(F.right("work_id", F.lit(1)).isin("1", "2")).select("work_id", "category_id", F.col("category_id").startswith("type").cast("int").alias("group_rank"), F.col("order").alias("pos"))
    return U.rebuild_relations(t.work_category, new)


@query(
    """SELECT b.id AS book_id, b.s AS name, coalesce(o.id, f.id) AS series_id, row_number() OVER (PARTITION BY b.s ORDER BY b.id) AS series_order FROM (SELECT id, 'S' || (num % 60) AS s FROM titles) b LEFT JOIN olds o ON o.name = b.s
    LEFT JOIN (SELECT name, '0299' || format('{:06d}', ((SELECT max(substr(id, 5)::BIGINT) FROM olds) + row_number() OVER (ORDER BY name))) AS id FROM (SELECT DISTINCT 'S' || (num % 60) AS name FROM titles) WHERE name NOT IN (SELECT name FROM olds)) f ON f.name = b.s""",
    "olds AS (SELECT '0299' || lpad(n_nationkey::VARCHAR, 6, '0') AS id, 'S' || n_nationkey AS name FROM nation)",
)
def upsert_series(t):
    k = F.col("n_nationkey").cast("string")
    olds = t.nation.select(F.concat(F.lit("0299"), F.lpad(k, 6, "0")).alias("id"), F.concat(F.lit("S"), k).alias("name"))
    out = U.upsert_series(t.titles.select("id", F.concat(F.lit("S"), (F.col("num") % 60).cast("string")).alias("series_name")), olds)
    return out.withColumn("series_order", F.col("series_order").cast("long"))


@query('SELECT work_id, max("order") + 1 AS next_order FROM work_category GROUP BY work_id')
def append_order(t):
    return U.append_order(t.work_category)


@query("""SELECT w.id AS work_id, 'type:SMALL' AS category_id, coalesce(n, 0) AS "order" FROM works w LEFT JOIN (SELECT work_id, max("order") + 1 AS n FROM work_category GROUP BY 1) l ON l.work_id = w.id WHERE w.id NOT IN (SELECT work_id FROM work_category WHERE category_id = 'type:SMALL')""")
def tag_backfill(t):
    return U.tag_backfill(t.works, t.work_category, "type:SMALL")


PLAN = """plan AS (SELECT id AS old_id, p.prefix || format('{:06d}', (p.f + row_number() OVER (PARTITION BY kind ORDER BY id))) AS new_id, kind FROM (SELECT id, CASE num % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS kind FROM works) JOIN (VALUES ('a', '0101', 90), ('b', '0301', 0)) p(k, prefix, f) ON p.k = kind)"""


def _plan(t):
    works = t.works.select("id", F.when(F.col("num") % 5 == 0, "a").when(F.col("num") % 5 == 1, "b").alias("kind"))
    targets = t.spark.createDataFrame([("a", "0101", 90), ("b", "0301", 0)], "kind string, prefix string, first int")
    return U.reclassify_plan(works, targets)


@query("SELECT * FROM plan", PLAN)
def reclassify_plan(t):
    return _plan(t)


@query(
    """SELECT DISTINCT 'id_in_use' AS problem, new_id AS id FROM plan WHERE new_id IN (SELECT id FROM works) AND new_id NOT IN (SELECT old_id FROM plan) UNION ALL
    SELECT 'id_twice', new_id FROM plan GROUP BY new_id HAVING count(*) > 1 UNION ALL SELECT 'no_source', old_id FROM plan WHERE old_id NOT IN (SELECT id FROM works WHERE num % 10 > 0) AND false""",
    PLAN,
)
def reclassify_preflight(t):
    return U.reclassify_preflight(_plan(t), t.works)


@query('SELECT coalesce(p.new_id, w.work_id) AS work_id, category_id, "order" FROM work_category w LEFT JOIN plan p ON p.old_id = w.work_id', PLAN)
def reclassify_apply(t):
    return U.reclassify_apply(t.work_category, _plan(t), "work_id")


NESTED = """rel AS (SELECT person_id AS id, work_id AS rid, "order" AS o, coalesce(p.new_id, work_id) AS nid FROM (SELECT DISTINCT person_id, work_id, "order" FROM work_person) LEFT JOIN plan p ON p.old_id = work_id),
items AS (SELECT id, string_agg('{"title": "T ' || rid || '", "id" : "' || nid || '", "parts": [{"id":"' || nid || '","note":"see \\"id\\": \\"' || rid || '\\", {"}], "ids": ["' || rid || '"]}', ',' ORDER BY o, rid) AS x, bool_or(nid <> rid) AS any_new, min(rid) AS low FROM rel GROUP BY id)"""


@query(
    """SELECT id, CASE WHEN id % 7 = 0 THEN '[]' WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN 'cut {"id":"' || low || '"' ELSE '{"list":[' || x || '],"id":5}' END AS related,
    any_new AND id % 7 > 0 AND id % 11 > 0 AND id % 13 > 0 AS changed FROM items""",
    PLAN + ", " + NESTED,
)
def rewrite_related_ids(t):
    rid, q = F.col("work_id"), F.lit('"')
    item = F.concat(
        F.lit('{"title": "T '), rid, F.lit('", "id" : "'), rid, F.lit('", "parts": [{"id":"'), rid, F.lit('","note":"see \\"id\\": \\"'), rid, F.lit('\\", {"}], "ids": ["'), rid, F.lit('"]}')
    )
    one = t.work_person.select(F.col("person_id").alias("id"), "order", "work_id", item.alias("item")).distinct()
    g = one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("order", "work_id", "item"))).alias("x"), F.min("work_id").alias("low"))
    text = F.concat(F.lit('{"list":['), F.array_join(F.transform("x", lambda e: e["item"]), ","), F.lit('],"id":5}'))
    n = F.col("id")
    related = F.when(n % 7 == 0, "[]").when(n % 11 == 0, None).when(n % 13 == 0, F.concat(F.lit('cut {"id":"'), F.col("low"), q)).otherwise(text)
    return U.rewrite_related_ids(g.select("id", related.alias("related")), _plan(t))


@query("SELECT coalesce(p.new_id, w.id) AS id, title, CASE WHEN p.new_id IS NOT NULL THEN w.id END AS renamed_from FROM works w LEFT JOIN plan p ON p.old_id = w.id", PLAN)
def apply_id_renames(t):
    return U.apply_id_renames(t.works.select("id", "title"), _plan(t).select("old_id", "new_id"))


@query(
    """SELECT rank, source_id, coalesce(k.id, '0101' || format('{:06d}', ((SELECT max(substr(id, 5)::BIGINT) FROM works WHERE num % 2 = 0) + row_number() OVER (PARTITION BY k.id IS NULL ORDER BY rank)))) AS id, k.id IS NULL AS is_new
    FROM (SELECT p_partkey AS rank, 'db' || (p_partkey * 2) AS source_id FROM part) i LEFT JOIN (SELECT 'db' || num AS sid, min(id) AS id FROM works WHERE num % 2 = 0 AND num % 3 = 0 GROUP BY 1) k ON k.sid = i.source_id"""
)
def assign_existing_or_new_id(t):
    items = t.part.select(F.col("p_partkey").alias("rank"), F.concat(F.lit("db"), (F.col("p_partkey") * 2).cast("string")).alias("source_id"))
    known = t.works.where("num % 2 = 0").select("id", F.when(F.col("num") % 3 == 0, F.concat(F.lit("db"), F.col("num").cast("string"))).alias("source_id"))
    return U.assign_existing_or_new_id(items, known, "0101")


@query("SELECT run_id, position, ok AS applied FROM (SELECT *, coalesce(bool_or(NOT ok) OVER (PARTITION BY run_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS f FROM (SELECT user_id AS run_id, event_id AS position, value < 90 AS ok FROM events)) WHERE NOT f")
def apply_until_failure(t):
    return U.apply_until_failure(t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("position"), (F.col("value") < 90).alias("ok"))).select("run_id", "position", "applied")


@query("SELECT id, rank FROM (SELECT id, CASE WHEN num % 3 = 0 THEN NULL ELSE num % 700 END AS rank FROM titles) ORDER BY rank NULLS LAST, id LIMIT 250")
def ranked_slice(t):
    return U.ranked_slice(t.titles.select("id", F.when(F.col("num") % 3 != 0, F.col("num") % 700).alias("rank")))


# validation

INTEGRITY = """integrity AS (SELECT id, num, concat_ws(',', CASE WHEN num % 4 = 0 THEN 'douban_id' END, CASE WHEN num % 5 = 0 THEN 'imdb_id' END, CASE WHEN num % 6 = 0 THEN 'baike_url' END, CASE WHEN num % 6 > 0 AND num % 7 = 0 THEN 'baike_id' END) AS problems FROM titles)"""


def _ids(t):
    n = F.col("num").cast("string")
    m = lambda k: F.col("num") % k == 0
    return t.titles.select(
        "id", F.when(m(4), "x1").otherwise(n).alias("douban_id"), F.when(m(5), n).otherwise(F.concat(F.lit("tt"), n)).alias("imdb_id"), F.lit(None).cast("string").alias("tmdb_id"),
        F.when(m(6), "https://b/item/name").otherwise(F.concat(F.lit("https://b/item/name/"), n)).alias("baike_url"), F.when(m(7), "no").otherwise(n).alias("baike_id"),
    )


@query("SELECT id, problems FROM integrity", INTEGRITY)
def source_integrity(t):
    return V.source_integrity(_ids(t)).withColumn("problems", F.array_join("problems", ","))


PROFILES = [("movie", "1-URGENT", "video", "movie", True), ("tv", "2-HIGH", "video", "series", False), ("anime", "3-MEDIUM", "anime", None, False)]


@query("SELECT id, CASE schema_type WHEN '1-URGENT' THEN 'movie' WHEN '2-HIGH' THEN 'tv' WHEN '3-MEDIUM' THEN 'anime' ELSE CASE submodule WHEN 'series' THEN 'tv' ELSE 'movie' END END AS profile, CASE WHEN (schema_type = '1-URGENT' AND submodule = 'series') OR (schema_type = '2-HIGH' AND submodule = 'movie') OR schema_type = '3-MEDIUM' THEN 'profile_conflict' END AS error FROM works")
def resolve_profile(t):
    p = t.spark.createDataFrame(PROFILES, "profile string, schema_type string, module string, submodule string, is_default boolean")
    return V.resolve_profile(t.works, p)


REQUIRED = "req AS (SELECT id, CASE WHEN num % 2 = 0 THEN 'a' ELSE 'b' END AS profile, CASE WHEN num % 2 = 0 THEN concat_ws(',', CASE WHEN year IS NULL THEN 'year' END, CASE WHEN trim(coalesce(country, '')) = '' THEN 'country' END) ELSE concat_ws(',', CASE WHEN isbn IS NULL THEN 'isbn' END) END AS missing FROM titles)"


def _required(t):
    rows = t.titles.withColumn("profile", F.when(F.col("num") % 2 == 0, "a").otherwise("b"))
    return V.required_fields(rows, {"a": ["year", "country"], "b": ["isbn"]})


@query("SELECT * FROM req", REQUIRED)
def required_fields(t):
    return _required(t).withColumn("missing", F.array_join("missing", ","))


@query("SELECT c.id, concat_ws(',', CASE WHEN coalesce(n, 0) < episode_count THEN 'episodes' END, CASE WHEN coalesce(k, 0) = 0 THEN 'characters' END) AS missing FROM episode_counts c LEFT JOIN (SELECT work_id, count(DISTINCT episode) AS n FROM episodes WHERE trim(text) <> '' GROUP BY 1) e ON e.work_id = c.id LEFT JOIN (SELECT work_id, count(*) AS k FROM episodes WHERE source = 'plot' GROUP BY 1) p ON p.work_id = c.id")
def enhancement_fields(t):
    ch = t.episodes.select("work_id", F.when(F.col("source") == "plot", "c").alias("character"))
    return V.enhancement_fields(t.episode_counts, t.episodes, ch).withColumn("missing", F.array_join("missing", ","))


@query(
    """SELECT t.id, CASE WHEN p = '' THEN 'ok' ELSE 'failed' END AS status, p AS problems FROM (SELECT t.id, concat_ws(',', CASE WHEN num % 3 = 0 AND num % 8 <> 0 THEN 'nothing_to_update' END, CASE WHEN num % 3 > 0 AND num % 8 = 0 THEN 'exists' END, CASE WHEN num % 3 > 0 AND num % 9 = 1 THEN 'unexpected_id' END, CASE WHEN num % 10 = 0 THEN 'missing_assets' END,
    nullif(i.problems, ''), 'missing:' || replace(nullif(r.missing, ''), ',', ',missing:')) AS p FROM titles t JOIN (SELECT id, problems FROM integrity) i ON i.id = t.id JOIN req r ON r.id = t.id) t""",
    INTEGRITY + ", " + REQUIRED,
)
def precheck_media(t):
    m = lambda k, r=0: F.col("num") % k == r
    items = t.titles.select("id", m(3).alias("update"))
    matches = t.titles.where(m(8)).select(F.col("id").alias("new_id"), F.lit("o").alias("old_id"))
    expected = t.titles.select("id", F.when(m(9, 1), "other").otherwise(F.col("id")).alias("expected_id"))
    return V.precheck_media(items, matches, expected, t.titles.where(m(10)).select("id"), V.source_integrity(_ids(t)), _required(t))


SHAPE = """shape AS (SELECT id, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'no_meta,tags_not_a_list' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'no_meta' WHEN 4 THEN 'serialised_json,no_meta' ELSE 'not_an_object' END AS problems FROM payloads)"""


@query("SELECT id, problems FROM shape", SHAPE)
def staging_shape(t):
    return V.staging_shape(t.payloads).withColumn("problems", F.array_join("problems", ","))


def _content(t):
    kind = F.when(F.col("id") % 2 == 0, "web_novel").otherwise("book")
    ex = F.array("txt", F.concat(F.lit(" "), F.coalesce("txt", F.lit(""))), F.lit("z"))
    return V.content_quality(t.texts.select("id", F.col("txt").alias("summary"), F.col("txt").alias("story"), kind.alias("kind"), F.filter(ex, lambda x: x.isNotNull()).alias("excerpts")))


CONTENT = f"""content AS (SELECT id, concat_ws(',', CASE WHEN b THEN 'summary_missing' END, CASE WHEN NOT b AND NOT {ZH} THEN 'summary_not_chinese' END, CASE WHEN NOT b AND {CUT} THEN 'summary_truncated' END,
  CASE WHEN b AND id % 2 = 1 THEN 'story_missing' END, CASE WHEN NOT b AND NOT {ZH} THEN 'story_not_chinese' END, CASE WHEN NOT b AND {CUT} THEN 'story_truncated' END) AS problems,
  CASE WHEN b AND id % 2 = 0 THEN 'story_missing' ELSE '' END AS warnings, CASE WHEN txt IS NULL THEN 0 ELSE 1 END AS n_dup_excerpts FROM (SELECT *, trim(coalesce(txt, '')) = '' AS b FROM texts))"""


@query("SELECT * FROM content", CONTENT)
def content_quality(t):
    out = _content(t)
    return out.withColumns({c: F.array_join(c, ",") for c in ("problems", "warnings")})


@query("SELECT c.id, CASE WHEN p = '' THEN 'ok' ELSE 'failed' END AS status, p AS problems, c.warnings FROM (SELECT id, warnings, concat_ws(',', CASE WHEN id % 7 = 0 THEN 'exists' END, CASE WHEN id % 5 = 0 THEN 'not_an_object' END, nullif(problems, '')) AS p FROM content) c", CONTENT)
def precheck_books(t):
    items = t.texts.select("id")
    matches = items.where("id % 7 = 0").select(F.col("id").alias("new_id"))
    shape = items.select("id", F.when(F.col("id") % 5 == 0, F.array(F.lit("not_an_object"))).otherwise(F.array().cast("array<string>")).alias("problems"))
    return V.precheck_books(items, matches, shape, _content(t))


def _batch_items(t):
    n = F.col("num")
    flag = lambda cond, *xs: F.when(cond, F.array(*[F.lit(x) for x in xs])).otherwise(F.array().cast("array<string>"))
    return t.titles.select(
        "id", flag(n % 11 == 0, "boom").alias("errors"), F.concat(flag(n % 3 == 0, "unexpected_id"), flag(n % 13 == 0, "story_missing")).alias("problems"), flag(n % 7 == 0, "note").alias("notes"), (n % 2 == 0).alias("consecutive"),
        F.when(n % 5 == 0, " ").otherwise("1").alias("anchor_id"), (n % 3).alias("n_authors_listed"), (n % 6).alias("n_authors"), F.when(n % 4 == 0, "web_novel").otherwise("book").alias("type"),
        F.when(n % 8 == 0, "web-novel-fast").otherwise("standard").alias("profile"), (n % 16 == 0).alias("has_raw"), (n % 5).alias("n_covers"),
    )


@query(
    """SELECT id, CASE WHEN num % 11 = 0 OR nb > 0 THEN 'failed' WHEN num % 7 = 0 OR num % 5 = 0 OR (num % 3 > 0 AND num % 6 > num % 3 + 1) THEN 'needs_review' ELSE 'ready' END AS status, nb AS n_blocking
    FROM (SELECT *, (CASE WHEN num % 3 = 0 AND num % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN num % 13 = 0 THEN 1 ELSE 0 END) AS nb FROM titles)"""
)
def classify_item(t):
    return V.classify_item(_batch_items(t))


@query(
    """SELECT id, CASE WHEN (CASE WHEN num % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN num % 13 = 0 AND num % 8 > 0 THEN 1 ELSE 0 END + CASE WHEN num % 8 = 0 AND num % 6 = 0 THEN 1 ELSE 0 END) > 0 THEN 'failed' WHEN num % 8 = 0 AND (num % 16 > 0 OR num % 5 = 0 OR num % 13 = 0) THEN 'needs_review' ELSE 'ready' END AS status FROM titles"""
)
def profile_quality_gate(t):
    return V.profile_quality_gate(_batch_items(t))


@query("SELECT id, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'title' WHEN 3 THEN 'tags,title' WHEN 4 THEN 'tags' ELSE 'tags,title' END AS missing, CASE id % 6 WHEN 0 THEN 'n' WHEN 1 THEN 'detail' WHEN 3 THEN 'k' WHEN 4 THEN 'extra' ELSE '' END AS unexpected FROM payloads")
def record_contract(t):
    out = V.record_contract(t.payloads, ["title", "tags"], ["_meta"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("missing", "unexpected")})


@query(
    """SELECT coalesce(a.id, b.id) AS id, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL AND a.value IS NOT DISTINCT FROM b.value) AS same, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL AND a.value IS DISTINCT FROM b.value) AS different,
    count(*) FILTER (WHERE a.id IS NULL) AS missing, count(*) FILTER (WHERE b.id IS NULL) AS extra FROM (SELECT id, source AS key, title AS value FROM obs WHERE "rank" < 5) a FULL JOIN (SELECT id, source AS key, CASE WHEN id % 3 = 0 THEN 'other' ELSE title END AS value FROM obs WHERE "rank" > 1) b ON a.id = b.id AND a.key = b.key GROUP BY 1"""
)
def record_diff(t):
    kv = lambda df: df.select("id", F.col("source").alias("key"), F.col("title").alias("value"))
    right = kv(t.obs.where("rank > 1")).withColumn("value", F.when(F.col("id") % 3 == 0, "other").otherwise(F.col("value")))
    return V.record_diff(kv(t.obs.where("rank < 5")), right)


@query("SELECT id, concat_ws(',', CASE WHEN id % 6 > 0 THEN 'missing_keys' END, CASE WHEN id % 6 IN (0, 1, 3, 4) THEN 'unexpected_keys' END) AS errors, CASE WHEN id % 2 = 0 THEN '' ELSE 'reviews' END AS warnings, id % 6 NOT IN (0, 1, 2, 3, 4, 5) AS passed FROM payloads")
def quality_gate(t):
    reviews = t.payloads.select("id", (F.col("id") % 2 == 0).alias("complete"))
    return V.quality_gate(V.record_contract(t.payloads, ["title", "tags"], ["_meta"]), reviews)


@query("SELECT 'works' AS check_name, (SELECT count(*) FROM works) AS left_n, (SELECT count(*) FROM orders) AS right_n, true AS agree UNION ALL SELECT 'published', (SELECT count(*) FROM works), (SELECT count(*) FROM works WHERE status = 'published'), false")
def catalog_integrity(t):
    return V.catalog_integrity([("works", t.works, t.orders), ("published", t.works, t.works.where("status = 'published'"))])


@query("SELECT id, concat_ws(',', CASE WHEN num % 3 = 0 THEN 'year' END, CASE WHEN num % 4 = 0 THEN 'scores' END) AS rejected, CASE WHEN num % 3 = 1 THEN num::DOUBLE END AS year FROM titles")
def coerce_payload(t):
    n = F.col("num")
    rows = t.titles.select("id", F.when(n % 3 == 0, "MCM").when(n % 3 == 1, n.cast("string")).otherwise(" ").alias("year"), F.when(n % 4 == 0, "{bad").otherwise('{"a":1}').alias("scores"))
    return V.coerce_payload(rows, ["year"], ["scores"]).select("id", "rejected", "year")


# reports


@query(
    """SELECT status, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM works), 4)::DOUBLE AS rate FROM works GROUP BY status UNION ALL
    SELECT 'local_assets', n, round(n * 1.0 / (SELECT count(*) FROM works), 4)::DOUBLE FROM (SELECT count(*) AS n FROM works WHERE id IN (SELECT id FROM checked WHERE state <> 'external' AND kind <> 'poster'))""",
    REFS,
)
def batch_summary(t):
    return R.batch_summary(t.works, M.asset_check(M.asset_refs(t.files.drop("poster")), t.inventory))


@query("SELECT source, count(DISTINCT id) AS n, round(count(DISTINCT id) * 1.0 / (SELECT count(*) FROM part), 4)::DOUBLE AS rate FROM obs GROUP BY source")
def source_rates(t):
    return R.source_rates(t.obs, t.part)


@query("SELECT id, CASE WHEN num % 5 = 0 THEN 'source_hint_invalid' WHEN num % 7 = 0 THEN 'existing' WHEN num % 3 = 0 THEN 'needs_source_hint' ELSE 'ready' END AS state FROM titles")
def preflight_report(t):
    n = F.col("num")
    items = t.titles.select("id", F.when(n % 5 == 0, "x").when(n % 3 == 0, " ").otherwise(n.cast("string")).alias("hint"))
    return R.preflight_report(items, t.titles.where(n % 7 == 0).select(F.col("id").alias("new_id")))


@query("SELECT count(*) FILTER (WHERE s = 'completed') AS completed, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'skipped') AS skipped, round(count(*) FILTER (WHERE s = 'completed') * 1.0 / count(*), 4)::DOUBLE AS rate FROM (SELECT CASE WHEN num % 3 = 0 THEN 'completed' WHEN num % 5 = 0 THEN 'failed' ELSE 'skipped' END AS s FROM works)")
def batch_completion(t):
    done, failed = t.works.where("num % 3 = 0"), t.works.where("num % 5 = 0")
    return R.batch_completion(t.works, done.select("id", F.lit("completed").alias("status")), failed.select("id", F.lit("failed").alias("status")))


@query("SELECT id, CASE WHEN num % 2 = 0 THEN 2 ELSE 0 END AS n_genre, 1 AS n_tags FROM titles")
def staging_summary(t):
    rows = t.titles.select("id", F.when(F.col("num") % 2 == 0, F.array("genre", "studio")).alias("genre"), F.array("studio").alias("tags"))
    return R.staging_summary(rows, ["genre", "tags"])


LATEST = "latest AS (SELECT item, source, arg_max(status, {'t': ts, 's': status}) AS status FROM log GROUP BY item, source)"


@query("SELECT * FROM latest", LATEST)
def latest_status(t):
    return R.latest_status(t.log)


@query("SELECT source, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status NOT IN ('done', 'error')) AS pending FROM latest GROUP BY source", LATEST)
def progress_summary(t):
    return R.progress_summary(R.latest_status(t.log))


@query("SELECT item, arg_min(source, CASE source WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 3 END) AS source FROM latest WHERE status <> 'done' AND source IN ('signup', 'view', 'click') GROUP BY item", LATEST)
def next_pending_source(t):
    return R.next_pending_source(R.latest_status(t.log), ["signup", "view", "click"])


FIELDS = """raw AS (SELECT id // 6 AS item, id % 6 AS k, id AS e, json_extract_string(payload, '$.k') AS own FROM (SELECT id, CASE WHEN id % 6 IN (0, 3) THEN payload END AS payload FROM payloads)),
vals AS (SELECT item, 's' || k AS source, 'title' AS field, CASE k WHEN 0 THEN 'title' WHEN 1 THEN 'detail.title' WHEN 4 THEN 'extra' END AS path, CASE k WHEN 0 THEN 't' || (e % 50) WHEN 1 THEN 'd' || (e % 50) WHEN 4 THEN '["q"]' END AS preview FROM raw WHERE k IN (0, 1, 4) UNION ALL
  SELECT item, 's' || k, '_meta', CASE WHEN k = 0 THEN '_meta' END, CASE WHEN k = 0 THEN '1 keys: k' END FROM raw WHERE k IN (0, 4) UNION ALL
  SELECT item, 's' || k, 'tags', 'tags', CASE WHEN k = 0 THEN '1 items: a' ELSE 'x' END FROM raw WHERE k IN (0, 1) UNION ALL
  SELECT item, 's3', 'k', CASE WHEN own IS NOT NULL THEN 'k' END, own FROM raw WHERE k = 3)"""


def _field_values(t):
    n = F.col("id")
    raw = t.payloads.select(F.floor(n / 6).alias("id"), F.concat(F.lit("s"), (n % 6).cast("string")).alias("source"), "payload")
    rules = [
        *[("title", f"s{k}", i, p) for k in (0, 1, 2, 4) for i, p in enumerate(["title", "detail.title", "extra"])], ("_meta", "s0", 0, "_meta"), ("_meta", "s0", 1, "n"), ("_meta", "s4", 0, "_meta"),
        ("_meta", "s4", 1, "_meta.k"), ("tags", "s0", 0, "tags"), ("tags", "s1", 0, "tags"), ("k", "s3", 0, "k"), ("k", "s5", 0, "k"),
    ]
    return R.field_values(raw, t.spark.createDataFrame(rules, "field string, source string, place int, path string"))


@query(
    """SELECT v.item AS id, field, count(path) AS hits, count(*) AS sources, min(source) FILTER (path IS NOT NULL) AS source, arg_min(path, source) FILTER (path IS NOT NULL) AS path,
    arg_min(preview, source) FILTER (path IS NOT NULL) AS preview, CASE field WHEN 'title' THEN v.item % 3 = 0 WHEN 'tags' THEN v.item % 3 < 2 ELSE false END AS staged FROM vals v GROUP BY v.item, field""",
    FIELDS,
)
def field_coverage(t):
    n = F.col("id")
    staged = t.payloads.select(F.floor(n / 6).alias("id")).distinct()
    text = F.when(n % 3 == 0, '{"title":"a","tags":["x"],"_meta":{}}').when(n % 3 == 1, '{"title":" ","tags":1}').otherwise("broken")
    return R.field_coverage(_field_values(t), staged.select("id", text.alias("payload")))


@query("SELECT field, source, count(path) AS hits, count(*) AS total FROM vals GROUP BY field, source", FIELDS)
def field_totals(t):
    return R.field_totals(_field_values(t))


@query(
    """SELECT id, len(ks) AS n_keys, array_to_string(list_sort(list_filter(ks, lambda k: NOT (k = 'title' AND id % 2 = 0))), '|') AS missing_source, array_to_string(list_sort(list_filter(ks, lambda k: k NOT IN ('title', 'tags', '_meta'))), '|') AS extra
    FROM (SELECT id, CASE WHEN id % 6 = 3 THEN json_keys(payload) ELSE CASE id % 6 WHEN 0 THEN ['_meta', 'tags', 'title', 'n'] WHEN 1 THEN ['detail', 'tags'] WHEN 4 THEN ['_meta', 'title', 'extra'] END END AS ks
      FROM (SELECT id, CASE WHEN id % 6 = 3 THEN payload END AS payload FROM payloads)) WHERE ks IS NOT NULL"""
)
def key_baseline(t):
    known = t.payloads.where("id % 2 = 0").select("id", F.lit("title").alias("key"))
    out = R.key_baseline(t.payloads, known, t.spark.createDataFrame([("title",), ("tags",), ("_meta",)], "key string"))
    return out.select("id", "n_keys", F.array_join("missing_source", "|").alias("missing_source"), F.array_join("extra", "|").alias("extra"))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(CASE id % 6 WHEN 0 THEN ['_meta', 'tags', 'title', 'n'] WHEN 1 THEN ['detail', 'tags'] WHEN 3 THEN ['k'] WHEN 4 THEN ['_meta', 'title', 'extra'] ELSE [] END) AS key FROM payloads) GROUP BY key")
def key_coverage(t):
    return R.key_coverage(t.payloads)


@query("""SELECT id, source AS field, 'old' AS source, NULL::VARCHAR AS note FROM obs WHERE "rank" < 2 UNION ALL SELECT id, source, 'system', CASE WHEN id % 2 = 0 THEN 'empty' END FROM obs WHERE "rank" >= 2""")
def fill_missing_provenance(t):
    fields = t.obs.select("id", F.col("source").alias("field"), F.when(F.col("id") % 2 == 0, " [] ").otherwise("x").alias("value"))
    return R.fill_missing_provenance(fields, t.obs.where("rank < 2").select("id", F.col("source").alias("field"), F.lit("old").alias("source")))


@query("SELECT source AS id, count(*) AS n, count(*) >= 12 AND count(*) FILTER (WHERE kind = 'short') >= 3 AND count(*) FILTER (WHERE kind = 'long') >= 3 AND count(*) FILTER (WHERE kind = 'other') >= 3 AS complete FROM reviews GROUP BY source")
def review_coverage(t):
    return R.review_coverage(t.reviews.select(F.col("source").alias("id"), "kind"), total=12, each=3)


@query("SELECT CASE WHEN r > 1 THEN 'duplicate' WHEN k THEN 'existing' ELSE 'actionable' END AS state, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY position) AS r, title IN (SELECT title FROM works WHERE num % 2 = 0) AS k FROM (SELECT 'Work ' || (c_custkey % 1200) AS title, c_custkey AS position FROM customer)) GROUP BY 1")
def batch_reconcile(t):
    items = t.customer.select(F.concat(F.lit("Work "), (F.col("c_custkey") % 1200).cast("string")).alias("title"), F.col("c_custkey").alias("position"))
    return R.batch_reconcile(items, t.works.where("num % 2 = 0"))


@query("SELECT id, CASE WHEN num % 8 = 0 THEN 'qidian' WHEN num % 4 = 0 THEN 'douban,baike,qidian' ELSE 'douban,baike' END AS sources FROM titles")
def source_scope(t):
    return R.source_scope(_batch_items(t), ["douban", "baike", "qidian"], "qidian").withColumn("sources", F.array_join("sources", ","))


# scalar rules


@query("SELECT num, regexp_replace(strip_accents(lower('Zoë ' || studio)), '[^a-z0-9]', '', 'g') AS key FROM titles")
def normalize_name(t):
    return t.titles.select("num", N.normalize_name(F.concat(F.lit("Zoë "), "studio")).alias("key"))


@query("SELECT s_suppkey, 'supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') AS first, CASE WHEN s_suppkey % 2 = 0 THEN 'x' || s_suppkey ELSE '' END AS last, s_suppkey % 2 = 0 AS reversed FROM supplier")
def split_name(t):
    k = F.col("s_suppkey").cast("string")
    full = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" Mid X"), k)).otherwise(F.col("s_name"))
    first, last = S.split_name(full)
    swapped = F.concat(F.lit("x"), k, F.lit(" "), "s_name")
    return t.supplier.select("s_suppkey", first.alias("first"), last.alias("last"), S.is_reversed_name(full, swapped).alias("reversed"))


TRANSLIT = """words AS (SELECT num, pos, string_split(title, ' ')[pos] AS w FROM titles, unnest(range(1, len(string_split(title, ' ')) + 1)) u(pos)),
entry AS (SELECT DISTINCT left(w, 3 + length(w) % 4) AS latin FROM words WHERE length(w) % 3 > 0),
said AS (SELECT w, coalesce(max('<' || latin || '>') FILTER (latin = w), arg_min('<' || latin || '>', md5(latin)), w) AS local FROM (SELECT DISTINCT w FROM words) t LEFT JOIN entry ON starts_with(w, latin) OR starts_with(latin, left(w, 3)) GROUP BY w)"""


def _translit_table(t):
    w = t.titles.select(F.explode(F.split("title", " ")).alias("w")).distinct().where(F.length("w") % 3 > 0)
    entry = w.select(F.left("w", 3 + F.length("w") % 4).alias("latin")).distinct()
    return entry.select(F.md5(F.col("latin").cast("binary")).alias("place"), "latin", F.concat(F.lit("<"), "latin", F.lit(">")).alias("local"))


@query("SELECT num, string_agg(local, '·' ORDER BY pos) AS local FROM words JOIN said USING (w) GROUP BY num", TRANSLIT)
def transliterate_name(t):
    """Names of several words by a table as large as the words ask for."""
    said = N.transliterate(t.titles.select(F.col("title").alias("name")), _translit_table(t))
    return t.titles.join(said, t.titles["title"] == said["name"]).select("num", "local")


@query(
    """SELECT w.num // 8 AS work_id, w.num AS western_id, arg_min(l.num, l.num % 8) AS local_id FROM two w JOIN two l ON w.num // 8 = l.num // 8 AND l.num % 2 = 0 WHERE w.b <> '' AND l.b <> '' AND (w.b = l.b OR
    (length(w.b) > 3 AND length(l.b) > 3 AND len(list_filter(string_split(l.b, ''), lambda c: contains(w.b, c))) >= least(length(w.b), length(l.b)) * 0.7)) GROUP BY ALL""",
    TRANSLIT + ", two AS (SELECT num, regexp_replace(lower(string_agg(local, '·' ORDER BY pos)), '[·\\s]', '', 'g') AS b FROM words JOIN said USING (w) WHERE pos <= 2 GROUP BY num)",
)
def person_match_transliterated(t):
    """People of a work that only their transliterated names bring together."""
    two = F.array_join(F.slice(F.split("title", " "), 1, 2), " ")
    table, n = _translit_table(t), F.col("num")
    people = t.titles.select(F.floor(n / 8).alias("work_id"), "num", two.alias("name"))
    local = people.where("num % 2 = 0").join(N.transliterate(people, table).select("name", F.col("local").alias("said")), "name")
    local = local.select("work_id", F.col("num").alias("local_id"), (n % 8).alias("position"), F.col("said").alias("name"), F.lit(None).cast("string").alias("name_en"))
    return M.person_match(people.select("work_id", F.col("num").alias("western_id"), "name"), local, table)


#: Letters as Chinese characters, by which the given texts try the rules on Chinese text.
HAN = "的一是不了人我在有他这中大来上国个到说们为子和你地出"
DOC_TEXTS = f"""dt AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{HAN}') WHEN 2 THEN translate(text, 'aeiou', '{HAN[:5]}')
  ELSE left(text, length(text) // 2) || '...' END AS txt FROM documents)"""


@query(
    f"""SELECT id, coalesce(regexp_matches(txt, '[\\x{{4e00}}-\\x{{9fff}}]'), false) AS has_cjk, coalesce({ZH}, false) AS is_text, coalesce({CUT}, false) AS truncated,
    try_cast(nullif(regexp_extract(replace(txt, ',', ''), '(\\d+)', 1), '') AS BIGINT)::VARCHAR AS number, try_cast(nullif(regexp_extract(txt, '(\\d{{4}})', 1), '') AS INTEGER) AS year,
    len(list_filter(regexp_split_to_array(txt, '\\n\\s*\\n'), lambda x: trim(x) <> '')) AS paragraphs, len(list_filter(regexp_split_to_array(txt, '\\r?\\n'), lambda x: trim(x) <> '')) AS lines, md5(txt) AS hash FROM dt""",
    DOC_TEXTS,
)
def text_rules(t):
    """Rules on Chinese text, numbers and paragraphs over all documents."""
    c, k = F.col("text"), F.col("doc_id") % 4
    han = F.translate(F.lower(c), "abcdefghijklmnopqrstuvwxyz", HAN)
    txt = F.when(k == 0, c).when(k == 1, han).when(k == 2, F.translate(c, "aeiou", HAN[:5])).otherwise(F.concat(F.left(c, F.floor(F.length(c) / 2).cast("int")), F.lit("...")))
    x = F.col("txt")
    rules = {"has_cjk": S.has_cjk(x), "is_text": S.is_chinese_text(x), "truncated": S.has_truncation(x), "number": S.parse_int(x).cast("string"), "year": S.year_from_text(x), "hash": S.content_hash(x)}
    counts = {"paragraphs": F.size(S.split_paragraphs(x)).cast("long"), "lines": F.size(S.split_paragraphs(x, False)).cast("long")}
    return t.documents.select(F.col("doc_id").alias("id"), txt.alias("txt")).select("id", *[v.alias(n) for n, v in (rules | counts).items()])


@query(f"SELECT id, coalesce(regexp_matches(txt, '[\\x{{4e00}}-\\x{{9fff}}]'), false) AS has_cjk, coalesce(regexp_full_match(txt, '[\\x{{4e00}}-\\x{{9fa5}}]+'), false) AS is_chinese, coalesce({ZH}, false) AS is_text, coalesce({CUT}, false) AS truncated FROM texts")
def chinese_text(t):
    c = F.col("txt")
    return t.texts.select("id", S.has_cjk(c).alias("has_cjk"), S.is_chinese(c).alias("is_chinese"), S.is_chinese_text(c).alias("is_text"), S.has_truncation(c).alias("truncated"))


@query("SELECT id, CASE id % 8 WHEN 0 THEN '海明威' WHEN 1 THEN '简·奥斯汀' ELSE trim(name) END AS name, CASE id % 8 WHEN 0 THEN '美' WHEN 1 THEN '英' END AS prefix, CASE country WHEN '中' THEN '中国' WHEN '香港' THEN '中国' WHEN '苏联' THEN '俄罗斯' ELSE country END AS country FROM names")
def strip_country_prefix(t):
    name, prefix = S.strip_country_prefix(F.col("name"))
    return t.names.select("id", name.alias("name"), prefix.alias("prefix"), S.normalize_country(F.col("country")).alias("country"))


@query("SELECT num, lower(replace(studio, '#', '')) || replace(title, ' ', '') AS title_key, lower(studio) AS series_key, replace(title, ' ', '') AS text_key FROM titles")
def title_keys(t):
    return t.titles.select("num", S.normalize_title(F.concat("studio", F.lit(" — "), "title")).alias("title_key"), S.series_key(F.concat(F.lit("《"), "studio", F.lit("》 · "))).alias("series_key"), S.text_key(F.col("title")).alias("text_key"))


@query("SELECT num, title, year FROM titles")
def split_query(t):
    """Titles with their year in brackets of either width, before or after; without one there is no year to find."""
    y, n = F.col("year").cast("string"), F.col("num") % 3
    said = F.when(n == 0, F.concat("title", F.lit(" ("), y, F.lit(")"))).when(n == 1, F.concat(F.lit("（"), y, F.lit("） "), "title")).otherwise(F.concat(F.lit("  "), "title", F.lit("  "), y))
    title, year = S.split_query(F.coalesce(said, "title"))
    return t.titles.select("num", title.alias("title"), year.alias("year"))


@query("SELECT id, CASE id % 9 WHEN 5 THEN 12 WHEN 6 THEN 7 WHEN 8 THEN 1234 END::BIGINT AS n, CASE id % 9 WHEN 5 THEN 321 WHEN 8 THEN 1234 END::BIGINT AS labeled, CASE id % 9 WHEN 5 THEN 125000 WHEN 6 THEN 7 WHEN 8 THEN 1234 END::BIGINT AS cjk, CASE id % 9 WHEN 6 THEN 7 END AS episode, CASE id % 9 WHEN 7 THEN '好书一本。' WHEN 0 THEN '这是一本网络小说，作者是张三，正在连载。' WHEN 2 THEN '电视剧由李四执导，主演王五...' WHEN 3 THEN '短' WHEN 5 THEN '约12.5万字，页码：321 页' WHEN 6 THEN '第 7 集 他们终于见面了' WHEN 8 THEN '字数：1,234 first text…' END AS summary FROM texts")
def text_numbers(t):
    c = F.col("txt")
    return t.texts.select("id", S.parse_int(c).alias("n"), S.labeled_int(c, "字数", "页码").alias("labeled"), S.cjk_number(c).alias("cjk"), S.episode_number(F.regexp_extract(c, r"(第 \d+ 集)", 1)).alias("episode"), S.clean_store_summary(c).alias("summary"))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, o_orderkey % 300 AS minutes FROM orders")
def year_from_text(t):
    text = F.concat(F.lit("on "), F.col("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", S.first_publish_year(F.lit("n/a"), text).alias("y"), S.runtime_minutes(F.concat((F.col("o_orderkey") % 300).cast("string"), F.lit(" min"))).cast("long").alias("minutes"))


@query("SELECT num, CASE num % 3 WHEN 0 THEN (num % 5) * 2.0::DOUBLE WHEN 1 THEN (num % 101)::DOUBLE END AS value, CASE num % 3 WHEN 0 THEN 10 WHEN 1 THEN 100 END AS scale FROM titles")
def parse_rating(t):
    n = F.col("num")
    text = F.when(n % 3 == 0, F.concat((n % 5).cast("string"), F.lit(" / 5"))).when(n % 3 == 1, F.concat((n % 101).cast("string"), F.lit("%"))).otherwise("good")
    r = S.parse_rating(text)
    return t.titles.select("num", r["value"].alias("value"), r["scale"].alias("scale"))


@query("SELECT num, CASE WHEN num % 2 = 0 THEN '' ELSE studio || '|' || title END AS items FROM titles")
def split_csv(t):
    return t.titles.select("num", F.array_join(S.split_csv(F.when(F.col("num") % 2 == 0, "N/A").otherwise(F.concat("studio", F.lit(" , ,"), "title"))), "|").alias("items"))


@query("SELECT num, title, 12 + num % 5 AS likes, studio AS note FROM titles")
def clean_excerpt(t):
    text, note, likes = S.clean_excerpt(F.concat("title", F.lit("\n引自 "), "studio", F.lit("\n"), (12 + F.col("num") % 5).cast("string"), F.lit(" 赞 2020-01-02 10:11")))
    return t.titles.select("num", text.alias("title"), likes.cast("long").alias("likes"), note.alias("note"))


@query("SELECT num, '海明威' AS local, studio AS latin, title AS character FROM titles")
def split_person_label(t):
    local, latin, character = S.split_person_label(F.concat(F.lit("海明威 "), "studio", F.lit(" (饰 "), "title", F.lit(")")))
    return t.titles.select("num", local.alias("local"), latin.alias("latin"), character.alias("character"))


@query("SELECT num, title || ' & <b>' AS text FROM titles")
def decode_html_text(t):
    return t.titles.select("num", S.decode_html_text(F.concat(F.lit("<p> "), "title", F.lit("&nbsp;&amp; <i></i>&lt;b&gt;</p>"))).alias("text"))


@query("SELECT num, num % 4 = 0 AS placeholder, CASE WHEN num % 2 = 0 THEN 'cover.png' ELSE 'cover-s.png' END AS file FROM titles")
def pick_cover(t):
    n = F.col("num")
    url = F.concat(F.lit("http://h/"), F.when(n % 4 == 0, "Placeholder").otherwise(n.cast("string")), F.lit(".png"))
    return t.titles.select("num", S.is_placeholder_cover(url).alias("placeholder"), S.pick_cover_name(url, F.lit("s"), n % 2 == 0).alias("file"))


@query("SELECT id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines, md5(text) AS hash FROM reviews")
def split_paragraphs(t):
    return t.reviews.select("id", F.size(S.split_paragraphs(F.col("text"), blank_lines=False)).cast("long").alias("n_lines"), S.content_hash(F.col("text")).alias("hash"))


@query("SELECT id, CASE id % 6 WHEN 0 THEN 't' || (id % 50) WHEN 4 THEN ' ' END AS title, CASE id % 6 WHEN 1 THEN 'd' || (id % 50) END AS nested FROM payloads")
def get_path(t):
    return t.payloads.select("id", S.get_path(F.col("payload"), "title").alias("title"), S.get_path(F.col("payload"), "detail.title").alias("nested"))
