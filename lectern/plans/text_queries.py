"""Queries of sources, payloads, pages, review text and streams."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lectern.operators import density as D
from lectern.operators import importing as I
from lectern.operators import merge as G
from lectern.operators import pages as P
from lectern.operators import payloads as L
from lectern.operators import reviews as V
from lectern.operators import segmentation as G2
from lectern.plans.change_queries import HAN, LATEST
from lectern.plans.registry import query
from lectern.sources import io as IO
from lectern.sources.scratch import scratch_folder, written
from lectern.sources.versions import VersionedTables
from lectern.streaming import streams as T


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE json_extract(props, '$.k')::INTEGER END AS k FROM events")
def parse_json_columns(t):
    e = t.events.withColumn("props", F.when(F.col("event_id") % 3 == 0, "{bad").otherwise(F.col("props")))
    out = IO.parse_json_columns(e.select("event_id", "props"), {"props": ("struct<k: int>", F.struct(F.lit(-1).alias("k")))})
    return out.select("event_id", F.coalesce("props.k", F.lit(-1)).alias("k"))


@query("SELECT id, title, updated_at FROM works WHERE status = 'published'")
def export_csv(t):
    return IO.export_rows(t.works, ["id", "title", "updated_at"])


@query("SELECT id, douban, imdb FROM works")
def export_ratings_csv(t):
    w = t.works.select("id", F.to_json(F.struct("douban", "imdb")).alias("scores"))
    return IO.export_ratings(w).select("id", "douban", "imdb")


@query("SELECT 'run' || (num // 20) AS run, row_number() OVER (PARTITION BY num // 20 ORDER BY id)::INTEGER AS position, id AS bookId, title FROM titles")
def read_manifest(t):
    rows = t.titles.groupBy(F.concat(F.lit("run"), F.floor(F.col("num") / 20).cast("string")).alias("run")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("bookId"), "title"))).alias("items"))
    return IO.manifest_items(rows.select("run", F.to_json(F.struct("items")).alias("payload"))).select("run", "position", "bookId", "title")


@query("SELECT num AS pos, title FROM titles WHERE num % 3 = 1")
def read_title_list(t):
    lines = t.titles.select(F.lit("f").alias("file"), F.col("num").alias("pos"), F.when(F.col("num") % 3 == 0, "  ").when(F.col("num") % 3 == 2, F.concat(F.lit("# "), "title")).otherwise(F.concat(F.lit(" "), "title")).alias("value"))
    return IO.title_list(lines).select("pos", "title")


def _folder(t) -> str:
    return scratch_folder(t.spark)


@query("SELECT id, title, year FROM titles")
def snapshot_tables(t):
    folder, table = _folder(t), {"titles": t.titles.select("id", "title", "year")}
    IO.snapshot_tables(table, folder)
    return IO.restore_tables(t.spark, folder, table)["titles"]


@query("SELECT id, title, module, coalesce(submodule, '__HIVE_DEFAULT_PARTITION__') AS submodule FROM works")
def write_entries(t):
    folder = _folder(t)
    IO.write_entries(t.works.select("id", "title", "module", F.coalesce("submodule", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("submodule")), folder)
    back = t.spark.read.schema("id string, title string, module string, submodule string").json(f"{folder}/entries")
    return back.select("id", "title", "module", F.coalesce("submodule", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("submodule"))


@query("SELECT id, title, module FROM works")
def write_indexes(t):
    folder = _folder(t)
    IO.write_indexes(t.works.select("id", "title", "module", F.coalesce("submodule", F.lit("none")).alias("submodule")), folder)
    return t.spark.read.schema("id string, title string, module string").json(f"{folder}/search").join(t.spark.read.schema("id string").json(f"{folder}/lists"), "id", "left_semi").withColumn("module", F.lit("video"))


@query("SELECT id, source, CASE id % 6 WHEN 0 THEN 't' || (id % 50) WHEN 1 THEN 'd' || (id % 50) END AS title FROM payloads")
def normalize_source_payload(t):
    return L.normalize_source_payload(t.payloads, ["title"])


@query("SELECT id, CASE WHEN num % 3 = 0 THEN title WHEN num % 3 = 1 THEN studio ELSE 'plain' END AS title, CASE WHEN num % 2 = 0 THEN (num % 5) * 2.0::DOUBLE END AS rating, CASE WHEN num % 4 = 0 THEN 'a / b' END AS roles FROM titles")
def project_api_payload(t):
    n = F.col("num")
    title = F.when(n % 3 == 0, F.concat(F.lit('["'), "title", F.lit('","x"]'))).when(n % 3 == 1, F.concat(F.lit('{"value":"'), "studio", F.lit('"}'))).otherwise(F.lit('"plain"'))
    rating = F.when(n % 2 == 0, F.concat(F.lit(',"rating":'), (n % 5).cast("string"))).otherwise("")
    roles = F.when(n % 4 == 0, ',"roles":["a"," b","a",""]').otherwise("")
    return L.project_api_payload(t.titles.select("id", F.concat(F.lit('{"title":'), title, rating, roles, F.lit("}")).alias("payload"))).select("id", "title", "rating", "roles")


@query("SELECT id, key, min({'l': lang_rank, 'p': pos}).l AS lang_rank, min({'l': lang_rank, 'p': pos}).p AS pos FROM (SELECT l_orderkey AS id, l_suppkey % 5 AS key, l_suppkey % 3 AS lang_rank, l_linenumber AS pos FROM lineitem WHERE l_returnflag = 'A') GROUP BY id, key")
def first_videos(t):
    k = F.col("l_suppkey")
    return L.first_videos(t.lineitem.select(F.col("l_orderkey").alias("id"), (k % 3).alias("lang_rank"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "A", "YouTube").otherwise("x").alias("site"), (k % 5).alias("key")))


@query("SELECT id, CASE WHEN num % 2 = 0 THEN 'q1|' || studio ELSE title END AS quotes, CASE WHEN num % 3 > 0 THEN (num % 10)::DOUBLE END AS douban, CASE WHEN num % 4 = 0 THEN 'douban:' || num || '|imdb:tt1' ELSE 'imdb:tt1' END AS sources FROM titles")
def legacy_projection(t):
    n = F.col("num")
    quotes = F.when(n % 2 == 0, F.concat(F.lit('[{"text":"q1"},{"text":"'), "studio", F.lit('"}]'))).otherwise(F.concat(F.lit('["'), "title", F.lit('"]')))
    ratings = F.when(n % 3 > 0, F.concat(F.lit('{"douban":'), (n % 10).cast("string"), F.lit("}"))).otherwise("{}")
    douban = F.when(n % 4 == 0, F.concat(F.lit(',"doubanId":"'), n.cast("string"), F.lit('"'))).otherwise("")
    payload = F.concat(F.lit('{"quotes":'), quotes, F.lit(',"ratings":'), ratings, douban, F.lit(',"imdbId":"tt1"}'))
    return L.legacy_projection(t.titles.select("id", payload.alias("payload")))


@query("""SELECT id, CASE WHEN num % 2 = 0 THEN 'type' ELSE 'tag' END AS "group", genre AS name, NULL::VARCHAR AS note FROM titles""")
def migrate_person_category(t):
    return L.migrate_categories(t.titles.select("id", F.when(F.col("num") % 2 == 0, "genre").otherwise("keyword").alias("kind"), F.concat(F.lit(" "), "genre").alias("label")))


@query("SELECT id, CASE WHEN num % 2 = 0 THEN studio ELSE title END AS name, NULL::VARCHAR AS role, title AS related, 1995 AS year, CASE WHEN num % 3 = 0 THEN num::DOUBLE END AS rating, studio AS character FROM titles")
def normalize_elements(t):
    n = F.col("num")
    p = L.normalize_credit_person(F.struct(F.when(n % 2 == 0, " ").otherwise(F.col("title")).alias("name"), F.col("studio").alias("name_en"), F.lit(" ").alias("role")))
    r = L.normalize_related(F.struct("title", F.lit("1995-02").alias("date"), F.when(n % 3 == 0, n.cast("string")).otherwise("n/a").alias("rating")))
    c = L.normalize_character(F.struct(F.concat("studio", F.lit(" ")).alias("name"), F.lit("").alias("actor")))
    return t.titles.select("id", p["name"].alias("name"), p["role"].alias("role"), r["title"].alias("related"), r["year"].alias("year"), r["rating"].alias("rating"), c["name"].alias("character"))


@query("SELECT num, CASE WHEN num % 2 = 0 THEN num::INTEGER END AS episode, CASE WHEN num % 3 = 0 THEN studio ELSE title END AS text FROM titles")
def normalize_episode(t):
    n = F.col("num")
    e = G.normalize_episode(F.struct(F.when(n % 2 == 0, n.cast("string")).otherwise("x").alias("episode"), F.when(n % 3 == 0, " ").otherwise(F.col("title")).alias("story"), F.col("studio").alias("plot")))
    return t.titles.select("num", e["episode"].alias("episode"), e["text"].alias("text"))


@query("SELECT work_id, character, id FROM (SELECT *, row_number() OVER (PARTITION BY work_id, character ORDER BY \"order\", id) AS r FROM work_person WHERE character IS NOT NULL) WHERE r = 1")
def keep_first_dedupe(t):
    return G.keep_first(t.work_person.where("character is not null"), ["work_id", "character"], "order", "id").select("work_id", "character", "id")


@query("SELECT id::VARCHAR AS item_id, source, coalesce(try_cast(payload AS JSON) IS NOT NULL AND trim(payload) <> '', false) AS valid FROM payloads")
def read_raw_snapshots(t):
    path = F.concat(F.lit("file:/raw/"), F.col("id").cast("string"), F.lit("/"), "source", F.lit(".json"))
    return IO.raw_snapshots(t.payloads.select(path.alias("path"), F.col("payload").alias("value"))).select("item_id", "source", "valid")


@query("SELECT id, '{\"id\":\"' || id || '\",\"title\":\"' || title || '\"}' AS payload FROM titles WHERE num % 4 <> 1")
def read_staging(t):
    inner = F.when(F.col("num") % 4 == 1, "other").otherwise(F.col("id"))
    rows = t.titles.select(F.concat(F.lit("file:/staging/"), "id", F.lit(".json")).alias("path"), F.to_json(F.struct(inner.alias("id"), "title")).alias("value"))
    return IO.staged_items(rows)


# pages


@query("SELECT page_id, coalesce(length(html) >= 64 AND NOT regexp_matches(html, 'Access Denied|Just a moment|验证码'), false) AS valid FROM pages")
def page_validity(t):
    return P.page_validity(t.pages)


@query("SELECT page_id, trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS heading FROM pages")
def page_heading(t):
    return P.page_heading(t.pages)


#: An item of a stored page's navigation: its target and its text.
NAV = r'<li><a href="/([^"]*)">([^<]*)</a></li>'


def _recast(t, pattern: str, markup: str):
    """The stored pages with what ``pattern`` finds in them set in other markup; what is read from it is still the page's own text."""
    return t.pages.withColumn("html", F.regexp_replace("html", pattern, markup))


@query("SELECT page_id, '{\"id\":' || regexp_extract(html, 'track\\((\\d+)\\);', 1) || '}' AS payload FROM pages WHERE regexp_matches(html, 'track\\(\\d+\\);')")
def page_embedded_json(t):
    return P.page_embedded_json(_recast(t, r"track\((\d+)\);", r'window.DATA = {"id":$1};'), r"window\.DATA").where("payload is not null")


@query(
    """SELECT page_id, label, replace(regexp_extract(html, '<li><a href="/([^"]*)">[^<]*' || label || '</a></li>', 1), '&amp;', '&') || ' x' AS value FROM pages, (SELECT unnest(['The', 'and', 'der', 'la', 'para']) AS label)
    WHERE regexp_matches(html, '<li><a href="/([^"]*)">[^<]*' || label || '</a></li>')"""
)
def page_label_value(t):
    return P.page_label_values(_recast(t, NAV, r'<div><span class="pl">$2:</span> <b>$1</b> x<br></div>'), ["The", "and", "der", "la", "para"])


@query(
    """SELECT page_id, pos AS rank, title FROM (SELECT page_id, generate_subscripts(x, 1)::INTEGER AS pos, trim(regexp_replace(replace(regexp_replace(unnest(x), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title
    FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS x FROM pages)) WHERE title <> ''"""
)
def page_ranked_list(t):
    return P.page_ranked_list(t.pages)


@query("SELECT id, id % 9 = 2 AS other FROM texts")
def non_book_entry(t):
    return t.texts.select("id", P.non_book_entry(F.col("txt"), ["电视剧", "主演", "导演"], ["网络小说", "连载"]).alias("other"))


ALIASES = {"The": "article", "and": "joint", "der": "artikel", "la": "article", "para": "purpose"}


@query(
    """SELECT page_id, CASE label WHEN 'and' THEN 'joint' WHEN 'der' THEN 'artikel' WHEN 'para' THEN 'purpose' ELSE 'article' END AS field, replace(regexp_extract(html, '<li><a href="/([^"]*)">' || label || '</a></li>', 1), '&amp;', '&') || ' x' AS value
    FROM pages, (SELECT unnest(['The', 'and', 'der', 'la', 'para']) AS label) WHERE regexp_matches(html, '<li><a href="/([^"]*)">' || label || '</a></li>')"""
)
def page_infobox(t):
    return P.page_infobox(P.parse_pages(_recast(t, NAV, "<dt>$2:</dt><dd>$1 x</dd>")), ALIASES)


@query(
    """SELECT page_id, heading, array_to_string(list_filter(ps, lambda x, i: list_position(ps, x) = i), chr(10)) AS text FROM (SELECT page_id,
      trim(regexp_replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS heading,
      list_filter(list_transform(string_split(regexp_extract(html, '(?s)</h1>(.*)</p>', 1), '</p>'), lambda x: trim(regexp_replace(replace(replace(regexp_replace(regexp_extract(x, '(?s)^.*<p>(.*)$', 1), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))),
        lambda x: length(x) >= 8) AS ps FROM pages) WHERE heading <> '' AND len(ps) > 0"""
)
def page_section(t):
    return P.page_section(P.parse_pages(t.pages), ".")


@query("SELECT DISTINCT page_id, '' AS heading, item FROM (SELECT page_id, trim(replace(unnest(regexp_extract_all(html, '<li><a[^>]*>(.*?)</a></li>', 1)), '&amp;', '&')) AS item FROM pages) WHERE item <> ''")
def page_lists(t):
    return P.page_lists(P.parse_pages(t.pages), "^$")


@query(
    """SELECT page_id, 3 AS episode, text FROM (SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(unnest(string_split(regexp_replace(html, '(?s)<footer.*$', ''), '</p><p>')[2:]), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages) WHERE text <> ''"""
)
def page_episodes(t):
    parts = F.replace(F.regexp_replace("html", "(?s)<footer.*$", ""), F.lit("</p><p>"), F.lit("</p><p>第 3 集 "))
    return P.page_episodes(t.pages.withColumn("html", parts))


@query("SELECT DISTINCT page_id, trim(replace(x, '&amp;', '&')) AS character, trim(replace(y, '&amp;', '&')) AS actor FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"/([^\"]*)\">([^<]*)</a></li>', 1)) AS x, unnest(regexp_extract_all(html, '<li><a href=\"/([^\"]*)\">([^<]*)</a></li>', 2)) AS y FROM pages) WHERE trim(x) <> '' AND trim(y) <> ''")
def page_characters(t):
    return P.page_characters(P.parse_pages(_recast(t, NAV, "<li>$2 饰 $1</li>")))


# review text


@query("SELECT id AS work_id, 0 AS pos, 'a' AS source, title AS content FROM titles UNION ALL SELECT id, 1, 'b', studio FROM titles")
def explode_reviews(t):
    w = t.titles.select("id", F.array(F.struct(F.lit("a").alias("source"), F.col("title").alias("content")), F.struct(F.lit("b").alias("source"), F.col("studio").alias("content"))).alias("comments"))
    return V.explode_reviews(w)


STOP = "[" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + "]"
TOKENS = f"""tok AS (SELECT id, source, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s,;.\\-]+'), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w)) AS ws FROM reviews),
tf AS (SELECT id, w AS term, count(*) AS tf FROM (SELECT id, unnest(ws) AS w FROM tok) GROUP BY 1, 2),
tw AS (SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS total, round(sum(tf) * ln(((SELECT count(*) FROM tok) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) / (SELECT count(*) FROM tok), 3) AS weight FROM tf GROUP BY term)"""


@query("SELECT id, len(ws) AS n_tokens, len(list_distinct(ws)) AS n_terms FROM tok", TOKENS)
def tokenize_reviews(t):
    out = V.tokenize_reviews(t.reviews)
    return out.select("id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


@query("SELECT term, n_docs, total FROM tw", TOKENS)
def tfidf(t):
    return V.term_weights(t.reviews, "id").drop("weight")


@query("SELECT term, n_docs, total, weight FROM tw ORDER BY weight DESC, term LIMIT 20", TOKENS)
def top_keywords(t):
    return V.top_keywords(t.reviews, "id")


@query("SELECT source, count(*) AS n, round(avg(h), 3) AS positive, round(1 - avg(h), 3) AS negative FROM (SELECT source, CASE WHEN regexp_matches(lower(text), '\\b(?:was|heed|ores)\\b') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h FROM reviews) GROUP BY source")
def lexicon_sentiment(t):
    return V.lexicon_sentiment(t.reviews, "source", ["was", "heed", "ores"])


BAYES = f"""lab AS (SELECT d.doc_id AS key, l.quality AS label, ('0x' || md5(d.doc_id::VARCHAR)[1:4])::INTEGER % 10 >= 7 AS held,
  list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s,;.\\-]+'), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w)) AS ws FROM documents d JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IS NOT NULL) l USING (doc_id)),
prior AS (SELECT label, ln(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM lab WHERE NOT held)) AS prior FROM lab WHERE NOT held GROUP BY label),
per AS (SELECT label, w AS term, count(*) AS n FROM (SELECT label, unnest(ws) AS w FROM lab WHERE NOT held) GROUP BY ALL),
voc AS (SELECT term FROM per GROUP BY term ORDER BY sum(n) DESC, term LIMIT 1000),
cells AS (SELECT v.term, p.label, coalesce(per.n, 0) AS n FROM voc v CROSS JOIN prior p LEFT JOIN per ON per.term = v.term AND per.label = p.label),
wgt AS (SELECT term, label, ln((n + 0.01::DOUBLE) / (sum(n) OVER (PARTITION BY label) + 0.01::DOUBLE * count(*) OVER (PARTITION BY label))) AS w FROM cells),
sc AS (SELECT l.key, l.label AS truth, p.label, round(p.prior + coalesce(s, 0), 6) AS score FROM lab l CROSS JOIN prior p LEFT JOIN
  (SELECT key, g.label, sum(tf * g.w) AS s FROM (SELECT key, w AS term, count(*) AS tf FROM (SELECT key, unnest(ws) AS w FROM lab WHERE held) GROUP BY ALL) f JOIN wgt g USING (term) GROUP BY ALL) x ON x.key = l.key AND x.label = p.label WHERE l.held)"""


@query("SELECT key, any_value(truth) AS label, arg_min(label, {'s': -score, 'l': label}) AS prediction FROM sc GROUP BY key", BAYES)
def train_sentiment(t):
    rows = t.documents.join(t.labels.where("quality is not null").select("doc_id", "quality").distinct(), "doc_id")
    return V.train_sentiment(rows, "doc_id", "quality").select("key", "label", "prediction")


@query()
def cut_reviews(t):
    """Words as runs of characters, cut by a dictionary of the frequent short words."""
    text = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", HAN)
    rows = t.reviews.select("id", text.alias("text"))
    words = G2.word_dictionary(rows, "text", "[一-鿿]{2,4}").where("n >= 20")
    out = V.cut_reviews(rows, "id", words, stop_words=[])
    return out.select("id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


def _vectors(t):
    return V.tfidf(V.tokenize_reviews(t.reviews))[0].select("id", "features")


def _square(v):
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


@query(
    "SELECT id, CASE WHEN bool_or(v.term IS NOT NULL) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS squared_norm FROM (SELECT id, unnest(CASE WHEN len(ws) = 0 THEN [''] ELSE ws END) AS term FROM tok) r LEFT JOIN voc v USING (term) GROUP BY id",
    TOKENS + ", voc AS (SELECT term FROM tw ORDER BY total DESC, term LIMIT 1000)",
)
def tfidf_vectors(t):
    return _vectors(t).select("id", F.round(_square(vector_to_array("features")), 6).alias("squared_norm"))


@query("SELECT id, true AS at_nearest FROM reviews")
def kmeans_topics(t):
    """Every review is in the cluster of the nearest centre."""
    x = _vectors(t)
    model = V.kmeans_model(x, 5)
    rows = V.nearest_centre(model.transform(x), model.clusterCenters())
    return rows.select("id", (F.col("cluster") == F.col("nearest")).alias("at_nearest"))


@query("SELECT unnest(range(2, 7))::INTEGER AS k, true AS inertia_is_sum, 1::BIGINT AS n_elbows")
def elbow_k(t):
    """The inertia of each k is the sum of squared distances to the nearest centres, and one k is the elbow."""
    x = written(_vectors(t), "vectors")
    bend, totals = V.elbow_k(x, 6), []
    for k in range(2, 7):
        totals.append((k, V.nearest_centre(x, V.kmeans_model(x, k).clusterCenters()).agg(F.sum("distance")).first()[0]))
    sums = t.spark.createDataFrame(totals, "k int, total double")
    n = bend.agg(F.count_if("is_elbow").alias("n_elbows"))
    same = F.abs(F.col("inertia") - F.col("total")) < 1e-6 * F.col("total")
    return bend.join(sums, "k").crossJoin(n).select("k", same.alias("inertia_is_sum"), "n_elbows")


@query("SELECT count(*) AS n, true AS uncorrelated, true AS in_order FROM reviews")
def pca_coords(t):
    """Principal coordinates are uncorrelated, and the first varies most."""
    c = V.pca_coords(_vectors(t))
    return c.agg(F.count("*").alias("n"), (F.abs(F.corr("x", "y")) < 1e-6).alias("uncorrelated"), (F.var_pop("x") >= F.var_pop("y")).alias("in_order"))


@query()
def dbscan_reviews(t):
    """Reviews by the density of their principal coordinates."""
    c = V.pca_coords(_vectors(t), 3)
    return D.dbscan_topics(c.select("id", F.array("x", "y", "z").alias("v")), 0.05, 5, dims=3)


@query(
    """SELECT id, coalesce(cluster, -1) AS cluster FROM (SELECT a.id, min(r.root) AS cluster FROM pts a LEFT JOIN pts b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.5 LEFT JOIN roots r ON r.id = b.id GROUP BY a.id)""",
    """pts AS (SELECT num AS id, (num % 20) * 1.0 + (num // 100) * 0.001 AS x, CASE WHEN num % 20 = 7 THEN num * 10.0 ELSE 0.0 END AS y FROM titles),
    core AS (SELECT a.id, a.x, a.y FROM pts a JOIN pts b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.5 GROUP BY a.id, a.x, a.y HAVING count(*) >= 3), roots AS (SELECT a.id, min(b.id) AS root FROM core a JOIN core b ON floor(a.x) = floor(b.x) GROUP BY a.id)""",
)
def dbscan_topics(t):
    n = F.col("num")
    v = F.array((n % 20).cast("double") + F.floor(n / 100) * 0.001, F.when(n % 20 == 7, n * 10.0).otherwise(0.0))
    return D.dbscan_topics(t.titles.select(n.alias("id"), v.alias("v")), 0.5, 3, dims=2)


# streams


def _drained(stream, mode: str, name: str):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


@query("SELECT item::VARCHAR AS item, source, status FROM latest", LATEST)
def progress_stream(t):
    folder, out = _folder(t), _folder(t)
    log = t.log.withColumn("ts", F.col("ts").cast("timestamp"))
    log.repartitionByRange(3, "ts").write.parquet(folder)
    updates = t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    T.progress_sink(T.progress_stream(updates, late="3650 days", idle_minutes=10 * 365 * 24 * 60), out, _folder(t)).awaitTermination()
    return T.progress_table(t.spark, out).select("item", "source", "status")


@query("SELECT source, date_trunc('hour', ts) AS hour, count(*) AS n FROM log GROUP BY ALL")
def windowed_activity(t):
    folder = _folder(t)
    log = t.log.withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(folder)
    updates = t.spark.readStream.schema(log.schema).parquet(folder)
    out = _drained(T.windowed_activity(updates), "complete", f"activity_{uuid.uuid4().hex}")
    return out.select("source", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")


@query("SELECT id, title, studio AS person, 'type:' || genre AS category FROM titles WHERE num % 3 > 0")
def staging_drop_stream(t):
    folder, c = _folder(t), F.lit(None).cast("string")
    credit = F.struct(F.col("studio").alias("name"), F.lit("direction").alias("department"))
    t.titles.select("id", "title", "year", F.array(credit).alias("credits"), F.array(F.lit(" "), F.col("genre")).alias("genre")).repartition(4).write.json(folder)
    works = t.titles.where("num % 3 = 0").select("id", "title", "year", c.alias("country"), c.alias("status"), c.alias("created_at"), c.alias("updated_at"))
    empty = {n: t.spark.createDataFrame([], schema) for n, schema in I.TABLES.items()}
    store = VersionedTables(t.spark, _folder(t))
    I.begin_catalog(store, empty | {"works": works})
    apply = lambda df, n: I.import_batch(store, I.staged_batch(df), "drops", n)
    T.staging_drop_stream(t.spark, folder, I.STAGED, lambda: store.tables()["works"], apply, _folder(t), files_per_batch=2).awaitTermination()
    new = store.tables()
    links = new["work_category"].join(new["category"].select(F.col("id").alias("category_id"), F.concat_ws(":", "group", "name").alias("category")), "category_id")
    people = new["work_person"].join(new["person"].select(F.col("id").alias("person_id"), F.col("name").alias("person")), "person_id")
    return new["works"].join(people, F.col("id") == people["work_id"]).join(links, F.col("id") == links["work_id"]).select("id", "title", "person", "category")
