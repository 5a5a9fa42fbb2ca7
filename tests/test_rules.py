"""Rules on small hand-made rows: nulls, blanks, ties, repeats, Chinese and Latin values."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars as S
from lectern.functions.names import normalize_name, starter_table, transliterate
from lectern.operators import export as X
from lectern.operators import matching as M
from lectern.operators import merge as G
from lectern.operators import reviews as V
from lectern.operators import upsert as U
from lectern.operators import validate as C


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    "values, rating", [((9.7, 9.3, 8.9, 91.0), 9.3), ((9.7, None, None, None), 9.7), ((None, None, None, None), None), ((8.25, 8.25, 8.25, None), 8.3)]
)
def test_aggregate_rating(spark, values, rating):
    df = spark.createDataFrame([values], "a double, b double, c double, d double")
    assert df.select(X.aggregate_rating(*[F.col(c) for c in "abcd"]).alias("x")).first().x == rating


def test_labels(spark):
    df = spark.createDataFrame([(142,), (None,)], "m int").select(S.runtime_label(F.col("m")).alias("a"), S.timecode(F.col("m")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [("142 分钟", "2:22:00"), ("时长待补充", None)]


@pytest.mark.parametrize(
    "text, name, country", [("[哥伦比亚] 加西亚·马尔克斯", "加西亚·马尔克斯", "哥伦比亚"), ("（美）海明威", "海明威", "美"), ("鲁迅", "鲁迅", None), (" ", "", None)]
)
def test_country_prefix(spark, text, name, country):
    assert one(spark, text, lambda c: S.strip_country_prefix(c)[0]) == name
    assert one(spark, text, lambda c: S.strip_country_prefix(c)[1]) == country


def test_reversed_and_folded_names(spark):
    assert one(spark, "frank darabont", lambda c: S.is_reversed_name(c, F.lit("Darabont Frank")))
    assert not one(spark, "frank", lambda c: S.is_reversed_name(c, F.lit("Frank")))
    assert one(spark, "Penélope  Cruz-1", normalize_name) == "penelopecruz1"
    assert one(spark, None, normalize_name) == ""
    names = spark.createDataFrame([("Adamson Xu",), (" al  ALEX Alexa ",), ("",), (None,)], "name string")
    got = {r.name: r.local for r in transliterate(names, starter_table(spark)).collect()}
    assert got == {"Adamson Xu": "亚当·Xu", " al  ALEX Alexa ": "艾伦·亚历克斯·亚历克斯", "": ""}
    full = spark.createDataFrame([(0, "alex", "A"), (1, "alexander", "B"), (2, "alex", "C"), (3, "ki", "D")], "place long, latin string, local string")
    got = {r.name: r.local for r in transliterate(spark.createDataFrame([("Alexander",), ("alexandra",), ("k",), ("kim",)], "name string"), full).collect()}
    assert got == {"Alexander": "B", "alexandra": "C", "k": "D", "kim": "D"}


def test_chinese_text(spark):
    assert one(spark, "中文 and a few more words", S.is_chinese_text) is False
    assert one(spark, "中文内容 ok", S.is_chinese_text) is True
    assert one(spark, None, S.is_chinese_text) is False
    assert one(spark, "他说…", S.has_truncation) is True


def test_covers_are_a_list_or_a_map(spark):
    df = spark.createDataFrame([(["a.jpg", " ", "c.jpg"], None), (None, {"x": "y"}), (None, None)], "l array<string>, m map<string,string>")
    got = [r.x for r in df.select(X.covers_map(F.col("l"), F.col("m")).alias("x")).collect()]
    assert got == [{"cover1": "a.jpg", "cover3": "c.jpg"}, {"x": "y"}, {}]


def test_authors_keep_first_and_prefer_chinese(spark):
    rows = [(1, 0, "[美] Mark Twain"), (1, 1, "马克·吐温"), (1, 2, "马克吐温"), (2, 0, "Mark Twain"), (2, 1, "mark twain"), (2, 2, " ")]
    got = {r.id: r.authors for r in G.dedupe_authors(spark.createDataFrame(rows, "id int, pos int, name string")).collect()}
    assert got == {1: ["马克·吐温"], 2: ["Mark Twain"]}


def test_excerpts_by_url_and_text(spark):
    items = [("u", "a b"), ("u", "c"), ("", "ab"), ("v", " "), ("", "d"), (None, "d ")]
    df = spark.createDataFrame([(items,), (None,)], "e array<struct<url:string,content:string>>")
    got = [[x.content for x in r.k] for r in df.select(G.dedupe_excerpts(F.col("e")).alias("k")).collect()]
    assert got == [["a b", "d"], []]


def test_first_accepted_candidate_wins(spark):
    western = spark.createDataFrame([(1, 7, "Frank Darabont")], "work_id int, western_id int, name string")
    local = [(1, 2, 1, "甲", "frank darabont"), (1, 1, 0, "乙", "Darabont Frank"), (1, 3, 2, "丙", None)]
    local = spark.createDataFrame(local, "work_id int, local_id int, position int, name string, name_en string")
    assert M.person_match(western, local).first().local_id == 1


def test_book_upsert_is_idempotent_and_follows_isbn(spark):
    ddl = "id string, title string, isbn string, scores string, publisher string, status string, updated_at string"
    old = spark.createDataFrame([("1", "A", "978", '{"a":1}', None, "draft", "1")], ddl)
    new = spark.createDataFrame([("9", " ", "978", "[]", "P", "published", "2")], ddl)
    once = U.upsert_books(old, new)
    assert [tuple(r) for r in once.collect()] == [("1", "A", "978", '{"a":1}', "P", "draft", "2")]
    assert once.collect() == U.upsert_books(once, new).collect()


def test_ids_do_not_depend_on_partitions(spark):
    new = spark.range(200).select(F.lit("0101").alias("prefix"), F.col("id").alias("position"))
    have = spark.createDataFrame([("0101000041",)], "id string")
    a = {r.position: r.id for r in U.allocate_ids(new.repartition(7), have).collect()}
    assert a == {r.position: r.id for r in U.allocate_ids(new.coalesce(1), have).collect()}
    assert a[0] == "0101000042" and a[199] == "0101000241"


def test_apply_stops_after_the_first_failure(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, True)], "run_id int, position int, ok boolean")
    assert sorted((r.run_id, r.position) for r in U.apply_until_failure(rows).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_category_scope_compares_nulls(spark):
    ddl = "group string, name string, module string, submodule string"
    have = spark.createDataFrame([("tag", "x", None, None)], ddl)
    want = spark.createDataFrame([("tag", "x", None, None), ("tag", "x", "book", None), ("tag", "x", "book", None)], ddl)
    assert [r.module for r in U.upsert_categories(want, have).collect()] == ["book"]


def test_next_id_problem_is_forgiven_in_a_row(spark):
    ddl = "id int, errors array<string>, problems array<string>, notes array<string>, consecutive boolean, anchor_id string, n_authors_listed int, n_authors int"
    rows = [(1, [], [C.NEXT_ID], [], True, "5", 1, 2), (2, [], [C.NEXT_ID], [], False, "5", 1, 1), (3, [], [], [], True, None, 0, 9), (4, [], [], [], True, "5", 1, 3)]
    got = {r.id: r.status for r in C.classify_item(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: "ready", 2: "failed", 3: "needs_review", 4: "needs_review"}


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "work_id string, id string, department string, order int, is_primary boolean, name string")
    assert X.group_credits(rows).count() == 0
    assert G.dedupe_authors(spark.createDataFrame([], "id int, pos int, name string")).count() == 0


def test_tokens_cut_chinese_runs_into_pairs(spark):
    df = spark.createDataFrame([("很好看 The movie, ok a",), (None,)], "text string")
    assert [r.tokens for r in V.tokenize_reviews(df).collect()] == [["很好", "好看", "movie", "ok"], []]
