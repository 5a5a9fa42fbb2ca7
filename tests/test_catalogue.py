"""Imports as versions, ids, JSON ids, hot joins, pages, assets, coverage, transliteration tables and the progress stream on small rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import export as X
from lectern.operators import importing as I
from lectern.operators import matching as M
from lectern.operators import reports as R
from lectern.operators import upsert as U
from lectern.sources import io as IO
from lectern.sources.versions import VersionedTables
from lectern.streaming import streams as T


def tables(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), ddl) for n, ddl in I.TABLES.items()}


CREDITS = "work_id string, name string, name_en string, avatar string, department string, pos int, is_primary boolean, character string"
CATEGORIES = "work_id string, group string, name string, module string, submodule string, group_rank int, pos int"


def batch(spark, works=(), credits=(), categories=()):
    return {"works": spark.createDataFrame(list(works), I.TABLES["works"]), "credits": spark.createDataFrame(list(credits), CREDITS), "categories": spark.createDataFrame(list(categories), CATEGORIES)}


@pytest.fixture()
def store(spark, tmp_path):
    s = VersionedTables(spark, f"file://{tmp_path}/catalogue")
    old = tables(
        spark,
        works=[("1", "One", 2000, None, "draft", "a", "a"), ("2", "Two", None, None, "draft", "a", "a")],
        person=[(7, "Ann", None, None, "p999999")], work_person=[("1", 7, "cast", 0, True, None), ("2", 7, "cast", 0, True, None)],
        category=[("t1", "type", "Drama", "video", "movie")], work_category=[("1", "t1", 0), ("2", "t1", 0)],
    )
    assert I.begin_catalog(s, old) == 1
    return s


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_import_of_a_batch_makes_one_version(spark, store):
    b = batch(
        spark, [("1", "One!", None, "FR", "x", "b", "b"), ("3", "Three", 2001, None, "draft", "b", "b")],
        [("1", "Bob", "Bob B", "b.jpg", "direction", 5, None, None), ("1", "Ann", None, "a.jpg", "cast", 0, False, "Eve"), ("3", " ", None, None, "cast", 0, None, None), ("9", "Lost", None, None, "cast", 0, None, None)],
        [("1", "tag", "New", None, None, 1, 0), ("1", "type", "Drama", "video", "movie", 0, 3), ("3", "type", "Drama", "video", None, 0, 0)],
    )
    assert I.import_batch(store, b, "s", 4) == 2
    t = store.tables()
    assert rows(t["works"], "id", "title", "year", "country", "status", "created_at") == [("1", "One!", 2000, "FR", "draft", "a"), ("2", "Two", None, None, "draft", "a"), ("3", "Three", 2001, None, "draft", "b")]
    assert rows(t["person"], "id", "name", "avatar", "person_id") == [(7, "Ann", "a.jpg", "p999999"), (8, "Bob", "b.jpg", "p1000000")]
    assert rows(t["work_person"], "work_id", "person_id", "order", "is_primary", "character") == [("1", 7, 1, False, "Eve"), ("1", 8, 0, True, None), ("2", 7, 0, True, None)]
    assert rows(t["work_category"], "work_id", "category_id", "order") == [("1", "t1", 0), ("1", "tag:New::", 1), ("2", "t1", 0), ("3", "type:Drama:video:", 0)]
    before = {n: rows(df, *df.columns) for n, df in t.items()}
    assert I.import_batch(store, b, "s", 4) == 2  # a replay is passed over
    assert I.import_batch(store, b, "s", 5) == 3  # the same batch again changes nothing
    assert {n: rows(df, *df.columns) for n, df in store.tables().items()} == before
    assert rows(store.tables(1)["works"], "id") == [("1",), ("2",)]  # older versions stay


def test_a_failed_check_leaves_the_version(spark, store, monkeypatch):
    bad = lambda old, new: old | {"works": old["works"].where("id <> '2'")}
    monkeypatch.setattr(I, "plan_import", bad)
    with pytest.raises(I.ImportRejected, match="work_category.work_id 2|work_person.work_id 2|works.gone 2"):
        I.import_batch(store, batch(spark))
    assert store.version() == 1 and rows(store.tables()["works"], "id") == [("1",), ("2",)]
    found = I.import_problems(bad(store.tables(), None), store.tables())
    assert {(r.relation, r.key) for r in found.collect()} == {("work_person.work_id", "2"), ("work_category.work_id", "2"), ("works.gone", "2")}


def test_two_writers(spark, store):
    at = store.stage({"person": spark.createDataFrame([(7, "Ann", None, None, "p7"), (9, "x", None, None, None)], I.TABLES["person"])})
    assert store.publish(1, at, "a", 0) == 2
    with pytest.raises(FileExistsError):
        store.publish(1, at, "b", 0)
    assert store.version() == 2 and not store.applied("b", 0)
    assert I.import_batch(store, batch(spark, [("5", "Five", None, None, None, None, None)]), "b", 0) == 3  # planned on the version of the other


def test_dry_run_counts_by_the_same_plan(spark, store):
    b = batch(spark, [("3", "Three", None, None, None, None, None)], [("3", "Zoe", None, None, "cast", 0, None, None)])
    got = {r.relation: (r.n_before, r.n_after) for r in I.dry_run_import(store.tables(), b).collect()}
    assert got == {"works": (2, 3), "person": (1, 2), "work_person": (2, 3), "category": (1, 1), "work_category": (2, 2)} and store.version() == 1
    assert {r.relation for r in I.dry_run_import(tables(spark), batch(spark)).collect()} == set(I.TABLES)


def test_numbers_beyond_six_digits(spark):
    new = spark.createDataFrame([("0101", i) for i in range(4)], "prefix string, position long")
    old = spark.createDataFrame([("0101999998",)], "id string")
    assert [r.id for r in U.allocate_ids(new, old).orderBy("position").collect()] == ["0101999999", "01011000000", "01011000001", "01011000002"]
    more = spark.createDataFrame([("01011000002",)], "id string")
    assert [r.id for r in U.allocate_ids(new.limit(1), old.union(more)).collect()] == ["01011000003"]
    assert U.next_person_id(spark.createDataFrame([("p999999",), ("x",)], "person_id string")).first().next_id == "p1000000"
    works = spark.createDataFrame([("a", "k"), ("b", "k")], "id string, kind string")
    plan = U.reclassify_plan(works, spark.createDataFrame([("k", "0301", 999_998)], "kind string, prefix string, first int"))
    assert [r.new_id for r in plan.orderBy("old_id").collect()] == ["0301999999", "03011000000"]


def deep(value, ids):
    if isinstance(value, list):
        return [deep(x, ids) for x in value]
    if isinstance(value, dict):
        return {k: ids[v] if k == "id" and isinstance(v, str) and v in ids else deep(v, ids) for k, v in value.items()}
    return value


def test_ids_are_rewritten_at_any_depth(spark):
    ids = {"a1": "b1", "a2": "b2", 'q"\\': "no"}
    values = [
        [{"id": "a1", "x": {"id": ["a1", {"id": "a2"}], "note": '{"id": "a1"}, "id":"a2"'}}, "a1", {"ids": "a1", "Id": "a1"}], {"id": 5, "k": {"id": "other"}}, {"list": [[{"id": "a2"}]], '"id': "a1", "id ": "a1"},
        {"e": "\\", "id": "a1"}, {"id": "a1", "t": "x,"}, [], {}, "a1", {"id": {"id": "a2"}}, {"a": 'say, "id": ', "id": "a2"},
    ]
    texts = [json.dumps(v) for v in values] + [json.dumps(v, indent=2) for v in values] + [None, "", "broken {\"id\":\"a1\"", json.dumps({"id": "a1", "long": "é" * 200_000})]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)] + [(None, '{"id":"a1"}', "kept")], "id long, related string, extra string")
    plan = spark.createDataFrame(list(ids.items()), "old_id string, new_id string")
    got = U.rewrite_related_ids(df, plan).collect()
    assert len(got) == len(texts) + 1 and all(r.extra == "kept" for r in got)
    for r in got:
        if r.id is None:
            assert (r.related, r.changed) == ('{"id":"a1"}', False)
            continue
        t = texts[r.id]
        try:
            want = deep(json.loads(t), ids)
        except (TypeError, ValueError):
            assert (r.related, r.changed) == (t, False)
            continue
        assert json.loads(r.related) == want and r.changed == (want != json.loads(t)) and (r.changed or r.related == t)


def test_a_hot_title_is_many_tasks_work(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = spark.range(9000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("title"), F.lit(None).cast("int").alias("year"))
        old = new.where("id % 2000 = 0")
        on = [("t", [("title", "title")], [("year", "year")])]
        left, right = (df.select(F.col("id").alias(n), "title") for df, n in ((new, "n"), (old, "o")))
        split = M.split_join(left, right, ["title"], least=100)
        most = split.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("n").alias("c")).agg(F.max("c")).first()[0]
        plain = left.join(right, "title").groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("n").alias("c")).agg(F.max("c")).first()[0]
        assert plain >= 3000 and most <= 600
        assert rows(split, "n", "o") == rows(left.join(right, "title"), "n", "o")
        pairs = M.match_pairs(new, old, on, least=100)
        assert pairs.count() == left.join(right, "title").count() and pairs.where("reasons <> 't'").count() == 0
    finally:
        for k in ("adaptive.enabled", "shuffle.partitions", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{k}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("find", [M.existing_match, M.manifest_match])
def test_pairs_of_single_ids_are_not_shuffled(spark, find):
    works = spark.range(600).select(F.col("id").cast("string").alias("id"), F.lit("Same").alias("title"), F.lit("Same").alias("title_original"), F.lit(None).cast("int").alias("year"))
    works = works.select("*", F.lit("db").alias("source"), F.lit("1").alias("source_id"))
    got = find(works, works)
    above = str(got._jdf.queryExecution().executedPlan()).split("Join")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    assert got.count() == 600 * 600 and got.select("new_id", "old_id").distinct().count() == 600 * 600
    if find is M.existing_match:
        assert {(r.same, r.reasons) for r in got.select((F.col("new_id") == F.col("old_id")).alias("same"), "reasons").distinct().collect()} == {
            (True, "id|original_year|source|title_year"), (False, "original_year|source|title_year"),
        }


def works_of(spark, r, ids, n):
    pick = lambda *values: r.choice(values)
    rows = [(ids(k), pick("A", "B", "C", None), pick("A", "B", None), pick(1999, 2000, None), pick("db", "tm", None), pick("1", "2", "3", None)) for k in range(n)]
    rows += rows[:3]  # rows that come twice
    return rows, spark.createDataFrame(rows, "id string, title string, title_original string, year int, source string, source_id string")


@pytest.mark.parametrize("ids", [lambda k: str(k), lambda k: None if k % 4 == 0 else str(k % 20)], ids=["single", "repeated or null"])
def test_pairs_equal_all_comparisons(spark, ids):
    import random

    r = random.Random(5)
    (new, new_df), (old, old_df) = works_of(spark, r, ids, 30), works_of(spark, r, ids, 25)
    same = lambda a, b: a is not None and a == b
    want, listed = {}, set()
    for a in new:
        for b in old:
            met = [("id", same(a[0], b[0])), ("source", same(a[4], b[4]) and same(a[5], b[5])), ("title_year", same(a[1], b[1]) and a[3] == b[3]), ("original_year", same(a[2], b[2]) and a[3] == b[3])]
            want.setdefault((a[0], b[0]), set()).update(x for x, y in met if y)
            if (same(a[1], b[1]) or same(a[1], b[2])) and (a[3] is None or a[3] == b[3]):
                listed.add((a[0], b[0]))
    got = [(x.new_id, x.old_id, x.reasons) for x in M.existing_match(new_df, old_df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(*k, "|".join(sorted(v))) for k, v in want.items() if v}
    got = [(x.new_id, x.old_id) for x in M.manifest_match(new_df, old_df).collect()]
    assert len(got) == len(set(got)) and set(got) == listed


def test_pages_of_one_index(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("n"), F.when(F.col("id") % 5 > 0, F.col("id") % 10).alias("year"))
    index = X.page_index(df, F.desc_nulls_last("year"), "id")
    want = [r.id for r in df.orderBy(F.desc_nulls_last("year"), "id").collect()]
    got = [r.id for p in range(1, 10) for r in index.page(p, 12).collect()]
    assert got == want and index.pages(12) == 9
    last = index.page(99, 12)
    assert last.columns == ["id", "n", "year", "page", "pages"] and [r.id for r in last.collect()] == want[96:] and last.first().page == 9
    assert "PushedFilters: [IsNotNull(__n), GreaterThan(__n,96), LessThanOrEqual(__n,108)]" in last._jdf.queryExecution().toString()
    assert X.page_index(df.limit(0), "id").page(3, 24).count() == 0


def test_archive_order_for_any_partitioning(spark):
    e = spark.createDataFrame([(str(i), "m" if i % 3 else None, None if i % 4 == 0 else str(i % 2), None if i % 5 == 0 else i % 11, i) for i in range(300)], "id string, module string, submodule string, year int, n int")
    want = {}
    for m in ("m", None):
        own = [r for r in e.collect() if r.module == m]
        own.sort(key=lambda r: (r.submodule is not None, r.submodule or "", r.year is None, -(r.year or 0), r.id))
        want |= {r.id: i + 1 for i, r in enumerate(own)}
    for parts in (1, 7):
        out = X.archive_order(e.repartition(parts))
        assert {r.id: r.position for r in out.collect()} == want and set(out.columns) == {*e.columns, "position"}


def test_assets_are_found_in_the_schema(spark):
    ddl = "id string, module string, submodule string, images struct<poster:string, stills:array<string>, covers:map<string,string>>, cast array<struct<name:string, avatarPath:string>>, seasons array<struct<episodes:array<struct<thumbnail:string, title:string>>>>, title string"
    row = ("1", "video", "movie", ("p.jpg", [None, " ", "s.jpg", "s.jpg"], {"a": "c.jpg", "b": None}), [("x", "a\\b.jpg"), None, ("y", " ")], [None, ([("t.jpg", "no"), None],), (None,)], "no.jpg")
    got = M.asset_refs(spark.createDataFrame([row, ("2", None, None, None, None, None, None)], ddl))
    assert rows(got, "kind", "path") == [
        ("cast.avatarPath", "a/b.jpg"), ("images.covers", "video/movie/1/c.jpg"), ("images.poster", "video/movie/1/p.jpg"), ("images.stills", "video/movie/1/s.jpg"), ("seasons.episodes.thumbnail", "video/movie/1/t.jpg")
    ]
    assert M.asset_refs(spark.createDataFrame([("1", "x")], "id string, title string")).count() == 0


def test_coverage_of_odd_payloads(spark):
    p = spark.createDataFrame(
        [("1", "a", '{"x": {"y": "  "}, "z": [1, {"k": 2}, 3]}'), ("1", "b", '{"x": false}'), ("1", "c", "["), ("2", "a", None), ("2", "b", '{"x": {"' + '":1,"'.join("abcdefgh") + '":1}}'), (None, "a", '{"z": "' + "w" * 300 + '"}'), ("3", None, "{}")],
        "id string, source string, payload string",
    )
    rules = spark.createDataFrame([("f", "a", 2, "z"), ("f", "a", 1, "x.y"), ("f", "b", 1, "x.y.z"), ("f", "b", 2, "x"), ("g", "a", 1, "no")], "field string, source string, place int, path string")
    got = {(r.id, r.field): tuple(r[2:]) for r in R.field_coverage(R.field_values(p, rules)).collect()}
    assert got[("1", "f")] == (2, 2, "a", "z", '3 items: 1, {"k":2}', None)
    assert got[("2", "f")] == (1, 1, "b", "x", "8 keys: a, b, c, d, e, f", None)
    assert got[("1", "g")] == (0, 1, None, None, None, None)
    assert got[(None, "f")][4] == "w" * 220 + "..."
    assert R.field_values(p, rules.limit(0)).count() == 0
    base = R.key_baseline(p.where("source = 'b' or payload = '['"), spark.createDataFrame([("1", "x")], "id string, key string"), spark.createDataFrame([("y",)], "key string"))
    assert rows(base, "id", "n_keys", "missing_source", "extra") == [("1", 1, [], ["x"]), ("2", 1, ["x"], ["x"])]


def test_transliteration_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"Zed": "泽德", "adam": "亚当", "": "x"}, ensure_ascii=False))
    (tmp_path / "b.csv").write_text("# note, not an entry\nben, 本\nadam,阿丹\n\nbroken\n")
    got = IO.read_transliterations(spark, str(tmp_path)).orderBy("place")
    assert [tuple(r) for r in got.collect()] == [(0, "zed", "泽德"), (1, "adam", "亚当"), (2, "ben", "本"), (3, "adam", "阿丹")]


def test_progress_stream_late_expired_and_replayed(spark, tmp_path):
    t0, folder = datetime(2024, 1, 1), tmp_path / "in"
    at = lambda h: t0 + timedelta(hours=h)
    ddl = "item string, source string, status string, ts timestamp"

    def drop(n, rows_):
        spark.createDataFrame(rows_, ddl).coalesce(1).write.parquet(f"{folder}/{n}")

    def run(out, checkpoint):
        updates = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        T.progress_sink(T.progress_stream(updates, late="2 hours", idle_minutes=24 * 60), f"file://{tmp_path}/{out}", f"file://{tmp_path}/{checkpoint}").awaitTermination()

    drop(1, [("a", "s", "done", at(1)), ("a", "s", "error", at(0)), ("b", "s", "pending", at(1)), (None, "s", "x", at(1)), ("c", "s", None, at(1))])
    run("out", "cp")
    drop(2, [("b", "s", "done", at(30)), ("a", "s", "old", at(0.5))])
    run("out", "cp")
    drop(3, [("b", "s", "late", at(2)), ("d", "s", "pending", at(30))])  # behind the watermark by more than two hours
    run("out", "cp")
    last = T.progress_table(spark, f"file://{tmp_path}/out")
    got = {r.item: (r.status, r.open) for r in last.collect()}
    assert got == {"a": ("done", False), "b": ("done", True), "c": (None, False), "d": ("pending", True)}
    drop(4, [("a", "s", "pending", at(31))])  # it comes back
    run("out", "cp")
    assert {r.item: (r.status, r.open) for r in T.progress_table(spark, f"file://{tmp_path}/out").collect()}["a"] == ("pending", True)
    batches = sorted((tmp_path / "out").glob("batch=*"))
    again = spark.read.parquet(str(batches[0]))
    before = rows(T.progress_table(spark, f"file://{tmp_path}/out"), "item", "status", "open")
    keep = again.toPandas()
    spark.createDataFrame(keep, T.PROGRESS).write.mode("overwrite").parquet(str(batches[0]))
    assert rows(T.progress_table(spark, f"file://{tmp_path}/out"), "item", "status", "open") == before
