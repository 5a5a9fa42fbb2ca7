"""Import of a batch into the catalogue: one plan for all its tables, checked and then made visible at once.

The steps are those of saving one work after another: works, persons, their links, categories,
their links, as set operations on the whole batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import nonblank
from lectern.operators.matching import fk_check
from lectern.operators.upsert import number_text, rebuild_relations, upsert_categories, upsert_persons, upsert_works
from lectern.sources.versions import VersionedTables

TABLES = {
    "works": "id string, title string, year int, country string, status string, created_at string, updated_at string",
    "person": "id long, name string, name_en string, avatar string, person_id string",
    "work_person": "work_id string, person_id long, department string, order int, is_primary boolean, character string",
    "category": "id string, group string, name string, module string, submodule string",
    "work_category": "work_id string, category_id string, order int",
}
#: Departments in the order of a work's credits; others follow.
DEPARTMENTS = ["direction", "writing", "original_work", "cast", "production"]
#: A cast member is a main one up to this place, unless the credit says.
PRIMARY = 10


def _order(rows: DataFrame, key: str, by: list) -> DataFrame:
    """``order`` from 0 within each work: the rows of one work, some hundreds, are one window."""
    return rows.withColumn("order", (F.row_number().over(Window.partitionBy(key).orderBy(*by)) - 1).cast("int"))


def plan_import(old: dict[str, DataFrame], batch: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five tables as they are after the import of a batch: works, credits (work_id, name, name_en, avatar, department, pos, is_primary, character), categories (work_id, group, name, module, submodule, group_rank, pos).

    Works are patched by id, of works twice in a batch the last updated counts. Persons are got by name and Latin name or created,
    with the next numbers and codes; an avatar is filled in. Links of works in the batch are replaced, so a second import
    of the same batch changes nothing. Credits and categories without a name, and those of works that are not in the batch, are left out.
    """
    last = Window.partitionBy("id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("title"))
    new = batch["works"].withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    ids = new.select(F.col("id").alias("work_id"))
    credits = batch["credits"].where(nonblank(F.col("name")).isNotNull()).join(ids, "work_id", "left_semi")
    categories = batch["categories"].where(nonblank(F.col("name")).isNotNull()).join(ids, "work_id", "left_semi")

    people = upsert_persons(credits.withColumn("pos", F.struct("work_id", "pos")), old["person"])
    top = old["person"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.coalesce(F.max(F.regexp_extract("person_id", r"^p(\d+)$", 1).try_cast("long")), F.lit(0)).alias("code"))
    made = people.where("is_new").crossJoin(F.broadcast(top))  # one row
    made = made.select("id", "name", "name_en", "avatar", F.concat(F.lit("p"), number_text(F.col("code") + F.col("id") - F.col("top"))).alias("person_id"))
    given = people.where("not is_new").select("id", F.col("avatar").alias("__avatar"))
    kept = old["person"].join(given, "id", "left").withColumn("avatar", F.coalesce(nonblank(F.col("avatar")), "__avatar")).select("id", "name", "name_en", "avatar", "person_id")
    person = kept.unionByName(made)

    named = people.select(F.col("name").alias("__name"), F.col("name_en").alias("__name_en"), F.col("id").alias("person_id"))
    links = credits.join(named, (F.col("name") == F.col("__name")) & F.col("name_en").eqNullSafe(F.col("__name_en")))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(d) for d in DEPARTMENTS]), F.col("department")), F.lit(0)), F.lit(len(DEPARTMENTS) + 1))
    links = _order(links, "work_id", [rank, "pos", "person_id"])
    primary = F.when(F.col("department") == "cast", F.coalesce("is_primary", F.col("order") < PRIMARY)).otherwise(True)
    links = links.withColumn("is_primary", primary).select(*[c.split()[0] for c in TABLES["work_person"].split(", ")])
    work_person = old["work_person"].join(ids, "work_id", "left_anti").unionByName(links)

    keys = ["group", "name", "module", "submodule"]
    code = F.concat_ws(":", *[F.coalesce(k, F.lit("")) for k in keys])
    category = old["category"].select("id", *keys).unionByName(upsert_categories(categories, old["category"]).select(code.alias("id"), *keys))
    c = category.select(F.col("id").alias("category_id"), *[F.col(k).alias(f"__{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) if k in ("module", "submodule") else F.col(k) == F.col(f"__{k}") for k in keys]
    linked = categories.join(c, on[0] & on[1] & on[2] & on[3]).select("work_id", "category_id", "group_rank", "pos")
    emptied = old["work_category"].join(ids.join(linked.select("work_id").distinct(), "work_id", "left_anti"), "work_id", "left_anti")
    work_category = rebuild_relations(emptied, linked).withColumn("order", F.col("order").cast("int"))
    return {"works": upsert_works(old["works"], new), "person": person, "work_person": work_person, "category": category, "work_category": work_category}


def import_problems(new: dict[str, DataFrame], old: dict[str, DataFrame]) -> DataFrame:
    """(relation, key, n): dangling references, keys given twice, and keys of the old tables that are gone."""
    dangling = fk_check([
        ("work_person.work_id", new["work_person"], "work_id", new["works"], "id"), ("work_person.person_id", new["work_person"], "person_id", new["person"], "id"),
        ("work_category.work_id", new["work_category"], "work_id", new["works"], "id"), ("work_category.category_id", new["work_category"], "category_id", new["category"], "id"),
    ])
    for name in ("works", "person", "category"):
        key = F.col("id").cast("string").alias("key")
        twice = new[name].groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        gone = old[name].select(key).join(new[name].select(key), "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"))
        dangling = dangling.unionByName(twice.select(F.lit(f"{name}.twice").alias("relation"), "key", "n")).unionByName(gone.select(F.lit(f"{name}.gone").alias("relation"), "key", "n"))
    return dangling


def import_counts(new: dict[str, DataFrame], old: dict[str, DataFrame]) -> DataFrame:
    """(relation, n_before, n_after) of each table, and (problem relation, null, n) of each kind of problem."""
    counts = None
    for name in TABLES:
        a, b = old[name].agg(F.count("*").alias("n_before")), new[name].agg(F.count("*").alias("n_after"))
        row = a.crossJoin(b).select(F.lit(name).alias("relation"), "n_before", "n_after")
        counts = row if counts is None else counts.unionByName(row)
    bad = import_problems(new, old).groupBy("relation").agg(F.count("*").alias("n_after"))
    return counts.unionByName(bad.select("relation", F.lit(None).cast("long").alias("n_before"), "n_after"))


class ImportRejected(ValueError):
    """The checks found something; the catalogue is as it was."""


STAGED = "id string, title string, year int, country string, status string, created_at string, updated_at string, credits array<struct<name:string,name_en:string,avatar:string,department:string,is_primary:boolean,character:string>>, genre array<string>, tags array<string>, module string, submodule string"


def staged_batch(staged: DataFrame) -> dict[str, DataFrame]:
    """Rows of STAGED as a batch: credits in their order, genres as types of the work's module, tags without one."""
    work = F.col("id").alias("work_id")
    credits = staged.select(work, F.posexplode("credits").alias("pos", "c")).select("work_id", "c.*", "pos")
    none = F.lit(None).cast("string")
    types = staged.select(work, F.coalesce("module", F.lit("video")).alias("module"), F.coalesce("submodule", F.lit("movie")).alias("submodule"), F.posexplode("genre").alias("pos", "name"))
    tags = staged.select(work, F.posexplode("tags").alias("pos", "name")).select("work_id", none.alias("module"), none.alias("submodule"), "pos", "name")
    both = types.select("*", F.lit("type").alias("group"), F.lit(0).alias("group_rank")).unionByName(tags.select("*", F.lit("tag").alias("group"), F.lit(1).alias("group_rank")))
    return {"works": staged.select(*[c.split()[0] for c in TABLES["works"].split(", ")]), "credits": credits, "categories": both}


def begin_catalog(store: VersionedTables, tables: dict[str, DataFrame]) -> int:
    """The first version, from tables at hand."""
    return store.publish(0, store.stage({n: tables[n] for n in TABLES}), "begin", 0)


def import_batch(store: VersionedTables, batch: dict[str, DataFrame], stream: str = "manual", number: int | None = None) -> int:
    """The catalogue's version after the batch: all five tables written to new folders, checked there, and named by one log entry.

    A batch whose number its stream has already applied is passed over. ImportRejected leaves the old version in place. If another
    writer publishes meanwhile, the plan is made again on its version.
    """
    while True:
        base = store.version()
        if number is not None and store.applied(stream, number):
            return base
        old = store.tables(base)
        at = store.stage(plan_import(old, batch))
        found = import_problems(store.staged(at), old).limit(5).collect()  # a report for the message
        if found:
            raise ImportRejected("; ".join(f"{r.relation} {r.key} ({r.n})" for r in found))
        try:
            return store.publish(base, at, stream, base if number is None else number)
        except FileExistsError:
            continue


def dry_run_import(old: dict[str, DataFrame], batch: dict[str, DataFrame]) -> DataFrame:
    """What an import would make of the catalogue, by the same plan; nothing is written to it."""
    return import_counts(plan_import(old, batch), old)
