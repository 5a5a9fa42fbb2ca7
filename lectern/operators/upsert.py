"""Catalogue change as set operations: ids, get-or-create, patches, relations, reclassification.

Sequential get-or-create becomes distinct + anti join + allocation; every tie
has an explicit order, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import nonblank
from lectern.sources.scratch import written

EMPTY = ("[]", "{}")


def number_text(n: Column, digits: int = 6) -> Column:
    """A number with leading zeros up to ``digits`` places; a longer one stays whole."""
    text = n.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def allocate_ids(new: DataFrame, existing: DataFrame, digits: int = 6) -> DataFrame:
    """(prefix, position, ...) -> id: prefix and consecutive numbers after the largest present, by position.

    Numbers are given per prefix by block counts and offsets, so a huge prefix is
    not numbered in one task: a block is a hash bucket of range-ordered positions.
    """
    top = existing.groupBy(F.substring("id", 1, 4).alias("prefix")).agg(F.max(F.expr("substring(id, 5)").try_cast("long")).alias("top"))
    block = F.floor(F.col("position") / 65536).alias("block")
    rows = new.select("*", block)
    sizes = rows.groupBy("prefix", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("prefix").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("prefix", "block", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("prefix", "block").orderBy("position"))
    out = rows.withColumn("number", number).join(sizes, ["prefix", "block"]).join(top, "prefix", "left")
    n = F.coalesce("top", F.lit(0)) + F.col("before") + F.col("number")
    return out.withColumn("id", F.concat("prefix", number_text(n, digits))).drop("block", "number", "before", "top")


def next_person_id(person: DataFrame) -> DataFrame:
    """One row: ``p`` and the largest number of such codes plus one, six digits at least."""
    n = F.regexp_extract("person_id", r"^p(\d+)$", 1).try_cast("long")
    return person.agg(F.concat(F.lit("p"), number_text(F.coalesce(F.max(n), F.lit(0)) + 1)).alias("next_id"))


def patch(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], keep: list[str], fill: list[str], blank_is_null: bool = False) -> DataFrame:
    """Upsert: ``overwrite`` takes the new value, ``fill`` the new one if not null, ``keep`` never changes; others keep the old.

    With ``blank_is_null`` blank texts and empty JSON containers count as null.
    """
    n = new.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in [*overwrite, *keep, *fill]])
    j = old.withColumn("__old", F.lit(True)).join(n, key, "full")
    given = lambda c: nonblank(F.when(~F.col(c).isin(*EMPTY), F.col(c))) if blank_is_null and dict(j.dtypes)[c] == "string" else F.col(c)
    values = {c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in overwrite}
    values |= {c: F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}")) for c in keep}
    values |= {c: F.coalesce(given(f"__{c}"), F.col(c)) for c in fill}
    return j.select(*[values.get(c, F.col(c)).alias(c) for c in old.columns])


def upsert_works(old: DataFrame, new: DataFrame) -> DataFrame:
    """Title and updated_at overwritten, year and country filled, status and created_at kept."""
    return patch(old, new, "id", ["title", "updated_at"], ["status", "created_at"], ["year", "country"])


def upsert_books(old: DataFrame, new: DataFrame) -> DataFrame:
    """As works, blanks and empty containers as null; a book with a known ISBN goes to that book's id."""
    by_isbn = old.where(nonblank(F.col("isbn")).isNotNull()).groupBy("isbn").agg(F.min("id").alias("isbn_id"))
    target = new.join(by_isbn, "isbn", "left").withColumn("id", F.coalesce("isbn_id", "id")).drop("isbn_id")
    last = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("title"))
    target = target.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    return patch(old, target, "id", ["updated_at"], ["status"], ["title", "publisher", "isbn", "scores"], blank_is_null=True)


def upsert_persons(credits: DataFrame, person: DataFrame) -> DataFrame:
    """Get-or-create by identity (name and Latin name, or name alone): (name, name_en, id, is_new); attributes fill from the first credit that has them.

    New ids follow the largest by name order.
    """
    ident = credits.groupBy("name", "name_en").agg(F.min_by("avatar", F.when(nonblank(F.col("avatar")).isNotNull(), F.col("pos"))).alias("avatar"))
    known = person.groupBy("name", "name_en").agg(F.min("id").alias("known_id"))
    j = ident.join(known, (ident["name"] == known["name"]) & ident["name_en"].eqNullSafe(known["name_en"]), "left").select(ident["name"], ident["name_en"], "avatar", "known_id")
    fresh = j.where("known_id is null").select("name", "name_en")
    top = person.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    number = numbered(fresh, F.struct("name", "name_en"))
    ids = number.crossJoin(F.broadcast(top)).select("name", "name_en", (F.col("top") + F.col("n")).alias("new_id"))
    out = j.join(ids.withColumnRenamed("name", "n1").withColumnRenamed("name_en", "n2"), (F.col("name") == F.col("n1")) & F.col("name_en").eqNullSafe(F.col("n2")), "left")
    return out.select("name", "name_en", "avatar", F.coalesce("known_id", "new_id").alias("id"), F.col("known_id").isNull().alias("is_new"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with n = 1.. in ``order`` over the whole table: range partitions, their counts, offsets. No task sees all rows.

    The partition numbers are written once, as they would differ between two evaluations.
    """
    keyed = written(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    local = keyed.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = local.groupBy("__p").agg(F.max("__i").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    return local.join(F.broadcast(sizes.select("__p", before.alias("__b"))), "__p").withColumn("n", F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def avatar_paths(url: Column, code: Column) -> tuple[Column, Column, Column]:
    """(path, western path, local path) of a stored avatar, by the address it came from."""
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"(?i)\.(jpe?g|png|webp)(?:\?|$)", 1)), F.lit("")), F.lit("jpg"))
    western, local = F.coalesce(url.contains("tmdb"), F.lit(False)), F.coalesce(url.contains("douban"), F.lit(False))
    name = lambda suffix: F.concat(F.lit("avatars/"), code, F.lit(suffix), F.lit("."), ext)
    return F.when(url.isNotNull(), name("")), F.when(western, name("-tmdb")), F.when(local, name("-douban"))


def upsert_categories(wanted: DataFrame, category: DataFrame) -> DataFrame:
    """Categories (group, name, module, submodule) that are not there yet; scopes compare null with null."""
    keys = ["group", "name", "module", "submodule"]
    w, c = wanted.select(*keys).distinct().alias("w"), category.select(*keys).alias("c")
    on = (F.col("w.group") == F.col("c.group")) & (F.col("w.name") == F.col("c.name"))
    for k in ("module", "submodule"):
        on = on & F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}"))
    return w.join(c, on, "left_anti")


def rebuild_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links (work_id, category_id, order): those of works in ``new`` are replaced, numbered from 0 by (group_rank, pos); a link twice keeps its lowest order."""
    touched = new.select("work_id").distinct()
    first = new.groupBy("work_id", "category_id").agg(F.min(F.struct("group_rank", "pos")).alias("p"))
    order = (F.row_number().over(Window.partitionBy("work_id").orderBy("p", "category_id")) - 1).alias("order")
    return old.join(touched, "work_id", "left_anti").select("work_id", "category_id", "order").unionByName(first.select("work_id", "category_id", order))


def upsert_series(books: DataFrame, series: DataFrame) -> DataFrame:
    """(book_id, name, series_id, series_order): series by name, new ones numbered after the largest by name; order within a series by book."""
    names = books.where(nonblank(F.col("series_name")).isNotNull()).select(F.col("series_name").alias("name")).distinct()
    fresh = names.join(series.select("name"), "name", "left_anti").withColumn("prefix", F.lit("0299"))
    fresh = numbered(fresh, F.col("name")).withColumnRenamed("n", "position")
    ids = allocate_ids(fresh, series).select("name", "id").unionByName(series.select("name", "id"))
    linked = books.join(ids, books["series_name"] == ids["name"]).select(books["id"].alias("book_id"), "name", ids["id"].alias("series_id"))
    return linked.withColumn("series_order", F.row_number().over(Window.partitionBy("series_id").orderBy("book_id")))


def append_order(links: DataFrame) -> DataFrame:
    """(work_id, next_order): one more than the largest order of each work."""
    return links.groupBy("work_id").agg((F.coalesce(F.max("order"), F.lit(-1)) + 1).alias("next_order"))


def tag_backfill(works: DataFrame, links: DataFrame, category_id: int) -> DataFrame:
    """New links of the category for works without it, appended after each work's last."""
    missing = works.select(F.col("id").alias("work_id")).join(links.where(F.col("category_id") == category_id).select("work_id"), "work_id", "left_anti")
    return missing.join(append_order(links), "work_id", "left").select("work_id", F.lit(category_id).alias("category_id"), F.coalesce("next_order", F.lit(0)).alias("order"))


def reclassify_plan(works: DataFrame, targets: DataFrame) -> DataFrame:
    """(old_id, new_id, kind): works of each kind get new ids prefix + number by old id order.

    ``works`` has id and kind, ``targets`` kind, prefix and first (the number before).
    """
    wanted = works.select("id", "kind").join(F.broadcast(targets), "kind")  # a row per kind
    n = written(numbered(wanted, F.struct("kind", "id")))
    before = n.groupBy("kind").agg((F.min("n") - 1).alias("before"))
    j = n.join(F.broadcast(before), "kind").withColumn("n", F.col("n") - F.col("before"))  # a row per kind
    return j.select(F.col("id").alias("old_id"), F.concat("prefix", number_text(F.col("first") + F.col("n"))).alias("new_id"), "kind")


def reclassify_preflight(plan: DataFrame, works: DataFrame) -> DataFrame:
    """(problem, id): new ids in use by other works, new ids given twice, old ids that do not exist."""
    ids = works.select("id").distinct()
    used = plan.select(F.col("new_id").alias("id")).join(ids, "id", "left_semi").join(plan.select(F.col("old_id").alias("id")), "id", "left_anti").distinct()
    twice = plan.groupBy(F.col("new_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    gone = plan.select(F.col("old_id").alias("id")).join(ids, "id", "left_anti")
    parts = [df.select(F.lit(p).alias("problem"), "id") for p, df in (("id_in_use", used), ("id_twice", twice), ("no_source", gone))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def reclassify_apply(rows: DataFrame, plan: DataFrame, column: str = "id") -> DataFrame:
    """Any table with its work id column re-pointed by the plan."""
    p = plan.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))
    return rows.join(p, rows[column] == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


#: A string under the key "id" of an object. Inside a JSON string quotes are escaped, so a bare quote after a brace or comma begins a key.
ID_VALUE = r'([{,]\s*+"id"\s*+:\s*+)"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def rewrite_related_ids(rows: DataFrame, plan: DataFrame, column: str = "related") -> DataFrame:
    """``rows`` (id, ``column``: JSON text, ...) with ids replaced wherever a key "id" holds one, at any depth; ``changed`` tells which rows.

    All else of the text stays as it is: other keys, strings that quote an id, numbers, spaces. Null, empty and invalid texts stay, as do rows without an id.
    The ids are joined with the plan as rows, so neither side has to fit anywhere.
    """
    ids = F.regexp_extract_all(column, F.lit(ID_VALUE), F.lit(2))
    asked = rows.select("id", F.explode(F.array_distinct(ids)).alias("old_id"))
    pairs = asked.join(plan.select("old_id", "new_id"), "old_id").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("old_id", "new_id"))).alias("__new"))
    j = rows.join(pairs, "id", "left").withColumn("changed", F.col("__new").isNotNull() & F.try_parse_json(column).isNotNull())
    between = F.split(F.regexp_replace(column, ID_VALUE, "$1\u0001"), "\u0001")  # a bare control character is in no valid JSON
    named = F.transform(ids, lambda x: F.concat(F.lit('"'), F.coalesce(F.col("__new")[x], x), F.lit('"')))
    text = F.concat(F.get(between, F.lit(0)), F.array_join(F.zip_with(named, F.slice(between, F.lit(2), F.size(ids)), lambda a, b: F.concat(a, b)), ""))
    return j.withColumn(column, F.when(F.col("changed"), text).otherwise(F.col(column))).select(*rows.columns, "changed")


def apply_id_renames(items: DataFrame, renames: DataFrame) -> DataFrame:
    """Batch items with their new id; ``renamed_from`` holds the old one."""
    r = renames.select(F.col("old_id").alias("id"), "new_id")
    j = items.join(r, "id", "left")
    return j.withColumn("renamed_from", F.when(F.col("new_id").isNotNull(), F.col("id"))).withColumn("id", F.coalesce("new_id", "id")).drop("new_id")


def assign_existing_or_new_id(items: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    """Ranked items (rank, source_id): the id of the known source id, else the next new one in rank order."""
    k = known.where("source_id is not null").groupBy("source_id").agg(F.min("id").alias("known_id"))
    j = items.join(k, "source_id", "left")
    fresh = j.where("known_id is null").select("source_id", F.lit(prefix).alias("prefix"), F.col("rank").cast("long").alias("position"))
    ids = allocate_ids(fresh, known.select("id")).select("source_id", F.col("id").alias("new_id"))
    return j.join(ids, "source_id", "left").select("rank", "source_id", F.coalesce("known_id", "new_id").alias("id"), F.col("known_id").isNull().alias("is_new"))


def apply_until_failure(results: DataFrame) -> DataFrame:
    """Rows (run_id, position, ok) up to and with the first failure of each run; ``applied`` marks the successes."""
    failed = results.where(~F.col("ok")).groupBy("run_id").agg(F.min("position").alias("__f"))
    reached = F.col("__f").isNull() | (F.col("position") <= F.col("__f"))
    return results.join(failed, "run_id", "left").where(reached).select(*results.columns, F.col("ok").alias("applied"))


def ranked_slice(items: DataFrame, n: int = 250) -> DataFrame:
    """The first n (250 at most) by rank, nulls last."""
    return items.orderBy(F.asc_nulls_last("rank"), "id").limit(min(n, 250))
