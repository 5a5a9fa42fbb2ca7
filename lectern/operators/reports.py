"""Batch reports: progress, completion, preflight, coverage of fields, keys, reviews and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import nonblank


def batch_summary(items: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(status, n, rate) of items, rate to four decimals of all; with ``assets`` (id, state), a row ``local_assets``: items that name a file of ours (any reference that is not external)."""
    total = items.agg(F.count("*").alias("total"))
    rows = items.groupBy("status").agg(F.count("*").alias("n"))
    if assets is not None:
        own = assets.where(F.col("state") != "external").select("id").distinct()
        rows = rows.unionByName(items.join(own, "id", "left_semi").agg(F.lit("local_assets").alias("status"), F.count("*").alias("n")))
    rate = F.coalesce(F.round(F.try_divide("n", "total"), 4), F.lit(0.0))
    return rows.crossJoin(F.broadcast(total)).select("status", "n", rate.alias("rate"))


def source_rates(hits: DataFrame, n_items: DataFrame) -> DataFrame:
    """(source, n, rate): items that have each source."""
    g = hits.groupBy("source").agg(F.countDistinct("id").alias("n"))
    return g.crossJoin(F.broadcast(n_items.agg(F.count("*").alias("total")))).select("source", "n", F.round(F.col("n") / F.col("total"), 4).alias("rate"))


def preflight_report(items: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, state): hint_invalid, then existing, then needs_source_hint, else ready."""
    m = matches.select(F.col("new_id").alias("id"), F.lit(True).alias("known")).distinct()
    hint = nonblank(F.col("hint"))
    state = F.when(hint.isNotNull() & ~hint.rlike(r"^\d+$"), "source_hint_invalid").when(F.col("known"), "existing").when(hint.isNull(), "needs_source_hint").otherwise("ready")
    return items.join(m, "id", "left").select("id", state.alias("state"))


def batch_completion(items: DataFrame, results: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: completed, failed, skipped, rate; a result counts first, then the previous run's."""
    r, p = results.select("id", F.col("status").alias("s1")), previous.select("id", F.col("status").alias("s2"))
    s = items.select("id").join(r, "id", "left").join(p, "id", "left").select(F.coalesce("s1", "s2", F.lit("skipped")).alias("s"))
    done = F.count_if(F.col("s") == "completed")
    return s.agg(done.alias("completed"), F.count_if(F.col("s") == "failed").alias("failed"), F.count_if(F.col("s") == "skipped").alias("skipped"), F.round(done / F.count("*"), 4).alias("rate"))


def staging_summary(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Sizes of the list columns of each record; null lists are empty."""
    return rows.select("id", *[F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(f"n_{c}") for c in lists])


def latest_status(log: DataFrame) -> DataFrame:
    """(item, source, status) by the latest ts (ties to the greater status)."""
    return log.groupBy("item", "source").agg(F.max_by("status", F.struct("ts", "status")).alias("status"))


def progress_summary(latest: DataFrame) -> DataFrame:
    """Per source the items done, with an error, or pending (any other status)."""
    s = F.col("status")
    return latest.groupBy("source").agg(
        F.count_if(s == "done").alias("done"), F.count_if(s == "error").alias("error"), F.count_if(F.coalesce(~s.isin("done", "error"), F.lit(True))).alias("pending")
    )


def next_pending_source(latest: DataFrame, order: list[str]) -> DataFrame:
    """(item, source): the first source of the order that is not done, of items that have one."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("source"))
    return latest.where((F.col("status") != "done") & (pos > 0)).groupBy("item").agg(F.min_by("source", pos).alias("source"))


def json_path(dotted: Column) -> Column:
    """``a.b`` as the path of keys a and b."""
    return F.concat(F.lit("$"), F.array_join(F.transform(F.split(dotted, r"\."), lambda k: F.concat(F.lit("['"), k, F.lit("']"))), ""))


def present(text: Column) -> Column:
    """Whether JSON text is a value: not null, blank, or an empty list or object."""
    return text.isNotNull() & ~text.isin("null", "[]", "{}") & ~text.rlike(r'^"(?:\s|\\[nrt])*"$')


def preview(text: Column, longest: int = 220) -> Column:
    """A JSON text in short: a list as its length and first two items, an object as its number of keys and the first six, others as they are; cut at ``longest``."""
    first = F.filter(F.array(F.get_json_object(text, "$[0]"), F.get_json_object(text, "$[1]")), lambda x: x.isNotNull())
    keys = F.json_object_keys(text)
    short = (
        F.when(text.startswith("["), F.concat(F.json_array_length(text).cast("string"), F.lit(" items: "), F.array_join(first, ", ")))
        .when(text.startswith("{"), F.concat(F.size(keys).cast("string"), F.lit(" keys: "), F.array_join(F.slice(keys, 1, 6), ", ")))
        .when(text.startswith('"'), F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")).otherwise(text)
    )
    return F.concat(F.left(short, F.lit(longest)), F.when(F.length(short) > longest, "...").otherwise(""))


def field_values(payloads: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, source, field, path, value): for each readable payload and each field that ``rules`` (field, source, place, path) seeks in its source, the first path, by place, with a value; nulls if none has one.

    A payload is parsed once, rules are rows: the plan does not grow with them.
    """
    read = payloads.select("id", "source", F.try_parse_json("payload").alias("v")).where(F.col("v").isNotNull() & F.col("source").isNotNull())
    j = read.join(rules.select("field", "source", "place", "path"), "source")
    text = F.to_json(F.try_variant_get("v", json_path(F.col("path")), "variant"))
    tried = j.select("id", "source", "field", "place", "path", text.alias("value"))
    hit = F.when(present(F.col("value")), F.struct("place", "path", "value"))
    return tried.groupBy("id", "source", "field").agg(F.min(hit).alias("h")).select("id", "source", "field", "h.path", "h.value")


def field_coverage(values: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """(id, field, hits, sources, source, path, preview, staged) of ``field_values``: in how many of the sources asked a field has a value, the first such source by name with its path and value in short, and whether the staged record (id, payload) has the field."""
    found = F.when(F.col("path").isNotNull(), F.struct("source", "path", "value"))
    g = values.groupBy("id", "field").agg(F.count("path").alias("hits"), F.count("*").alias("sources"), F.min(found).alias("f"))
    out = g.select("id", "field", "hits", "sources", "f.source", "f.path", preview(F.col("f.value")).alias("preview"))
    if staged is None:
        return out.withColumn("staged", F.lit(None).cast("boolean"))
    s = staged.select("id", F.try_parse_json("payload").alias("v"))
    held = present(F.to_json(F.try_variant_get("v", json_path(F.col("field")), "variant")))
    return out.join(s, "id", "left").select(*out.columns, F.coalesce(held, F.lit(False)).alias("staged"))


def field_totals(values: DataFrame) -> DataFrame:
    """(field, source, hits, total) of ``field_values``."""
    return values.groupBy("field", "source").agg(F.count("path").alias("hits"), F.count("*").alias("total"))


def key_baseline(rows: DataFrame, provenance: DataFrame, allowed: DataFrame, column: str = "payload") -> DataFrame:
    """(id, n_keys, missing_source, extra) of records that are JSON objects: their top-level keys without an entry in ``provenance`` (id, key), and those not in ``allowed`` (key), both sorted."""
    keys = rows.select("id", F.explode_outer(F.json_object_keys(column)).alias("key"), F.json_object_keys(column).isNotNull().alias("object")).where("object").distinct()
    known = provenance.select("id", "key", F.lit(True).alias("known")).distinct()
    j = keys.join(known, ["id", "key"], "left").join(allowed.select("key", F.lit(True).alias("allowed")).distinct(), "key", "left")
    pick = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col("key"))))
    return j.groupBy("id").agg(F.count("key").alias("n_keys"), pick("known").alias("missing_source"), pick("allowed").alias("extra"))


def key_coverage(rows: DataFrame, column: str = "payload") -> DataFrame:
    """(key, n): records that have each top-level key."""
    return rows.select("id", F.explode(F.json_object_keys(column)).alias("key")).distinct().groupBy("key").agg(F.count("*").alias("n"))


def fill_missing_provenance(fields: DataFrame, provenance: DataFrame) -> DataFrame:
    """(id, field, source, note): fields without an entry get ``system``, with a note if their value is an empty list."""
    gone = fields.join(provenance.select("id", "field"), ["id", "field"], "left_anti")
    added = gone.select("id", "field", F.lit("system").alias("source"), F.when(F.trim("value") == "[]", "empty").alias("note"))
    return provenance.select("id", "field", "source", F.lit(None).cast("string").alias("note")).unionByName(added)


def review_coverage(reviews: DataFrame, total: int = 40, each: int = 10, classes: tuple[str, ...] = ("short", "long", "other")) -> DataFrame:
    """(id, n, complete): reviews of (id, kind), complete with ``total`` in all and ``each`` per class."""
    counts = [F.count_if(F.col("kind") == k) for k in classes]
    enough = F.count("*") >= total
    for c in counts:
        enough = enough & (c >= each)
    return reviews.groupBy("id").agg(F.count("*").alias("n"), enough.alias("complete"))


def batch_reconcile(items: DataFrame, works: DataFrame) -> DataFrame:
    """(state, n): input titles that repeat an earlier one, are in the catalogue, or are to be done."""
    w = Window.partitionBy("title").orderBy("position")
    rows = items.withColumn("r", F.row_number().over(w))
    known = works.select("title").distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("r") > 1, "duplicate").when(F.col("known"), "existing").otherwise("actionable")
    return rows.join(known, "title", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def source_scope(items: DataFrame, sources: list[str], platform: str) -> DataFrame:
    """(id, sources): fast web novels take the platform alone, web novels all sources, others all but the platform."""
    all_, rest = (F.array(*[F.lit(s) for s in xs]) for xs in (sources, [s for s in sources if s != platform]))
    web = F.coalesce(F.col("type") == "web_novel", F.lit(False))
    fast = web & F.coalesce(F.col("profile") == "web-novel-fast", F.lit(False))
    return items.select("id", F.when(fast, F.array(F.lit(platform))).when(web, all_).otherwise(rest).alias("sources"))

