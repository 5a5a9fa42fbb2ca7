"""Validation and quality gates: every check yields an array of problems, so checks combine by concat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import has_truncation, is_chinese_text, nonblank


def problems(*checks: tuple[Column, str]) -> Column:
    """Messages of the conditions that hold (null counts as not)."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))


def source_integrity(rows: DataFrame) -> DataFrame:
    """(id, problems) of douban_id, imdb_id, tmdb_id, baike_url, baike_id: formats, and the id that the address carries."""
    url_id = F.nullif(F.regexp_extract("baike_url", r"/(\d+)/?(?:[?#].*)?$", 1), F.lit(""))
    p = problems(
        (nonblank(F.col("douban_id")).isNotNull() & ~F.col("douban_id").rlike(r"^\d+$"), "douban_id"),
        (nonblank(F.col("imdb_id")).isNotNull() & ~F.col("imdb_id").rlike(r"^tt\d+$"), "imdb_id"),
        (nonblank(F.col("tmdb_id")).isNotNull() & ~F.col("tmdb_id").rlike(r"^\d+$"), "tmdb_id"),
        (nonblank(F.col("baike_url")).isNotNull() & url_id.isNull(), "baike_url"),
        (url_id.isNotNull() & nonblank(F.col("baike_id")).isNotNull() & (url_id != F.col("baike_id")), "baike_id"),
    )
    return rows.select("id", p.alias("problems"))


def resolve_profile(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, profile, error): by schema_type (an error if module or submodule disagree), else by module and submodule, else the default.

    ``profiles``: profile, schema_type, module, submodule, is_default, a few rows.
    """
    p = F.broadcast(profiles)  # a row per media profile
    by_type = p.select(F.col("schema_type"), F.col("profile").alias("p1"), F.col("module").alias("m1"), F.col("submodule").alias("s1"))
    by_scope = p.groupBy("module", "submodule").agg(F.min("profile").alias("p2"))
    default = p.where("is_default").agg(F.min("profile").alias("p3"))
    j = items.join(by_type, "schema_type", "left").join(by_scope, ["module", "submodule"], "left").crossJoin(default)
    clash = F.col("p1").isNotNull() & ((F.col("module").isNotNull() & (F.col("module") != F.col("m1"))) | (F.col("submodule").isNotNull() & (F.col("submodule") != F.col("s1"))))
    return j.select("id", F.coalesce("p1", "p2", "p3").alias("profile"), F.when(clash, "profile_conflict").alias("error"))


def missing_fields(rows: DataFrame, fields: list[str]) -> Column:
    return problems(*[(nonblank(F.col(f).cast("string")).isNull(), f) for f in fields])


def required_fields(rows: DataFrame, by_profile: dict[str, list[str]]) -> DataFrame:
    """(id, profile, missing): required fields of the row's profile without a value."""
    missing = F.lit(None).cast("array<string>")
    for profile, fields in by_profile.items():
        missing = F.when(F.col("profile") == profile, missing_fields(rows, fields)).otherwise(missing)
    return rows.select("id", "profile", F.coalesce(missing, F.array().cast("array<string>")).alias("missing"))


def enhancement_fields(rows: DataFrame, episodes: DataFrame, characters: DataFrame) -> DataFrame:
    """(id, missing): stills and videos empty, fewer episode texts than episodes, no character with a name."""
    e = episodes.where(nonblank(F.col("text")).isNotNull()).groupBy("work_id").agg(F.countDistinct("episode").alias("n_ep"))
    c = characters.where(nonblank(F.col("character")).isNotNull()).groupBy("work_id").agg(F.count("*").alias("n_ch"))
    j = rows.join(e, rows["id"] == e["work_id"], "left").drop("work_id").join(c, rows["id"] == c["work_id"], "left").drop("work_id")
    n_ep, n_ch = F.coalesce("n_ep", F.lit(0)), F.coalesce("n_ch", F.lit(0))
    p = problems((n_ep < F.coalesce("episode_count", F.lit(1)), "episodes"), (n_ch == 0, "characters"))
    return j.select("id", p.alias("missing"))


def precheck_media(items: DataFrame, matches: DataFrame, expected: DataFrame, missing_assets: DataFrame, integrity: DataFrame, required: DataFrame) -> DataFrame:
    """(id, status, problems) from matches (update items must match, new ones must not), expected ids, assets, integrity, required fields."""
    m = matches.groupBy(F.col("new_id").alias("id")).agg(F.count("*").alias("n_match"))
    a = missing_assets.groupBy("id").agg(F.count("*").alias("n_missing"))
    j = items.join(m, "id", "left").join(a, "id", "left").join(expected, "id", "left")
    j = j.join(integrity.select("id", F.col("problems").alias("p1")), "id", "left").join(required.select("id", F.col("missing").alias("p2")), "id", "left")
    n = F.coalesce("n_match", F.lit(0))
    own = problems(
        (F.col("update") & (n == 0), "nothing_to_update"),
        (~F.col("update") & (n > 0), "exists"),
        (~F.col("update") & (F.col("expected_id") != F.col("id")), "unexpected_id"),
        (F.coalesce("n_missing", F.lit(0)) > 0, "missing_assets"),
    )
    none = F.array().cast("array<string>")
    all_ = F.concat(own, F.coalesce("p1", none), F.transform(F.coalesce("p2", none), lambda x: F.concat(F.lit("missing:"), x)))
    return j.select("id", F.when(F.size(all_) == 0, "ok").otherwise("failed").alias("status"), F.array_join(all_, ",").alias("problems"))


def precheck_books(items: DataFrame, matches: DataFrame, shape: DataFrame, content: DataFrame) -> DataFrame:
    """(id, status, problems, warnings) from matches, staging shape and content quality."""
    m = matches.groupBy(F.col("new_id").alias("id")).agg(F.count("*").alias("n_match"))
    j = items.join(m, "id", "left").join(shape.select("id", F.col("problems").alias("p1")), "id", "left").join(content.select("id", F.col("problems").alias("p2"), "warnings"), "id", "left")
    none = F.array().cast("array<string>")
    all_ = F.concat(problems((F.coalesce("n_match", F.lit(0)) > 0, "exists")), F.coalesce("p1", none), F.coalesce("p2", none))
    return j.select("id", F.when(F.size(all_) == 0, "ok").otherwise("failed").alias("status"), F.array_join(all_, ",").alias("problems"), F.array_join(F.coalesce("warnings", none), ",").alias("warnings"))


def staging_shape(rows: DataFrame, column: str = "payload") -> DataFrame:
    """(id, problems) of staging JSON texts: no JSON object, serialised JSON inside strings, no _meta object, tags that are no list."""
    p = F.col(column)
    valid = F.coalesce(F.try_parse_json(p).isNotNull() & p.rlike(r"^\s*\{"), F.lit(False))
    meta, tags = F.get_json_object(p, "$._meta"), F.get_json_object(p, "$.tags")
    return rows.select(
        "id",
        problems(
            (~valid, "not_an_object"),
            (valid & p.rlike(r':\s*"\s*[\[{]\\?"'), "serialised_json"),
            (valid & (meta.isNull() | ~meta.startswith("{")), "no_meta"),
            (valid & tags.isNotNull() & ~tags.startswith("["), "tags_not_a_list"),
        ).alias("problems"),
    )


def content_quality(rows: DataFrame) -> DataFrame:
    """(id, problems, warnings, n_dup_excerpts) of summary and story: missing, not Chinese, cut short; lenient for web novels and non-fiction."""
    p, w = [], []
    for f in ("summary", "story"):
        c = F.col(f)
        blank = nonblank(c).isNull()
        lenient = F.col("kind").isin("web_novel", "non_fiction") if f == "story" else F.lit(False)
        p += [(blank & ~lenient, f"{f}_missing"), (~blank & ~is_chinese_text(c), f"{f}_not_chinese"), (~blank & has_truncation(c), f"{f}_truncated")]
        w += [(blank & lenient, f"{f}_missing")]
    keys = F.transform(F.coalesce("excerpts", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"\s+", ""))
    return rows.select("id", problems(*p).alias("problems"), problems(*w).alias("warnings"), (F.size(keys) - F.size(F.array_distinct(keys))).alias("n_dup_excerpts"))


NEXT_ID = "unexpected_id"


def classify_item(items: DataFrame) -> DataFrame:
    """(id, status) from arrays errors, problems, notes, author counts and consecutive: failed, needs_review or ready.

    The next-id problem is forgiven if the batch numbers its items in a row; one
    author more than listed is tolerated; a missing anchor id is a note.
    """
    blocking = F.filter("problems", lambda x: ~((x == NEXT_ID) & F.col("consecutive")))
    extra = (F.col("n_authors_listed") > 0) & (F.col("n_authors") > F.col("n_authors_listed") + 1)
    noted = (F.size("notes") > 0) | nonblank(F.col("anchor_id")).isNull() | extra
    status = F.when((F.size("errors") > 0) | (F.size(blocking) > 0), "failed").when(noted, "needs_review").otherwise("ready")
    return items.select("id", status.alias("status"), F.size(blocking).alias("n_blocking"))


def profile_quality_gate(items: DataFrame) -> DataFrame:
    """(id, status): for fast web novels a missing author blocks; missing raw source, cover and story are notes."""
    fast = (F.col("type") == "web_novel") & (F.col("profile") == "web-novel-fast")
    story = F.array_contains("problems", "story_missing")
    blocking = F.size(F.filter("problems", lambda x: ~(fast & (x == "story_missing")))) + F.when(fast & (F.col("n_authors") <= 0), 1).otherwise(0)
    notes = F.when(fast, (~F.col("has_raw")).cast("int") + (F.col("n_covers") <= 0).cast("int") + story.cast("int")).otherwise(0)
    return items.select("id", F.when(blocking > 0, "failed").when(notes > 0, "needs_review").otherwise("ready").alias("status"))


def record_contract(rows: DataFrame, required: list[str], allowed: list[str], column: str = "payload") -> DataFrame:
    """(id, missing, unexpected): top-level keys of a JSON text against a contract."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    return rows.select("id", F.array_sort(F.array_except(lit(required), keys)).alias("missing"), F.array_sort(F.array_except(keys, lit([*required, *allowed]))).alias("unexpected"))


def record_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, same, different, missing, extra): counts of keys of (id, key, value) rows against a baseline."""
    a, b = left.select("id", "key", F.col("value").alias("a"), F.lit(True).alias("in_a")), right.select("id", "key", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    j = a.join(b, ["id", "key"], "full")
    both = F.col("in_a") & F.col("in_b")
    return j.groupBy("id").agg(
        F.count_if(both & F.col("a").eqNullSafe(F.col("b"))).alias("same"), F.count_if(both & ~F.col("a").eqNullSafe(F.col("b"))).alias("different"),
        F.count_if(F.col("in_a").isNull()).alias("missing"), F.count_if(F.col("in_b").isNull()).alias("extra"),
    )


def quality_gate(contract: DataFrame, reviews: DataFrame, strict: bool = False) -> DataFrame:
    """(id, errors, warnings, passed): contract findings are errors; thin reviews are warnings, or errors if strict."""
    j = contract.join(reviews, "id", "left")
    thin = ~F.coalesce("complete", F.lit(False))
    hard = problems((F.size("missing") > 0, "missing_keys"), (F.size("unexpected") > 0, "unexpected_keys"), (thin & F.lit(strict), "reviews"))
    soft = problems((thin & F.lit(not strict), "reviews"))
    return j.select("id", F.array_join(hard, ",").alias("errors"), F.array_join(soft, ",").alias("warnings"), (F.size(hard) == 0).alias("passed"))


def catalog_integrity(pairs: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(check_name, left_n, right_n, agree) of row counts that must be equal."""
    out = None
    for name, a, b in pairs:
        row = a.agg(F.count("*").alias("left_n")).crossJoin(b.agg(F.count("*").alias("right_n"))).select(F.lit(name).alias("check_name"), "left_n", "right_n", (F.col("left_n") == F.col("right_n")).alias("agree"))
        out = row if out is None else out.unionAll(row)
    return out


def coerce_payload(rows: DataFrame, numeric: list[str], json_columns: list[str]) -> DataFrame:
    """Blank to null, numbers cast, and ``rejected``: columns whose text is no number or no JSON."""
    bad = [(nonblank(F.col(c)).isNotNull() & F.col(c).try_cast("double").isNull(), c) for c in numeric]
    bad += [(nonblank(F.col(c)).isNotNull() & F.try_parse_json(c).isNull(), c) for c in json_columns]
    out = rows.withColumn("rejected", F.array_join(problems(*bad), ","))
    return out.withColumns({c: nonblank(F.col(c)).try_cast("double") for c in numeric} | {c: nonblank(F.col(c)) for c in json_columns})
