"""Many sources to one record: priorities, provenance, conflicts, ordered de-duplication, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import author_key, has_cjk, is_chinese_text, nonblank, normalize_country, series_key, strip_country_prefix, text_key


def keep_first(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key, by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def merge_first_valid(obs: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """(id, field, source, value) -> (id, field, value, source): the first non-blank value by source rank.

    ``priority`` ranks sources (unlisted ones after); without it a ``rank`` column is used.
    """
    if priority is not None:
        rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("source")), F.lit(1 << 20))
        obs = obs.withColumn("rank", rank)
    valid = obs.where(nonblank(F.col("value")).isNotNull())
    best = F.min(F.struct("rank", "source", "value")).alias("b")
    return valid.groupBy("id", "field").agg(best).select("id", "field", F.col("b.value").alias("value"), F.col("b.source").alias("source"))


def merge_wide(obs: DataFrame, fields: dict[str, list[str]], sources: list[str]) -> DataFrame:
    """One row per id: each field from its own source order; one shuffle, a pivot of the payload columns.

    ``obs`` has id, source and the field columns, one row per (id, source).
    """
    aggs = [F.max(F.when(F.col("source") == s, nonblank(F.col(f).cast("string")))).alias(f"{f}__{s}") for f in fields for s in sources]
    wide = obs.groupBy("id").agg(*aggs)
    return wide.select("id", *[F.coalesce(*[F.col(f"{f}__{s}") for s in order]).alias(f) for f, order in fields.items()])


def field_conflicts(obs: DataFrame, merged: DataFrame, most: float) -> DataFrame:
    """(id, field, source, value, winner): numeric values of other sources that differ from the winner by more than ``most``."""
    m = merged.select("id", "field", F.col("value").alias("winner"), F.col("source").alias("winner_source"))
    far = F.abs(F.col("value").try_cast("double") - F.col("winner").try_cast("double")) > most
    return obs.join(m, ["id", "field"]).where((F.col("source") != F.col("winner_source")) & far).select("id", "field", "source", "value", "winner")


def book_conflicts(obs: DataFrame) -> DataFrame:
    """Per id the conflicts of rows (id, rank, year, summary, title_original): year off by more than one, summary under half as long, another original title."""
    w = Window.partitionBy("id").orderBy("rank")
    first = lambda c: F.first(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = obs.withColumns({f"w_{c}": first(c) for c in ("year", "summary", "title_original")})
    a, b = F.length("summary"), F.length("w_summary")
    found = F.array_compact(
        F.array(
            F.when(F.abs(F.col("year") - F.col("w_year")) > 1, F.lit("year")),
            F.when(F.least(a, b) < 0.5 * F.greatest(a, b), F.lit("summary")),
            F.when(F.col("title_original") != F.col("w_title_original"), F.lit("title_original")),
        )
    )
    return rows.select("id", "rank", F.explode(found).alias("conflict"))


def media_conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Works of two sources whose runtime differs by more than five minutes or whose year differs."""
    j = left.select("id", F.col("runtime").alias("l_runtime"), F.col("year").alias("l_year")).join(right.select("id", F.col("runtime").alias("r_runtime"), F.col("year").alias("r_year")), "id")
    runtime, year = F.abs(F.col("l_runtime") - F.col("r_runtime")) > 5, F.col("l_year") != F.col("r_year")
    return j.select("id", F.coalesce(runtime, F.lit(False)).alias("runtime_conflict"), F.coalesce(year, F.lit(False)).alias("year_conflict")).where("runtime_conflict or year_conflict")


def book_overrides(rows: DataFrame) -> DataFrame:
    """Exceptions to first-wins: first-edition year, original title of the wiki, platform word count, title cut to the platform's if that is contained."""
    shorter = nonblank(F.col("platform_title")).isNotNull() & F.col("title").contains(F.trim("platform_title"))
    return rows.select(
        "id",
        F.when(shorter, F.trim("platform_title")).otherwise(F.col("title")).alias("title"),
        F.coalesce("first_edition_year", "year").alias("year"),
        F.coalesce(nonblank(F.col("wiki_original")), F.col("title_original")).alias("title_original"),
        F.coalesce("platform_words", "word_count").alias("word_count"),
    )


def web_novel_rules(rows: DataFrame) -> DataFrame:
    """Web novels take the summary from platform then encyclopedia and the story from the top content, Chinese and not cut short; else null."""
    from lectern.functions.scalars import has_truncation

    good = lambda c: F.when(is_chinese_text(F.col(c)) & ~has_truncation(F.col(c)), F.trim(c))
    web = F.coalesce((nonblank(F.col("platform_url")).isNotNull()) | F.col("status").rlike("起点|连载|完结"), F.lit(False))
    return rows.select(
        "id",
        web.alias("is_web_novel"),
        F.when(web, F.coalesce(good("platform_summary"), good("baike_summary"))).otherwise(F.col("summary")).alias("summary"),
        F.when(web, good("top_content")).otherwise(F.col("story")).alias("story"),
    )


def merge_reviews(*groups: tuple[str, Column]) -> Column:
    """One array of (source, content) over review arrays in the given order; null arrays are empty."""
    empty = F.array().cast("array<struct<source:string,content:string>>")

    def labelled(name: str, arr: Column) -> Column:
        return F.coalesce(F.transform(arr, lambda x: F.struct(F.lit(name).alias("source"), x.alias("content"))), empty)

    return F.concat(*[labelled(name, arr) for name, arr in groups])


def merge_genres(*texts: Column, cjk_only: bool = True) -> Column:
    """Items of several delimited texts, in order, distinct; CJK ones only by default."""
    items = F.flatten(F.array(*[F.split(F.coalesce(t, F.lit("")), r"[、,，/;；|]") for t in texts]))
    items = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: (x != "") & (has_cjk(x) if cjk_only else F.lit(True)))
    return F.array_distinct(items)


def dedupe_authors(rows: DataFrame) -> DataFrame:
    """(id, pos, name) -> (id, authors): country prefix off, one per key in first order; if any has CJK, those only."""
    clean, _ = strip_country_prefix(F.col("name"))
    r = rows.where(nonblank(F.col("name")).isNotNull()).withColumn("clean", clean).withColumn("key", author_key(F.col("clean")))
    first = r.groupBy("id", "key").agg(F.min(F.struct("pos", "clean")).alias("f"))
    g = first.groupBy("id").agg(F.array_sort(F.collect_list("f")).alias("fs"), F.max(has_cjk(F.col("f.clean"))).alias("any_cjk"))
    names = F.transform("fs", lambda x: x["clean"])
    return g.select("id", F.when(F.col("any_cjk"), F.filter(names, has_cjk)).otherwise(names).alias("authors"))


def country_from_authors(rows: DataFrame) -> DataFrame:
    """(id, pos, name) -> (id, country) of the first name with a country prefix."""
    _, country = strip_country_prefix(F.col("name"))
    r = rows.withColumn("country", normalize_country(country)).where("country is not null")
    return r.groupBy("id").agg(F.min_by("country", F.struct("pos", "country")).alias("country"))


#: Link texts that are no series, and a site whose links are not.
NOISE_SERIES = ["novelupdatesenglishtranslationpage", "englishtranslationpage"]


def series_candidates(rows: DataFrame) -> DataFrame:
    """(id, title, pos, name, url) -> the first candidate of each (id, name, url) that is not blank, noise, or the title itself; ``is_series`` marks each id's first."""
    key = series_key(F.col("name"))
    ok = (nonblank(F.col("name")).isNotNull()) & (key != series_key(F.col("title"))) & ~key.isin(NOISE_SERIES) & ~F.coalesce(F.lower("url").contains("novelupdates.com"), F.lit(False))
    kept = keep_first(rows.where(ok), ["id", "name", "url"], "pos")
    return kept.withColumn("is_series", F.row_number().over(Window.partitionBy("id").orderBy("pos", "name")) == 1)


def external_sources(*entries: tuple[str, Column, Column]) -> Column:
    """Array of (name, id, link) in the given order, without those that have neither id nor link."""
    return F.array_compact(
        F.array(*[F.when(nonblank(i).isNotNull() | nonblank(u).isNotNull(), F.struct(F.lit(n).alias("name"), nonblank(i).alias("id"), nonblank(u).alias("link"))) for n, i, u in entries])
    )


def related_map(similar: Column, recommended: Column) -> Column:
    """Non-blank similar titles, else the recommended ones."""
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(clean(similar)) > 0, clean(similar)).otherwise(clean(recommended))


def dedupe_excerpts(items: Column) -> Column:
    """Keep an excerpt (url, content) unless its url or its text without white space is kept already; blank texts go. Order stays."""
    empty = F.array().cast("array<struct<url:string,content:string>>")

    def step(kept, x):
        url = nonblank(x["url"])
        seen = F.exists(kept, lambda k: (F.trim(k["url"]) == url) | (text_key(k["content"]) == text_key(x["content"])))
        return F.when(nonblank(x["content"]).isNull() | F.coalesce(seen, F.lit(False)), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(F.coalesce(items, empty), empty, step)


def cast_slices(rows: DataFrame, first: int = 10) -> DataFrame:
    """(work_id, pos, name) -> order, is_primary (the first ten by position)."""
    order = F.row_number().over(Window.partitionBy("work_id").orderBy("pos", "name")) - 1
    return rows.withColumn("order", order).withColumn("is_primary", F.col("order") < first)


def merge_crew(western: DataFrame, local: DataFrame, matches: DataFrame) -> DataFrame:
    """Western credits with their match, then the local ones that matched nothing; ``origin`` is merged, western or local."""
    m = western.select("work_id", "western_id", F.col("name").alias("name_en")).join(matches, ["work_id", "western_id"], "left")
    x = local.select("work_id", "local_id", F.col("name").alias("local_name"))
    j = m.join(x, ["work_id", "local_id"], "full")
    origin = F.when(F.col("western_id").isNull(), "local").when(F.col("local_name").isNull(), "western").otherwise("merged")
    return j.select("work_id", "western_id", "local_id", F.coalesce("local_name", "name_en").alias("name"), origin.alias("origin"))


def merge_credits_single(rows: DataFrame) -> DataFrame:
    """(work_id, side, pos, name) of works with credits of one side only, or both: origin, order, primary."""
    sides = F.array_join(F.array_sort(F.collect_set("side").over(Window.partitionBy("work_id"))), "+")
    order = F.row_number().over(Window.partitionBy("work_id", "side").orderBy("pos", "name")) - 1
    return rows.withColumn("sides", sides).withColumn("order", order).withColumn("is_primary", F.col("order") < 10)


def normalize_episode(e: Column) -> Column:
    """(episode, text): number parsed, text from story, else plot; blank text is null."""
    return F.struct(e["episode"].try_cast("int").alias("episode"), F.coalesce(nonblank(e["story"]), nonblank(e["plot"])).alias("text"))


def build_characters(cast: DataFrame) -> DataFrame:
    """(work_id, pos, actor, character) -> characters by first position, one per (character, actor), blanks out."""
    return keep_first(cast.where(nonblank(F.col("character")).isNotNull()), ["work_id", "character", "actor"], "pos")


def best_episode(rows: DataFrame, scored: bool = False) -> DataFrame:
    """(work_id, episode, group_rank, pos, text, source): per numbered episode the longest text, first on ties; unnumbered ones all stay, empty texts go.

    ``scored``: 1000 more for source ``plot``, 10000 less for texts with play or download words.
    """
    r = rows.where(nonblank(F.col("text")).isNotNull())
    score = F.length("text")
    if scored:
        score = score + F.when(F.col("source") == "plot", 1000).otherwise(0) - F.when(F.col("text").rlike("播放|下载|展开全部"), 10000).otherwise(0)
    numbered = keep_first(r.where("episode is not null"), ["work_id", "episode"], F.desc(score), "group_rank", "pos")
    return numbered.unionByName(r.where("episode is null"))


def best_season(rows: DataFrame) -> DataFrame:
    """(work_id, season, language, lang_rank, n_episodes, n_text, target): per work a complete season first, else most episodes with text; seasons over 0, exact counts first."""
    complete = (F.col("n_text") >= F.col("target")).cast("int")
    exact = (F.col("n_episodes") == F.col("target")).cast("int")
    return keep_first(rows.where("season > 0"), ["work_id"], F.desc(complete), F.desc("n_text"), F.desc(exact), "season", "lang_rank")


def missing_episodes(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, missing): numbers of 1..episode_count without a text."""
    have = rows.where(nonblank(F.col("text")).isNotNull()).groupBy("work_id").agg(F.collect_set("episode").alias("have"))
    j = counts.join(have, counts["id"] == have["work_id"], "left").where("episode_count > 0")
    return j.select("id", F.array_except(F.sequence(F.lit(1), F.col("episode_count")), F.coalesce("have", F.array().cast("array<int>"))).alias("missing"))


def episodes_exact(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, exact): the episode set is 1..episode_count, or not empty if the count is unknown."""
    have = rows.groupBy("work_id").agg(F.array_sort(F.collect_set("episode")).alias("have"))
    j = counts.join(have, counts["id"] == have["work_id"], "left")
    known = F.col("episode_count") > 0
    exact = F.when(known, F.col("have") == F.sequence(F.lit(1), F.greatest("episode_count", F.lit(1)))).otherwise(F.size("have") > 0)
    return j.select("id", F.coalesce(exact, F.lit(False)).alias("exact"))


def split_out_of_scope(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows with ``in_scope``: the episode does not exceed the work's count (unknown counts and numbers are in scope)."""
    j = rows.join(counts.select(F.col("id").alias("work_id"), "episode_count"), "work_id", "left")
    return j.withColumn("in_scope", F.coalesce(F.col("episode") <= F.col("episode_count"), F.lit(True))).drop("episode_count")


def earliest_country(rows: DataFrame) -> DataFrame:
    """(work_id, date, place) -> place of the earliest release that is no festival or premiere, else of the earliest."""
    festival = F.coalesce(F.col("place").rlike("电影节|首映|festival|premiere"), F.lit(False)).cast("int")
    return rows.groupBy("work_id").agg(F.min_by("place", F.struct(festival, "date", "place")).alias("country"))


def infer_country(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(work_id, kind, pos, place) -> country by the first rule (pattern, country) on theatrical releases, then on any."""
    country = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        country = F.when(F.col("place").rlike(pattern), name).otherwise(country)
    r = rows.withColumn("country", country).where("country is not null")
    rank = F.when(F.col("kind") == "theatrical", 0).otherwise(1)
    return r.groupBy("work_id").agg(F.min_by("country", F.struct(rank, "pos", "country")).alias("country"))


def backfill_enhancements(existing: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """Existing and found episodes, best per number and within the count; per work kept, out of scope, missing."""
    best = best_episode(existing.unionByName(found)).where("episode is not null")
    scoped = split_out_of_scope(best, counts)
    g = scoped.groupBy("work_id").agg(F.count_if("in_scope").alias("kept"), F.count_if(~F.col("in_scope")).alias("out_of_scope"))
    j = counts.join(g, counts["id"] == g["work_id"], "left")
    kept = F.coalesce("kept", F.lit(0))
    return j.select("id", kept.alias("kept"), F.coalesce("out_of_scope", F.lit(0)).alias("out_of_scope"), F.greatest(F.col("episode_count") - kept, F.lit(0)).alias("missing"))
