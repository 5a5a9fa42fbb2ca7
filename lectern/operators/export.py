"""Catalogue export: credits and categories per work, ratings, entries, list and search rows, facets.

Every function takes and returns DataFrames. Ordered collections carry an
explicit order key and are sorted inside the group, never globally.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import entry_path, has_cjk, nonblank, round1, web_url
from lectern.operators.upsert import numbered
from lectern.sources.scratch import written

PLACEHOLDER = "/assets/poster-placeholder.svg"


def active_catalog(works: DataFrame, modules: list[str] | None = None) -> DataFrame:
    """Works that are not archived, optionally of some modules."""
    out = works.where(F.col("status") != "archived")
    return out.where(F.col("module").isin(modules)) if modules else out


def credits_join(work_person: DataFrame, person: DataFrame) -> DataFrame:
    """Credit rows with their person's name and code; credits without a person are left out."""
    p = person.select(F.col("id").alias("person_id"), "name", "name_en", F.col("person_id").alias("person_code"))
    return work_person.join(p, "person_id")


def categories_join(links: DataFrame, category: DataFrame) -> DataFrame:
    c = category.select(F.col("id").alias("category_id"), "group", "name")
    return links.join(c, "category_id")


def in_order(when: Column, value: Column, *keys: Column) -> Column:
    """Values of the rows that meet ``when``, collected in key order."""
    rows = F.collect_list(F.when(when, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))))
    return F.transform(F.array_sort(rows), lambda x: x["v"])


def group_credits(credits: DataFrame) -> DataFrame:
    """Per work: director, writer, cast, other_cast and producer names in credit order."""
    d, keys = F.col("department"), (F.col("order"), F.col("id"))
    cast = d == "cast"
    return credits.groupBy("work_id").agg(
        in_order(d == "direction", F.col("name"), *keys).alias("director"),
        in_order(d.isin("writing", "original_work"), F.col("name"), *keys).alias("writer"),
        in_order(cast & F.col("is_primary"), F.col("name"), *keys).alias("cast"),
        in_order(cast & ~F.col("is_primary"), F.col("name"), *keys).alias("other_cast"),
        in_order(d == "production", F.col("name"), *keys).alias("producer"),
    )


def group_categories(links: DataFrame, key: str = "work_id") -> DataFrame:
    """Per work: genre (group ``type``) and tags (group ``tag``) in link order."""
    keys = (F.col("order"), F.col("name"))
    return links.groupBy(key).agg(
        in_order(F.col("group") == "type", F.col("name"), *keys).alias("genre"), in_order(F.col("group") == "tag", F.col("name"), *keys).alias("tags")
    )


def group_book_people(people: DataFrame) -> DataFrame:
    """Per book: translators, and authors (everybody else)."""
    keys, tr = (F.col("order"), F.col("name")), F.coalesce(F.col("role") == "translator", F.lit(False))
    return people.groupBy("book_id").agg(in_order(~tr, F.col("name"), *keys).alias("authors"), in_order(tr, F.col("name"), *keys).alias("translators"))


def group_book_categories(links: DataFrame) -> DataFrame:
    """As group_categories, names with a CJK character only."""
    return group_categories(links.where(has_cjk(F.col("name"))), "book_id")


def book_relations_join(books: DataFrame, series: DataFrame, people: DataFrame, categories: DataFrame) -> DataFrame:
    """Books with series name, authors, translators, genre and tags; what is missing is null or empty."""
    s = series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name"))
    out = books.join(s, "series_id", "left")
    for grouped, names in ((group_book_people(people), ("authors", "translators")), (group_categories(categories, "book_id"), ("genre", "tags"))):
        out = out.join(grouped, out["id"] == grouped["book_id"], "left").drop("book_id")
        for n in names:
            out = out.withColumn(n, F.coalesce(n, F.array().cast("array<string>")))
    return out


def entry_assembly(works: DataFrame, credits: DataFrame, categories: DataFrame) -> DataFrame:
    """Works with grouped credits and categories; missing groups become empty arrays."""
    out = works
    for grouped in (credits, categories):
        names = [c for c in grouped.columns if c != "work_id"]
        out = out.join(grouped, out["id"] == grouped["work_id"], "left").drop("work_id")
        out = out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in names})
    return out


def compact_people(credits: DataFrame, directors: int = 3, cast: int = 4) -> DataFrame:
    """Per work the first directors and cast names."""
    g = group_credits(credits)
    return g.select("work_id", F.slice("director", 1, directors).alias("directors"), F.slice(F.concat("cast", "other_cast"), 1, cast).alias("cast"))


def merged_credit_names(credits: DataFrame) -> DataFrame:
    """Per work: directors and writers merged by person, ``name（label / label）`` joined by `` / `` in first order."""
    label = F.when(F.col("department") == "direction", F.lit("导演")).when(F.col("department").isin("writing", "original_work"), F.lit("编剧"))
    rows = credits.withColumn("label", label).where(F.col("label").isNotNull())
    rank = F.when(F.col("label") == "导演", 0).otherwise(1)
    pos = F.struct(rank, F.col("order"), F.col("id"))
    per = rows.groupBy("work_id", "person_code", "name").agg(F.min(pos).alias("pos"), F.sort_array(F.collect_set(F.struct(rank.alias("r"), "label"))).alias("ls"))
    name = F.concat("name", F.lit("（"), F.array_join(F.transform("ls", lambda x: x["label"]), " / "), F.lit("）"))
    per = per.withColumn("shown", name)
    return per.groupBy("work_id").agg(F.array_join(in_order(F.lit(True), F.col("shown"), F.col("pos"), F.col("name")), " / ").alias("names"))


def credits_carousel(credits: DataFrame) -> DataFrame:
    """One row per work and person key (code, else Latin name, else name): labels in order, first non-null character.

    Actors without a role are left out.
    """
    key = F.coalesce(nonblank(F.col("person_code")), nonblank(F.col("name_en")), F.col("name"))
    rows = credits.where(~((F.col("department") == "cast") & nonblank(F.col("character")).isNull())).withColumn("key", key)
    pos = F.struct("department", "order", "id")
    return rows.groupBy("work_id", "key").agg(
        F.min("order").alias("first_order"),
        F.array_join(F.array_sort(F.collect_set("department")), "/").alias("labels"),
        F.min_by(F.col("character"), F.when(F.col("character").isNotNull(), pos)).alias("character"),
    )


def _mean_of(*values: Column) -> Column:
    present = F.array_compact(F.array(*values))
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(present) > 0, total / F.size(present))


def aggregate_rating(douban: Column, imdb: Column, tmdb: Column, rotten_tomatoes: Column) -> Column:
    """Mean of the present ratings, the percent one over ten; one decimal, halves up; null if none."""
    return round1(_mean_of(douban, imdb, tmdb, rotten_tomatoes / 10))


def legacy_rating(douban: Column, imdb: Column, tmdb: Column, rotten_tomatoes: Column, metascore: Column) -> Column:
    """The older mean, with the metascore over ten."""
    return round1(_mean_of(douban, imdb, tmdb, rotten_tomatoes / 10, metascore / 10))


def book_aggregate_rating(scores: dict[str, Column], douban: Column, goodreads: Column, openlibrary: Column) -> Column:
    """Mean over the map's four scores and the three columns, so a platform in both counts twice."""
    return round1(_mean_of(*[scores[k] for k in ("douban", "goodreads", "openlibrary", "avg")], douban, goodreads, openlibrary))


def score_avg(*scores: Column) -> Column:
    """Mean of the present scores on their own scales, one decimal."""
    return round1(_mean_of(*scores))


def list_index(entries: DataFrame) -> DataFrame:
    """Flat list row of an entry (id, module, submodule, title, year, poster, ratings, director, cast, genre)."""
    poster = F.concat(F.lit("/assets/"), F.col("module"), F.lit("/"), F.col("submodule"), F.lit("/"), F.col("id"), F.lit("/"), nonblank(F.col("poster")))
    return entries.select(
        "id",
        entry_path(F.col("module"), F.col("submodule"), F.col("id")).alias("path"),
        "title",
        "year",
        F.coalesce(poster, F.lit(PLACEHOLDER)).alias("poster_url"),
        aggregate_rating(*[F.col(c) for c in ("douban", "imdb", "tmdb", "rotten_tomatoes")]).alias("rating"),
        F.nullif(F.array_join("director", " / "), F.lit("")).alias("director_names"),
        F.array_join(F.slice("cast", 1, 3), " / ").alias("cast_preview"),
        F.array_join("genre", "|").alias("genre"),
    )


def book_list_index(entries: DataFrame) -> DataFrame:
    cover = F.concat(F.lit("/assets/book/"), F.col("id"), F.lit("/"), nonblank(F.col("cover")))
    return entries.select(
        "id",
        entry_path(F.lit("book"), F.lit(None).cast("string"), F.col("id")).alias("path"),
        "title",
        "year",
        F.coalesce(cover, F.lit(PLACEHOLDER)).alias("cover_url"),
        F.nullif(F.array_join("authors", " / "), F.lit("")).alias("author_names"),
        F.nullif(F.array_join("translators", " / "), F.lit("")).alias("translator_names"),
        "publisher",
    )


def search_index(entries: DataFrame) -> DataFrame:
    """Row for the site search: aliases fall back to other titles, cast to authors."""
    return entries.select(
        "id",
        entry_path(F.col("module"), F.col("submodule"), F.col("id")).alias("path"),
        "title",
        "module",
        "submodule",
        F.array_join(F.coalesce("aka", "other_titles", F.array().cast("array<string>")), "|").alias("aka"),
        F.array_join(F.coalesce("cast", "authors", F.array().cast("array<string>")), "|").alias("cast"),
    )


def build_media_entry(works: DataFrame) -> DataFrame:
    """The nested entry: identity, path, ratings struct, images struct and texts."""
    return works.select(
        "id",
        entry_path(F.col("module"), F.col("submodule"), F.col("id")).alias("path"),
        F.struct("title", F.col("title_original").alias("originalTitle"), "year", "country").alias("identity"),
        F.struct("douban", "imdb", "tmdb", "rotten_tomatoes").alias("ratings"),
        F.struct(nonblank(F.col("poster")).alias("poster")).alias("images"),
        F.struct(F.col("introduction").alias("text")).alias("synopsis"),
    )


def build_book_entry(books: DataFrame) -> DataFrame:
    """The nested book entry; its douban rating falls back to the average score."""
    return books.select(
        "id",
        F.concat(F.lit("/book/"), "id").alias("path"),
        F.struct("title", "year", "publisher").alias("identity"),
        F.coalesce("douban", "avg").alias("douban_rating"),
        F.when(F.col("series_id").isNotNull(), F.struct("series_id", "series_order")).alias("series"),
    )


def normalize_images(single: Column, items: Column) -> tuple[Column, Column]:
    """(blank to null, trimmed non-blank items)."""
    return nonblank(single), F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def covers_map(as_list: Column, as_map: Column) -> Column:
    """Covers given as a list become ``coverN`` entries (blank files dropped, numbers kept); a map stays."""
    kept = F.filter(F.transform(as_list, lambda x, i: F.struct(F.concat(F.lit("cover"), (i + 1).cast("string")).alias("name"), x.alias("file"))), lambda e: nonblank(e["file"]).isNotNull())
    return F.coalesce(F.map_from_entries(kept), as_map, F.create_map().cast("map<string,string>"))


def normalize_videos(videos: Column) -> Column:
    return F.coalesce(F.transform(videos, lambda v: v.withField("thumbnail", nonblank(v["thumbnail"]))), F.array().cast("array<struct<url:string,thumbnail:string>>"))


def last_source(external: Column, name: Column, field: str) -> Column:
    """Field of the last entry of an external_source array whose name is ``name``."""
    hits = F.filter(external, lambda e: e["name"] == name)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)[field])


def book_source_link(external: Column, name: str) -> Column:
    """Last http(s) link of the entries whose lower-cased name holds ``name``."""
    hits = F.filter(external, lambda e: F.lower(e["name"]).contains(name) & web_url(e["link"]).isNotNull())
    return F.when(F.size(hits) > 0, F.trim(F.element_at(hits, -1)["link"]))


#: Marks in a source's name to the platform that they mean, in the order tried.
SOURCE_MARKS = {
    "豆瓣": "douban", "douban": "douban", "imdb": "imdb", "tmdb": "tmdb", "百度": "baike", "baike": "baike", "维基": "wikipedia", "wikipedia": "wikipedia",
    "openlibrary": "openlibrary", "goodreads": "goodreads", "当当": "dangdang", "起点": "qidian", "isbn": "isbn",
}


def source_key(name: Column) -> Column:
    low, out = F.lower(name), F.lit(None).cast("string")
    for mark, platform in reversed(SOURCE_MARKS.items()):
        out = F.when(low.contains(mark), platform).otherwise(out)
    return out


def source_id_map(rows: DataFrame) -> DataFrame:
    """(id, pos, name, value) of external sources -> (id, source, source_id): the last position wins, blanks dropped."""
    known = rows.withColumn("source", source_key(F.col("name"))).where(F.col("source").isNotNull() & nonblank(F.col("value")).isNotNull())
    return known.groupBy("id", "source").agg(F.max_by("value", F.struct("pos", "value")).alias("source_id"))


def recent_top_n(entries: DataFrame, n: int = 12) -> DataFrame:
    """The newest entries: updated_at descending, id ascending."""
    return entries.orderBy(F.desc(F.coalesce("updated_at", F.lit(""))), "id").limit(n)


def archive_order(entries: DataFrame) -> DataFrame:
    """Position of each entry in its module by submodule, year descending (none last), id.

    Entries are numbered over the whole table by range partitions; a module's own numbers follow from its smallest, so no task has to hold a module.
    """
    n = written(numbered(entries.withColumnRenamed("n", "__own") if "n" in entries.columns else entries, F.asc_nulls_first("module"), F.asc_nulls_first("submodule"), F.desc_nulls_last("year"), F.asc("id")))
    first = n.groupBy(F.col("module").alias("__module")).agg(F.min("n").alias("__first"))
    j = n.join(first, F.col("module").eqNullSafe(F.col("__module"))).withColumn("position", (F.col("n") - F.col("__first") + 1).cast("int"))
    return j.drop("n", "__module", "__first").withColumnRenamed("__own", "n")


def facet_values(categories: DataFrame, column: str) -> DataFrame:
    """Distinct items of an array column, sorted."""
    return categories.select(F.explode(column).alias("value")).distinct().orderBy("value")


def facet_counts(works: DataFrame, column: str) -> DataFrame:
    return works.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def facet_tags(links: DataFrame, n: int = 12) -> DataFrame:
    """The first tags by first appearance."""
    return links.groupBy("name").agg(F.min(F.struct("work_id", "order")).alias("first")).orderBy("first", "name").limit(n).select("name")


#: Year buckets of the browse page with their bounds.
YEAR_BUCKETS = {"2020-2015": (2015, 2020), "2014-2010": (2010, 2014), "2009-2000": (2000, 2009), "1990s": (1990, 1999), "1980s": (1980, 1989), "other": (None, 1979)}
#: Countries with a filter of their own.
KNOWN_COUNTRIES = ["中国大陆", "中国香港", "中国台湾", "美国", "日本", "韩国", "泰国", "印度", "英国", "法国", "德国", "加拿大", "西班牙", "意大利", "澳大利亚"]


def year_in_bucket(year: Column, bucket: str) -> Column:
    """A single year, a descending range ``2020-2015``, a decade, or ``other`` (before 1980); no year is in none."""
    if bucket in ("1990s", "1980s"):
        lo = int(bucket[:4])
        hit = year.between(lo, lo + 9)
    elif bucket == "other":
        hit = year < 1980
    elif "-" in bucket:
        hi, lo = map(int, bucket.split("-"))
        hit = year.between(lo, hi)
    else:
        hit = year == int(bucket)
    return F.coalesce(hit, F.lit(False))


def country_in_bucket(country: Column, bucket: str, known: list[str] = KNOWN_COUNTRIES) -> Column:
    """Equality, or for ``其他`` any country that is not among the known ones."""
    c = nonblank(country)
    return F.coalesce(~c.isin(known) if bucket == "其他" else c == bucket, F.lit(False))


def facet_availability(works: DataFrame, buckets: list[str]) -> DataFrame:
    """(bucket, available): whether a work falls into each year bucket; one pass, no join."""
    flags = works.agg(*[F.max(year_in_bucket(F.col("year"), b)).alias(b) for b in buckets])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.coalesce(F.col(f"`{b}`"), F.lit(False)).alias("available")) for b in buckets])).alias("x")).select("x.*")


def browse_filter(entries: DataFrame, query: str = "", submodule: str | None = None, genre: str | None = None, country: str | None = None, year: int | None = None, tag: str | None = None) -> DataFrame:
    """Optional equality filters and a lower-cased substring over title, original title, synopsis, country and genres."""
    out = entries
    for column, value in (("submodule", submodule), ("country", country), ("year", year)):
        out = out.where(F.col(column) == value) if value is not None else out
    for column, value in (("genre", genre), ("tags", tag)):
        out = out.where(F.array_contains(column, value)) if value is not None else out
    if query.strip():
        text = F.lower(F.concat_ws(" ", "title", "title_original", "introduction", "country", F.array_join("genre", " ")))
        out = out.where(text.contains(query.strip().lower()))
    return out


def book_browse_filter(books: DataFrame, query: str = "", tag: str | None = None, year: int | None = None) -> DataFrame:
    out = books
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if year is not None:
        out = out.where(F.col("year") == year)
    if query.strip():
        text = F.lower(F.concat_ws(" ", "title", "title_original", F.array_join("authors", " "), "publisher", "summary", F.array_join("tags", " ")))
        out = out.where(text.contains(query.strip().lower()))
    return out


def admin_search(works: DataFrame, query: str = "", status: str | None = None, module: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """LIKE over id, title, original title and other titles (ASCII case folded), newest first; limit held to 1..200."""
    out = works
    if query.strip():
        hit = F.lit(False)
        for c in ("id", "title", "title_original", "other_titles"):
            hit = hit | F.coalesce(F.col(c).ilike(f"%{query.strip()}%"), F.lit(False))
        out = out.where(hit)
    for column, value in (("status", status), ("module", module)):
        out = out.where(F.col(column) == value) if value else out
    return out.orderBy(F.desc("updated_at"), F.desc("id")).offset(max(0, offset)).limit(min(max(limit, 1), 200))


def person_search(person: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """LIKE over name, Latin name and code, by name; a blank query finds nothing; limit held to 1..80."""
    if not query.strip():
        return person.limit(0)
    hit = F.lit(False)
    for c in ("name", "name_en", "person_id"):
        hit = hit | F.coalesce(F.col(c).ilike(f"%{query.strip()}%"), F.lit(False))
    return person.where(hit).orderBy("name", "id").limit(min(max(limit, 1), 80))


def category_list(category: DataFrame, group: str | None = None, module: str | None = None) -> DataFrame:
    """Categories of a group; a module filter admits global rows too."""
    out = category.where(F.col("group") == group) if group else category
    if module:
        out = out.where(F.col("module").isNull() | (F.col("module") == module))
    return out.orderBy("group", "order", "name")


@dataclass(frozen=True)
class PageIndex:
    """Entries with their place ``__n`` in an order, as a written table of which each file has a range of places."""

    table: DataFrame
    total: int

    def pages(self, size: int) -> int:
        return max(1, -(-self.total // size))

    def page(self, page: int, size: int) -> DataFrame:
        """One page with page count; size is one of 12, 24, 48 (else 24), page is clamped. Reads the row groups that hold these places, however deep."""
        size = size if size in (12, 24, 48) else 24
        page = min(max(page, 1), self.pages(size))
        rows = self.table.where((F.col("__n") > (page - 1) * size) & (F.col("__n") <= page * size)).orderBy("__n").drop("__n")
        return rows.withColumn("page", F.lit(page)).withColumn("pages", F.lit(self.pages(size)))


def page_index(entries: DataFrame, *order: Column) -> PageIndex:
    """The entries numbered in ``order`` once, for any page and size."""
    own = entries.withColumnRenamed("n", "__own") if "n" in entries.columns else entries
    order = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    table = numbered(own, *order).withColumnRenamed("n", "__n")
    table = written(table.withColumnRenamed("__own", "n").repartitionByRange("__n").sortWithinPartitions("__n"), "pages")
    return PageIndex(table, table.count())


def paginate(entries: DataFrame, page: int, size: int, *order) -> DataFrame:
    """One page of entries that have no index yet, see ``PageIndex.page``."""
    return page_index(entries, *order).page(page, size)


def home_selection(entries: DataFrame, curated: list[str], n: int = 4) -> DataFrame:
    """Curated ids first, in list order, then the others by id."""
    rank = F.nullif(F.array_position(F.array(*[F.lit(x) for x in curated]), F.col("id")), F.lit(0))
    return entries.orderBy(F.coalesce(rank, F.lit(len(curated) + 1)), "id").limit(n)


def department_order(credits: DataFrame) -> DataFrame:
    """Credits of each work numbered by department rank, order and id."""
    d = F.col("department")
    rank = F.when(d == "direction", 0).when(d == "writing", 1).when(d == "original_work", 2).when(d == "cast", 3).when(d == "production", 4).otherwise(5)
    return credits.withColumn("position", F.row_number().over(Window.partitionBy("work_id").orderBy(rank, "order", "id")))


def related_sidebar(entries: DataFrame, n: int = 6) -> DataFrame:
    """Series if there is one, else similar works; the first few with a poster address."""
    return entries.select("id", F.slice(F.when(F.size("series") > 0, F.col("series")).otherwise(F.coalesce("similar", F.array().cast("array<string>"))), 1, n).alias("related"))


def all_entries(works: DataFrame, books: DataFrame) -> DataFrame:
    return works.unionByName(books, allowMissingColumns=True)


def class_distribution(works: DataFrame) -> DataFrame:
    return works.groupBy("module", "submodule", "schema_type").agg(F.count("*").alias("n"))


def catalog_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def catalog_summary(works: DataFrame, person: DataFrame, category: DataFrame) -> DataFrame:
    """One row: works, books left out, people, categories, works without a poster, last change."""
    a = works.agg(F.count("*").alias("works"), F.count_if(nonblank(F.col("poster")).isNull()).alias("missing_poster"), F.max("updated_at").alias("last_update"))
    return a.crossJoin(person.agg(F.count("*").alias("people"))).crossJoin(category.agg(F.count("*").alias("categories")))


def cover_map(files: DataFrame) -> DataFrame:
    """(book_id, file, source) -> main cover (``cover.*`` if present, else the first by name) and the others as source=file."""
    fixed = F.col("file").rlike(r"^cover\.")
    main = F.coalesce(F.min(F.when(fixed, F.col("file"))), F.min("file"))
    g = files.groupBy("book_id").agg(main.alias("cover"), F.array_sort(F.collect_set(F.concat("source", F.lit("="), "file"))).alias("all"))
    return g.select("book_id", "cover", F.filter("all", lambda x: ~x.endswith(F.concat(F.lit("="), F.col("cover")))).alias("others"))
