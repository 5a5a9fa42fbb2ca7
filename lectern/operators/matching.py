"""Matching candidates to the catalogue, candidate ranking, person matching, reference checks.

OR conditions are unions of equi-joins, so no pair is compared that shares no key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.names import normalize_name, starter_table, transliterate, transliteration_match
from lectern.functions.scalars import is_reversed_name, nonblank, normalize_title, text_key


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: A key with more than this share of all rows is hot; so there are fewer than SHARES hot keys, whatever the input.
SHARES = 400


def split_join(left: DataFrame, right: DataFrame, keys: list[str], least: int = 10_000) -> DataFrame:
    """Inner join on ``keys`` (equal and not null) in which a hot key of ``left`` is several tasks' work.

    Rows of a key are counted, combined before their shuffle. A key with more than 1 / SHARES of the rows (and ``least``) is dealt into parts of
    that size by a hash of the row, and ``right``'s rows of it are repeated for each part. Keys below that pass as they are; the table of hot keys has under SHARES rows.
    """
    held = left.dropna(subset=keys)
    counts = held.groupBy(*keys).agg(F.count("*").alias("__c"))
    share = max((counts.agg(F.sum("__c")).first()[0] or 0) // SHARES, least)
    parts = F.ceil(F.col("__c") / share).cast("int")
    hot = F.broadcast(counts.where(F.col("__c") > share).select(*keys, parts.alias("__parts")))
    dealt = held.join(hot, keys, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*held.columns), F.col("__parts")).cast("int")))
    every = right.dropna(subset=keys).join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0)))))
    return dealt.drop("__parts").join(every.drop("__parts"), [*keys, "__part"]).drop("__part")


def pairs_once(new: DataFrame, old: DataFrame, find: Callable[[DataFrame, DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each (new_id, old_id) once, from ``find``, which gives a pair once for two rows that match. ``new`` has new_id, ``old`` has old_id.

    Pairs may be far more than rows, so they are not shuffled: ids that have a single row find a pair once anyway. Only
    pairs of ids with several different rows (or null with several) go through ``merge``, which may shuffle.
    """

    def told_apart(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
        often = lambda df: df.groupBy(key).agg(F.count("*").alias("__c")).where("__c > 1").select(F.col(key).alias("__id"))
        if often(rows).isEmpty():
            return rows, None
        rows = rows.distinct()
        again, same = often(rows), F.col(key).eqNullSafe(F.col("__id"))
        return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")

    (new_one, new_more), (old_one, old_more) = told_apart(new, "new_id"), told_apart(old, "old_id")
    more = [find(new_more, every) for every in (old_one, old_more) if every is not None] if new_more is not None else []
    if old_more is not None:
        more.append(find(new_one, old_more))
    once = find(new_one, old_one)
    return _union([once, merge(_union(more))]) if more else once


def match_pairs(new: DataFrame, old: DataFrame, rules: list[tuple[str, list[tuple[str, str]], list[tuple[str, str]]]], least: int = 10_000) -> DataFrame:
    """(new_id, old_id, reasons): pairs that meet any rule, reasons sorted and joined by '|'.

    A rule is (reason, keys equal and not null, keys equal with null equal to null). Common keys, such as a title without a year, are split.
    Rows carry the keys of all rules, so two rows are a pair of the first rule that they meet only, which also tells the others.
    """
    cells: dict[tuple, int] = {}  # (key of new, key of old, null-safe part) -> number of the column
    needs = [[cells.setdefault(c, len(cells)) for c in [(*pair, "") for pair in keys] + [(*pair, part) for pair in null_safe for part in ("is", "as")]] for _, keys, null_safe in rules]

    def side(df: DataFrame, at: int, name: str) -> DataFrame:
        value = {"": lambda c: c, "is": Column.isNull, "as": lambda c: F.coalesce(c.cast("string"), F.lit(""))}  # null and its absence as keys that are never null
        return df.select(F.col("id").alias(name), *[value[cell[2]](F.col(cell[at])).alias(f"{name[0]}{i}") for cell, i in cells.items() if i != whole])

    whole = cells.get(("id", "id", ""), -1)  # the ids themselves
    of = lambda x, i: F.col({"n": "new_id", "o": "old_id"}[x] if i == whole else f"{x}{i}")
    reasons = sorted({reason for reason, _, _ in rules})
    texts = ["|".join(r for i, r in enumerate(reasons) if bits >> i & 1) for bits in range(1 << len(reasons))]  # rules are few

    def find(n: DataFrame, o: DataFrame) -> DataFrame:
        parts = []
        for at, on in enumerate(needs):
            keyed = lambda df, x: df.withColumns({f"k{i}": of(x, i) for i in on}).drop(*[f"{x}{i}" for i in on])
            alike = lambda cols: reduce(Column.__and__, [of("n", i) == of("o", i) for i in cols if i not in on], F.lit(True))
            met = [F.coalesce(alike(cols), F.lit(False)) for cols in needs]
            bits = [F.when(m, 1 << reasons.index(reason)).otherwise(0) for (reason, _, _), m in zip(rules, met)]
            found = split_join(keyed(n, "n"), keyed(o, "o"), [f"k{i}" for i in on], least).where(~reduce(Column.__or__, met[:at], F.lit(False)))
            parts.append(found.select("new_id", "old_id", reduce(Column.bitwiseOR, bits[at:]).alias("bits")))
        return _union(parts)

    def merge(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("new_id", "old_id").agg(F.bit_or("bits").alias("bits"))

    return pairs_once(side(new, 0, "new_id"), side(old, 1, "old_id"), find, merge).select("new_id", "old_id", F.get(F.lit(texts), F.col("bits")).alias("reasons"))


def existing_match(new: DataFrame, old: DataFrame) -> DataFrame:
    """Same id, same (source, source_id), title and year, original title and year; years compare null-safe."""
    return match_pairs(
        new, old,
        [
            ("id", [("id", "id")], []),
            ("source", [("source", "source"), ("source_id", "source_id")], []),
            ("title_year", [("title", "title")], [("year", "year")]),
            ("original_year", [("title_original", "title_original")], [("year", "year")]),
        ],
    )


def manifest_match(items: DataFrame, old: DataFrame, least: int = 10_000) -> DataFrame:
    """Title of an item against title or original title; an item without a year matches any year.

    Items with a year are joined by title and year, the others by title. What the title has matched is left out for the original title.
    """
    n = items.select(F.col("id").alias("new_id"), F.col("title").alias("key"), "year")
    o = old.select(F.col("id").alias("old_id"), "title", "title_original", "year")

    def find(n: DataFrame, o: DataFrame) -> DataFrame:
        parts = []
        for left, keys in ((n.where("year is not null"), ["key", "year"]), (n.where("year is null").drop("year"), ["key"])):
            years = [c for c in keys if c == "year"]
            parts.append(split_join(left, o.select("old_id", F.col("title").alias("key"), *years), keys, least))
            other = o.where(~F.col("title").eqNullSafe(F.col("title_original"))).select("old_id", F.col("title_original").alias("key"), *years)
            parts.append(split_join(left, other, keys, least))
        return _union([p.select("new_id", "old_id") for p in parts])

    return pairs_once(n, o, find, DataFrame.distinct)


def candidate_score(pairs: DataFrame) -> DataFrame:
    """Score of (query_title, query_year, title, original, year, type): exact 100 / 80, contained 35 / 20, year 15, type 10."""
    keyed = pairs.withColumns({f"__{c}": normalize_title(F.col(c)) for c in ("query_title", "title", "original")})  # once each
    q, t, o = F.col("__query_title"), F.col("__title"), F.col("__original")
    has = q != ""
    parts = [
        F.when(has & (t == q), 100), F.when(has & (o == q), 80), F.when(has & t.contains(q) & (t != q), 35), F.when(has & o.contains(q) & (o != q), 20),
        F.when(F.col("query_year") == F.col("year"), 15), F.when(F.col("type") == "movie", 10),
    ]
    return keyed.withColumn("score", reduce(Column.__add__, [F.coalesce(p, F.lit(0)) for p in parts])).select(*[c for c in pairs.columns if c != "score"], "score")


def candidate_top_k(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best candidates of each query with rank; auto: the best has 110 or more and leads by 30."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    lead = F.lead("score").over(w)
    auto = (F.col("rank") == 1) & (F.col("score") >= 110) & (F.col("score") - F.coalesce(lead, F.lit(0)) >= 30)
    return ranked.withColumn("auto", auto)


def candidate_select(cands: DataFrame, url_mark: str, exact: int, year_bonus: int) -> DataFrame:
    """The best candidate per query: those whose url has the mark if there are any; by match, year match, rating, then position.

    Two sites differ only in the weights: (2, 2) and (3, 3).
    """
    q, t = normalize_title(F.col("query_title")), normalize_title(F.col("title"))
    known = F.coalesce(F.col("query_year"), F.lit(0)) != 0
    same = F.when(known & (F.col("query_year") == F.col("year")), year_bonus).otherwise(0)
    off = F.when(known & (F.coalesce(F.col("year"), F.lit(0)) != 0) & (F.col("query_year") != F.col("year")), -2).otherwise(0)
    match = F.when(t == q, exact).otherwise(0) + F.when((q != "") & t.contains(q), 1).otherwise(0) + same + off
    order = F.struct(F.col("url").contains(url_mark).cast("int"), match, same, F.coalesce("rating", F.lit(0)).cast("double"), -F.col("position"))
    return cands.groupBy("query_id").agg(F.max_by("candidate_id", order).alias("candidate_id"))


def candidate_select_rt(cands: DataFrame) -> DataFrame:
    return candidate_select(cands, "/m/", 2, 2)


def candidate_select_mc(cands: DataFrame) -> DataFrame:
    return candidate_select(cands, "/movie/", 3, 3)


def suggest_filter(pairs: DataFrame) -> DataFrame:
    """Pairs of the same year (if both are known) whose titles contain one another."""
    q, t = normalize_title(F.col("query_title")), normalize_title(F.col("title"))
    year = F.col("query_year").isNull() | F.col("year").isNull() | (F.col("query_year") == F.col("year"))
    return pairs.where(year & (t.contains(q) | q.contains(t)))


def novel_candidate_score(pairs: DataFrame) -> DataFrame:
    """Title exact 100, candidate in query 60, query in candidate 40; author exact 30, contained 15; less the position."""
    q, t = text_key(F.lower("query_title")), text_key(F.lower("title"))
    qa, a = text_key(F.lower("query_author")), text_key(F.lower("author"))
    title = F.when(q == t, 100).when(q.contains(t), 60).when(t.contains(q), 40)
    author = F.when(qa == "", 0).when(qa == a, 30).when(a.contains(qa), 15)
    return pairs.withColumn("score", title + author - F.col("position")).where(F.col("score").isNotNull())


#: Marks that speak for and against a book article, with their weights.
BOOK_MARKS = {"网络小说": 120, "长篇小说": 100, "小说": 70, "文学作品": 70, "起点中文网": 80, "连载": 40, "完结": 30, "作者": 20}
OTHER_MARKS = {
    "电视剧": 140, "网络剧": 140, "古装剧": 120, "电影": 110, "动画": 90, "动漫": 90, "漫画": 90, "游戏": 100, "手游": 100, "网游": 100,
    "有声小说": 80, "广播剧": 80, "主演": 100, "导演": 100, "执导": 100, "出品公司": 100, "制片地区": 100,
}


def title_aliases(title: Column) -> list[Column]:
    """Names under which a book may be found: its title, what follows a colon in it, the title without a volume in brackets."""
    after = [F.when(title.contains(mark), F.regexp_extract(title, f"(?s){mark}(.*)$", 1)) for mark in ("：", ":")]
    return [title, *after, F.regexp_replace(title, "（卷[一二三四五六七八九十]+）", "")]


def encyclopedia_candidate_score(text: Column, title: Column, author: Column, href: Column | None = None, positive: dict[str, int] = BOOK_MARKS, negative: dict[str, int] = OTHER_MARKS) -> Column:
    """The first alias of the title found 30 (50 at the start), author 80, weights of the marks found, 10 for a link from a disambiguation page."""
    t, who = text_key(text), text_key(author)
    score = F.coalesce(*[F.when((key != "") & t.contains(key), F.when(t.startswith(key), 50).otherwise(30)) for key in map(text_key, title_aliases(title))], F.lit(0))
    if href is not None:
        score = score + F.when(href.contains("fromModule=disambiguation"), 10).otherwise(0)
    score = score + F.when((who != "") & t.contains(who), 80).otherwise(0)
    for marks, sign in ((positive, 1), (negative, -1)):
        for mark, weight in marks.items():
            score = score + F.when(t.contains(mark), sign * weight).otherwise(0)
    return score


def person_match(western: DataFrame, local: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(work_id, western_id, local_id): for each western credit the first local one, by position, that any rule accepts.

    Rules: equal names, equal normalised names (not empty), first and last name
    swapped, transliteration by ``table`` (place, latin, local; the starter table, if none is given). ``local`` has work_id, local_id, position, name, name_en.
    """
    w = western.select("work_id", "western_id", F.col("name").alias("w_name"))
    told = transliterate(w.select(F.col("w_name").alias("name")), starter_table(western.sparkSession) if table is None else table)
    w = w.withColumn("w_key", normalize_name("w_name")).join(told.select(F.col("name").alias("w_name"), F.col("local").alias("w_local")), "w_name", "left")
    x = local.withColumn("l_key", normalize_name("name_en"))
    hit = (
        (F.lower("w_name") == F.lower("name_en"))
        | ((F.col("w_key") != "") & (F.col("w_key") == F.col("l_key")))
        | is_reversed_name(F.col("w_name"), F.col("name_en"))
        | transliteration_match(F.col("w_local"), F.col("name"))
    )
    pairs = w.join(x, "work_id").where(F.coalesce(hit, F.lit(False)))
    return pairs.groupBy("work_id", "western_id").agg(F.min_by("local_id", "position").alias("local_id"))


def person_merge(western: DataFrame, local: DataFrame, matches: DataFrame) -> DataFrame:
    """Western credits with the matched local name, avatar and character, where there is one."""
    m = western.join(matches, ["work_id", "western_id"], "left")
    x = local.select("work_id", "local_id", F.col("name").alias("local_name"), F.col("avatar").alias("local_avatar"), nonblank(F.col("character")).alias("local_character"))
    return m.join(x, ["work_id", "local_id"], "left")


def fk_check(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(relation, key, n): keys of child rows that no parent has. Null keys are no reference."""
    parts = []
    for name, child, column, parent, key in checks:
        c = child.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("key"))
        p = parent.select(F.col(key).cast("string").alias("key")).distinct()
        parts.append(c.join(p, "key", "left_anti").groupBy("key").agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "key", "n"))
    return _union(parts)


#: Where entries name files. Every text under the first, at any depth, and every text field of the other names, wherever it stands.
ASSET_TREES, ASSET_FIELDS = ("images",), ("poster", "still", "avatar", "thumbnail", "avatarPath")
#: Fields that hold a whole path; the others hold a file name in their work's folder.
WHOLE_PATHS = ("avatarPath",)


def _of_each(values: Callable[[Column], Column], c: Column) -> Column:
    return F.flatten(F.filter(F.transform(c, lambda x: values(x)), lambda x: x.isNotNull()))


def _of_each_value(values: Callable[[Column], Column], c: Column) -> Column:
    return _of_each(values, F.map_values(c))


def _of_field(values: Callable[[Column], Column], name: str, c: Column) -> Column:
    return values(c.getField(name))


def asset_fields(schema: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Callable[[Column], Column]]]:
    """(path, column -> array of texts) of all asset fields of a nested type: structs, arrays, and arrays of structs of arrays."""
    if isinstance(schema, T.StringType):
        wanted = bool(path) and (path[0] in ASSET_TREES or path[-1] in ASSET_FIELDS)
        return [(path, lambda c: F.array(c))] if wanted else []
    if isinstance(schema, T.ArrayType):
        return [(p, partial(_of_each, f)) for p, f in asset_fields(schema.elementType, path)]
    if isinstance(schema, T.MapType):
        return [(p, partial(_of_each_value, f)) for p, f in asset_fields(schema.valueType, path)]
    if isinstance(schema, T.StructType):
        return [(p, partial(_of_field, f, field.name)) for field in schema for p, f in asset_fields(field.dataType, (*path, field.name))]
    return []


def _named(*columns: Column) -> Callable[[Column], Column]:
    return lambda x: F.struct(*columns, x.alias("path"))


def asset_refs(entries: DataFrame) -> DataFrame:
    """(id, kind, path) of the files that entries name, distinct, blanks left out; kind is the field's path in the schema, such as ``images.stills`` or ``cast.avatarPath``.

    The fields are found in the schema, so a new nested one needs no code. With columns module and submodule a file
    name stands in the folder module/submodule/id; whole paths get forward slashes. Texts with a scheme stay as they are.
    """
    refs = []
    for field in entries.schema:
        for path, values in asset_fields(field.dataType, (field.name,)):
            kind, whole = F.lit(".".join(path)).alias("kind"), F.lit(path[-1] in WHOLE_PATHS).alias("whole")
            refs.append(F.transform(values(F.col(field.name)), _named(kind, whole)))
    if not refs:
        return entries.select("id", F.lit("").alias("kind"), F.lit("").alias("path")).limit(0)
    none = F.array().cast("array<struct<kind:string,whole:boolean,path:string>>")
    rows = entries.withColumn("r", F.explode(F.concat(*[F.coalesce(r, none) for r in refs])))
    name = nonblank(F.col("r.path"))
    path = F.when(F.col("r.whole"), F.replace(name, F.lit("\\"), F.lit("/"))).otherwise(name)
    if {"module", "submodule"} <= set(entries.columns):
        path = F.when(F.col("r.whole") | name.rlike("^[a-z]+://"), path).otherwise(F.concat_ws("/", "module", "submodule", "id", name))
    return rows.where(name.isNotNull()).select("id", "r.kind", path.alias("path")).distinct()


def asset_check(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """References with their state: external (has a scheme), exists, or missing from the inventory of paths."""
    inv = inventory.select("path").distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("path").rlike("^[a-z]+://"), "external").when(F.col("known"), "exists").otherwise("missing")
    return refs.join(inv, "path", "left").select("id", "kind", "path", state.alias("state"))


def asset_rollup(checked: DataFrame) -> DataFrame:
    return checked.groupBy("kind").agg(F.count_if(F.col("state") == "exists").alias("existing"), F.count_if(F.col("state") == "missing").alias("missing"))


def approved_only(items: DataFrame, approved: DataFrame) -> DataFrame:
    return items.join(approved.select("id").distinct(), "id", "left_semi")


def select_tasks(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The manual choice, else the automatic one, looked up among the candidates; otherwise unresolved, with a reason."""
    chosen = F.coalesce("manual_id", "auto_id")
    q = queries.withColumn("chosen", chosen).withColumn("how", F.when(F.col("manual_id").isNotNull(), "manual").when(F.col("auto_id").isNotNull(), "auto"))
    c = candidates.select("query_id", F.col("candidate_id").alias("chosen"), F.lit(True).alias("found")).distinct()
    reason = F.when(F.col("chosen").isNull(), "no_selection").when(F.col("found").isNull(), "not_a_candidate").otherwise("resolved")
    return q.join(c, ["query_id", "chosen"], "left").select("query_id", "chosen", "how", reason.alias("reason"))


def prune_asset_refs(entries: DataFrame, inventory: DataFrame) -> DataFrame:
    """(id, files array) without files that are not in the inventory, order kept; n_cleared counts them."""
    rows = entries.select("id", F.posexplode_outer("files").alias("pos", "path"))
    known = inventory.select("path").distinct().withColumn("known", F.lit(True))
    g = rows.join(known, "path", "left").groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("pos", "path")))).alias("kept"), F.count_if(F.col("known").isNull() & F.col("path").isNotNull()).alias("n_cleared")
    )
    return g.select("id", F.transform("kept", lambda x: x["path"]).alias("files"), "n_cleared")


def pending_links(works: DataFrame, links: DataFrame, category_id) -> DataFrame:
    """Works that are not linked to the category."""
    return works.join(links.where(F.col("category_id") == category_id).select(F.col("work_id").alias("id")), "id", "left_anti")


def index_entry_consistency(index: DataFrame, entries: DataFrame, fields: list[str]) -> DataFrame:
    """(id, problem): index rows without an entry, entries without an index row, fields that differ."""
    i = index.select("id", F.lit(True).alias("in_index"), *[F.col(f).alias(f"i_{f}") for f in fields])
    e = entries.select("id", F.lit(True).alias("in_entries"), *[F.col(f).alias(f"e_{f}") for f in fields])
    differ = F.array_compact(F.array(*[F.when(~F.col(f"i_{f}").eqNullSafe(F.col(f"e_{f}")), F.lit(f)) for f in fields]))
    problem = (
        F.when(F.col("in_entries").isNull(), "no_entry").when(F.col("in_index").isNull(), "no_index").when(F.size(differ) > 0, F.concat(F.lit("differs:"), F.array_join(differ, ",")))
    )
    return i.join(e, "id", "full").select("id", problem.alias("problem")).where("problem is not null")
