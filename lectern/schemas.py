"""Schemas of the catalogue tables and of the JSON texts that their columns hold."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


_TABLES = {
    "works": "id string, module string, submodule string, schema_type string, title string, title_original string, other_titles string, "
    "year int, country string, language string, total_time int, studio string, release_dates string, quotes string, scores string, "
    "episode_count int, episode_time int, episodes_story string, introduction string, story string, external_source string, images string, "
    "videos string, comments string, soundtrack string, related string, characters string, status string, created_at string, updated_at string",
    "person": "id int, person_id string, name string, name_en string, source_ids string, avatar_path string, tmdb_avatar_path string, "
    "douban_avatar_path string, profile_link string, intro string",
    "work_person": "id int, work_id string, person_id int, department string, role string, character string, character_en string, `order` int, is_primary boolean",
    "category": "id int, `group` string, name string, module string, submodule string, `order` int, enabled boolean",
    "work_category": "id int, work_id string, category_id int, `order` int",
    "books": "id string, title string, title_original string, other_titles string, isbn string, year int, country string, language string, "
    "word_count int, publisher string, publish_date string, pages int, price string, binding string, format string, edition string, summary string, "
    "story string, quotes string, excerpts string, series_id string, series_order int, scores string, external_source string, images string, "
    "reviews string, related string, status string, created_at string, updated_at string",
    "book_series": "id string, name string, name_original string, book_count int, summary string, images string, status string, created_at string, updated_at string",
    "book_person": "id int, book_id string, person_id int, role string, `order` int, is_primary boolean",
    "book_category": "id int, book_id string, category_id int, `order` int",
}


def table_schema(name: str) -> T.StructType:
    """The schema of a catalogue table; ids stay strings, for their leading zeros."""
    return _struct(_TABLES[name])


TABLE_NAMES = tuple(_TABLES)

#: DDL of the values in JSON text columns.
EXTERNAL_SOURCE = "array<struct<name: string, id: string, link: string>>"
RELEASE_DATES = "array<struct<date: string, location: string>>"
EPISODES = "array<struct<episode: int, title: string, story: string, plot: string, source: string, sourceUrl: string>>"
CHARACTERS = "array<struct<name: string, nameEn: string, actorName: string, image: string, description: string>>"
COMMENTS = "array<struct<author: string, source: string, date: string, content: string, url: string, title: string>>"
SCORES = "struct<avg: double, douban: double, imdb: double, tmdb: double, rottenTomatoes: double, metacritic: double>"
RELATED = "struct<series: array<struct<id: string, title: string, year: int, rating: double>>, similar: array<struct<id: string, title: string, year: int, rating: double>>>"

MANIFEST_ITEM = (
    "bookId: string, title: string, authors: array<string>, type: string, contentKind: string, profile: string, expectedAction: string, "
    "doubanId: string, sourceHints: map<string,string>, reviewNotes: array<string>"
)
