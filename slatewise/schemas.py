"""Schemas of the records that cross a file boundary."""

from __future__ import annotations

from pyspark.sql import types as T

ASSET = T.StructType(
    [
        T.StructField("uri", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("width_px", T.LongType()),
        T.StructField("height_px", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("codec", T.StringType()),
    ]
)

MOVIES = "director_name string, actor_1_name string, actor_2_name string, actor_3_name string, genres string, movie_title string, comb string"
MUSIC = "artist_name string, entity_type string, country string, genres string, born string, disambiguation string, aliases string, comb string"
BOOKS = "book_title string, authors string, first_publish_year string, subjects string, cover_id string, key string, comb string"
RATED_FILMS = "movieId string, title string, genres string"

IMAGE = "struct<hi_res:string,large:string,thumb:string,medium:string,small:string>"
PRODUCTS = (
    "parent_asin string, asin string, title string, features array<string>, description array<string>, "
    f"categories array<string>, images array<{IMAGE}>, details map<string,string>, store string"
)

ARTIST = (
    "name string, type string, country string, disambiguation string, score double, "
    "tags array<struct<name:string,count:long>>, `life-span` struct<begin:string>, aliases array<struct<name:string>>"
)
BOOK = "title string, author_name array<string>, first_publish_year long, subject array<string>, cover_i long, key string"
FILM_CREDITS = "title string, crew array<struct<name:string,job:string>>, cast array<struct<name:string>>, overview string, release_date string"

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
SNAPSHOT = (
    "dataset_id string, version string, license_name string, source_uri string, snapshot_utc string, "
    "content_hash string, schema_hash string, domain string, record_limit long, rejected long"
)
