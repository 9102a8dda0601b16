"""Catalogue files and the projections that bring each of them into the universal item shape."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slatewise import schemas
from slatewise.functions import expressions as X
from slatewise.operators.scale import bounded_broadcast


@dataclass(frozen=True)
class AdapterConfig:
    dataset_id: str
    domain: str
    locale: str = "en"
    delimiter: str = ","
    id_column: str = ""
    title_column: str = ""
    text_columns: Sequence[str] = field(default_factory=tuple)


def with_row_index(df: DataFrame) -> DataFrame:
    """Adds ``row_index`` 0, 1, ... in the order of file name, place of the split in the file, and row.

    A scan packs its splits by size, so its own row ids follow the files only within a split. The rows of each split are
    counted, and each row's number is its place in the split behind all earlier splits: no row is moved.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    # One row per split of the source; the splits' sums are a window over these few.
    splits = placed.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    order = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("__file", "__start", (F.coalesce(F.sum("__rows").over(order), F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(bounded_broadcast(before), ["__file", "__start"]).withColumn("row_index", F.col("__id") + F.col("__shift")).select(*df.columns, "row_index")


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, delimiter: str = ",") -> DataFrame:
    """Header file with a separator. Without a schema all columns are text, named by the header."""
    reader = spark.read.option("header", True).option("sep", delimiter).option("escape", '"').option("multiLine", False)
    if schema is not None:
        # Columns are matched to the header by name, so the file's own order does not matter.
        wanted = spark.createDataFrame([], schema).columns
        raw = reader.option("inferSchema", False).csv(path)
        return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in wanted])
    return reader.option("inferSchema", False).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def load_catalog(raw: DataFrame, title: str = "movie_title", text: str = "comb") -> DataFrame:
    """Lower-cased title and text; a missing text becomes empty."""
    return raw.withColumn(title, F.lower(F.col(title).cast("string"))).withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def _item(df: DataFrame, config: AdapterConfig, key: Column, text: Sequence[Column], provenance: dict[str, Column], images: Column | None = None) -> DataFrame:
    """Rows with a key become items; ``text`` are the aliased fields of the text modality."""
    nothing = F.create_map().cast("map<string,string>")
    no_assets = F.array().cast(f"array<{schemas.ASSET.simpleString()}>")
    known = [F.lit("dataset_id"), F.lit(config.dataset_id), F.lit("row_index"), F.col("row_index").cast("string")]
    extra = [v for name, value in provenance.items() for v in (F.lit(name), value.cast("string"))]
    return df.select(
        X.stable_item_id(F.lit(config.domain), key).alias("item_id"),
        F.lit(config.domain).alias("domain"),
        F.lit(config.locale).alias("locale"),
        F.struct(
            F.struct(*text).alias("text"), nothing.alias("image"), nothing.alias("audio"), nothing.alias("video"), nothing.alias("sequence")
        ).alias("modalities"),
        F.struct(
            no_assets.alias("text"), (no_assets if images is None else images).alias("image"), no_assets.alias("audio"), no_assets.alias("video")
        ).alias("assets"),
        F.create_map(*known, *extra).alias("provenance"),
    )


def _text(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))


def movies(df: DataFrame, config: AdapterConfig) -> DataFrame:
    rows = df.filter(_text("movie_title") != "")
    text = [_text("movie_title").alias("title"), F.coalesce("comb", F.lit("")).alias("combined")]
    return _item(rows, config, F.lower(_text("movie_title")), text, {"source": F.lit("catalog")})


def rated_films(df: DataFrame, config: AdapterConfig) -> DataFrame:
    rows = df.filter((_text("movieId") != "") & (_text("title") != ""))
    text = [_text("title").alias("title"), _text("genres").alias("genres"), X.combined_text("title", "genres").alias("combined")]
    return _item(rows, config, F.concat(F.lit("movielens:"), _text("movieId")), text, {"movie_id": _text("movieId")})


def image_urls(images: Column) -> Column:
    """Per image hi_res, large, thumb, medium, small in that order, without empties."""
    each = F.transform(images, lambda i: F.array(i["hi_res"], i["large"], i["thumb"], i["medium"], i["small"]))
    return F.filter(F.flatten(each), lambda u: u.isNotNull() & (u != ""))


def products(df: DataFrame, config: AdapterConfig) -> DataFrame:
    clean = lambda c: F.when(F.lower(_text(c)) != "nan", _text(c)).otherwise("")
    rows = df.withColumn("__key", F.coalesce(X.blank_to_null(clean("parent_asin")), X.blank_to_null(clean("asin"))))
    rows = rows.filter(F.col("__key").isNotNull() & (clean("title") != ""))
    features, description, categories = (X.as_text_list(c) for c in ("features", "description", "categories"))
    combined = F.concat_ws(" ", F.array(clean("title")), features, description, categories)
    asset = lambda u: F.struct(
        u.alias("uri"),
        X.media_type(u).alias("mime_type"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ASSET.fields[2:]],
    )
    text = [
        clean("title").alias("title"), features.alias("features"), description.alias("description"), categories.alias("categories"),
        clean("store").alias("store"), F.coalesce("details", F.create_map().cast("map<string,string>")).alias("details"), combined.alias("combined"),
    ]
    found = F.coalesce(F.col("images"), F.array().cast(f"array<{schemas.IMAGE}>"))
    provenance = {"parent_asin": clean("parent_asin"), "asin": clean("asin")}
    return _item(rows, config, F.col("__key"), text, provenance, F.transform(image_urls(found), asset))


def mapped_table(df: DataFrame, config: AdapterConfig) -> DataFrame:
    """Any table whose id, title and text columns are named in the configuration."""
    if not config.id_column.strip() or not config.title_column.strip():
        raise ValueError("mapping requires id_column and title_column")
    rows = df.filter((_text(config.id_column) != "") & (_text(config.title_column) != ""))
    texts = [c.strip() for c in config.text_columns if c.strip() and c.strip() in df.columns]
    text = [_text(config.title_column).alias("title"), X.combined_text(config.title_column, *texts).alias("combined")]
    return _item(rows, config, _text(config.id_column), text, {"source_id": _text(config.id_column)})


def music(df: DataFrame, config: AdapterConfig) -> DataFrame:
    rows = df.filter(_text("artist_name") != "")
    plain = lambda c: F.coalesce(c, F.lit("")).alias(c)
    listed = lambda c: F.coalesce(X.split_pipe(c), F.array().cast("array<string>")).alias(c)
    text = [
        _text("artist_name").alias("title"), plain("entity_type"), plain("country"), listed("genres"), plain("born"), plain("disambiguation"),
        listed("aliases"), F.coalesce("comb", F.lit("")).alias("combined"),
    ]
    return _item(rows, config, F.lower(_text("artist_name")), text, {"source": F.lit("musicbrainz")})


def books(df: DataFrame, config: AdapterConfig) -> DataFrame:
    rows = df.filter(_text("book_title") != "")
    plain = lambda c: F.coalesce(c, F.lit("")).alias(c)
    listed = lambda c: F.coalesce(X.split_pipe(c), F.array().cast("array<string>")).alias(c)
    text = [
        _text("book_title").alias("title"), listed("authors"), plain("first_publish_year"), listed("subjects"), plain("cover_id"), plain("key"),
        F.coalesce("comb", F.lit("")).alias("combined"),
    ]
    return _item(rows, config, F.lower(_text("book_title")), text, {"source": F.lit("openlibrary")})


@dataclass(frozen=True)
class Adapter:
    read: Callable[[SparkSession, str, AdapterConfig], DataFrame]
    normalize: Callable[[DataFrame, AdapterConfig], DataFrame]


def _csv(schema: str | None):
    return lambda spark, path, config: read_delimited(spark, path, schema, config.delimiter)


ADAPTERS = {
    "movies_catalog": Adapter(_csv(None), movies),
    "movielens_movies": Adapter(_csv(None), rated_films),
    "amazon_reviews_2023_meta": Adapter(lambda s, p, c: read_json_lines(s, p, schemas.PRODUCTS), products),
    "mapped_tabular": Adapter(_csv(None), mapped_table),
    "music_catalog": Adapter(_csv(None), music),
    "books_catalog": Adapter(_csv(None), books),
}
