"""Files in, tables out: adapters, ingestion job, checksums, registry, feature and vector tables, facts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from slatewise import schemas
from slatewise.sources import catalog, facts, ingestion, tables


def _manifest(tmp_path, source, dataset, columns, **extra):
    raw = {
        "dataset_id": dataset, "version": "1", "domain": "d", "source_uri": str(source), "license_name": "l", "snapshot_utc": "2024-01-01T00:00:00Z", "locale_default": "en",
        "expected_columns": columns, "output_items_path": str(tmp_path / "items"), "output_snapshot_path": str(tmp_path / "snap"), **extra,
    }
    return ingestion.parse_manifest(json.dumps(raw))


FILES = {
    "movies_catalog": ("movie_title,comb\nFirst Film,one two\n,x\nSecond,three\n", ["movie_title", "comb"], "first film", 2),
    "movielens_movies": ("movieId,title,genres\n1,Film (1995),A|B\n", ["movieId", "title"], "movielens:1", 1),
    "music_catalog": ("artist_name,entity_type,country,genres,born,disambiguation,aliases,comb\nAda,Person,DE,pop| rock |,1970,,A|B,ada pop\n", ["artist_name"], "ada", 1),
    "books_catalog": ("book_title,authors,first_publish_year,subjects,cover_id,key,comb\nTome,Ann|Bob,1901,x|y,7,/k,tome\n", ["book_title"], "tome", 1),
}


@pytest.mark.parametrize("dataset", sorted(FILES))
def test_csv_ingestion(spark, tmp_path, dataset):
    text, columns, key, count = FILES[dataset]
    source = tmp_path / "in.csv"
    source.write_text(text)
    report = ingestion.run_ingestion(spark, _manifest(tmp_path, source, dataset, columns)).first()
    assert report.normalized_rows == count
    items = spark.read.json(str(tmp_path / "items"))
    assert hashlib.sha256(f"d|{key}".encode()).hexdigest() in {r.item_id for r in items.collect()}
    snapshot = spark.read.json(str(tmp_path / "snap")).first()
    assert snapshot.content_hash == hashlib.sha256(text.encode()).hexdigest()
    assert snapshot.schema_hash == hashlib.sha256("\n".join(text.split("\n")[0].split(",")).encode()).hexdigest()


def test_products_and_limit(spark, tmp_path):
    rows = [
        {"parent_asin": "P1", "title": "Thing", "features": ["soft", " ", None], "description": ["nice"], "categories": [], "images": [{"hi_res": "http://a/b.jpg", "thumb": "http://a/c.png"}], "details": {"k": "v"}, "store": "S"},
        {"parent_asin": None, "asin": "A2", "title": "Other"},
        {"title": "no key"},
    ]
    source = tmp_path / "in.jsonl"
    source.write_text("\n".join(json.dumps(r) for r in rows))
    report = ingestion.run_ingestion(spark, _manifest(tmp_path, source, "amazon_reviews_2023_meta", ["title"], record_limit=2)).first()
    assert (report.total_rows, report.normalized_rows, report.warnings) == (2, 2, "record_limit applied")
    item = spark.read.json(str(tmp_path / "items")).orderBy(F.col("provenance.row_index")).first()
    assert item.modalities.text.combined == "Thing soft nice"
    assert [(a.uri, a.mime_type) for a in item.assets.image] == [("http://a/b.jpg", "image/jpeg"), ("http://a/c.png", "image/png")]


def test_mapped_table_and_errors(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("id;name;text\n1;One;alpha\n2; ;beta\n")
    mapping = {"id_column": "id", "title_column": "name", "text_columns": ["text"]}
    report = ingestion.run_ingestion(spark, _manifest(tmp_path, source, "mapped_tabular", ["id"], mapping=mapping, delimiter=";", strict_validation=False)).first()
    assert (report.total_rows, report.normalized_rows, report.rejected_rows) == (2, 1, 0)
    with pytest.raises(ValueError):
        ingestion.run_ingestion(spark, _manifest(tmp_path, source, "mapped_tabular", ["id"], delimiter=";"))
    with pytest.raises(ValueError):
        ingestion.run_ingestion(spark, _manifest(tmp_path, source, "movies_catalog", ["other"]))
    with pytest.raises(ValueError):
        ingestion.run_ingestion(spark, _manifest(tmp_path, source, "nothing", []))
    with pytest.raises(ValueError):
        ingestion.parse_manifest("{}")


def test_row_numbers_and_reader(spark, tmp_path):
    source = tmp_path / "many.csv"
    source.write_text("b,a\n" + "\n".join(f"{i},x" for i in range(50)))
    rows = catalog.with_row_index(catalog.read_delimited(spark, str(source), "a string, b string, c string"))
    assert [(r.row_index, r.b, r.c) for r in rows.orderBy("row_index").collect()] == [(i, str(i), None) for i in range(50)]


def test_row_numbers_follow_the_files(spark, tmp_path):
    """A scan packs the largest file first; rows are still numbered by file name."""
    (tmp_path / "part-0.csv").write_text("a\nfirst\n")
    (tmp_path / "part-1.csv").write_text("a\n" + "\n".join(f"second-{i}" for i in range(50)))
    (tmp_path / "part-2.csv").write_text("a\n" + "\n".join(f"third-{i}" for i in range(5)))
    rows = catalog.with_row_index(catalog.read_delimited(spark, str(tmp_path), "a string")).orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(56))
    assert [r.a for r in rows] == ["first", *(f"second-{i}" for i in range(50)), *(f"third-{i}" for i in range(5))]


def test_checksums(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"alpha")
    (tmp_path / "b.bin").write_bytes(b"beta")
    rows = [("a.bin", "sha256", hashlib.sha256(b"alpha").hexdigest()), ("b.bin", "md5", "0"), ("c.bin", "sha1", "0")]
    got = {r.name: r.status for r in ingestion.verify_checksums(spark, spark.createDataFrame(rows, "name string, algorithm string, checksum string"), str(tmp_path)).collect()}
    assert got == {"a.bin": "ok", "b.bin": "mismatch", "c.bin": "missing"}
    joined = "\n".join(hashlib.sha256(b).hexdigest() for b in (b"alpha", b"beta"))
    assert ingestion.content_hash(spark, str(tmp_path)).first()[0] == hashlib.sha256(joined.encode()).hexdigest()


def test_checksums_of_nested_names(spark, tmp_path):
    for folder, data in (("", b"top"), ("a", b"one"), ("b", b"two")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "x.csv").write_bytes(data)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    rows = [("x.csv", "sha256", sha(b"top")), ("a/x.csv", "sha256", sha(b"one")), ("./b/x.csv", "sha256", sha(b"two")), ("c/x.csv", "sha256", "0")]
    found = ingestion.verify_checksums(spark, spark.createDataFrame(rows, "name string, algorithm string, checksum string"), str(tmp_path)).collect()
    assert sorted((r.name, r.status) for r in found) == [("a/x.csv", "ok"), ("b/x.csv", "ok"), ("c/x.csv", "missing"), ("x.csv", "ok")]
    one = [("x.csv", "sha256", sha(b"one"))]
    found = ingestion.verify_checksums(spark, spark.createDataFrame(one, "name string, algorithm string, checksum string"), str(tmp_path / "a" / "x.csv")).collect()
    assert [(r.name, r.status) for r in found] == [("x.csv", "ok")]


def test_process_domain(spark, tmp_path):
    source = tmp_path / "raw"
    source.mkdir()
    (source / "x.json").write_text('{"item_id":"a","v":2}\n{"item_id":"a","v":1}\n{"v":3}\n')
    ingestion.process_domain(spark, str(source), str(tmp_path / "out"), "item_id string, v int", ["v"])
    assert [(r.item_id, r.v, r.ingested_at is not None) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 1, True)]


def test_feature_and_vector_tables(spark, tmp_path):
    rows = [("ns", "item", "1", "clip", "v1", "text", [1.0], 1), ("ns", "item", "1", "clip", "v1", "text", [2.0], 2), ("ns", "item", "2", "clip", "v1", "image", [3.0], 1)]
    path = str(tmp_path / "features")
    tables.append_features(spark.createDataFrame(rows, "namespace string, entity_type string, entity_id string, feature_name string, feature_version string, modality string, vector array<double>, seq long"), path)
    loaded = tables.load_features(spark, path, "clip", "text")
    from slatewise.operators.features import latest_features

    newest = latest_features(loaded).first()
    assert newest.key == "ns:item:1:clip:v1:text" and newest.vector == [2.0]
    assert newest.checksum == hashlib.sha256(b"2.00000000").hexdigest()
    items = spark.createDataFrame([(0, "a", [1.0, 2.0], "x"), (1, "b", [], "x")], "pos long, item_id string, vector array<double>, domain string")
    tables.build_vector_table(items, str(tmp_path / "vectors"))
    assert tables.load_vector_table(spark, str(tmp_path / "vectors")).count() == 1
    tables.build_vector_table(items.filter("pos = 1"), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        tables.load_vector_table(spark, str(tmp_path / "none"))


def test_facts(spark):
    artist = {"name": "Ada", "score": 90, "type": "Person", "tags": [{"name": t, "count": c} for t, c in (("a", 1), ("b", 5), ("c", -1), ("d", 5), ("e", 2), ("f", 3), ("g", 0))], "life-span": {"begin": "1970"}, "aliases": [{"name": n} for n in ("x", "", "y", "z", "w")]}
    weak = {"name": "Bob", "score": 10}
    row = facts.artist_facts(spark.createDataFrame([(json.dumps(artist),), (json.dumps(weak),)], "payload string")).collect()
    assert len(row) == 1 and row[0].genres == ["b", "d", "f", "e", "a"] and row[0].aliases == ["x", "y", "z"]
    assert row[0].facts == "Truth File: Artist: Ada | Type: Person | Genres: b, d, f, e, a | Born: 1970"
    book = {"title": "T", "author_name": list("abcd"), "subject": ["nyt:x", "award:y"] + [f"s{i}" for i in range(9)], "first_publish_year": 1999}
    frame = spark.createDataFrame([(json.dumps(book),)], "payload string")
    got = facts.book_facts(frame).first()
    assert got.authors == ["a", "b", "c"] and got.subjects[:2] == ["award:y", "s0"] and len(got.subjects) == 8
    assert facts.book_facts(frame, skip_prefixes=("nyt:", "award:")).first().subjects[0] == "s0"
    movies = spark.createDataFrame([(0, "Film", "Dir", "A", "", None)], "pos int, movie_title string, director_name string, actor_1_name string, actor_2_name string, actor_3_name string")
    films = spark.createDataFrame([("film", None), ("none", None)], "title string, payload string")
    lines = {r.title: r.facts for r in facts.film_facts(films, movies).collect()}
    assert lines == {"film": "Truth File: Movie: Film | Director: Dir | Cast: A", "none": None}


def test_lists_and_lines(spark):
    rows = [('["a","b,c"]',), ('["a","b"c","d"]',), ("plain",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(facts.text_to_list("t")).collect()]
    assert got == [["a", "b,c"], ["a", 'b"c', "d"], ["plain"]]
    from slatewise.functions import expressions as X

    text = "hello\nTruth File: Book: T | Author: A: B | junk | book: Z\nTruth File: Book: other"
    assert spark.createDataFrame([(text,)], "t string").select(X.facts_map("t")).first()[0] == {"author": "A: B", "book": "Z"}


def test_registry(spark):
    registry = spark.createDataFrame([("a", "1")], "dataset_id string, version string")
    batch = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], "dataset_id string, version string")
    fresh, clashing = ingestion.register_snapshots(registry, batch)
    assert [tuple(r) for r in fresh.collect()] == [("a", "2")]
    assert sorted(r.snapshot_key for r in clashing.collect()) == ["a:1", "b:1"]
    assert schemas.ASSET.fieldNames()[:2] == ["uri", "mime_type"]
