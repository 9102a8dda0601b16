"""The ingestion job: manifest in; items, rejects, snapshot and report out."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from slatewise.operators.contracts import split_valid, validate_records
from slatewise.operators.scale import top_n_per_group
from slatewise.sources.catalog import ADAPTERS, AdapterConfig, missing_columns, with_row_index

# Manifest fields and their types; the last two are optional.
_REQUIRED = {
    "dataset_id": str,
    "version": str,
    "domain": str,
    "source_uri": str,
    "license_name": str,
    "snapshot_utc": str,
    "locale_default": str,
    "expected_columns": list,
    "output_items_path": str,
    "output_snapshot_path": str,
}


@dataclass(frozen=True)
class Manifest:
    dataset_id: str
    version: str
    domain: str
    source_uri: str
    license_name: str
    snapshot_utc: str
    locale_default: str
    expected_columns: tuple[str, ...]
    output_items_path: str
    output_snapshot_path: str
    record_limit: int | None
    strict_validation: bool
    extras: dict


def parse_manifest(text: str) -> Manifest:
    """Checks the one small JSON document of a job."""
    raw = json.loads(text)
    for name, kind in _REQUIRED.items():
        if name not in raw:
            raise ValueError(f"manifest lacks {name}")
        if not isinstance(raw[name], kind):
            raise ValueError(f"manifest field {name} must be {kind.__name__}")
    if not all(isinstance(c, str) for c in raw["expected_columns"]):
        raise ValueError("manifest field expected_columns must hold strings")
    limit, strict = raw.get("record_limit"), raw.get("strict_validation", True)
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, (int, float))):
        raise ValueError("manifest field record_limit must be a number or null")
    if not isinstance(strict, bool):
        raise ValueError("manifest field strict_validation must be a boolean")
    extras = {k: v for k, v in raw.items() if k not in _REQUIRED and k not in ("record_limit", "strict_validation")}
    values = {k: raw[k] for k in _REQUIRED}
    values["expected_columns"] = tuple(raw["expected_columns"])
    return Manifest(**values, record_limit=None if limit is None else int(limit), strict_validation=strict, extras=extras)


def limit_records(df: DataFrame, limit: int | None, order: str = "row_index") -> DataFrame:
    """First ``limit`` records in file order, by their number, so that no task has to gather them."""
    return df if limit is None else df.filter(F.col(order) < limit)


def file_digests(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, algorithm) to digest. Each file is read in pieces inside a task, so its size does not matter."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            out = []
            for path, algorithm in zip(frame["path"], frame["algorithm"]):
                system, inner = fs.FileSystem.from_uri(path)
                total = hashlib.new(algorithm)
                with system.open_input_stream(inner) as stream:
                    while piece := stream.read(1 << 22):
                        total.update(piece)
                out.append(total.hexdigest())
            yield frame.assign(digest=out)

    return files.select("path", "algorithm").repartition("path").mapInPandas(digest, "path string, algorithm string, digest string")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below ``path`` without reading the files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return listed.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """One row. A single file: SHA-256 of its bytes. Several: SHA-256 over the sorted digests, one per line."""
    digests = file_digests(spark, list_files(spark, path).withColumn("algorithm", F.lit("sha256")))
    # One digest per file.
    listed = digests.agg(F.sort_array(F.collect_list(F.struct("path", "digest"))).alias("d"))
    joined = F.array_join(F.transform("d", lambda e: e["digest"]), "\n")
    return listed.select(F.when(F.size("d") == 1, F.col("d")[0]["digest"]).otherwise(F.sha2(joined, 256)).alias("content_hash"))


def schema_hash(columns: list[str]) -> str:
    return hashlib.sha256("\n".join(columns).encode("utf8")).hexdigest()


def verify_checksums(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """status ok / missing / mismatch per manifest row (name, algorithm, checksum); names are relative to ``root``."""
    plain = lambda path: F.regexp_replace(path, "^file:/*", "/")
    files = list_files(spark, root)
    # What stands behind the root; a root that is a file itself is named by its last part.
    base = re.sub("^file:/*", "/", root).rstrip("/")
    behind = F.when(plain("path").endswith(base), F.lit(base.rsplit("/", 1)[-1])).otherwise(F.element_at(F.split(plain("path"), re.escape(base.lstrip("/") + "/"), 2), -1))
    files = files.withColumn("name", behind)
    manifest = manifest.withColumn("name", F.regexp_replace("name", "^(\\./)+", ""))
    present = manifest.join(files, "name", "left")
    digests = file_digests(spark, present.filter(F.col("path").isNotNull()))
    joined = present.join(digests, ["path", "algorithm"], "left")
    status = F.when(F.col("path").isNull(), "missing").when(F.lower("checksum") == F.col("digest"), "ok").otherwise("mismatch")
    return joined.select("name", "algorithm", "checksum", status.alias("status"))


def deduplicate_domain(raw: DataFrame, order: list, key: str = "item_id", stamp: bool = True) -> DataFrame:
    """Rows with a key, one per key (first in ``order``), with the ingestion time."""
    kept = top_n_per_group(raw.filter(F.col(key).isNotNull()), [key], order, 1, "__n").drop("__n")
    return kept.withColumn("ingested_at", F.current_timestamp()) if stamp else kept


def process_domain(spark: SparkSession, source: str, target: str, schema: str, order: list[str]) -> None:
    """JSON folder to a Parquet folder of distinct items."""
    rows = deduplicate_domain(spark.read.schema(schema).json(source), [F.col(c) for c in order])
    rows.write.mode("overwrite").parquet(target)


def snapshot_key(dataset: str = "dataset_id", version: str = "version"):
    return F.concat_ws(":", dataset, version)


def register_snapshots(registry: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, clashing keys). A key clashes when the registry has it or the batch holds it twice."""
    keyed = batch.withColumn("snapshot_key", snapshot_key())
    taken = registry.select(snapshot_key().alias("snapshot_key")).distinct()
    twice = keyed.groupBy("snapshot_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("snapshot_key")
    clashing = keyed.select("snapshot_key").join(taken, "snapshot_key", "left_semi").unionByName(twice).distinct()
    return keyed.join(clashing, "snapshot_key", "left_anti").drop("snapshot_key"), clashing


def run_ingestion(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Reads, checks, normalises, validates and writes one dataset; returns the one-row report.

    Counts come from observations of the write itself, so the source is not read again for them. Rejects go to
    ``<items>.rejects`` in lenient mode and abort the job in strict mode.
    """
    adapter = ADAPTERS.get(manifest.dataset_id)
    if adapter is None:
        raise ValueError(f"no adapter for {manifest.dataset_id}")
    mapping = manifest.extras.get("mapping", {}) or {}
    config = AdapterConfig(
        manifest.dataset_id, manifest.domain, manifest.locale_default, str(manifest.extras.get("delimiter", ",")),
        str(mapping.get("id_column", "")), str(mapping.get("title_column", "")), tuple(mapping.get("text_columns", []) or []),
    )
    raw = adapter.read(spark, manifest.source_uri, config)
    absent = missing_columns(raw, manifest.expected_columns)
    if absent:
        raise ValueError(f"missing columns in source: {', '.join(absent)}")
    columns = raw.columns
    read = Observation("read")
    limited = limit_records(with_row_index(raw), manifest.record_limit).observe(read, F.count(F.lit(1)).alias("n"))
    items = adapter.normalize(limited, config)
    checked = validate_records(items.withColumn("payload", F.to_json(F.struct(*items.columns))), "item")
    if manifest.strict_validation:
        checked = checked.withColumn(
            "valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat(F.lit("invalid record: "), F.array_join("violations", "; "))).cast("boolean"))
        )
    written = Observation("written")
    valid, rejects = split_valid(checked, strict=False)
    valid.drop("payload").observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(manifest.output_items_path)
    rejected = 0
    if not manifest.strict_validation:
        refused = Observation("refused")
        rejects.select("payload", "violations").observe(refused, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(manifest.output_items_path + ".rejects")
        rejected = refused.get["n"]
    total, kept = read.get["n"], written.get["n"]
    content = content_hash(spark, manifest.source_uri)
    snapshot = content.select(
        *[F.lit(v).alias(k) for k, v in (
            ("dataset_id", manifest.dataset_id), ("version", manifest.version), ("license_name", manifest.license_name),
            ("source_uri", manifest.source_uri), ("snapshot_utc", manifest.snapshot_utc), ("schema_hash", schema_hash(columns)),
            ("domain", manifest.domain), ("record_limit", manifest.record_limit), ("rejected", rejected),
        )],
        "content_hash",
    )
    snapshot.write.mode("overwrite").json(manifest.output_snapshot_path)
    warnings = ["invalid item skipped"] * min(rejected, 1) + (["record_limit applied"] if manifest.record_limit is not None else [])
    return spark.createDataFrame([(total, kept, rejected, "; ".join(warnings))], "total_rows long, normalized_rows long, rejected_rows long, warnings string")
