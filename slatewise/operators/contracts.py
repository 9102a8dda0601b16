"""Record contracts: which required fields are missing or of the wrong type, per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.operators.scale import spread

# Required and optional fields with their JSON types, per record kind.
ASSET_FIELDS = {
    "uri": ("string", True),
    "mime_type": ("string", True),
    "checksum": ("string?", False),
    "size_bytes": ("number?", False),
    "width_px": ("number?", False),
    "height_px": ("number?", False),
    "duration_ms": ("number?", False),
    "codec": ("string?", False),
}
CONTRACTS = {
    "item": {
        "item_id": ("string", True),
        "domain": ("string", True),
        "locale": ("string", True),
        "modalities": ("object", True),
        "modalities.text": ("object", True),
        "modalities.image": ("object", True),
        "modalities.audio": ("object", True),
        "modalities.video": ("object", True),
        "modalities.sequence": ("object", True),
        "assets": ("object", False),
        "assets.text": ("assets", False),
        "assets.image": ("assets", False),
        "assets.audio": ("assets", False),
        "assets.video": ("assets", False),
        "provenance": ("object", True),
    },
    "user": {
        "user_id": ("string", True),
        "locale": ("string", True),
        "attributes": ("object", False),
        "preferences": ("object", False),
    },
    "session": {
        "session_id": ("string", True),
        "user_id": ("string?", False),
        "started_at_utc": ("string", True),
        "context": ("object", True),
        "context.device_type": ("string", True),
        "context.network_type": ("string", False),
        "context.timezone_offset": ("number", False),
        "context.app_version": ("string", False),
        "context.cohort": ("string", True),
    },
    "event": {
        "event_id": ("string", True),
        "event_type": ("string", True),
        "user_id": ("string?", False),
        "item_id": ("string?", False),
        "session_id": ("string?", False),
        "occurred_at_utc": ("string", True),
        "properties": ("object", False),
    },
    "snapshot": {
        "dataset_id": ("string", True),
        "version": ("string", True),
        "license_name": ("string", True),
        "source_uri": ("string", True),
        "snapshot_utc": ("string", True),
        "content_hash": ("string", True),
        "schema_hash": ("string", True),
        "extra": ("object", False),
    },
}
# Event types.
KNOWN_EVENT_TYPES = ("impression", "click", "dwell", "purchase", "save", "hide", "skip", "complaint")


def _kind_matches(variant_type: Column, kind: str) -> Column:
    """``variant_type`` is the text of schema_of_variant for the field."""
    base = kind.rstrip("?")
    number = variant_type.rlike(r"^(BIGINT|DOUBLE|DECIMAL.*)$")
    ok = {
        "string": variant_type == "STRING",
        "number": number,
        "object": variant_type.startswith("OBJECT"),
        "assets": variant_type.startswith("ARRAY"),
    }[base]
    return (ok | (variant_type == "VOID")) if kind.endswith("?") else ok


def _field_problem(record: Column, path: str, kind: str, required: bool) -> Column:
    value = F.try_variant_get(record, f"$.{path}", "variant")
    shape = F.schema_of_variant(value)
    problem = F.when(value.isNull(), F.lit(f"{path}: missing") if required else F.lit(None).cast("string"))
    return problem.when(~_kind_matches(shape, kind), F.lit(f"{path}: not {kind.rstrip('?')}"))


def _asset_problems(record: Column, path: str) -> Column:
    """Entries of one asset list that lack a field or hold it in the wrong type, with their place."""
    entries = F.try_variant_get(record, f"$.{path}", "array<variant>")

    def of(entry: Column, index: Column) -> Column:
        found = F.array(*[_field_problem(entry, name, kind, required) for name, (kind, required) in ASSET_FIELDS.items()])
        bad = F.filter(found, lambda p: p.isNotNull())
        return F.transform(bad, lambda p: F.concat(F.lit(f"{path}["), index.cast("string"), F.lit("]."), p))

    return F.flatten(F.transform(F.coalesce(entries, F.array().cast("array<variant>")), of))


def validate_records(records: DataFrame, contract: str, payload: str = "payload", strict_event_type: bool = False) -> DataFrame:
    """Adds ``violations`` (text list) and ``valid`` to rows whose ``payload`` column holds a JSON record."""
    record = F.try_parse_json(payload)
    fields = CONTRACTS[contract]
    checks = []
    for path, (kind, required) in fields.items():
        problem = _field_problem(F.col("__record"), path, kind, required)
        if "." in path:
            # A broken parent is reported once, not again for each of its fields.
            parent = F.try_variant_get(F.col("__record"), f"$.{path.rsplit('.', 1)[0]}", "variant")
            problem = F.when(F.schema_of_variant(parent).startswith("OBJECT"), problem)
        checks.append(problem)
    listed = [F.array(*checks)]
    for path, (kind, _) in fields.items():
        if kind == "assets":
            listed.append(_asset_problems(F.col("__record"), path))
    if strict_event_type:
        kind = F.try_variant_get(F.col("__record"), "$.event_type", "string")
        listed.append(F.array(F.when(kind.isNotNull() & ~kind.isin(*KNOWN_EVENT_TYPES), F.lit("event_type: unknown"))))
    found = F.filter(F.concat(*listed), lambda p: p.isNotNull())
    shaped = F.when(F.col("__record").isNull(), F.array(F.lit("record: not JSON"))).otherwise(found)
    checked = spread(records).withColumn("__record", record).withColumn("violations", shaped)
    return checked.withColumn("valid", F.size("violations") == 0).drop("__record")


def known_event_type(event_type: str = "event_type") -> Column:
    return F.coalesce(F.col(event_type).isin(*KNOWN_EVENT_TYPES), F.lit(False))


def split_valid(checked: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects). Strict mode raises on the first reject; lenient mode hands the rejects back, one row each."""
    rejects = checked.filter(~F.col("valid"))
    if strict:
        bad = rejects.limit(1).collect()
        if bad:
            raise ValueError(f"invalid record: {bad[0]['violations']}")
    return checked.filter(F.col("valid")).drop("valid", "violations"), rejects
