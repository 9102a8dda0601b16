"""Text screening, personal-data redaction and keyword routing over text tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions import expressions as X
from slatewise.operators.scale import spread

# A word's edge by ASCII letters, digits and underscore. Java's \b also counts other letters as part of a word.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
# Blocked patterns in the order they are tried.
BLOCKED_PATTERNS = (
    ("script_injection", r"(?i)<\s*script"),
    ("sql_injection", rf"(?i){EDGE}(select|union|drop|insert|delete|update){EDGE}.+{EDGE}(from|table|into|where){EDGE}"),
    ("path_traversal", r"\.\./|\.\.\\"),
    ("null_byte", r"\x00"),
    ("prompt_injection", r"(?i)ignore\s+previous\s+instructions|system\s+prompt"),
)
# Personal data patterns in the order they are redacted.
PERSONAL_DATA = (
    ("email", rf"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{EDGE}", "[REDACTED_EMAIL]"),
    ("phone", rf"{EDGE}\+?\d[\d\-() ]{{8,}}\d{EDGE}", "[REDACTED_PHONE]"),
    ("card", rf"{EDGE}(?:\d[ -]*){{13,19}}{EDGE}", "[REDACTED_CARD]"),
)
NON_PRINTABLE = r"[\p{C}\p{Zl}\p{Zp}   -   　]"


@dataclass(frozen=True)
class ScreenLimits:
    query_length: int = 180
    form_fields: int = 80
    field_length: int = 10_000


def strip_controls(text: Column | str) -> Column:
    """Without non-printable characters (line breaks vanish), single blanks, trimmed."""
    value = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.regexp_replace(value, NON_PRINTABLE, ""), " +", " "))


def blocked_reason(clean: Column) -> Column:
    reason = F.lit(None).cast("string")
    for name, pattern in reversed(BLOCKED_PATTERNS):
        reason = F.when(clean.rlike(pattern), F.lit(name)).otherwise(reason)
    return reason


def redact(clean: Column) -> tuple[Column, Column]:
    """Redacted text and the kinds found, each step working on the text left by the one before."""
    text, kinds = clean, []
    for kind, pattern, mask in PERSONAL_DATA:
        kinds.append(F.when(text.rlike(pattern), F.lit(kind)))
        text = F.regexp_replace(text, pattern, mask)
    return text, F.filter(F.array(*kinds), lambda k: k.isNotNull())


def screen_text(texts: DataFrame, text: str = "text", max_length: int = ScreenLimits.query_length) -> DataFrame:
    """Adds allowed, status, reason, sanitized, redactions. First rule that fires decides."""
    with_clean = spread(texts).withColumn("__clean", strip_controls(F.coalesce(F.col(text), F.lit(""))))
    masked, kinds = redact(F.col("__clean"))
    staged = with_clean.withColumn("__blocked", blocked_reason(F.col("__clean"))).withColumn("__masked", masked).withColumn("__kinds", kinds)
    reason = (
        F.when(F.col("__clean") == "", "empty_input")
        .when(F.length("__clean") > max_length, "input_too_large")
        .when(F.col("__blocked").isNotNull(), F.col("__blocked"))
        .when(F.size("__kinds") > 0, "pii_detected")
        .otherwise("ok")
    )
    done = staged.withColumn("reason", reason)
    personal = F.col("reason") == "pii_detected"
    return (
        done.withColumn("allowed", F.col("reason") == "ok")
        .withColumn("status", F.when(F.col("reason") == "ok", 200).when(F.col("reason") == "input_too_large", 413).otherwise(400))
        .withColumn("sanitized", F.when(personal, F.col("__masked")).when(F.col("reason") == "ok", F.col("__clean")).otherwise(""))
        .withColumn("redactions", F.when(personal, F.col("__kinds")).otherwise(F.array().cast("array<string>")))
        .drop("__clean", "__blocked", "__masked", "__kinds")
    )


def screen_forms(forms: DataFrame, key: str = "form_id", fields: str = "fields", limits: ScreenLimits = ScreenLimits()) -> DataFrame:
    """One verdict per form. ``fields`` is an array of (name, value) in form order; the first bad field decides.

    Forms with too many fields are decided before their fields are unfolded, so a form yields at most 80 rows.
    """
    sized = forms.withColumn("__n", F.size(fields))
    large = sized.filter(F.col("__n") > limits.form_fields).select(
        key, F.lit(False).alias("allowed"), F.lit(413).alias("status"), F.lit("too_many_form_fields").alias("reason")
    )
    empty = sized.filter(F.col("__n") == 0).select(key, F.lit(True).alias("allowed"), F.lit(200).alias("status"), F.lit("ok").alias("reason"))
    rows = sized.filter((F.col("__n") <= limits.form_fields) & (F.col("__n") > 0)).select(
        key, F.posexplode(fields).alias("place", "field")
    )
    rows = rows.select(key, "place", F.col("field.name").alias("name"), F.col("field.value").alias("value"))
    verdicts = screen_text(rows, "value", limits.field_length)
    bad = F.when(~F.col("allowed"), F.col("place"))
    per_form = verdicts.groupBy(key).agg(F.min_by(F.struct("status", "reason", "name"), bad).alias("first_bad"))
    decided = per_form.select(
        key,
        F.col("first_bad").isNull().alias("allowed"),
        F.coalesce("first_bad.status", F.lit(200)).alias("status"),
        F.coalesce(F.concat_ws(":", "first_bad.reason", "first_bad.name"), F.lit("ok")).alias("reason"),
    )
    decided = decided.withColumn("reason", F.when(F.col("allowed"), "ok").otherwise(F.col("reason")))
    return decided.unionByName(large).unionByName(empty)


# Keyword weights per domain.
KEYWORD_WEIGHTS = {
    "movies": {
        "movie": 3.0, "film": 3.0, "cinema": 2.5, "director": 2.5, "actor": 2.0, "actress": 2.0, "cast": 1.5,
        "screenplay": 2.0, "blockbuster": 2.0, "oscar": 2.0, "imdb": 2.0, "trailer": 1.5, "sequel": 1.5,
        "franchise": 1.5, "directed": 2.5, "starring": 2.0, "watch": 1.0, "scene": 1.0, "plot": 1.0, "hollywood": 2.0,
    },
    "music": {
        "song": 3.0, "album": 3.0, "artist": 2.0, "singer": 3.0, "rapper": 3.0, "band": 3.0, "musician": 3.0,
        "concert": 2.5, "track": 2.0, "lyrics": 2.5, "melody": 2.0, "beat": 1.5, "genre": 1.0, "grammy": 2.5, "rap": 2.5,
        "rock": 1.5, "pop": 1.5, "jazz": 2.0, "hip hop": 2.5, "listen": 1.0, "playlist": 2.0, "tour": 1.5,
        "guitar": 2.0, "vocal": 2.0,
    },
    "books": {
        "book": 3.0, "novel": 3.0, "author": 2.5, "writer": 2.5, "wrote": 2.0, "written": 2.0, "publish": 2.0,
        "edition": 2.0, "read": 1.5, "fiction": 2.0, "nonfiction": 2.0, "literature": 2.5, "chapter": 2.0,
        "bestseller": 2.0, "paperback": 2.0, "hardcover": 2.0, "library": 1.5, "isbn": 2.5, "page": 1.0, "trilogy": 2.0,
        "memoir": 2.5, "biography": 2.5, "poetry": 2.5, "narrative": 1.5,
    },
}
SUPPORTED_DOMAINS = ("movies", "music", "books")


def _sum_of(words: str, lookup: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(lookup[w], F.lit(0.0)))


def route_by_keywords(
    texts: DataFrame, text: str = "text", weights: dict[str, dict[str, float]] | None = None, floor: float = 0.4,
    override: str | None = None,
) -> DataFrame:
    """Adds domain, confidence, method. Words count once per text; phrases match anywhere in it.

    The weights are a small fixed table, so they live in the expression: every text is routed where it is, without a
    join or a shuffle. Ties go to the domain listed first. A supported ``override`` value wins with confidence 1.
    """
    table = weights or KEYWORD_WEIGHTS
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    routed = spread(texts).withColumn("__lower", lower)
    routed = routed.withColumn("__words", F.array_distinct(F.regexp_extract_all("__lower", F.lit("[a-z]+"), F.lit(0))))
    scores = []
    for words in table.values():
        single = {w: v for w, v in words.items() if " " not in w}
        lookup = F.create_map(*[F.lit(v) for pair in single.items() for v in pair])
        total = _sum_of("__words", lookup)
        for phrase, value in words.items():
            if " " in phrase:
                total = total + F.when(F.col("__lower").contains(phrase), value).otherwise(0.0)
        scores.append(total)
    for i, total in enumerate(scores):
        routed = routed.withColumn(f"__s{i}", total)
    whole = sum((F.col(f"__s{i}") for i in range(len(scores))), F.lit(0.0))
    best = F.greatest(*[F.col(f"__s{i}") for i in range(len(scores))], F.lit(0.0))
    name = F.lit(None).cast("string")
    for i, domain in reversed(list(enumerate(table))):
        name = F.when(F.col(f"__s{i}") == F.col("__best"), F.lit(domain)).otherwise(name)
    routed = routed.withColumn("__whole", whole).withColumn("__best", best)
    share = F.when(F.col("__whole") > 0.0, F.col("__best") / F.col("__whole")).otherwise(0.0)
    routed = routed.withColumn("confidence", share)
    routed = routed.withColumn("domain", F.when(F.col("confidence") < floor, "unknown").otherwise(name)).withColumn("method", F.lit("keyword"))
    if override:
        forced = F.coalesce(F.col(override).isin(*SUPPORTED_DOMAINS), F.lit(False))
        routed = (
            routed.withColumn("domain", F.when(forced, F.col(override)).otherwise(F.col("domain")))
            .withColumn("confidence", F.when(forced, 1.0).otherwise(F.col("confidence")))
            .withColumn("method", F.when(forced, "user_override").otherwise(F.col("method")))
        )
    return routed.drop("__lower", "__words", "__whole", "__best", *[f"__s{i}" for i in range(len(scores))])


def mentions_entity(query: Column, name: Column) -> Column:
    """At least half of the name's words, and at least one, are words of the query."""
    words = X.ascii_token_set(name)
    shared = F.size(F.array_intersect(words, X.ascii_token_set(query)))
    return F.coalesce((F.size(words) > 0) & (shared >= F.greatest(F.lit(1.0), F.size(words) * 0.5)), F.lit(False))
