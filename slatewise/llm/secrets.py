"""Secret scan: every rule in one byte pass of one minimal automaton.

The joint automaton of all mirrored rules (of some long ones, of what every match begins with) reads a text once, from its
last byte to its first, and so names every position at which a match of some rule begins. Walking these positions forward, each rule takes the leftmost one that its previous
match has not passed and follows its own automaton to the longest end.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.automaton import Automaton
from slatewise.llm.common import map_rows, text_bytes


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` of it has at least ``least`` characters; else it is passed over.

    ``lead``, where given, is an expression that every match begins with: the joint automaton looks for it in place of the
    whole of a long rule, which keeps it small."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    fold_case: bool = False
    lead: str | None = None


# The base rules. [0-9a-f]{24,} finds the same matches as [0-9a-f]+ of 24 or more.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
# Publicly documented token formats. Lengths are the least ones, so that the joint automaton needs no counters.
MORE_RULES = (
    # A private key: the first line, header lines, lines of base64, and the last line; a key cut short ends with its base64.
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]+-----([\r\n]+[A-Za-z-]+:\x20[A-Za-z0-9,\x20/.-]+)*(([\r\n\x20\t]|\\[nr])+[A-Za-z0-9+/=]{16,})*(([\r\n\x20\t]|\\[nr])*([A-Za-z0-9+/=]+([\r\n\x20\t]|\\[nr])+)?-----END [A-Z0-9 ]+-----)?", 20, lead="-----BEGIN [A-Z0-9 ]+-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("code_host_fine", r"github_pat_[A-Za-z0-9_]+", 80),
    Rule("code_host_lab", r"gl(pat|dt|rt|cbt|ptt)-[A-Za-z0-9_-]+", 25),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 16),
    Rule("chat_hook", r"hooks\.slack\.com/services/[A-Za-z0-9]+/[A-Za-z0-9]+/[A-Za-z0-9]+", 60, lead=r"hooks\.slack\.com/services/"),
    Rule("chat_hook_other", r"discord(app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+", 80, lead=r"discord(app)?\.com/api/webhooks/"),
    Rule("chat_bot", r"[0-9]+:AA[A-Za-z0-9_-]+", 44),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("oauth_secret", r"GOCSPX-[A-Za-z0-9_-]+", 30),
    Rule("oauth_access", r"ya29\.[A-Za-z0-9_-]+", 40),
    Rule("session_access", r"ASIA[A-Z0-9]+", 20),
    Rule("storage_key", r"AccountKey=[A-Za-z0-9+/]+==", 90, lead="AccountKey="),
    Rule("payment", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("payment_point", r"sq0(atp|csp|idp)-[A-Za-z0-9_-]+", 29),
    Rule("mail_grid", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 60, lead=r"SG\."),
    Rule("mail_gun", r"key-[0-9a-f]+", 36),
    Rule("mail_list", r"[0-9a-f]+-us[0-9]+", 36),
    Rule("phone_key", r"SK[0-9a-f]+", 34),
    Rule("package_js", r"npm_[A-Za-z0-9]+", 40),
    Rule("package_py", r"pypi-AgE[A-Za-z0-9_-]+", 60),
    Rule("package_rb", r"rubygems_[0-9a-f]+", 57),
    Rule("shop", r"shp(at|ca|pa|ss)_[A-Fa-f0-9]+", 38),
    Rule("cloud_ocean", r"do[opr]_v1_[a-f0-9]+", 71),
    Rule("vault", r"hv[bs]\.[A-Za-z0-9_-]+", 28),
    Rule("lakehouse", r"dapi[0-9a-f]+", 36),
    Rule("models", r"hf_[A-Za-z]+", 37),
    Rule("issues", r"lin_api_[A-Za-z0-9]+", 48),
    Rule("requests", r"PMAK-[0-9a-f]+-[0-9a-f]+", 60, lead="PMAK-"),
    Rule("file_key", r"AGE-SECRET-KEY-1[0-9A-Z]+", 74, lead="AGE-SECRET-KEY-1"),
    Rule("dashboards", r"glsa_[A-Za-z0-9]+_[A-Fa-f0-9]+", 46, lead="glsa_"),
    Rule("monitoring", r"NRAK-[A-Z0-9]+", 32),
    Rule("stack", r"pul-[0-9a-f]+", 44),
)
RULES = BASE_RULES + MORE_RULES

Span = tuple[str, int, int]
_CONTINUATION = bytes(range(0x80, 0xC0))


class Scanner:
    def __init__(self, rules: Sequence[Rule] = RULES) -> None:
        self.rules = tuple(rules)
        self.starts = Automaton([(r.lead or r.pattern, r.fold_case) for r in rules], backward=True, anywhere=True)
        self.ends = [Automaton([(r.pattern, r.fold_case)]) for r in rules]
        self.checks = [re.compile(r.pattern.encode(), re.IGNORECASE if r.fold_case else 0) for r in rules]

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, by start and then rule."""
        passed = [0] * len(self.rules)
        found = []
        for at, rules in self.starts.hits_from_end(data):
            for number, rule in enumerate(self.rules):
                if rules >> number & 1 and at >= passed[number]:
                    end = self.ends[number].longest(data, at)
                    if end < 0:  # a lead alone
                        continue
                    passed[number] = end
                    match = self.checks[number].fullmatch(data, at, end)
                    if match and match.end(rule.group) - match.start(rule.group) >= rule.least:
                        found.append((at, number, end))
        return found

    def spans(self, data: bytes) -> list[Span]:
        """(kind, start, end) in code points."""
        out, byte, points = [], 0, 0
        for at, number, end in self.byte_spans(data):
            points += len(data[byte:at].translate(None, _CONTINUATION))
            byte = at
            out.append((self.rules[number].kind, points, points + len(data[at:end].translate(None, _CONTINUATION))))
        return out

    def redact(self, data: bytes, mark: bytes) -> bytes:
        """``data`` with every stretch covered by spans replaced by ``mark``."""
        out, done, covered = [], 0, -1
        for at, _, end in self.byte_spans(data):
            if at >= covered:
                if covered >= 0:
                    done = covered
                out += [data[done:at], mark]
            covered = max(covered, end)
        return b"".join(out) + data[max(covered, 0) :]


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """doc_id and ``found``, an array of (kind, start, end) in code points, end exclusive, by start and then rule.

    Null and empty texts have no spans; repeated rows give repeated rows; columns besides doc_id and ``text`` are ignored.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # grows with the rules only

    def make():
        spans = scanner.value.spans
        return lambda ids, texts: [(i, [dict(zip(("kind", "start", "end"), s)) for s in spans(t)]) for i, t in zip(ids, texts)]

    schema = "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text)), schema, make)


def secret_digest(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts of the base kinds and the spans as text, one row per document."""
    found = scan_secrets(docs, rules)
    base = [r.kind for r in BASE_RULES]
    of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in base],
        F.sha2(of(F.filter("found", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        of(F.col("found")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "<secret>") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mark`` and n_chars, where there is such a column, counted anew.

    All other columns stay. Null text stays null.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        redact = scanner.value.redact
        return texts.map(lambda t: None if t is None else redact(t.encode(), mark.encode()).decode())

    new = {"text": clean("text")}
    out = docs.withColumns(new)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
