import hashlib
import random
import re

import pytest

from slatewise.llm.automaton import Automaton
from slatewise.llm.secrets import BASE_RULES, RULES, Scanner, redact_secrets, scan_secrets, secret_digest
from tests.llm.helpers import documents, rows

PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "Z9", "0123456789abcdef", "deadbeef", "f", "é", "𝒳", "\n", "ſ", "K", "ghp_", "x" * 36, "eyJ", "ab.cd.", "-", "_", "/", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\\n", "MIIEpAIBAAKCAQEA", "sk_live_", "SG.", "key-"]


def plain(text, rules=RULES):
    found = []
    for number, rule in enumerate(rules):
        for match in re.finditer(rule.pattern, text, re.IGNORECASE | re.ASCII if rule.fold_case else 0):
            if len(match.group(rule.group)) >= rule.least:
                found.append((match.start(), number, rule.kind, match.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def mixed(count):
    rng = random.Random(5)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(count)]


def test_scanner_equals_regular_expressions():
    scanner = Scanner()
    for text in mixed(3000):
        assert scanner.spans(text.encode()) == plain(text), text


def test_automaton_is_minimal_and_finds_longest():
    machine = Automaton([("ab|ac|adb?", False)])
    assert len(machine.table) == 5  # start, after a, after ad, end, dead
    assert [machine.longest(t, 0) for t in (b"ab", b"adb", b"ad", b"ax")] == [2, 3, 2, -1]
    with pytest.raises(ValueError):
        Automaton([("a*", False)])


def test_awkward_rows(spark):
    long = "x " * 200_000 + "token=abcdef" + " y" * 1000
    texts = [None, "", "token=abcdef", "token=abcdef", "token=abc", long, "é AKIA" + "A" * 16]
    ids = [1, 2, 3, 3, None, 5, 6]
    got = rows(secret_digest(documents(spark, texts, ids)))
    want = []
    for i, text in zip(ids, texts):
        spans = plain(text or "")
        told = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        base = [s for s in spans if s[0] in [r.kind for r in BASE_RULES]]
        want.append((i, *[sum(s[0] == r.kind for s in spans) for r in BASE_RULES], hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
    assert got == sorted(want, key=repr)
    assert scan_secrets(documents(spark, [])).count() == 0


def test_redaction(spark):
    texts = [None, "", "a token=0123456789abcdef0123456789abcdef b", "plain é"]
    got = {r["doc_id"]: r for r in redact_secrets(documents(spark, texts)).collect()}
    assert [got[i]["text"] for i in range(4)] == [None, "", "a <secret> b", "plain é"]
    assert [got[i]["n_chars"] for i in range(4)] == [None, 0, 12, 7]
    scanner = Scanner()
    for text in mixed(500):
        clean = scanner.redact(text.encode(), b"<secret>").decode()
        covered = bytearray(len(text))
        for _, a, b in plain(text):
            covered[a:b] = b"\1" * (b - a)
        assert clean.replace("<secret>", "") == "".join(c for c, x in zip(text, covered) if not x)


KEY = "MIIEpAIBAAKCAQEA7bq9" + "Zx3+/" * 8
WHOLE = [
    f"-----BEGIN RSA PRIVATE KEY-----\n{KEY}\n{KEY}\nAbc=\n-----END RSA PRIVATE KEY-----",
    f"-----BEGIN ENCRYPTED PRIVATE KEY----- {KEY} {KEY} qT== -----END ENCRYPTED PRIVATE KEY-----",
    f"-----BEGIN EC PRIVATE KEY-----\\n{KEY}\\n{KEY}\\n-----END EC PRIVATE KEY-----",
    f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB12\n\n{KEY}\n-----END RSA PRIVATE KEY-----",
    f"-----BEGIN OPENSSH PRIVATE KEY-----\r\n{KEY}\r\n{KEY}",
]


def test_whole_keys_are_redacted(spark):
    """Also one that was cut short; the words around a key stay."""
    texts = [f"before {key} after it" for key in WHOLE] + [WHOLE[0], WHOLE[0]]
    got = redact_secrets(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["before <secret> after it"] * len(WHOLE) + ["<secret>"] * 2
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    assert redact_secrets(documents(spark, [])).count() == 0


def test_every_documented_format_is_found():
    filled = {
        "code_host": "ghp_" + "A1" * 18, "code_host_fine": "github_pat_" + "a1" * 41, "code_host_lab": "glpat-" + "a-" * 10, "chat": "xoxb-" + "1" * 20,
        "chat_hook": "hooks.slack.com/services/T" + "0" * 10 + "/B" + "0" * 10 + "/" + "x" * 24, "chat_hook_other": "discord.com/api/webhooks/" + "1" * 18 + "/" + "x" * 68,
        "chat_bot": "123456789:AA" + "x" * 33, "web_token": "eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl", "maps_key": "AIza" + "x" * 35, "oauth_secret": "GOCSPX-" + "x" * 28,
        "oauth_access": "ya29." + "x" * 40, "session_access": "ASIA" + "X" * 16, "storage_key": "AccountKey=" + "x" * 86 + "==", "payment": "sk_live_" + "x" * 24,
        "payment_point": "sq0atp-" + "x" * 22, "mail_grid": "SG." + "x" * 22 + "." + "y" * 43, "mail_gun": "key-" + "0" * 32, "mail_list": "0" * 32 + "-us12",
        "phone_key": "SK" + "0" * 32, "package_js": "npm_" + "x" * 36, "package_py": "pypi-AgEIcHlwaS5vcmc" + "x" * 50, "package_rb": "rubygems_" + "0" * 48,
        "shop": "shpat_" + "0" * 32, "cloud_ocean": "dop_v1_" + "0" * 64, "vault": "hvs." + "x" * 24, "lakehouse": "dapi" + "0" * 32, "models": "hf_" + "x" * 34,
        "issues": "lin_api_" + "x" * 40, "requests": "PMAK-" + "0" * 24 + "-" + "0" * 34, "file_key": "AGE-SECRET-KEY-1" + "Q" * 58, "dashboards": "glsa_" + "x" * 32 + "_" + "0" * 8,
        "monitoring": "NRAK-" + "X" * 27, "stack": "pul-" + "0" * 40, "private_key": WHOLE[0],
    }
    assert set(filled) == {r.kind for r in RULES} - {r.kind for r in BASE_RULES} and len(filled) >= 30
    scanner = Scanner()
    for kind, text in filled.items():
        spans = scanner.spans(f"some {text} words".encode())
        assert any(k == kind for k, _, _ in spans), kind
        assert scanner.spans(f"some {text} words".encode()) == plain(f"some {text} words")
    assert scanner.spans(b"clean words at https://host.org/a:b@c and keys, key-words, SKY, npm_x, gl, ya29") == []
