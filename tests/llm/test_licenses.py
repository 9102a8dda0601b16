import random
import re

from slatewise.llm.licenses import BASE_TEMPLATES, TEMPLATES, scan_licenses
from tests.llm.helpers import documents


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = []
    for t in BASE_TEMPLATES:
        phrase = t.text.split()
        places += [(i, t.label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({la for _, la in places}))


def test_base_equals_plain_search(spark):
    rng = random.Random(2)
    parts = ["GNU", "General", "Public", "License", "apache", "license,", "CC", "BY", "by-", "MIT", "\x00", "é", "cc by", "x", "K", "\n"]
    texts = [None, "", "license", *(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)), "mit license " * 5000]
    ids = list(range(len(texts)))
    got = {r["doc_id"]: r for r in scan_licenses(documents(spark, texts, ids)).collect()}
    for i, text in zip(ids, texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text), text


def test_repeated_rows_and_missing_ids_stay_apart(spark):
    got = scan_licenses(documents(spark, ["mit license", "mit license", "mit license", None], [1, 1, None, None])).collect()
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert scan_licenses(documents(spark, [])).count() == 0


def test_notice_with_gaps_is_found_and_prose_is_not(spark):
    notice = next(t for t in TEMPLATES if t.label == "bsd").text.split()
    changed = notice[:8] + ["really"] + notice[8:14] + notice[15:]
    prose = "with or without the source in the form of following conditions that are met in use " * 20
    got = {r["doc_id"]: r for r in scan_licenses(documents(spark, ["x y " + " ".join(changed) + " z", prose, " ".join(notice)])).collect()}
    assert [got[i]["labels"] for i in range(3)] == ["bsd", "", "bsd"]
    assert 0.7 <= got[0]["score"] < 1 and got[1]["score"] == 0 and got[2]["score"] == 1


def test_plan_has_no_python(spark):
    plan = scan_licenses(documents(spark, ["mit license"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
