import base64
import random
import zlib

import numpy as np
import pytest

from slatewise.llm.language import LanguageModel, identify_languages, keep_known_languages, trigrams
from slatewise.llm.quality import FEATURES, Discriminant, keep_good_documents, score_quality, statistics
from slatewise.llm.rules import Limits, distance, judge, references, repeated_words
from slatewise.llm.common import table
from tests.llm.helpers import documents

SMALL = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_documents(spark):
    docs = table(spark, SMALL, "documents")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98 and got["score"].between(0, 1).all()


def test_held_out_languages_do_not_teach(spark):
    docs = table(spark, SMALL, "documents")
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(map(tuple, identify_languages(wrong).collect())) == sorted(map(tuple, identify_languages(docs).collect()))


def test_language_of_awkward_rows(spark):
    texts = [None, "", "123 !!", "the house and the garden", "the house and the garden", "das haus und der garten", "ñ " * 100_000] * 3
    ids = [*range(20), None]
    langs = [None, None, "en", "en", "en", "de", "es"] * 3
    got = identify_languages(documents(spark, texts, ids, langs)).collect()
    assert len(got) == 21
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in range(20) if i % 7 in (0, 1, 2))
    assert by[3]["lang_pred"] == "en" and by[5]["lang_pred"] == "de" and not by[None]["held_out"]
    assert all(r["lang_pred"] == "und" for r in identify_languages(documents(spark, ["abc"])).collect())
    assert identify_languages(documents(spark, [])).count() == 0
    kept = keep_known_languages(documents(spark, texts, ids, langs))
    assert sorted(str(r["text"])[:3] for r in kept.collect()) == sorted(str(t)[:3] for i, t in enumerate(texts) if i % 7 > 2)


def test_texts_in_no_language_go_and_clean_ones_stay(spark):
    docs = table(spark, SMALL, "documents")
    rng = random.Random(1)
    prose = {r["lang"]: r["text"] for r in docs.filter("length(text) > 2000").orderBy("doc_id").collect()}
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 9))) for _ in range(400)) for _ in range(20)]
    noise += [base64.b64encode(rng.randbytes(2000)).decode() for _ in range(20)]
    mixed = [prose[a][:2000] + " " + prose[b][:2000] for a, b in (("en", "fr"), ("de", "es"), ("en", "de"))]
    extra = documents(spark, noise + mixed, [None] * 43).select(*docs.columns)
    kept = [r["text"] for r in keep_known_languages(docs.unionByName(extra)).collect()]
    assert not set(noise) & set(kept) and set(mixed) <= set(kept)
    assert len(kept) >= docs.count() * 0.995
    unlabelled = documents(spark, ["abc def", "123", None])
    assert [r["text"] for r in keep_known_languages(unlabelled).collect()] == ["abc def"]


def test_families_then_pairs():
    rng = random.Random(0)
    letters = {"en": "abcd", "de": "abce", "fr": "mnop", "es": "mnoq", "fi": "xyz"}
    texts, langs = [], []
    for _ in range(60):
        for la, alphabet in letters.items():
            texts.append(" ".join("".join(rng.choices(alphabet, k=5)) for _ in range(20)))
            langs.append(la)
    model = LanguageModel(np.array(langs, dtype=object), np.stack([trigrams(t) for t in texts]))
    assert sorted(model.pair_weights) == [("de", "en"), ("es", "fr")] and model.families == ["fi", "germanic", "romance"]
    assert [p for p, _ in model.label(texts)] == langs


def test_quality_on_held_out_documents(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    got = score_quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == got["predicted"]).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    for label in (0, 1):
        assert (held[held["quality"] == label]["predicted"] == label).mean() > 0.9
    kept = keep_good_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(got[got["predicted"] == 1]["doc_id"])


def test_held_out_labels_do_not_teach(spark):
    from pyspark.sql import functions as F

    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    by = lambda labels: {r["doc_id"]: r["score"] for r in score_quality(docs, labels).collect()}
    one, other = by(labels), by(turned)
    assert one.keys() == other.keys() and all(other[k] == pytest.approx(v, abs=1e-9) for k, v in one.items())


def test_quality_of_awkward_rows(spark):
    docs = documents(spark, [None, "", "a b", "a b", "x" * 100_000, "!!!"], [1, 2, 3, 3, None, 6])
    labels = spark.createDataFrame([(3, 1), (3, 1), (6, 0), (2, None), (None, 1), (77, 0), (1, 0), (1, 1)], "doc_id bigint, quality int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = score_quality(docs, some).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert score_quality(docs.limit(0), labels).count() == 0


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(0)
    d = len(FEATURES)
    x = {0: rng.normal(0, 1, (400, d)), 1: rng.normal(1, 2, (900, d))}
    model = Discriminant({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()})
    at = rng.normal(0, 2, (20, d))
    density = []
    for mean, inverse, _, prior in model.parts:
        covariance = np.linalg.inv(inverse.T @ inverse)
        z = at - mean
        density.append(prior - 0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(covariance), z) + np.linalg.slogdet(covariance)[1]))
    assert np.allclose(model.score(at), 1 / (1 + np.exp(-(density[1] - density[0]) / d)))
    assert all(np.isfinite(statistics(t)).all() for t in (None, "", " ", "\n\n", "é", "a" * 1000, "\udcff".encode("utf-8", "replace").decode()))


def test_repeated_words():
    assert repeated_words(b"a b c a b c".split()) == 6 and repeated_words(b"a b c d".split()) == 0
    assert repeated_words(b"a a a a".split()) == 4 and repeated_words([]) == 0


def test_distance():
    a, b = np.array([[1.0, 0], [1, 1], [0, 0]]), np.array([[0.0, 1], [2, 2], [1, 0]])
    assert distance(a, b).tolist() == [1.0, 0.0, 0.0]


def _prose(rng, common, alphabet, many=30):
    """Texts of 150 words, four in ten of them common ones."""
    made = lambda: "".join(rng.choices(alphabet, k=5))
    return [" ".join(rng.choice(common) if rng.random() < 0.4 else made() for _ in range(150)) for _ in range(many)]


def test_rules_of_awkward_rows(spark):
    rng = random.Random(4)
    good = _prose(rng, "the of and to in a is that for it".split(), "aeinrst")
    odd = " ".join(f"{w}%%###{i}" for i, w in enumerate(good[0].split()))
    long = " ".join(good * 40) + " " + " ".join(f"w{i}" for i in range(150 * 30 * 40))
    texts = [None, "", "short", odd, odd.upper(), *good, good[0], good[0], long]
    langs = [None, "en", "en", "en", "zz", *["EN"] * 30, None, "en", "xx"]
    got = {i: r for i, r in enumerate(sorted(judge(documents(spark, texts, list(range(len(texts))), langs)).collect()))}
    assert [got[i]["base_failed"] for i in range(5)] == [True] * 3 + [False] * 2
    assert [got[i]["kept"] for i in range(5)] == [False] * 4 + [True]  # zz has no reference: only the base rules judge
    assert all(got[i]["kept"] for i in range(5, len(texts) - 1))
    assert (got[0]["n_words"], got[3]["n_symbols"], got[3]["word_chars"]) == (0, 150 * 5, len(odd) - 149)
    assert got[len(texts) - 1]["n_words"] == 150 * 30 * 80
    assert judge(documents(spark, [])).count() == 0
    repeated = judge(documents(spark, [good[0]] * 40, [7] * 40, ["en"] * 40))
    assert repeated.count() == 40 and repeated.filter("kept").count() == 40
    assert judge(documents(spark, good, langs=[None] * 30), Limits()).filter("kept").count() == 30  # nothing to compare with


def test_rules_judge_every_language_by_its_own_words(spark):
    """Clean texts of a Latin and a Cyrillic language stay, random letters and texts without common words go."""
    rng = random.Random(5)
    english = _prose(rng, "the of and to in a is that for it".split(), "aeinrst")
    russian = _prose(rng, "\u0438 \u0432 \u043d\u0435 \u043d\u0430 \u044f \u0447\u0442\u043e \u043e\u043d \u0441 \u043a\u0430\u043a \u044d\u0442\u043e".split(), "\u0430\u0435\u0438\u043d\u043e\u0440\u0441\u0442")
    noise = [" ".join("".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(400)) for alphabet in ("abcdefghijklmnopqrstuvwxyz", "\u0430\u0435\u0438\u043d\u043e\u0440\u0441\u0442")]
    texts = [*english, *russian, *noise, " ".join(noise[0].split()[:90])]
    langs = ["en"] * 30 + ["ru"] * 30 + ["en", "ru", "en"]
    got = judge(documents(spark, texts, list(range(len(texts))), langs)).toPandas().set_index("doc_id").sort_index()
    assert got.loc[:59, "kept"].all()
    assert not got.loc[60:61, "kept"].any() and got.loc[60, "char_distance"] < 0.3
    assert got.loc[62, "kept"]  # fewer words than a histogram of words needs


def test_limit_of_words_lies_between_clean_texts_and_texts_without_common_words(spark):
    """On the given documents: clean ones stay, and what has no common word is above the limit of every language."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    known = references(docs)
    assert set(known) == {"de", "en", "es", "fr"}
    judged = judge(docs).join(labels, "doc_id").filter("NOT base_failed AND n_words >= 100").toPandas()
    clean = judged[judged["quality"] == 1]
    assert len(clean) > 100 and clean["kept"].mean() > 0.99
    assert (judged[judged["quality"] == 0]["kept"]).mean() < 0.3
    for reference in known.values():
        assert reference.word_histogram(b"qqqq " * 200)[-1] == 200 and reference.without_common_words() > 0.2


def test_duplicate_lines(spark):
    row = judge(documents(spark, ["a b\n\n \na b\n \nc\nc \nc"])).first()
    assert row["n_dup_lines"] == 2 and row["n_words"] == 7


def test_language_limits_come_from_all_held_out_documents(spark):
    from slatewise.llm.language import BANDS, CHECK_FOLDS, CLEAN_LOSS, fit_language_model, fit_limits

    rng = np.random.default_rng(6)
    words = {"en": "the and with house river stone of that".split(), "fr": "le est avec maison pierre dans que une".split()}
    rows = []
    for i in range(8000):
        lang, other = ("en", "fr") if i % 2 else ("fr", "en")
        rows.append((i, " ".join(rng.choice(words[lang if rng.random() < rng.random() ** 0.1 else other]) for _ in range(rng.integers(3, 40))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(docs)
    held = [text for i, text, _ in rows if zlib.crc32(str(i).encode()) % CHECK_FOLDS == 0]
    scores, bands = np.array([score for _, score in model.label(held)]), np.searchsorted(BANDS, [len(t) for t in held], side="right")
    limits = fit_limits(model, docs)
    assert len(held) > 1500
    for band in np.unique(bands):
        low = np.clip(np.quantile(scores[bands == band], CLEAN_LOSS), 0.5, 1 - 1e-12)
        assert abs(limits[band] - 1 / (1 + np.sqrt((1 - low) / low))) < 1e-4
