"""Queries against their SQL, and the pipeline against plain versions of its stages."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from slatewise.llm.common import table
from slatewise.llm.language import identify_languages
from slatewise.llm.packing import token_pieces
from slatewise.llm.quality import score_quality
from slatewise.llm.queries import llm_queries
from tests.llm.test_near_copies import plain_components as plain_copies
from tests.llm.test_secrets import plain as plain_secrets
from tests.llm.test_simhash import plain_components, plain_print
from tests.oracle import compare, connect

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [n for n, q in llm_queries().items() if q.sql])
def test_query_equals_its_sql(spark, name):
    query = llm_queries()[name]
    assert compare(query.run(spark, SMALL).toPandas(), connect(SMALL).execute(query.sql).df()) is None


def test_near_duplicates_query(spark):
    docs = table(spark, TINY, "documents").toPandas()
    prints = [plain_print(t) for t in docs["text"]]
    want = list(zip(docs["doc_id"], (f"{p:016x}" for p in prints), plain_components(prints, list(docs["doc_id"]))))
    got = llm_queries()["op9_simhash_near_dedup"].run(spark, TINY).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_round_trip_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in llm_queries()["op6_bpe_round_trip"].run(spark, TINY).collect()}
    for doc, text in table(spark, TINY, "documents").select("doc_id", "text").collect():
        ids = library.encode(text, add_special_tokens=False).ids
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == (len(ids), sha, hashlib.sha256(text.encode()).hexdigest())


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, TINY, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "secrets", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(map(tuple, df.collect()))

    known = stage["language"](spark, docs, TINY)
    sure = {r["doc_id"] for r in identify_languages(docs).collect() if r["lang_pred"] != "und"}
    assert known.columns == docs.columns and rows(known) == [r for r in rows(docs) if r[0] in sure]

    good = stage["quality"](spark, known, TINY)
    best = {r["doc_id"] for r in score_quality(known, table(spark, TINY, "labels")).collect() if r["predicted"] == 1}
    assert rows(good) == [r for r in rows(known) if r[0] in best]

    apart = stage["near_duplicates"](spark, good, TINY)
    before = rows(good)
    assert rows(apart) == [r for i, (r, first) in enumerate(zip(before, plain_copies([r[1] for r in before]))) if i == first]

    clean = rows(stage["secrets"](spark, apart, TINY))
    for old, new in zip(rows(apart), clean):
        text = old[1]
        for _, start, end in sorted(plain_secrets(text), key=lambda s: -s[1]):
            text = text[:start] + "\0" * (end - start) + text[end:]
        assert new[0] == old[0] and new[2:4] == old[2:4] and new[4] == len(new[1])
        assert new[1].replace("<secret>", "") == text.replace("\0", "")

    packed = corpus_pipeline.run(spark, TINY).toPandas()
    tokens = token_pieces(stage["secrets"](spark, apart, TINY), public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed[key].to_numpy())) == sorted(map(tuple, tokens[key].to_numpy()))
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
