"""What odd rows give: nulls, empty texts, texts without words, repeated rows and rows without doc_id."""

import hashlib

from fieldleaf.llm import bpe, language, media, passages, secrets, simhash, substrings, toxicity
from fieldleaf.llm.queries import vocabulary
from tests.llm.test_llm import labels, odd

EMPTY = hashlib.sha256(b"").hexdigest()


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_language_of_odd_rows(spark):
    got = by_id(language.languages(odd(spark).drop("lang").selectExpr("*", "'en' as lang")))
    assert {i: {r["lang_pred"] for r in got[i]} for i in (1000, 1001, 1002, 1007)} == {1000: {"und"}, 1001: {"und"}, 1002: {"und"}, 1007: {"und"}}
    assert got[1003][0] == got[1003][1] and got[1003][0]["lang_pred"] == "en" == got[None][0]["lang_pred"]
    assert all(0 <= r["score"] <= 1 for rows in got.values() for r in rows)


def test_media_of_odd_rows(spark):
    got = by_id(media.stored_media(odd(spark)))
    assert [(r["n_bytes"], r["payload_bytes"]) for i in (1000, 1001) for r in got[i]] == [(0, 192)] * 2
    assert got[1000][0]["feature"] == got[1001][0]["feature"] and got[1000][0]["media_sha256"] == got[1001][0]["media_sha256"]
    assert got[1003][0] == got[1003][1] and got[1003][0]["n_bytes"] == 4 and got[None][0]["n_bytes"] == 9


def test_secrets_of_odd_rows(spark):
    got = by_id(secrets.find_secrets(odd(spark), secrets.fit(secrets.labelled_tokens(odd(spark)))))
    assert {(r["base_sha256"], r["spans"], r["n_assign"]) for i in (1000, 1001, 1002) for r in got[i]} == {(EMPTY, "", 0)}
    assert got[1003][0] == got[1003][1] and got[1003][0]["spans"] == ""


def test_toxicity_of_odd_rows(spark):
    got = by_id(toxicity.toxic_documents(odd(spark), labels(spark)))
    assert len({r["score"] for i in (1000, 1001, 1002) for r in got[i]}) == 1
    assert got[1003][0] == got[1003][1]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for rows in got.values() for r in rows)


def test_fingerprints_of_odd_rows(spark):
    got = by_id(simhash.near_duplicates(odd(spark)))
    assert {(r["fingerprint"], r["component_id"]) for i in (1000, 1001, 1002) for r in got[i]} == {("0" * 16, 1000)}
    assert got[1003][0] == got[1003][1] and got[1003][0]["component_id"] == 1003
    assert got[1004][0]["component_id"] == 1004


def test_passages_of_odd_rows(spark):
    got = by_id(passages.repeated_passages(odd(spark)))
    assert [got[i][0]["class_id"] for i in (1000, 1001, 1003, 1005)] == [1000, 1001, 1003, 1005]
    assert got[1003][0] == got[1003][1] and got[None][0]["class_id"] is None


def test_bytes_and_tokens_of_odd_rows(spark):
    got = by_id(substrings.dedup(odd(spark), with_text=False))
    assert {(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i in (1000, 1001) for r in got[i]} == {(0, 0, 0, EMPTY)}
    assert got[1003][0] == got[1003][1] and (got[1003][0]["n_removed"], got[1004][0]["n_removed"]) == (0, 0)
    told = by_id(bpe.encode(odd(spark), vocabulary(), also=()))
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for i in (1000, 1001, 1002) for r in told[i]} == {(0, EMPTY, EMPTY)}
    assert told[1003][0] == told[1003][1] and told[1003][0]["n_tokens"] == 1
