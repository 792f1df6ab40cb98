"""Every query of the folder over its whole table, against SQL or a plain restatement."""

import json
import zlib

import numpy as np
import pytest

from mailprism.llm.oracles import ORACLES
from mailprism.llm.queries import QUERIES
from tests.compare import differences, run_sql
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), run_sql(ORACLES[name], sf_dir)) == []


def test_substrings(docs, result):
    got = result("op1_suffix_dedup")
    want = brute.removed_bytes(docs)
    assert sum(w[1] for w in want.values()) > 0
    assert {d: tuple(got[d])[1:] for d in docs} == want


def test_fingerprints_and_components(docs, result):
    got = result("op2_simhash")
    prints = {d: brute.simhash(t) for d, t in docs.items()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == brute.classes(prints)


def test_mix(spark, sf_dir, result):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()]
    assert {d: tuple(r)[1:] for d, r in result("op3_mixing").items()} == brute.mix_plan(rows)


def test_pieces_come_back_as_text(docs, result):
    got = result("op4_sentencepiece")
    assert {d: r["decoded_sha256"] for d, r in got.items()} == {d: brute.sha(t or "") for d, t in docs.items()}
    assert all(r["n_pieces"] == len(r["ids"]) for r in got.values())


def test_quality(spark, sf_dir, docs, result):
    got = result("op6_quality")
    assert {d: tuple(r)[1:6] for d, r in got.items()} == {d: brute.quality_counts(t) for d, t in docs.items()}
    from mailprism.llm.quality import PASSED_ONCE_IN, chi2_point, text_counts

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    far = brute.outlier_distances(
        {r["doc_id"]: text_counts((r["text"] or "").encode()) for r in rows}, {r["doc_id"]: (r["lang"], r["source"]) for r in rows}
    )
    limit = chi2_point(1 - 1 / PASSED_ONCE_IN, 6)
    for d, r in got.items():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["distance"] == pytest.approx(far[d], rel=1e-6)
        assert r["kept"] == (not failed and far[d] <= limit)


def test_quality_keeps_good_and_rejects_bad(spark, sf_dir, result):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = result("op6_quality")
    good = [got[d]["kept"] for d, q in labels.items() if q and not got[d]["base_failed"]]
    bad = [got[d]["kept"] for d, q in labels.items() if not q]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.3


def test_token_files(docs, result):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, at = result("op7_token_files"), 0
    for d in sorted(docs):
        ids = [*tokenizer.encode(docs[d] or "", add_special_tokens=False).ids, 0]
        assert tuple(got[d]) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_secrets(docs, result):
    got = result("op9_secrets")
    for d, text in docs.items():
        spans = brute.base_secrets(text or "")
        assert got[d]["base_sha256"] == brute.spans_digest(spans)
        assert (got[d]["n_assign"], got[d]["n_access"], got[d]["n_hex"]) == tuple(
            sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")
        )


def test_main_text(spark, sf_dir, result):
    """The pages have their main text in an article of plain markup."""
    import html
    import re

    got = result("op10_main_text", "page_id")
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", page["html"], re.S).group(1)
        body = re.sub(r"</?[a-z][^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body))
        want = " ".join(html.unescape(body).split())
        assert tuple(got[page["page_id"]]) == (page["page_id"], page["url"], want, len(want))


def test_pipeline(spark, sf_dir):
    """All stages against plain restatements one behind the other."""
    import corpus_pipeline
    from mailprism.llm.quality import PASSED_ONCE_IN, chi2_point, text_counts

    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    far = brute.outlier_distances({d: text_counts((r["text"] or "").encode()) for d, r in rows.items()}, {d: (r["lang"], r["source"]) for d, r in rows.items()})
    limit = chi2_point(1 - 1 / PASSED_ONCE_IN, 6)
    texts = {}
    for d, r in rows.items():
        n, _, _, _, again = brute.quality_counts(r["text"])
        if n >= 50 and 100 * again <= 50 * n and far[d] <= limit:
            texts[d] = r["text"]
    texts = brute.lines_kept(texts)
    names = brute.classes({d: brute.simhash(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if names[d] == d}
    plan = brute.mix_plan([(d, rows[d]["source"], t) for d, t in texts.items()])
    want = sorted(x for d, t in texts.items() for x in [(d, brute.sha(t))] * (plan[d][3] // max(plan[d][0], 1)))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in got) == want
    assert 0 < len({r["doc_id"] for r in got}) < len(rows)


def test_json_names_groups_apart(spark):
    from mailprism.llm.quality import group_of

    found = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None)], "lang string, source string").select(group_of()).collect()
    assert len({r[0] for r in found}) == 3 and json.loads(found[0][0]) == {"lang": None, "source": "a"}
