"""What only larger tables or tables in folders show; rows are built here."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailprism.functions import fixed_values as v
from mailprism.functions.text import with_text_features
from mailprism.operators.explain import explain, explain_agent
from mailprism.operators.forest import ForestAgent, header_agent, text_url_agent, url_agent
from mailprism.operators.harmonise import SLICE_ROWS, flat_mail
from mailprism.operators.mime import slices
from mailprism.operators.text_agent import TextAgent
from mailprism.plans.queries import QUERIES, _mail_urls, _split_scores
from mailprism.sources.mail_files import read_mbox


def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    docs = spark.range(7).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Verify $"), F.col("id").cast("string"), F.lit(" now!")).alias("text")
    )
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["streamed_text_features"](spark, str(tmp_path))
    want = with_text_features(docs).drop("text")
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def chance_texts(spark, n, seed):
    """A telling line after words of chance; every tenth text has thousands of them."""
    draw = random.Random(seed)
    rows = [
        (i, " ".join(f"w{draw.randrange(6000)}" for _ in range(4000 if i % 10 == 0 else 60))
         + (" verify your account" if i // 10 % 2 else " see The notes the NOTES"), i // 10 % 2)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "row_id long, text string, label int").repartition(4)


def test_words_of_chance_do_not_outweigh_the_telling_ones(spark):
    agent = TextAgent().train(chance_texts(spark, 800, 1))
    found = agent.predict(chance_texts(spark, 800, 2))
    assert found.where((F.col("p1") > F.col("p0")).cast("int") != F.col("label")).count() == 0


def test_explanations_without_copies_are_those_of_the_copies(spark):
    texts = chance_texts(spark, 60, 3)
    agent = TextAgent().train(texts)
    blank = spark.createDataFrame([(100, None, 0), (101, " ..", 1)], texts.schema)
    some = texts.where("row_id >= 40").unionAll(blank).unionAll(texts.where("row_id = 41"))
    assert agent.term_weights() is not None
    quick, plain = (
        {r["row_id"]: r for r in found.collect()}
        for found in (
            explain_agent(some, agent, "text", "row_id", 5, 60, ("label",)),
            explain(some, agent.score_tokens, "text", "row_id", 5, 60, None, ("label",)),
        )
    )
    assert set(quick) == set(plain) and len(quick) == 22
    for i, a in quick.items():
        b = plain[i]
        assert a.label == b.label and abs(a.p0 - b.p0) + abs(a.p1 - b.p1) < 1e-9
        assert len(a.top_features) == len(b.top_features)
        weights = {f.token: f.weight for f in b.top_features}
        assert all(abs(weights.get(f.token, 0.0) - f.weight) < 1e-6 for f in a.top_features)


def test_folds_of_features_from_a_join_that_becomes_a_broadcast_late(spark, tmp_path):
    """Pages seem too large to broadcast and prove small; the join key has a subquery."""
    n = F.col("id").cast("string")
    junk = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat(n, i.cast("string")), 256)), "")
    docs = F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang")
    spark.range(200).select(*docs).write.parquet(str(tmp_path / "documents.parquet"))
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), n).alias("url"), junk.alias("html"))
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "12k")
    try:
        found = url_agent(trees=3, depth=3).cross_predict(_mail_urls(spark, str(tmp_path)), key="url_id")
        assert found.count() == 200
    finally:
        spark.conf.set(name, before)


def test_batches_of_mail_are_held_in_slices():
    mails = [b"x" * 40, None, b"", b"x" * 70, b"x" * 300, b"x", b"x" * 99]
    batch = pa.RecordBatch.from_pydict({"n": list(range(7)), "raw": pa.array(mails, pa.binary())})
    found = list(slices(batch, "raw", 100))
    assert [r for part in found for r in part.column("raw").to_pylist()] == mails
    assert [part.column("n").to_pylist() for part in found] == [[0, 1, 2, 3], [4], [5, 6]]
    assert [len(part) for part in slices(batch.slice(0, 0), "raw", 100)] == [0]


def test_json_mail_beyond_a_slice(spark):
    rows = spark.range(SLICE_ROWS * 2 + 3).coalesce(1).select("id", F.concat(F.lit('{"body": "b'), "id", F.lit('"}')).alias("j"))
    found = rows.select("id", flat_mail("j").alias("text")).collect()
    assert [r["text"] for r in found] == [f"\nb{r['id']}" for r in found] and len(found) == SLICE_ROWS * 2 + 3


def test_an_mbox_is_read_by_one_pass(spark, tmp_path):
    box = tmp_path / "box"
    box.write_text("".join(f"From a@b Mon\nSubject: s{i % 2}\n\nbody\n\n" for i in range(6)))
    mails = read_mbox(spark, str(box))
    assert "MapInArrow" not in mails._jdf.queryExecution().toString()
    assert len({r["msg_id"] for r in mails.collect()}) == 6


@pytest.fixture
def large(spark, monkeypatch):
    """Each table gives its count as ten million rows more."""
    frame = type(spark.range(1))
    count = frame.count
    monkeypatch.setattr(frame, "count", lambda df: count(df) + 10_000_000)


def labelled(spark, rows, key, *features):
    """``key``, a label, and features that tell it."""
    label = (F.col("id") % 3 == 0).cast("int")
    return spark.range(rows).select(F.col("id").alias(key), label.alias("label"), *(label.alias(n) for n in features))


def test_a_large_table_has_a_verdict_for_every_row(spark, large):
    found = ForestAgent(["a"], trees=2, depth=2).cross_predict(labelled(spark, 210, "url_id", "a"), key="url_id")
    assert sorted(tuple(r) for r in found.select("url_id", "label").collect()) == [(i, int(i % 3 == 0)) for i in range(210)]
    right = found.where("prediction = label").groupBy("fold").agg(F.count("*").alias("n"))
    assert {r["fold"]: r["n"] for r in right.collect()} == dict.fromkeys(range(5), 42)


def test_importances_of_a_large_table_come_from_every_training_row(spark, large):
    agent, _ = _split_scores(text_url_agent(trees=2, depth=2), labelled(spark, 200, "row_id", *v.TEXT_FEATURES), "row_id")
    assert agent.history["num_samples"] == 10_000_140
    assert sum(r["importance"] for r in agent.importances(spark).collect()) == pytest.approx(1)


def test_metrics_of_a_large_table_come_from_every_training_row(spark, large):
    agent, test = _split_scores(header_agent(trees=2, depth=2), labelled(spark, 200, "msg_id", *v.HEADER_FEATURES), "msg_id")
    assert agent.history["num_samples"] == 10_000_140
    found = agent.evaluate(test).first()
    assert (found["true_positives"], found["true_negatives"], found["accuracy"]) == (20, 40, 1)


def test_verdicts_of_a_large_table_come_from_every_training_row(spark, large):
    agent, test = _split_scores(header_agent(trees=2, depth=2), labelled(spark, 200, "msg_id", *v.HEADER_FEATURES), "msg_id")
    assert agent.history["num_samples"] == 10_000_140
    found = agent.predict(test, ("msg_id", "label")).collect()
    assert len({r["msg_id"] for r in found}) == 60 and all(r["prediction"] == r["label"] for r in found)
