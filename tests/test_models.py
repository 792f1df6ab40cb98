"""Agents on small tables with a clear signal, and the explainer against its definition."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailprism import sinks
from mailprism.functions import fixed_values as v
from mailprism.operators.explain import explain, top_tokens, word_weights
from mailprism.operators.external_model import external_scorer
from mailprism.operators.features import header_features
from mailprism.operators.forest import ForestAgent, header_agent
from mailprism.operators.text_agent import TextAgent
from mailprism.plans import agents

PHISHING = "urgent verify your account password at http://secure-bank.tk/login number {}"
HARMLESS = "meeting notes for the project are in the shared drive number {}"


def raw_mail(i, phishing):
    text = (PHISHING if phishing else HARMLESS).format(i)
    extra = "Reply-To: x@evil.example\r\n" if phishing else "Received: from a by b\r\n"
    return (
        f"From: s{i}@host.example\r\n{extra}Subject: mail {i}\r\n"
        f"Content-Type: text/plain; charset=utf-8\r\n\r\n{text}\r\n"
    ).encode()


@pytest.fixture(scope="module")
def mails(spark):
    rows = [(f"m{i}", bytearray(raw_mail(i, i % 3 == 0)), int(i % 3 == 0), "t", f"in/m{i}.eml")
            for i in range(150)]
    return spark.createDataFrame(
        rows, "msg_id string, raw_bytes binary, label int, source string, source_path string"
    )


@pytest.fixture(scope="module")
def messages(spark, mails, tmp_path_factory):
    return agents.persist_messages(spark, mails, str(tmp_path_factory.mktemp("m") / "messages"))


@pytest.fixture(scope="module")
def text_agent(spark, messages):
    corpus = agents.mail_bodies(messages).withColumnRenamed("msg_id", "row_id")
    return agents.run_text_agent(corpus, epochs=(2, 4), buckets=1 << 12)


def test_header_agent(spark, messages, tmp_path):
    agent, test, metrics = agents.run_header_agent(messages, str(tmp_path / "out"))
    assert metrics.first()["accuracy"] > 0.95
    assert len(agent.history["cv_f1"]) == 5 and agent.history["num_features"] == 37
    assert agent.cv_summary(spark).filter("mean > 0.9").count() == 2
    top = agent.importances(spark, 10).collect()
    assert len(top) == 10 and top[0]["importance"] >= top[-1]["importance"]
    loaded = ForestAgent.load(spark, str(tmp_path / "out" / "agent"))
    a, b = (x.predict(test).orderBy("msg_id").collect() for x in (agent, loaded))
    assert a == b
    saved = json.loads(spark.read.text(str(tmp_path / "out" / "metrics")).first()[0])
    assert saved["accuracy"] == metrics.first()["accuracy"]


def test_untrained_agents_refuse(spark, messages, tmp_path):
    feats = header_features(messages)
    for act in (
        lambda: header_agent().predict(feats), lambda: header_agent().save(str(tmp_path)),
        lambda: TextAgent().predict(messages.withColumn("text", F.lit("x"))),
        lambda: TextAgent().save(str(tmp_path)), lambda: header_agent().train(feats),
    ):
        with pytest.raises(ValueError):
            act()


def test_grid_search(spark, messages, monkeypatch):
    for name, grid in (("GRID_TREES", (5,)), ("GRID_DEPTH", (2, 4)), ("GRID_MIN_LEAF", (1,))):
        monkeypatch.setattr(v, name, grid)
    agent = header_agent().train(
        header_features(messages), key="msg_id", validate=False, tune=True
    )
    assert agent.best_params["trees"] == 5 and agent.best_params["f1"] > 0.9


def test_missing_features_count_as_zero(spark, messages):
    feats = header_features(messages)
    agent = header_agent(trees=5).train(feats, key="msg_id", validate=False)
    assert agent.predict(feats.select("msg_id", "has_reply_to")).count() == 150


def test_baseline(spark, mails):
    corpus = spark.range(300).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(PHISHING)).otherwise(F.lit(HARMLESS)).alias("Email Text"),
        F.when(F.col("id") % 3 == 0, "Phishing Email").otherwise("Safe Email").alias("Email Type"),
    )
    _, _, summary = agents.run_baseline(corpus, "id", 100, 0.7)
    row = summary.first()
    assert row["accuracy"] == 1.0 and row["test_samples"] == 30 and row["training_samples"] == 70


def test_text_agent(spark, text_agent, tmp_path):
    agent, test, metrics, report = text_agent
    assert metrics.first()["f1_score"] > 0.95
    assert agent.history_table(spark).count() == 2
    assert {r["class"] for r in report.collect()} >= {"Safe Email", "Phishing Email", "macro avg"}
    agent.save(str(tmp_path / "text"))
    loaded = TextAgent.load(str(tmp_path / "text"))
    a, b = (x.predict(test).orderBy("row_id").collect() for x in (agent, loaded))
    assert a == b


def test_explanations_name_the_words(spark, text_agent):
    agent = text_agent[0]
    rows = [("p", PHISHING.format(7)), ("h", HARMLESS.format(7)), ("none", " .. ")]
    mails = spark.createDataFrame(rows, "msg_id string, text string")
    runs = [
        {r["msg_id"]: r for r in explain(
            mails.repartition(n), agent.score_tokens, num_features=5, num_samples=200
        ).collect()}
        for n in (1, 3)
    ]
    assert runs[0] == runs[1]  # whatever the partitioning
    top = runs[0]["p"]["top_features"]
    assert len(top) == 5 and top[0]["weight"] > 0
    assert {f["token"] for f in top} <= set(PHISHING.replace("{}", "7").replace(":", " ").replace(
        "/", " ").replace(".", " ").replace("-", " ").split())
    assert [abs(f["weight"]) for f in top] == sorted((abs(f["weight"]) for f in top), reverse=True)
    assert runs[0]["h"]["top_features"][0]["weight"] < 0
    assert runs[0]["none"]["top_features"] == []
    direct = {r["msg_id"]: r["p1"] for r in agent.predict(mails).collect()}
    assert all(abs(direct[m] - runs[0][m]["p1"]) < 1e-12 for m in direct)
    ranked = top_tokens(explain(mails, agent.score_tokens, num_samples=50), 3).collect()
    assert {r["rank"] for r in ranked} == {1, 2, 3}


def test_word_weights_recover_a_linear_score():
    rng = np.random.default_rng(1)
    for n_words in (6, 300):  # both ways to solve
        mask = rng.random((200, n_words)) < 0.7
        mask[0] = True
        scores = 0.1 + 0.5 * mask[:, 2] - 0.3 * mask[:, 4]
        found = word_weights(mask, scores, 2)
        assert [i for i, _ in found] == [2, 4]
        assert found[0][1] > 0.2 and found[1][1] < -0.1


def test_batch_classification(spark, text_agent, mails, tmp_path):
    agent = text_agent[0]
    extra = spark.createDataFrame(
        [("long", bytearray(b"Subject: " + b"s" * 100 + b"\r\n\r\nnotes\r\n"), 0, "t", "in/long.eml")],
        mails.schema,
    )
    csv = str(tmp_path / "csv")
    results, summary = agents.classify_batch(
        mails.limit(9).unionByName(extra), agent, 5, 60, csv
    )
    rows = {r["File"]: r for r in spark.read.csv(csv, header=True).collect()}
    assert len(rows) == 10 and set(results.columns) == set(next(iter(rows.values())).asDict())
    assert rows["m0.eml"]["Verdict"] == "Phishing" and rows["m1.eml"]["Verdict"] == "Safe"
    assert rows["long.eml"]["Subject"] == "s" * 80 + "..."
    assert rows["m0.eml"]["Top phishing tokens"] != "n/a"
    assert sum(r["n"] for r in summary.collect()) == 10


def test_explain_mail_and_json_sink(spark, text_agent, mails, tmp_path):
    path = str(tmp_path / "json")
    agents.explain_mail(mails.limit(3), text_agent[0], 4, 40, path)
    rows = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert len(rows) == 3 and set(rows[0]) == {
        "file", "subject", "prediction", "confidence", "p_safe", "p_phishing", "top_features"
    }
    assert set(rows[0]["top_features"][0]) == {"token", "weight"}


def test_fused_agents(spark, messages, text_agent):
    header = header_agent(trees=10).train(header_features(messages), key="msg_id", validate=False)
    url, _, _ = agents.run_url_agent(
        spark,
        messages.withColumn("parts", F.expr(
            "transform(parts, p -> named_struct('content_type', p.content_type, 'content', "
            "concat(p.content, ' http://www.example.org/', msg_id), 'fallback', p.fallback))")),
        validate=False,
    )
    fused = agents.fuse_agents(messages, header, url, text_agent[0], {"header": 1.0, "url": 0.0, "text": 1.0})
    joined = fused.join(messages.select("msg_id", "label"), "msg_id")
    right = joined.filter((F.col("verdict") == "Phishing") == (F.col("label") == 1)).count()
    assert joined.count() == 150 and right > 140


def test_message_table_keeps_all_rows(spark, messages, tmp_path):
    sinks.write_messages(messages, str(tmp_path / "m"), rows_per_file=50)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 150


def load_word_model():
    def score(texts):
        p1 = np.array([0.9 if "urgent" in t.split() else 0.2 for t in texts])
        return np.stack([1 - p1, p1], axis=1)

    return score


def test_external_model_can_be_explained(spark):
    score = external_scorer(load_word_model, batch_size=7)
    mails = spark.createDataFrame(
        [("a", "an urgent word here"), ("b", "nothing of the kind")], "msg_id string, text string"
    )
    tokens = mails.select("msg_id", F.split("text", " ").alias("tokens"))
    assert {r["msg_id"]: r["p1"] for r in score(tokens).collect()} == {"a": 0.9, "b": 0.2}
    found = {r["msg_id"]: r for r in explain(mails, score, num_features=2, num_samples=80).collect()}
    top = found["a"]["top_features"][0]
    assert top["token"] == "urgent" and top["weight"] > 0.3
    assert all(abs(f["weight"]) < 1e-9 for f in found["b"]["top_features"])
