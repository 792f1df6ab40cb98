"""End-to-end runs of the agents: corpus, features, split, training, evaluation, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism import sinks
from mailprism.functions.headers import header
from mailprism.functions.bodies import explained_body, explained_text
from mailprism.functions.strings import not_blank
from mailprism.operators import evaluation, harmonise, sampling, scoring
from mailprism.operators.explain import explain_agent
from mailprism.operators.features import (
    header_features, text_url_features, url_corpus_features,
)
from mailprism.operators.forest import ForestAgent, header_agent, text_url_agent, url_agent
from mailprism.operators.mime import parse_messages
from mailprism.operators.text_agent import TextAgent
from mailprism.session import stored
from mailprism.sources.corpora import build_url_corpus, mail_bodies


def _train_forest(
    agent: ForestAgent, feats: DataFrame, key: str, test_size: float, validate: bool, tune: bool
) -> tuple[ForestAgent, DataFrame, DataFrame]:
    """Features and split are written once; training and evaluation read that table."""
    parts = stored(
        sampling.stratified_split(stored(feats, "features"), test_size, "label", key), "parts"
    )
    agent.train(parts.filter("is_test = 0"), "label", key, validate, tune)
    test = parts.filter("is_test = 1")
    return agent, test, agent.evaluate(test)


def _store(agent: ForestAgent, metrics: DataFrame, out: str | None) -> None:
    if out:
        agent.save(f"{out}/agent")
        sinks.write_metrics(metrics, f"{out}/metrics")


def persist_messages(spark: SparkSession, corpus: DataFrame, path: str) -> DataFrame:
    """Parse a raw corpus once and read it back as the table all agents share."""
    sinks.write_messages(parse_messages(corpus), path)
    return spark.read.parquet(path)


def run_header_agent(
    messages: DataFrame, out: str | None = None, validate: bool = True, tune: bool = False
):
    """Forest over the 37 header features, 70/30. Returns agent, test part and metrics."""
    feats = header_features(messages, ("msg_id", "label"))
    result = _train_forest(header_agent(), feats, "msg_id", 0.3, validate, tune)
    _store(result[0], result[2], out)
    return result


def with_url_ids(urls: DataFrame) -> DataFrame:
    """Unique ids for a URL corpus, whose rows may be exact copies of each other.

    Copies are interchangeable, so they are counted and numbered: rows per copy come back by
    exploding the count, in chunks spread over the cluster for a URL that fills a third of it.
    """
    chunk = 10_000
    counted = urls.groupBy("url_text", "label", "source").agg(F.count("*").alias("__n"))
    chunks = counted.withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {chunk}")))
    )
    first = F.col("__chunk") * chunk
    last = F.least(first + chunk, F.col("__n")) - 1
    numbered = chunks.repartition("url_text", "__chunk").withColumn(
        "__copy", F.explode(F.sequence(first, last))
    )
    return numbered.select(
        F.sha2(F.concat_ws("|", "url_text", "label", "source", "__copy"), 256).alias("url_id"),
        "url_text", "label", "source",
    )


def run_url_agent(
    spark: SparkSession, messages: DataFrame | None, out: str | None = None,
    phishing_csv: str | None = None, domains_csv: str | None = None,
    domains_limit: int | None = None,
    validate: bool = True, tune: bool = False,
):
    """Forest over the 23 URL features of a URL corpus, 70/30."""
    urls = build_url_corpus(spark, messages, phishing_csv, domains_csv, domains_limit)
    feats = url_corpus_features(with_url_ids(urls), ("url_id", "label"))
    result = _train_forest(url_agent(), feats, "url_id", 0.3, validate, tune)
    _store(result[0], result[2], out)
    return result


def run_baseline(
    corpus: DataFrame, key: str, total: int = 20000, legit_ratio: float = 0.7,
    out: str | None = None,
):
    """Class-ratio sample of a labelled text corpus, 55 text and URL features, forest, 70/30.

    The summary holds the sizes found, not the sizes asked for.
    """
    text_col = harmonise.resolve_text(corpus)
    labelled = harmonise.label_to_int(corpus, order_col=key).select(
        F.col(key).alias("row_id"), F.col(f"`{text_col}`").alias("text"), "label"
    )
    sample = sampling.class_ratio_sample(labelled, total, legit_ratio)
    feats = text_url_features(sample, "text", ("row_id", "label"))
    agent, test, metrics = _train_forest(text_url_agent(), feats, "row_id", 0.3, False, False)
    summary = metrics.select(
        F.lit(total).alias("requested_samples"),
        F.lit(agent.history["num_samples"]).alias("training_samples"),
        F.lit(legit_ratio).alias("legitimate_ratio"),
        F.lit(1 - legit_ratio).alias("phishing_ratio"),
        (F.col("true_positives") + F.col("true_negatives") + F.col("false_positives")
         + F.col("false_negatives")).alias("test_samples"),
        "accuracy", "precision", "recall", "f1_score", "roc_auc",
    )
    _store(agent, summary, out)
    return agent, test, summary


def build_text_corpus(
    base: DataFrame, messages: DataFrame | None = None, json_mail: DataFrame | None = None,
    four_class: DataFrame | None = None, hand_written: DataFrame | None = None,
) -> DataFrame:
    """Base texts and mail bodies, augmented with legitimate mail, without equal texts.

    ``json_mail``: ``phish_label, email_content``; ``four_class``: ``content, label`` 0-3;
    ``hand_written``: ``text, label``. Earlier sources win over later copies. ``row_id`` is the
    hash of the text, unique after the duplicates are gone.
    """
    frames = [harmonise.normalise_corpus(base)]
    if messages is not None:
        bodies = mail_bodies(messages).select("text", "label")
        frames[0] = harmonise.drop_blank(frames[0].unionByName(bodies))
    if json_mail is not None:
        legit = harmonise.with_flat_mail(
            harmonise.only_class(json_mail, 0, "phish_label"), "email_content"
        ).select("text", F.lit(0).alias("label"))
        frames.append(harmonise.drop_short(legit))
    if four_class is not None:
        legit = harmonise.only_class(four_class, 0).select(
            F.col("content").alias("text"), F.lit(0).alias("label")
        )
        frames.append(harmonise.drop_short(legit))
    if hand_written is not None:
        frames.append(harmonise.drop_short(hand_written.select("text", "label")))
    # inside a source the first row in reading order wins, whatever its label
    stacked = harmonise.union_corpora(
        *(
            f.withColumns(
                {"priority": F.lit(i), "position": F.monotonically_increasing_id()}
            )
            for i, f in enumerate(frames)
        )
    )
    unique = harmonise.dedup_keep_first(stacked, "text", ("priority", "position"))
    return unique.select(F.sha2("text", 256).alias("row_id"), "text", "label")


def run_text_agent(corpus: DataFrame, out: str | None = None, **options):
    """Text classifier on an 80/20 split. Returns agent, test part, metrics and report."""
    parts = stored(sampling.stratified_split(stored(corpus, "texts"), 0.2), "parts")
    agent = TextAgent(**options).train(parts.filter("is_test = 0"))
    test = parts.filter("is_test = 1")
    scored = agent.predict(test).withColumn("prediction", (F.col("p1") > F.col("p0")).cast("int"))
    metrics = evaluation.metrics(scored, "label", "prediction", "p1")
    report = evaluation.classification_report(
        scored, "label", "prediction", ("Safe Email", "Phishing Email")
    )
    if out:
        agent.save(f"{out}/agent")
        sinks.write_metrics(metrics, f"{out}/metrics")
    return agent, test, metrics, report


def explain_mail(
    mails: DataFrame, agent: TextAgent, num_features: int = 10, num_samples: int = 500,
    out: str | None = None,
) -> DataFrame:
    """Explanations of raw mail by its subject and body; mail without text is left out."""
    messages = parse_messages(mails)
    subject = header(F.col("headers"), "subject")
    body = explained_body(F.col("parts"), F.col("is_multipart"))
    texts = messages.select(
        "msg_id", F.element_at(F.split("source_path", "/"), -1).alias("file"),
        subject.alias("subject"), explained_text(subject, body).alias("text"),
    ).filter(not_blank(F.col("text")))
    result = explain_agent(
        texts, agent, "text", "msg_id", num_features, num_samples, ("file", "subject")
    )
    if out:
        sinks.write_explanations(result, out)
    return result


def classify_batch(
    mails: DataFrame, agent: TextAgent, num_features: int = 8, num_samples: int = 250,
    csv: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Result table and verdict summary of raw mail (``msg_id, raw_bytes, source_path``).

    Each mail is explained once: the table is stored, and CSV and summary come from there.
    """
    mail = scoring.batch_input(parse_messages(mails, as_text=True))
    found = explain_agent(
        mail, agent, "text", "msg_id", num_features, num_samples, scoring.BATCH_COLUMNS
    )
    results = stored(scoring.batch_results(found), "batch")
    if csv:
        sinks.write_batch_csv(results, csv)
    return results, scoring.batch_summary(results)


def fuse_agents(
    messages: DataFrame, header_model: ForestAgent, url_model: ForestAgent, text_model: TextAgent,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Verdict per mail from all three agents. The body is chosen once for both body agents."""
    bodies = mail_bodies(messages)
    by_header = header_model.predict(header_features(messages, ("msg_id",)), ("msg_id",))
    by_url = url_model.predict(
        url_corpus_features(bodies.withColumnRenamed("text", "url_text"), ("msg_id",)), ("msg_id",)
    )
    by_text = text_model.predict(bodies, "text", ("msg_id",))
    return scoring.fuse({"header": by_header, "url": by_url, "text": by_text}, weights)
