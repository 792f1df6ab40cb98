"""Named queries over the driver tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailprism.functions import bodies as B
from mailprism.functions import fixed_values as v
from mailprism.functions.headers import header
from mailprism.functions.strings import drop_tags, strip
from mailprism.functions.text import with_preprocessed, with_text_features
from mailprism.functions.urls import with_url_features
from mailprism.operators import evaluation, harmonise, profile, sampling, scoring
from mailprism.operators.explain import explain_agent, token_detail, top_tokens
from mailprism.operators.features import (
    flat_features, header_features, nested_features, text_url_features, url_corpus_features,
)
from mailprism.operators.forest import header_agent, scale_by_aggregate, text_url_agent, url_agent
from mailprism.operators.mime import parse_messages
from mailprism.operators.text_agent import TextAgent, tokens
from mailprism.plans.agents import classify_batch
from mailprism.plans.derived_mail import (
    derived_mail, derived_raw_mail, derived_scores, documents, table,
)
from mailprism.sources import corpora
from mailprism.sources.corpora import (
    body_urls, build_mail_corpus, build_url_corpus, mail_bodies, preprocess_mail,
)
from mailprism.session import shared_folder, stored
from mailprism.sources.mail_files import read_mbox
from mailprism.sinks import write_batch_csv, write_explanations, write_metrics
from mailprism.streaming.mail_stream import write_features
from mailprism.sources.tables import (
    domains_to_urls, first_rows, read_all_splits, read_labelled_csv, read_phishing_urls,
    read_ranked_domains, read_split, rebuild_ham,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _shared(spark: SparkSession) -> str:
    return shared_folder(spark, "query")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_messages(derived_raw_mail(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a labelled text corpus: ``row_id, text, label, source``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "text",
        F.when(F.col("doc_id") % 10 < 3, 1).otherwise(0).alias("label"), "source",
    )


# --- features --------------------------------------------------------------------------------
@query
def text_profile(spark, sf_dir):
    """Average words, upper-case share and flag totals of the document texts per source."""
    feats = with_text_features(documents(spark, sf_dir).select("source", "text"))
    return feats.groupBy("source").agg(
        F.count("*").alias("docs"),
        F.round(F.avg("word_count"), 6).alias("avg_words"),
        F.round(F.avg("uppercase_ratio"), 6).alias("avg_upper"),
        F.sum("contains_currency").alias("with_currency"),
        F.sum("urgency_word_count").alias("urgency_words"),
    )


@query
def text_features(spark, sf_dir):
    return with_text_features(derived_mail(spark, sf_dir).select("doc_id", "body"), "body").drop(
        "body"
    )


@query
def streamed_text_features(spark, sf_dir):
    """The text features on a stream of document files, through a parquet sink."""
    out = shared_folder(spark, "stream")
    # a pattern, as the table may be one file or a folder of files; a stream takes a plain path for a folder
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(f"{sf_dir}/documents.parque[t]")
    feats = with_text_features(stream).drop("text")
    write_features(feats, f"{out}/rows", f"{out}/log").awaitTermination()
    return spark.read.schema(feats.schema).parquet(f"{out}/rows")


@query
def preprocess(spark, sf_dir):
    mail = derived_mail(spark, sf_dir).select(
        "doc_id", "body", F.concat("source", F.lit("@"), "lang").alias("sender"), "label"
    )
    return with_preprocessed(mail, "body", "sender", "label")


@query
def preprocess_raw(spark, sf_dir):
    return preprocess_mail(derived_raw_mail(spark, sf_dir).drop("source_path"))


@query
def url_features(spark, sf_dir):
    mail = derived_mail(spark, sf_dir).select("doc_id", "body")
    return with_url_features(mail, "body", typosquatting=False).drop("body")


@query
def typosquatting(spark, sf_dir):
    """Look-alike flag per mail and per page URL."""
    mail = derived_mail(spark, sf_dir).select(F.col("doc_id").alias("id"), "body")
    pages = table(spark, sf_dir, "pages").select(
        (-F.col("page_id") - 1).alias("id"), F.col("url").alias("body")
    )
    return with_url_features(mail.unionByName(pages), "body").select(
        "id", "url_count", "potential_typosquatting"
    )


@query
def page_url_features(spark, sf_dir):
    """Every page URL as a URL corpus row."""
    urls = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("url_id"), F.col("url").alias("url_text")
    )
    return url_corpus_features(urls)


@query
def mail_header_features(spark, sf_dir):
    return header_features(_messages(spark, sf_dir), ("msg_id", "label"))


@query
def text_url_features_55(spark, sf_dir):
    corpus = derived_mail(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"), F.col("body").alias("text"), "label"
    )
    return text_url_features(corpus)


@query
def flat_features_92(spark, sf_dir):
    return flat_features(_messages(spark, sf_dir), ("msg_id", "label"))


@query
def nested_feature_groups(spark, sf_dir):
    nested = nested_features(_messages(spark, sf_dir), keep=("msg_id",))
    return nested.select("msg_id", "text.*", "url.*", "metadata.*")


@query
def body_choice(spark, sf_dir):
    """The four ways to pick a body, for plain, HTML and multipart mail."""
    parts = F.col("parts")
    return _messages(spark, sf_dir).select(
        "msg_id",
        B.strict_body(parts).alias("strict"),
        B.corpus_body(parts, F.col("raw_text")).alias("corpus"),
        B.explained_body(parts, F.col("is_multipart")).alias("explained"),
        B.batch_body(parts, F.col("is_multipart")).alias("batch"),
    )


@query
def scoring_texts(spark, sf_dir):
    subject = header(F.col("headers"), "subject")
    parts, multi = F.col("parts"), F.col("is_multipart")
    return _messages(spark, sf_dir).select(
        "msg_id",
        B.explained_text(subject, B.explained_body(parts, multi)).alias("explained_text"),
        B.batch_text(subject, B.batch_body(parts, multi)).alias("batch_text"),
    )


@query
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", strip(drop_tags(F.col("html"))).alias("text")
    )


# --- sources ---------------------------------------------------------------------------------
@query
def ham_envelope(spark, sf_dir):
    ham = documents(spark, sf_dir).select(
        "doc_id", "text", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("subject"),
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("sender"),
        F.when(F.col("doc_id") % 7 != 0, F.when(F.col("doc_id") % 10 < 3, 1).otherwise(0)).alias(
            "label"
        ),
    )
    return rebuild_ham(ham, key="doc_id").withColumn(
        "raw_bytes", F.decode("raw_bytes", "UTF-8")
    )


@query
def ranked_domains(spark, sf_dir):
    ranked = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1).cast("int").alias("rank"),
        F.when(F.col("page_id") % 11 != 0, F.regexp_extract("url", "^https?://([^/?#]*)", 1))
        .alias("domain"),
    )
    return domains_to_urls(ranked)


@query
def phishing_urls(spark, sf_dir):
    """URL list written as CSV, some URLs missing, and read back whole."""
    path = f"{_shared(spark)}/urls"
    table(spark, sf_dir, "pages").select(
        F.when(F.col("page_id") % 13 != 0, F.col("url")).alias("url"), "page_id"
    ).write.option("header", "true").csv(path)
    return read_phishing_urls(spark, path)


@query
def capped_corpora(spark, sf_dir):
    """The row caps, given by the caller: a hundred URLs, ranks and ham mails."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", (F.col("page_id") + 1).cast("int").alias("rank"),
        F.when(F.col("page_id") % 13 != 0, F.col("url")).alias("url_text"),
        F.when(F.col("page_id") % 11 != 0, F.regexp_extract("url", "^https?://([^/?#]*)", 1))
        .alias("domain"),
    )
    urls = first_rows(pages.select("page_id", "url_text"), 100, "page_id").dropna()
    ham = _texts(spark, sf_dir).select("row_id", "text", "label")
    capped = rebuild_ham(ham, 100, "row_id").withColumn("raw", F.decode("raw_bytes", "UTF-8"))
    return (
        urls.select(F.lit("urls").alias("kind"), F.col("url_text").alias("text"))
        .unionByName(domains_to_urls(pages, 100).select(
            F.lit("domains").alias("kind"), F.col("url_text").alias("text")))
        .unionByName(capped.select(
            F.lit("ham").alias("kind"), F.expr("substr(raw, instr(raw, '\\r\\n\\r\\n') + 4)").alias("text")))
    )


@query
def csv_corpora(spark, sf_dir):
    """The three CSV corpora written to the shared folder and read back by their readers."""
    out = _shared(spark)
    pages = table(spark, sf_dir, "pages")
    pages.select("page_id", "url").write.option("header", "true").csv(f"{out}/phishing")
    pages.select(
        (F.col("page_id") + 1).alias("rank"), F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    ).write.csv(f"{out}/ranked")
    _texts(spark, sf_dir).select("text", "label").write.option("header", "true").option(
        "escape", '"'
    ).csv(f"{out}/labelled")
    found = {
        "phishing": read_phishing_urls(spark, f"{out}/phishing"),
        "ranked": read_ranked_domains(spark, f"{out}/ranked"),
        "labelled": read_labelled_csv(spark, f"{out}/labelled").withColumnRenamed("text", "url_text"),
    }
    rows = [f.select(F.lit(k).alias("kind"), F.col("url_text").alias("text"), "label") for k, f in found.items()]
    return harmonise.union_corpora(*rows).groupBy("kind", "text", "label").agg(F.count("*").alias("n"))


@query
def split_corpora(spark, sf_dir):
    """A corpus of two splits: the train split alone, and all splits, one without a column."""
    out = _shared(spark)
    docs = table(spark, sf_dir, "documents")
    docs.filter("doc_id % 5 <> 0").select("doc_id", "lang").write.parquet(f"{out}/train")
    docs.filter("doc_id % 5 = 0").select("doc_id").write.parquet(f"{out}/test")
    splits = {"test": f"{out}/test", "train": f"{out}/train"}
    return read_split(spark, splits).select(F.lit("train").alias("part"), "doc_id", "lang").unionByName(
        read_all_splits(spark, splits).select(F.lit("all").alias("part"), "doc_id", "lang")
    )


@query
def mail_corpus(spark, sf_dir):
    """Two equal mbox files and the ham of the documents as one corpus, counted by source.

    Copies get running numbers, so ids are unique and the largest number is the count of copies.
    """
    out = _shared(spark)
    for name in ("a", "b"):
        _write_mbox(spark, sf_dir, f"{out}/{name}")
    ham = _texts(spark, sf_dir).select("text", "label")
    corpus = build_mail_corpus(spark, phishing_mboxes=[f"{out}/a", f"{out}/b"], ham=ham)
    parts = F.split("msg_id", "-")
    mails = corpus.groupBy("label", "source", parts[0].alias("hash")).agg(
        F.countDistinct("msg_id").alias("ids"), F.max(parts[1].cast("long")).alias("number")
    )
    return mails.groupBy("label", "source").agg(
        F.count("*").alias("n"), F.sum("ids").alias("mails"), F.max("number").alias("most")
    )


@query
def preprocess_mbox(spark, sf_dir):
    """Cleaned texts of an mbox file that begins with lines of no message."""
    box = f"{_shared(spark)}/box"
    _write_mbox(spark, sf_dir, box)
    return corpora.preprocess_mbox(spark, box).drop("msg_id").withColumn("mail", F.col("sender"))


@query
def default_rows(spark, sf_dir):
    """The 55 text and URL features; every third text is null, every third blank, the others are as they are."""
    kind = F.col("doc_id") % 3
    texts = table(spark, sf_dir, "documents").select("doc_id", F.when(kind == 1, " \n").when(kind == 2, F.col("text")).alias("text"))
    return text_url_features(texts, "text", ("doc_id",))


@query
def default_headers(spark, sf_dir):
    """The 37 header features; every fourth mail has no readable headers, every fourth one that cannot be decoded."""
    unread = F.transform("headers", lambda h: F.struct(
        h["name"].alias("name"), F.when(F.lower(h["name"]) != "from", h["value"]).alias("value")
    ))
    part = F.col("msg_id") % 4
    headers = F.when(part == 1, unread).when(part > 1, F.col("headers"))
    return header_features(_messages(spark, sf_dir).withColumn("headers", headers), ("msg_id",))


@query
def text_column_choice(spark, sf_dir):
    """Corpora that name their text in different ways, each with all the less likely names beside it."""
    docs, names = table(spark, sf_dir, "documents"), v.TEXT_COLUMNS
    out = []
    for i, name in enumerate(names):
        others = [F.upper("source").alias(n) for n in reversed(names[i + 1:])]
        corpus = docs.where(F.pmod("doc_id", F.lit(len(names))) == i).select("doc_id", *others, F.col("text").alias(name))
        chosen = harmonise.resolve_text(corpus)
        out.append(corpus.select("doc_id", F.lit(chosen).alias("chosen"), F.col(f"`{chosen}`").alias("text")))
    return reduce(DataFrame.unionAll, out)


@query
def mail_url_corpus(spark, sf_dir):
    """URLs of all mail bodies and of the page list, by URL, label and source."""
    mail = body_urls(derived_mail(spark, sf_dir), "body")
    pages = table(spark, sf_dir, "pages").select(
        F.col("url").alias("url_text"), F.lit(0).alias("label"),
        F.lit(v.SOURCE_RANKED_DOMAINS).alias("source"),
    )
    return mail.unionByName(pages).groupBy("url_text", "label", "source").agg(
        F.count("*").alias("n")
    )


@query
def parsed_url_corpus(spark, sf_dir):
    """URLs found in the bodies of parsed mail."""
    return build_url_corpus(spark, _messages(spark, sf_dir)).groupBy(
        "url_text", "label", "source"
    ).agg(F.count("*").alias("n"))


def _write_mbox(spark, sf_dir, path: str) -> None:
    """The derived mail as mbox files, each with a line of no message in front."""
    mails = derived_raw_mail(spark, sf_dir).select(
        F.concat(
            F.lit("From sender@example.com Mon Jan  1 00:00:00 2024\n"),
            # as mbox writers do, lest a body line be taken for a separator
            F.regexp_replace(F.decode("raw_bytes", "UTF-8"), "\nFrom ", "\n>From "),
        ).alias("value"), F.spark_partition_id().alias("file"), F.monotonically_increasing_id().alias("place"),
    )
    first = F.row_number().over(Window.partitionBy("file").orderBy("place")) == 1
    mails.select(
        F.when(first, F.concat(F.lit("a line of no message\n"), "value")).otherwise(F.col("value"))
    ).write.text(path)


@query
def mbox_messages(spark, sf_dir):
    """The derived mail written as mbox files to the shared folder and read back from 2022 on."""
    box = f"{_shared(spark)}/mbox"
    _write_mbox(spark, sf_dir, box)
    messages = parse_messages(read_mbox(spark, box, 1, after_year=2022))
    headers = F.col("headers")
    return messages.select(
        F.regexp_extract(header(headers, "message-id"), "<([0-9]+)@", 1).cast("long").alias(
            "doc_id"
        ),
        "label", "date_year", header(headers, "subject").alias("subject"),
        B.corpus_body(F.col("parts"), F.col("raw_text")).alias("body"),
    )


@query
def mail_body_corpus(spark, sf_dir):
    return mail_bodies(_messages(spark, sf_dir))


# --- labels, JSON, filters -------------------------------------------------------------------
def _typed_labels(spark, sf_dir):
    kinds = F.array(
        F.lit("Safe Email"), F.lit("Phishing Email"), F.lit("spear phishing"), F.lit(None)
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("Email Text"),
        F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("Email Type"),
    )


@query
def label_harmonise(spark, sf_dir):
    return harmonise.label_to_int(_typed_labels(spark, sf_dir), order_col="doc_id").select(
        "doc_id", "label"
    )


@query
def label_by_word(spark, sf_dir):
    return _typed_labels(spark, sf_dir).select(
        "doc_id", harmonise.label_by_word(F.col("Email Type")).alias("label")
    )


@query
def normalised_corpus(spark, sf_dir):
    """Raw corpus to text and label, blank texts left out; counted per text and label."""
    raw = _typed_labels(spark, sf_dir).withColumn(
        "Email Text", F.when(F.col("doc_id") % 17 == 0, "  \n").otherwise(F.col("Email Text"))
    )
    return harmonise.normalise_corpus(raw).groupBy("text", "label").agg(F.count("*").alias("n"))


@query
def json_flatten(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return harmonise.with_flat_mail(events, "props").drop("props")


@query
def json_flatten_mail(spark, sf_dir):
    """JSON mail built from the documents, with missing, empty and unparseable fields."""
    fields = F.create_map(
        F.lit("Subject"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")),
        F.lit("sender"), F.col("source"),
        F.lit("to"), F.lit("team@example.com"),
        F.when(F.col("doc_id") % 5 == 0, "note").otherwise("body"), F.col("text"),
    )
    raw = (
        F.when(F.col("doc_id") % 19 == 0, F.lit(None))
        .when(F.col("doc_id") % 7 == 0, F.col("text"))
        .otherwise(F.to_json(fields))
    )
    mail = documents(spark, sf_dir).select("doc_id", raw.alias("mail"))
    return harmonise.with_flat_mail(mail, "mail").drop("mail")


@query
def year_filter(spark, sf_dir):
    messages = _messages(spark, sf_dir).select("msg_id", "date_year")
    return harmonise.from_year(messages, 2022)


@query
def year_of_date_header(spark, sf_dir):
    date = F.regexp_extract("header_text", r"Date: ([^\r\n]*)", 1)
    return derived_mail(spark, sf_dir).select("doc_id", harmonise.year_of_date(date).alias("year"))


@query
def short_and_class_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.when(F.col("role") == "user", 0).otherwise(1).alias("label")
    )
    return harmonise.drop_short(harmonise.only_class(rows, 0))


# --- set operations --------------------------------------------------------------------------
def _union(spark, sf_dir):
    docs = _texts(spark, sf_dir).withColumn("priority", F.lit(0))
    bench = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("row_id"), "text", F.lit(0).alias("label"),
        F.lit("benchmark").alias("source"), F.lit(1).alias("priority"),
    )
    talk = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text",
        F.lit(0).alias("label"), F.lit("conversations").alias("source"),
        F.lit(2).alias("priority"),
    )
    return harmonise.union_corpora(docs, bench, talk)


@query
def union_clean(spark, sf_dir):
    return harmonise.drop_short(harmonise.drop_blank(_union(spark, sf_dir)))


@query
def dedup_keep_first(spark, sf_dir):
    return harmonise.dedup_keep_first(harmonise.drop_short(_union(spark, sf_dir)))


@query
def dedup_counts(spark, sf_dir):
    return harmonise.dedup_counts(_union(spark, sf_dir))


# --- profiles --------------------------------------------------------------------------------
@query
def class_distribution(spark, sf_dir):
    return profile.class_distribution(_texts(spark, sf_dir))


@query
def source_counts(spark, sf_dir):
    return profile.value_counts(_union(spark, sf_dir), "source")


@query
def corpus_summary(spark, sf_dir):
    return profile.corpus_summary(_union(spark, sf_dir))


@query
def text_length_profile(spark, sf_dir):
    return profile.text_lengths(_texts(spark, sf_dir))


@query
def low_card_profile(spark, sf_dir):
    return profile.low_cardinality_profile(table(spark, sf_dir, "documents"))


@query
def balance_ratio(spark, sf_dir):
    return profile.balance_ratio(_texts(spark, sf_dir))


@query
def class_weights(spark, sf_dir):
    weighted = profile.balanced_weights(_texts(spark, sf_dir).select("row_id", "label"))
    return weighted.withColumn("weight", F.round("weight", 9))


# --- sampling --------------------------------------------------------------------------------
@query
def class_ratio_sample(spark, sf_dir):
    return sampling.class_ratio_sample(_texts(spark, sf_dir), 400, 0.7)


@query
def class_ratio_sample_short(spark, sf_dir):
    """More rows wanted than one class has."""
    return sampling.class_ratio_sample(_texts(spark, sf_dir).drop("text"), 20000, 0.7)


@query
def seeded_shuffle(spark, sf_dir):
    shuffled = sampling.seeded_shuffle(_texts(spark, sf_dir).select("row_id", "label"))
    return shuffled.withColumn("order_hash", sampling.order_hash("row_id"))


@query
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_texts(spark, sf_dir).select("row_id", "label"), 0.3)


@query
def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(_texts(spark, sf_dir).select("row_id", "label"), 5)


# --- evaluation ------------------------------------------------------------------------------
def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *(
            F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


@query
def confusion(spark, sf_dir):
    return evaluation.confusion(derived_scores(spark, sf_dir))


@query
def metrics(spark, sf_dir):
    return _round(evaluation.metrics(derived_scores(spark, sf_dir)))


@query
def roc_auc(spark, sf_dir):
    return _round(evaluation.roc_auc(derived_scores(spark, sf_dir)))


@query
def roc_curve(spark, sf_dir):
    return _round(evaluation.roc_curve(derived_scores(spark, sf_dir)))


@query
def roc_curve_fine(spark, sf_dir):
    """One threshold per distinct event value, more than there are ranges."""
    scored = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.col("value").alias("score"),
    )
    return _round(evaluation.roc_curve(scored), 9)


@query
def classification_report(spark, sf_dir):
    return evaluation.classification_report(derived_scores(spark, sf_dir))


# --- scoring ---------------------------------------------------------------------------------
def _scores(spark, sf_dir, factor: int = 37, *keep) -> DataFrame:
    p1 = (F.col("doc_id") * factor % 101).cast("double") / 101
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("msg_id"), (1 - p1).alias("p0"), p1.alias("p1"), *keep
    )


@query
def verdicts(spark, sf_dir):
    return _round(scoring.verdicts(_scores(spark, sf_dir)))


@query
def mail_verdicts(spark, sf_dir):
    return _round(scoring.mail_verdicts(_scores(spark, sf_dir)))


@query
def threshold_verdicts(spark, sf_dir):
    return _round(scoring.threshold_verdicts(_scores(spark, sf_dir)))


@query
def fusion(spark, sf_dir):
    """Mails without a header row, with a null URL score, and without any score but null."""
    def unless(condition, scores):
        return scores.withColumn("p1", F.when(~condition, F.col("p1")))

    mail = F.col("msg_id")
    agents = {
        "text": unless(mail % 35 == 0, _scores(spark, sf_dir, 37)),
        "url": unless(mail % 7 == 0, _scores(spark, sf_dir, 53)),
        "header": _scores(spark, sf_dir, 71).filter(mail % 5 != 0),
    }
    return _round(scoring.fuse(agents, {"text": 2.0, "url": 1.0, "header": 1.0}))


@query
def batch_table(spark, sf_dir):
    """The eight-column result table for given scores and tokens."""
    scored = _scores(spark, sf_dir, 37, "lang", "source", F.col("text").alias("body"))
    weight = F.col("p1") - F.lit(0.5)
    tops = F.array(
        F.struct(F.col("lang").alias("token"), weight.alias("weight")),
        F.struct(F.col("source").alias("token"), (-weight).alias("weight")),
    )
    return scoring.batch_results(
        scored.select(
            F.concat(F.col("msg_id").cast("string"), F.lit(".eml")).alias("file"),
            F.col("body").alias("subject"),
            F.when(F.col("msg_id") % 9 == 4, F.lit(None))
            .when(F.col("msg_id") % 9 == 5, 1).otherwise(F.length("body")).alias("n_chars"),
            F.when(F.col("msg_id") % 9 == 4, "ValueError: bad boundary").alias("parse_error"),
            "p0", "p1", tops.alias("top_features"),
        )
    )


@query
def batch_summary(spark, sf_dir):
    return scoring.batch_summary(batch_table(spark, sf_dir))


@query
def token_details(spark, sf_dir):
    return _scores(spark, sf_dir).select(
        "msg_id",
        token_detail(F.col("msg_id").cast("string"), F.col("p1") - F.lit(0.5)).alias("detail"),
    )


@query
def truncated_tokens(spark, sf_dir):
    """Tokens the text model reads, of the whole token list of each text."""
    return documents(spark, sf_dir).select(
        "doc_id",
        F.size(tokens(F.col("text"), None)).alias("n_words"),
        F.array_join(tokens(F.col("text"), v.TRAIN_TOKENS), " ").alias("read"),
    )


@query
def standard_scale(spark, sf_dir):
    feats = with_text_features(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "text_length", "word_count", "digit_ratio", "requests_ssn"
    )
    return _round(
        scale_by_aggregate(feats, ["text_length", "word_count", "digit_ratio", "requests_ssn"])
    )


@query
def aligned_features(spark, sf_dir):
    feats = with_text_features(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "word_count", F.when(F.col("doc_id") % 2 == 0, F.col("text_length")).alias(
            "text_length"
        ),
    )
    return harmonise.align_features(feats, ("text_length", "url_count", "word_count"), ("doc_id",))


# --- models ----------------------------------------------------------------------------------
def _phishing_line(key: str):
    """1 where the derived mail carries one of the four phishing lines."""
    return F.when(F.col(key) % 8 < 4, 1).otherwise(0).alias("label")


def _model_mail(spark, sf_dir) -> DataFrame:
    """``row_id, text, label``: whole bodies as they are."""
    return derived_mail(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"), F.col("body").alias("text"), _phishing_line("doc_id"),
    )


def _split_scores(agent, feats: DataFrame, key: str) -> tuple:
    """The trained agent and the held-out rows; features and split are computed once."""
    split = sampling.stratified_split(stored(feats, "features"), 0.3, "label", key)
    parts = stored(split, "parts")
    train, test = parts.filter("is_test = 0"), parts.filter("is_test = 1")
    return agent.train(train, "label", key, validate=False), test


def _header_forest(spark, sf_dir) -> tuple:
    """The label a derived mail carries shows in its SPF result and its X-Mailer."""
    feats = header_features(_messages(spark, sf_dir), ("msg_id", "label"))
    return _split_scores(header_agent(), feats, "msg_id")


@query
def header_forest_metrics(spark, sf_dir):
    agent, test = _header_forest(spark, sf_dir)
    return _round(agent.evaluate(test))


@query
def header_forest_verdicts(spark, sf_dir):
    """Verdict per held-out mail."""
    agent, test = _header_forest(spark, sf_dir)
    return agent.predict(test, ("msg_id", "label")).select("msg_id", "label", "prediction")


def _mail_urls(spark, sf_dir) -> DataFrame:
    """URL features of each mail; four of the seven closing URLs are phishing."""
    return url_corpus_features(
        derived_mail(spark, sf_dir).select(
            F.col("doc_id").alias("url_id"), F.col("body").alias("url_text"),
            (F.col("doc_id") % 7).isin(0, 1, 5, 6).cast("int").alias("label"),
        )
    )


@query
def url_forest_verdicts(spark, sf_dir):
    """Verdict of a URL forest per held-out mail, by all URLs of the mail."""
    agent, test = _split_scores(url_agent(), _mail_urls(spark, sf_dir), "url_id")
    return agent.predict(test, ("url_id", "label")).select("url_id", "label", "prediction")


@query
def stored_agent(spark, sf_dir):
    """A forest saved to the shared folder and loaded again: equal scores for every held-out mail."""
    agent, test = _split_scores(url_agent(), _mail_urls(spark, sf_dir), "url_id")
    path = _shared(spark)
    agent.save(path)
    again = type(agent).load(spark, path).predict(test, ("url_id",)).select("url_id", F.col("p1").alias("again"))
    both = agent.predict(test, ("url_id",)).join(again, "url_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("p1") == F.col("again")).alias("equal"))


@query
def stored_metrics(spark, sf_dir):
    """The twelve metrics as the JSON object a run leaves behind."""
    path = _shared(spark)
    write_metrics(evaluation.metrics(derived_scores(spark, sf_dir)), path)
    names = evaluation.metrics(derived_scores(spark, sf_dir)).columns
    return _round(spark.read.json(path).select(*names))


@query
def stored_batch(spark, sf_dir):
    """The result table written as CSV and read back."""
    path = _shared(spark)
    rows = batch_table(spark, sf_dir)
    write_batch_csv(rows, path)
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select(*rows.columns)


@query
def stored_explanations(spark, sf_dir):
    """Explanations written as JSON lines and read back."""
    path = _shared(spark)
    tops = F.array(F.struct(F.col("lang").alias("token"), F.col("p1").alias("weight")))
    explained = _scores(
        spark, sf_dir, 37, F.concat(F.col("doc_id"), F.lit(".eml")).alias("file"),
        F.col("source").alias("subject"), "lang",
    ).withColumn("top_features", tops)
    write_explanations(explained, path)
    return _round(spark.read.json(path).select(
        "file", "subject", "prediction", "confidence", "p_safe", "p_phishing",
        F.col("top_features")[0]["token"].alias("token"), F.col("top_features")[0]["weight"].alias("weight"),
    ))


@query
def forest_importances(spark, sf_dir):
    agent, _ = _split_scores(text_url_agent(), text_url_features(_model_mail(spark, sf_dir)), "row_id")
    return agent.importances(spark, 15)


@query
def fold_verdicts(spark, sf_dir):
    """Each mail's verdict by the URL forest of the four other folds."""
    return url_agent().cross_predict(_mail_urls(spark, sf_dir), key="url_id")


def _text_agent(spark, sf_dir) -> tuple[TextAgent, DataFrame]:
    mail = stored(_model_mail(spark, sf_dir), "texts")
    parts = stored(sampling.stratified_split(mail, 0.2), "parts")
    return TextAgent().train(parts.filter("is_test = 0")), parts.filter("is_test = 1")


@query
def text_scores(spark, sf_dir):
    agent, test = _text_agent(spark, sf_dir)
    return scoring.mail_verdicts(agent.predict(test))


@query
def text_verdicts(spark, sf_dir):
    """Verdict per held-out mail."""
    agent, test = _text_agent(spark, sf_dir)
    return agent.predict(test).select(
        "row_id", "label", (F.col("p1") > F.col("p0")).cast("int").alias("prediction")
    )


@query
def text_agent_metrics(spark, sf_dir):
    agent, test = _text_agent(spark, sf_dir)
    return _round(agent.evaluate(test))


@query
def word_explanations(spark, sf_dir):
    """Ten strongest words of every held-out mail, over whole texts."""
    agent, test = _text_agent(spark, sf_dir)
    explained = explain_agent(test, agent, "text", "row_id", num_features=10, num_samples=500)
    return top_tokens(explained, 10, "row_id")


@query
def batch_classification(spark, sf_dir):
    """Raw mail to the eight-column result table: parse, score, explain, format."""
    agent, _ = _text_agent(spark, sf_dir)
    return classify_batch(derived_raw_mail(spark, sf_dir), agent)[0]
