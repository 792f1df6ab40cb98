"""Clean-up, sampling, profiles, evaluation: edge cases the driver tables do not have."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mailprism.operators import evaluation, harmonise, profile, sampling, scoring
from mailprism.plans.agents import build_text_corpus, with_url_ids
from mailprism.plans.queries import QUERIES
from mailprism.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_column_resolution(spark):
    df = frame(spark, [("a", "b")], "`Email Text` string, class string")
    assert harmonise.resolve_label(df) == "class" and harmonise.resolve_text(df) == "Email Text"
    with pytest.raises(ValueError):
        harmonise.resolve_label(df.drop("class"))


def test_label_to_int(spark):
    rows = [(1, "ham"), (2, "Phish A"), (3, "phish b"), (4, None), (5, "Phish A")]
    df = frame(spark, rows, "id int, target string")
    out = harmonise.label_to_int(df, order_col="id").orderBy("id").collect()
    assert [r["label"] for r in out] == [0, 1, 0, 0, 1]
    ints = frame(spark, [(1,), (0,)], "label long")
    assert [r["label"] for r in harmonise.label_to_int(ints).collect()] == [1, 0]
    with pytest.raises(Exception, match="no phishing value"):
        harmonise.label_to_int(frame(spark, [("x",)], "label string")).collect()


def flat(obj):
    """The flat text of a JSON mail, spelled out in plain Python."""
    lines = []
    for title, keys in (("Subject", ("subject", "Subject", "subj")),
                        ("From", ("sender", "from", "From")),
                        ("To", ("recipient", "to", "To"))):
        picked = next((obj[k] for k in keys if obj.get(k)), None)
        if picked is not None:
            lines.append(f"{title}: {picked}")
    envelope = ("subject", "Subject", "sender", "from", "From", "recipient", "to", "To")
    body = next((str(obj[k]) for k in ("body", "content", "text", "message", "email_body",
                                       "plain_text", "html") if obj.get(k)), "")
    body = body or " ".join(f"{k}: {x}" for k, x in obj.items() if k not in envelope)
    return "\n".join([*lines, "", body])


def test_flat_json_mail(spark):
    objects = [
        {"subject": "s", "from": "f", "to": "t", "body": "b"},
        {"subject": "", "Subject": "S", "body": "", "text": "x"},
        {"subj": "z", "other": "o", "n": 5},
        {"subject": 0, "Subject": "0", "body": False, "content": "false"},
        {"subject": True, "body": 1.5, "to": None},
        {"body": [], "text": {}, "message": "m"},
        {"subject": "only"}, {}, {"a": None, "b": "c"},
        {"body": "line\nbreak \"quoted\" é"},
    ]
    odd = [None, "plain text", "[1]", "12", '{"a": 1} trailing', "", "{broken}"]
    raws = [json.dumps(o) for o in objects] + odd
    df = frame(spark, list(enumerate(raws)), "id int, raw string")
    got = [r["text"] for r in harmonise.with_flat_mail(df, "raw").orderBy("id").collect()]
    assert got[: len(objects)] == [flat(o) for o in objects]
    assert got[len(objects):] == ["" if o is None else o for o in odd]


def test_dedup_keeps_the_first_source(spark):
    rows = [(9, "x", 1, 0), (1, "x", 0, 1), (2, "y", 0, 1), (3, "y", 1, 1)] + [
        (100 + i, "hot", 0, 1) for i in range(500)
    ] + [(7, "hot", 1, 0)]
    df = frame(spark, rows, "row_id int, text string, label int, priority int")
    out = {r["text"]: (r["row_id"], r["label"]) for r in harmonise.dedup_keep_first(df).collect()}
    assert out == {"x": (9, 1), "y": (2, 0), "hot": (7, 1)}
    counts = harmonise.dedup_counts(df).first()
    assert (counts["before"], counts["after"], counts["removed"]) == (505, 3, 502)
    assert harmonise.dedup_counts(df.limit(0)).first()["before"] == 0


def test_sampling_does_not_depend_on_partitioning(spark):
    df = spark.range(2000).select(
        F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label")
    )
    one, many = df.coalesce(1), df.repartition(13)
    for pick in (
        lambda d: sampling.class_ratio_sample(d, 300, 0.7),
        lambda d: sampling.stratified_split(d, 0.3),
        lambda d: sampling.stratified_folds(d, 5),
    ):
        a, b = ({tuple(r) for r in pick(d).collect()} for d in (one, many))
        assert a == b
    sample = sampling.class_ratio_sample(df, 300, 0.7)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 210, 1: 90}
    assert sampling.class_ratio_sample(df, 100, 1.0).filter("label = 1").count() == 0
    split = sampling.stratified_split(df, 0.2).groupBy("label", "is_test").count().collect()
    assert {(r["label"], r["is_test"]): r["count"] for r in split} == {
        (0, 0): 1066, (0, 1): 267, (1, 0): 534, (1, 1): 133
    }
    folds = sampling.stratified_folds(df, 5).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds if r["label"] == 0} <= {266, 267}
    stateless = sampling.split_by_hash(df, 0.3).agg(F.avg("is_test")).first()[0]
    assert 0.25 < stateless < 0.35


def test_test_sizes_use_largest_remainder(spark):
    def sizes(counts: dict) -> dict:
        frame = spark.createDataFrame(list(counts.items()), "label int, n long")
        return {r["label"]: r["rank"] for r in sampling.test_sizes(frame, 0.3).collect()}

    assert sizes({0: 7, 1: 3}) == {0: 2, 1: 1}
    assert sizes({0: 5, 1: 5, 2: 1}) == {0: 2, 1: 2, 2: 0}


def test_split_of_many_classes(spark):
    """There is no limit on classes, and nothing runs while the plan is built."""
    rows = spark.range(3000).selectExpr("id AS row_id", "CAST(id % 40 AS INT) AS label")
    found = sampling.stratified_split(rows, 0.3).groupBy("label").agg({"is_test": "sum"}).collect()
    assert len(found) == 40 and all(r[1] in (22, 23) for r in found)
    folds = sampling.stratified_folds(rows, 5).groupBy("label", "fold").count().collect()
    assert len(folds) == 200 and {r["count"] for r in folds} == {15}


def test_json_mail_as_python_prints_it(spark):
    raws = [
        ('{"other": true, "x": false}', "\nother: True x: False"),
        ("{'subject': 'S', 'body': 'b'}", "{'subject': 'S', 'body': 'b'}"),
        ('{"a": 1} x}', '{"a": 1} x}'),
        ('{"subject": "one", "subject": "two", "body": [1, {"k": null}]}', "Subject: two\n\n[1, {'k': None}]"),
        ('{"n": NaN, "big": 10000000000000000000000}', "\nn: nan big: 10000000000000000000000"),
        ("[1, 2]", "[1, 2]"), ('{"from": 0, "body": "", "text": "t"}', "\nt"), (None, ""), ("{}", "\n"),
    ]
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(raws)], "id int, raw string")
    got = [r["text"] for r in harmonise.with_flat_mail(df, "raw").orderBy("id").collect()]
    assert got == [text for _, text in raws]


def test_dedup_keeps_one_of_equal_rows(spark):
    rows = [("a", 1, 5), ("a", 1, 5), ("a", 0, 9), (None, 2, 2), (None, 1, 7), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "text string, priority int, row_id int")
    got = sorted(map(tuple, harmonise.dedup_keep_first(df).collect()), key=str)
    assert got == [("a", 0, 9), ("b", 1, 1), (None, 1, 7)]
    assert len(harmonise.dedup_keep_first(df.filter("row_id = 5")).collect()) == 1


def test_scores_that_are_missing(spark):
    rows = [(1, 0.9), (0, 0.1), (1, None), (0, 0.4)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert evaluation.roc_auc(df).first()[0] is None
    assert evaluation.roc_auc(df.filter("score IS NOT NULL")).first()[0] == 1.0
    assert evaluation.roc_curve(df).count() == 3
    one = spark.createDataFrame([("m", 0.1, 0.9), ("n", None, None)], "msg_id string, p0 double, p1 double")
    none = spark.createDataFrame([("m", None, None), ("n", None, None)], "msg_id string, p0 double, p1 double")
    fused = {r["msg_id"]: r for r in scoring.fuse({"a": one, "b": none}).collect()}
    assert (fused["m"]["p1"], fused["m"]["verdict"]) == (0.9, "Phishing")
    assert fused["n"]["p1"] is None and fused["n"]["verdict"] is None


def test_weights_with_one_class(spark):
    df = frame(spark, [(0,), (0,)], "label int")
    assert {r["weight"] for r in profile.balanced_weights(df).collect()} == {1.0}


def test_metrics_guard_empty_cells(spark):
    df = frame(spark, [(0, 0, 0.2), (0, 0, 0.4)], "label int, prediction int, score double")
    row = evaluation.metrics(df).first()
    assert row["accuracy"] == 1.0 and row["precision"] == 0.0 and row["recall"] == 0.0
    assert row["roc_auc"] is None


def test_auc_with_hot_scores(spark):
    """A third of the rows share one score; compared with counting all pairs."""
    rows = [(i % 2, 0.9) for i in range(100)] + [(int(i % 3 == 0), i / 200) for i in range(200)]
    df = frame(spark, rows, "label int, score double")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(evaluation.roc_auc(df).first()[0] - pairs) < 1e-12
    curve = evaluation.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert curve[-1]["fpr"] == 1.0 and curve[-1]["tpr"] == 1.0
    assert all(a["tpr"] <= b["tpr"] for a, b in zip(curve, curve[1:]))


def test_percent_rounds_like_python(spark):
    values = [0.97335, 0.005, 0.00005, 1.0, 0.123456, 0.10005]
    df = frame(spark, [(x,) for x in values], "p double")
    got = [r[0] for r in df.select(scoring.percent(F.col("p"))).collect()]
    assert got == [f"{x * 100:.2f}%" for x in values]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "h.csv").write_text('text,label,extra\n"two\nlines, ""quoted""",0,x\nb,1,y\n')
    rows = tables.read_labelled_csv(spark, str(tmp_path / "h.csv")).collect()
    assert [tuple(r) for r in rows] == [('two\nlines, "quoted"', 0), ("b", 1)]
    (tmp_path / "u.csv").write_text("url,x\n" + "".join(f"http://u{i}.tk,{i}\n" if i != 3 else ",3\n" for i in range(50)))
    urls = tables.read_phishing_urls(spark, str(tmp_path / "u.csv"), 10).collect()
    assert sorted(r["url_text"] for r in urls) == sorted(f"http://u{i}.tk" for i in range(10) if i != 3)
    assert tables.read_phishing_urls(spark, str(tmp_path / "no.csv")).count() == 0
    assert tables.read_ranked_domains(spark, str(tmp_path / "no.csv")).count() == 0


def test_splits(spark, tmp_path):
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.parquet")
    (tmp_path / "a.json").write_text('{"text": "one", "label": 0}\n')
    spark.createDataFrame([("two", 1)], "text string, label long").write.parquet(b)
    splits = {"validation": a, "train": b}
    assert tables.read_split(spark, splits).first()["text"] == "two"
    assert tables.read_split(spark, {"validation": a}).first()["text"] == "one"
    assert tables.read_all_splits(spark, splits).count() == 2


def test_text_corpus(spark):
    base = frame(spark, [("short", "Phishing Email"), ("the same mail text", "Phishing Email"),
                         (None, "Safe Email"), ("  ", "Safe Email")],
                 "`Email Text` string, `Email Type` string")
    mail = frame(spark, [(0, '{"body": "the same mail text"}'), (1, '{"body": "left out here"}'),
                         (0, "tiny")], "phish_label int, email_content string")
    four = frame(spark, [("a legitimate mail", 0), ("http://legit.example", 2)], "content string, label int")
    hand = frame(spark, [("a hand-written mail", 0)], "text string, label int")
    out = build_text_corpus(base, None, mail, four, hand).collect()
    assert {(r["text"], r["label"]) for r in out} == {
        ("short", 1), ("the same mail text", 1), ("\nthe same mail text", 0),
        ("a legitimate mail", 0), ("a hand-written mail", 0),
    }
    assert len({r["row_id"] for r in out}) == len(out)


def test_url_ids_keep_every_copy(spark):
    rows = [("http://hot", 1, "s")] * 25_000 + [("http://x", 0, "s"), ("http://x", 1, "s")]
    urls = spark.createDataFrame(rows, "url_text string, label int, source string")
    out = with_url_ids(urls)
    assert out.count() == len(rows) and out.select("url_id").distinct().count() == len(rows)


def test_value_counts_and_profile(spark):
    df = frame(spark, [("a", i, None) for i in range(30)] + [("b", 99, None)], "s string, i int, n string")
    got = {(r["column"], r["value"], r["n"]) for r in profile.low_cardinality_profile(df).collect()}
    assert got == {("s", "a", 30), ("s", "b", 1)}
    assert profile.value_counts(df, "s").first()["s"] == "a"


@pytest.mark.parametrize("name", ["stratified_split", "stratified_folds", "class_ratio_sample"])
def test_sampling_reads_its_table_three_times(spark, sf_dir, name):
    """Once to count, once for the rows around the cuts, once for the result; counts are shuffled once."""
    result = QUERIES[name](spark, sf_dir)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert 0 < plan.count("FileScan") <= 3


def test_cuts_at_ranks_of_a_sorted_class(spark):
    """Against a plain sort: several ranks of a class, one wanted twice, a class without a wanted rank."""
    rows = [(i, None if i % 7 == 6 else i % 3) for i in range(500)]
    frame = spark.createDataFrame(rows, "row_id int, label int")

    def ranks(sizes):
        ends = F.array(F.lit(1), F.lit(3), F.lit(3), F.col("n").cast("int"))
        return sizes.filter("label < 2").select("label", F.explode(ends).alias("rank"))

    got = {r["label"]: r["cuts"] for r in sampling.hash_cuts(frame, "label", "row_id", 42, ranks).collect()}
    want = {}
    for label in (0, 1):
        hashes = sorted(hashlib.md5(f"42|{i}".encode()).hexdigest() for i, other in rows if other == label)
        want[label] = [hashes[0], hashes[2], hashes[2], hashes[-1]]
    assert got == want


@pytest.mark.parametrize("partitions", ["1", "2", "7", "64"])
def test_auc_for_any_number_of_ranges(spark, partitions):
    rows = [(int(i * 7919 % 11 < 5), (i * 37 % 101) / 100.0) for i in range(400)]
    frame = spark.createDataFrame(rows, "label int, score double")
    pos, neg = [[s for l, s in rows if l == k] for k in (1, 0)]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = evaluation.roc_auc(frame).first()["roc_auc"]
        curve = evaluation.roc_curve(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == pytest.approx(want)
    for r in curve:
        assert r["tpr"] == pytest.approx(sum(p >= r["threshold"] for p in pos) / len(pos))
        assert r["fpr"] == pytest.approx(sum(n >= r["threshold"] for n in neg) / len(neg))
