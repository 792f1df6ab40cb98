"""Mail parsing, body choice, readers and the stream."""

import mailbox
import random
import re
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser

import pytest
from pyspark.sql import functions as F

from mailprism.functions import bodies as B
from mailprism.functions import fixed_values as v
from mailprism.functions.headers import READ_HEADERS, header
from mailprism.operators.features import flat_features, header_features, nested_features
from mailprism.operators.mime import parse_messages
from mailprism.sources import corpora
from mailprism.sources.mail_files import read_eml_tree, read_mbox
from mailprism.streaming.mail_stream import stream_eml_tree, stream_features, write_features

MULTIPART = b"""\
From: attacker@evil.com
To: victim@example.com
Subject: Urgent: Verify your account
MIME-Version: 1.0
Content-Type: multipart/alternative; boundary="boundary123"

--boundary123
Content-Type: text/plain; charset=utf-8

Verify your account immediately: http://evil.com/verify
--boundary123
Content-Type: text/html; charset=utf-8

<html><body><p>Verify your <b>account</b> immediately:
<a href="http://evil.com/verify">click here</a></p></body></html>
--boundary123--
"""
HTML_ONLY = b"From: a@b.co\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Hi</p> there\r\n"
ENCODED = (
    "From: =?utf-8?q?J=C3=BCrgen?= <j@sub.mail-host1.example.org>\r\n"
    "Subject: =?utf-8?b?R3LDvMOfZQ==?= and a very long\r\n\tfolded tail\r\n"
    "Received: from x by 10.1.1.1\r\nReceived: from y by 172.16.0.1\r\nX-A: 1\r\nx-b: 2\r\n"
    "Content-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: base64\r\n\r\n"
    "R3L832U=\r\n"
).encode()
BAD_CHARSET = b"From: a@b.co\r\nContent-Type: text/plain; charset=no-such-set\r\n\r\nplain words\r\n"
EMPTY = b""
NO_HEADERS = b"\r\njust text\r\n"
BINARY = b"From: a@b.co\r\nContent-Type: application/pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nJVBERg==\r\n"
MAILS = [MULTIPART, HTML_ONLY, ENCODED, BAD_CHARSET, EMPTY, NO_HEADERS, BINARY]


def mail_table(spark, mails):
    rows = [(i, bytearray(m), i % 2) for i, m in enumerate(mails)]
    return spark.createDataFrame(rows, "msg_id int, raw_bytes binary, label int")


def first_texts(raw):
    """Plain and HTML text of a mail by the standard library; None where decoding fails."""
    msg = BytesParser(policy=policy.default).parsebytes(raw)
    parts = list(msg.walk()) if msg.is_multipart() else [msg]
    found = []
    for kind in ("text/plain", "text/html"):
        part = next((p for p in parts if p.get_content_type() == kind), None)
        found.append("" if part is None else part.get_content())
    return found


def test_bodies_follow_the_standard_library(spark):
    parts = F.col("parts")
    got = parse_messages(mail_table(spark, MAILS)).select(
        "msg_id", B.strict_body(parts).alias("strict"),
        B.feature_body(parts, F.col("raw_repr")).alias("feature"),
        B.corpus_body(parts, F.col("raw_text")).alias("corpus"),
        B.explained_body(parts, F.col("is_multipart")).alias("explained"),
        B.batch_body(parts, F.col("is_multipart")).alias("batch"),
    ).orderBy("msg_id").collect()
    for r, raw in zip(got, MAILS):
        try:
            plain, html = first_texts(raw)
            strict = plain or (re.sub(r"<[^>]+>", " ", html) if html else "")
        except LookupError:
            strict = None
        assert r["strict"] == strict
        assert r["feature"] == (str(raw) if strict is None else strict)
        assert r["corpus"] == (strict or raw.decode("utf-8", "replace"))
    assert got[0]["explained"] == "Verify your account immediately: http://evil.com/verify"
    assert got[1]["explained"] == "<p>Hi</p> there" and got[1]["batch"] == "<p>Hi</p> there\r\n"
    assert got[2]["strict"].strip() == "Grüße" or got[2]["strict"].startswith("Gr")
    assert got[3]["batch"] == "plain words\r\n"


def test_headers_are_decoded_and_ordered(spark):
    messages = parse_messages(mail_table(spark, [ENCODED]))
    row = messages.select("headers", header(F.col("headers"), "SUBJECT").alias("s")).first()
    assert row["s"].startswith("Grüße and a very long") and row["s"].endswith("folded tail")
    names = [h["name"] for h in row["headers"]]
    assert names[:2] == ["From", "Subject"] and names.count("Received") == 2
    f = header_features(messages).first()
    assert f["sender_has_subdomain"] == 1 and f["sender_has_digits"] == 1
    assert f["num_received_headers"] == 2 and f["suspicious_ip_count"] == 2
    assert f["num_x_headers"] == 1 and f["dkim_none"] == 1 and f["spf_none"] == 1


def test_unreadable_headers_give_zeros(spark):
    plain = parse_messages(mail_table(spark, [NO_HEADERS]))
    broken = plain.withColumn("headers", F.expr("array(named_struct('name','From','value',cast(null as string)))"))
    assert header_features(plain).first()["dkim_none"] == 1
    assert all(header_features(broken).first()[n] == 0 for n in v.HEADER_FEATURES)


def test_flat_and_nested_features_agree(spark):
    messages = parse_messages(mail_table(spark, MAILS))
    flat = {r["msg_id"]: r for r in flat_features(messages).collect()}
    assert len(v.ALL_FEATURES) == len(set(v.ALL_FEATURES)) == 92
    for r in nested_features(messages).collect():
        whole = {**r["text"].asDict(), **r["url"].asDict(), **r["metadata"].asDict()}
        assert whole == {n: flat[r["msg_id"]][n] for n in v.ALL_FEATURES}
    known = messages.withColumn("known", F.lit("URGENT http://x.tk"))
    given = nested_features(known, "known").first()
    assert given["text"]["urgent_keyword_count"] == 1 and given["url"]["url_count"] == 1


@pytest.fixture()
def eml_tree(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, raw in (("a.eml", MULTIPART), ("sub/B.EML", HTML_ONLY), ("c.txt", b"no mail")):
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


def test_eml_tree(spark, eml_tree):
    mails = read_eml_tree(spark, eml_tree, 1).collect()
    assert sorted(bytes(m["raw_bytes"]) for m in mails) == sorted([MULTIPART, HTML_ONLY])
    assert len({m["msg_id"] for m in mails}) == 2 and {m["label"] for m in mails} == {1}
    flat = read_eml_tree(spark, eml_tree, recursive=False).collect()
    assert len(flat) == 1 and flat[0]["label"] is None
    assert read_eml_tree(spark, eml_tree + "/missing", 1).count() == 0


def test_many_small_files_share_tasks(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.eml").write_bytes(b"Subject: %d\r\n\r\nx" % i)
    mails = read_eml_tree(spark, str(tmp_path), 0)
    assert mails.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert mails.count() == 600


def test_preprocess_tree(spark, eml_tree):
    rows = corpora.preprocess_eml_tree(spark, eml_tree, 1).orderBy("source_path").collect()
    first = rows[0]
    assert (first["text_length"], first["url_count"], first["urgency_score"]) == (55, 1, 4)
    assert first["sender"] == "attacker@evil.com" and first["label"] == 1


def make_mbox(path, n=40):
    box = mailbox.mbox(path)
    for i in range(n):
        msg = EmailMessage()
        msg["From"], msg["Subject"] = f"s{i}@example.com", f"mail {i}"
        if i % 4 != 3:
            msg["Date"] = ("Mon, 01 Jan 2001 12:00:00 +0000", "Tue, 5 Apr 22 10:11:12 -0700",
                           "Wed, 3 May 2023 01:02:03 +0100")[i % 4]
        msg.set_content(f"line one of {i}\n\nFrom the start\nlast ☃ line")
        box.add(msg)
    box.add(b"From: odd\xff@example.com\r\nDate: garbage\r\n\r\nbytes \xfe\xff end\r\n")
    box.flush()
    box.close()


def test_mbox_matches_the_standard_library(spark, tmp_path):
    path = str(tmp_path / "box.mbox")
    make_mbox(path)
    expected = sorted(m.as_bytes() for m in mailbox.mbox(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # several splits
    try:
        mails = read_mbox(spark, path, 1).collect()
        recent = read_mbox(spark, path, 1, after_year=2022).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted(bytes(m["raw_bytes"]) for m in mails)
    assert [g.rstrip(b"\n") for g in got] == [e.rstrip(b"\n") for e in expected]
    assert sum(g != e for g, e in zip(got, expected)) <= 1  # the last mail keeps its closing line
    assert len({m["msg_id"] for m in mails}) == len(mails)
    assert recent == 10 + 10 + 10 + 1
    assert read_mbox(spark, path + ".none").count() == 0


def test_mail_corpus_and_url_corpus(spark, eml_tree, tmp_path):
    box = str(tmp_path / "b.mbox")
    make_mbox(box, 4)
    ham = spark.createDataFrame(
        [(1, "hello http://ham.example/x", None, None, 0), (2, "spam", "s", "x@y.z", 1),
         (3, "", "only subject", "", 0), (4, "null label", "s", "s", None)],
        "id int, text string, subject string, sender string, label int",
    )
    corpus = corpora.build_mail_corpus(spark, [eml_tree], [box], ham, ham_key="id")
    found = {r["source"]: r["n"] for r in corpus.groupBy("source").agg(F.count("*").alias("n")).collect()}
    # the .eml files, the mail of 2022 and later or without a date, and two ham rows
    assert found == {v.SOURCE_EML: 2, v.SOURCE_MBOX: 4, v.SOURCE_HAM: 2}
    ids = corpus.select("msg_id").distinct().count()
    assert ids == corpus.count()
    assert corpora.build_mail_corpus(spark).columns == corpus.columns

    messages = parse_messages(corpus)
    (tmp_path / "p.csv").write_text('id,url\n1,http://p1.tk/a\n2,\n3,"http://p3.tk/a,b"\n')
    (tmp_path / "d.csv").write_text("1,good.org\n2,fine.org\n3,late.org\n")
    urls = corpora.build_url_corpus(
        spark, messages, str(tmp_path / "p.csv"), str(tmp_path / "d.csv"), 2
    )
    rows = {(r["url_text"], r["label"], r["source"]) for r in urls.collect()}
    assert ("http://evil.com/verify", 1, "eml_" + v.SOURCE_EML) in rows
    assert ("http://ham.example/x", 0, "eml_" + v.SOURCE_HAM) in rows
    assert {r for r in rows if r[2] == v.SOURCE_URL_LIST} == {
        ("http://p1.tk/a", 1, v.SOURCE_URL_LIST), ("http://p3.tk/a,b", 1, v.SOURCE_URL_LIST)
    }
    assert {r[0] for r in rows if r[2] == v.SOURCE_RANKED_DOMAINS} == {
        "https://good.org/", "https://fine.org/"
    }
    bodies = corpora.mail_bodies(messages).collect()
    assert all(b["text"].strip() for b in bodies)


def test_stream_equals_batch(spark, eml_tree, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    query = write_features(stream_features(stream_eml_tree(spark, eml_tree, 1)), out, log)
    query.awaitTermination(120)
    streamed = spark.read.parquet(out).drop("source_path").orderBy("msg_id").collect()
    batch = flat_features(
        parse_messages(read_eml_tree(spark, eml_tree, 1)), ("msg_id", "label")
    ).orderBy("msg_id").collect()
    assert [r.asDict() for r in streamed] == [r.asDict() for r in batch]


def random_mail(rng):
    names = [n.title() for n in READ_HEADERS] + ["X-Mailer", "x-spam", "To", "SUBJECT", "received"]
    pieces = ["a@b.example", "<c@d-1.org>", '"Q, x" <e@f.gh>', "=?utf-8?b?w7w=?=", "=?bad", "plain text",
              "pass", "SOFTFAIL", "\r\n ", "\r\n\t", "  ", "\x0b", "\x0c", "\x1c", "ü", "\x85", "10.0.0.1",
              "text/html", "multipart/mixed; boundary=b", "1.0", "Tue, 5 Apr 2022 10:11:12 -0700", ";", ",", ":"]
    lines = []
    for _ in range(rng.randrange(0, 14)):
        value = "".join(rng.choices(pieces, k=rng.randrange(0, 5)))
        lines.append(f"{rng.choice(names)}:{rng.choice(['', ' ', '  '])}{value}")
    raw = "\r\n".join([*lines, "", "body", ""]).encode()
    return raw.replace("ü".encode(), b"\xfc") if rng.random() < 0.3 else raw


def test_header_values_follow_the_standard_library(spark):
    rng = random.Random(5)
    raws = [random_mail(rng) for _ in range(600)]
    parsed = parse_messages(mail_table(spark, raws))
    names = [n for n in READ_HEADERS if n != "date"]  # a date keeps its text instead of being rewritten
    got = parsed.select(
        "msg_id", F.col("headers.value").alias("all"), F.col("headers.name").alias("names"),
        *(header(F.col("headers"), n).alias(n) for n in names),
    ).orderBy("msg_id").collect()
    compared = 0
    for row, raw in zip(got, raws):
        msg = BytesParser(policy=policy.default).parsebytes(raw)
        assert row["names"] == msg.keys()
        for name in names:
            try:
                value = str(msg.get(name, ""))
            except Exception:
                at = [n.lower() for n in msg.keys()].index(name)
                assert row["all"][at] is None
                continue
            assert row[name] == value.encode("utf-8", "replace").decode(), (name, raw)
            compared += value != ""
    assert compared > 1000
