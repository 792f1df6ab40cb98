"""Mail, URL lists and scores derived from the driver tables, in SQL both engines read alike.

The tables hold no mail, so each document becomes one: its whole text, a closing line with the URL
of a page and a header block chosen by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAIL_SQL = """
SELECT d.doc_id, d.source, d.lang,
  concat(d.text, chr(10),
    CASE d.doc_id % 8 WHEN 0 THEN 'URGENT! Verify your account immediately!! Click here: '
      WHEN 1 THEN 'Dear Customer, you won a prize of $5000 today. '
      WHEN 2 THEN '<p>Please update your billing details</p> '
      WHEN 3 THEN 'Unauthorized access: legal action, account locked. '
      ELSE 'See the notes. ' END,
    p.url, ' ',
    CASE d.doc_id % 7 WHEN 0 THEN 'http://secure-bank-verify.tk/login?id=98234'
      WHEN 1 THEN 'http://192.168.1.1/verify' WHEN 2 THEN 'https://accounts.google.com/a;p=1?token=x&user=y'
      WHEN 3 THEN 'http://a-b.example.org:8080//r?u=http://c.example.net' WHEN 4 THEN 'https://www.microsoft.com/%7Ex'
      WHEN 5 THEN 'http://goggle.com/' ELSE 'http://u:p@facebook.com:TheCloud/x' END) AS body,
  concat('From: S <user', CAST(d.doc_id AS STRING), '@', d.source, '.', d.lang, '.example.com>', chr(13), chr(10),
    CASE WHEN d.doc_id % 3 = 0 THEN concat('Reply-To: r@other.example.net', chr(13), chr(10)) ELSE '' END,
    CASE d.doc_id % 5 WHEN 0 THEN concat('Received-SPF: softfail (x)', chr(13), chr(10)) WHEN 1 THEN concat('Received-SPF: Pass', chr(13), chr(10)) WHEN 2 THEN concat('Received-SPF: fail', chr(13), chr(10)) ELSE '' END,
    CASE WHEN d.doc_id % 4 = 1 THEN concat('Authentication-Results: mx; dkim=pass; dmarc=fail', chr(13), chr(10)) ELSE '' END,
    repeat(concat('Received: from h by 10.0.0.1', chr(13), chr(10)), CAST(d.doc_id % 13 AS INT)),
    'Subject: ', CASE d.doc_id % 6 WHEN 0 THEN 'RE: hello' WHEN 1 THEN 'URGENT ACTION REQUIRED!!!!' WHEN 2 THEN 'Fwd: note' ELSE 'plain' END, chr(13), chr(10),
    'Date: ', CASE d.doc_id % 4 WHEN 0 THEN 'Mon, 01 Jan 2001 12:00:00 +0000' WHEN 1 THEN 'Tue, 5 Apr 2022 10:11:12 -0700 (PDT)' WHEN 2 THEN 'garbage' ELSE 'Wed, 3 May 2023 01:02:03 +0100' END, chr(13), chr(10),
    CASE WHEN d.doc_id % 2 = 0 THEN concat('X-Priority: 1', chr(13), chr(10), 'X-Mailer: m', chr(13), chr(10)) ELSE '' END,
    'Message-ID: <', CAST(d.doc_id AS STRING), '@mx.example.com>', chr(13), chr(10), 'MIME-Version: 1.0', chr(13), chr(10)) AS header_text,
  CASE WHEN d.doc_id % 10 < 3 THEN 1 ELSE 0 END AS label
FROM {documents} d JOIN {pages} p ON p.page_id = d.doc_id % (SELECT count(*) FROM {pages})
"""

# One mail in nine is HTML only, one in nine has a plain and an HTML part, the rest is plain text.
_CRLF = "chr(13), chr(10)"
_UTF8 = f"'; charset=utf-8', {_CRLF}, 'Content-Transfer-Encoding: 8bit', {_CRLF}, {_CRLF}"
RAW_SQL = f"""
SELECT doc_id, source, lang, label, body, header_text,
  concat(header_text, CASE doc_id % 9
    WHEN 4 THEN concat('Content-Type: text/html', {_UTF8}, body)
    WHEN 7 THEN concat('Content-Type: multipart/alternative; boundary="=_cut"', {_CRLF}, {_CRLF},
      '--=_cut', {_CRLF}, 'Content-Type: text/plain', {_UTF8}, body, {_CRLF},
      '--=_cut', {_CRLF}, 'Content-Type: text/html', {_UTF8}, '<b>', body, '</b>', {_CRLF},
      '--=_cut--', {_CRLF})
    ELSE concat('Content-Type: text/plain', {_UTF8}, body) END) AS raw_text
FROM ({{mail}}) m
"""

# An evaluation table: document labels with a stand-in score.
SCORE_SQL = """
SELECT doc_id, toxic AS label, CAST(doc_id * 37 % 101 AS DOUBLE) / 101 AS score,
  CASE WHEN doc_id * 37 % 101 > 50 THEN 1 ELSE 0 END AS prediction
FROM {labels}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def derived_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, body, header_text, label``.

    The number of pages is put in as a number. As a subquery in the join key it fails ("Subquery has not
    finished") where pages seem too large to broadcast and prove small while the join runs.
    """
    pages = table(spark, sf_dir, "pages")
    sql = MAIL_SQL.replace("(SELECT count(*) FROM {pages})", str(pages.count()))
    return spark.sql(sql, documents=documents(spark, sf_dir), pages=pages)


def derived_raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mail as raw bytes: ``msg_id, raw_bytes, label, source, source_path``."""
    mail = derived_mail(spark, sf_dir)
    raw = spark.sql(RAW_SQL.format(mail="SELECT * FROM {mail}"), mail=mail)
    return raw.selectExpr(
        "doc_id AS msg_id", "encode(raw_text, 'UTF-8') AS raw_bytes", "label", "source",
        "concat('mail/', CAST(doc_id AS STRING), '.eml') AS source_path",
    )


def derived_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label, score, prediction``."""
    return spark.sql(SCORE_SQL, labels=table(spark, sf_dir, "labels"))


def for_duckdb(sql: str) -> str:
    """The same query over the views of the checking engine."""
    out = sql.replace("AS STRING", "AS VARCHAR")
    for name in ("documents", "pages", "labels"):
        out = out.replace("{" + name + "}", name)
    return out


MAIL_ORACLE = for_duckdb(MAIL_SQL)
RAW_ORACLE = for_duckdb(RAW_SQL.format(mail=MAIL_ORACLE))
SCORE_ORACLE = for_duckdb(SCORE_SQL)
