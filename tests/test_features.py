"""Features against plain Python on hand-made and generated texts."""

import random
import re
import string
import unicodedata
from difflib import SequenceMatcher
from urllib.parse import urlparse

from pyspark.sql import functions as F

from mailprism.functions import fixed_values as v
from mailprism.functions.similarity import candidate
from mailprism.functions.text import with_preprocessed, with_text_features
from mailprism.functions.urls import with_url_features
from mailprism.plans.derived_mail import derived_mail, table
from mailprism.plans.queries import QUERIES

SPACES = "\t\n\x0b\f\r\x1c\x1f \x85\xa0 　"


def random_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = string.ascii_letters + string.digits + string.punctuation + SPACES + "éÉß²①٣ǅⅣ中😀"
    words = ["urgent", "Click Here", "now", "http://a.b/c?x=1", "$5000", "25 USD", "<b>", "verify"]
    out = []
    for _ in range(n):
        parts = [
            rng.choice(words) if rng.random() < 0.2 else rng.choice(alphabet)
            for _ in range(rng.randrange(0, 80))
        ]
        out.append("".join(parts))
    return out


def test_text_features_agree_with_python(spark):
    texts = random_texts(400) + ["", "   ", "\x1c\x1d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in with_text_features(rows).collect()}
    for i, t in enumerate(texts):
        low, words, r = t.lower(), t.split(), got[i]
        share = (lambda k: k / len(t)) if t else (lambda k: 0)
        assert r["text_length"] == len(t)
        assert r["word_count"] == len(words)
        assert abs(r["avg_word_length"] - (sum(map(len, words)) / len(words) if words else 0)) < 1e-9
        assert r["sentence_count"] == len(re.findall(r"[.!?]+", re.sub(r"https?://\S+", "", t)))
        assert abs(r["uppercase_ratio"] - share(sum(c.isupper() for c in t))) < 1e-12, t
        assert abs(r["digit_ratio"] - share(sum(c.isdigit() for c in t))) < 1e-12, t
        assert abs(r["special_char_ratio"] - share(sum(c in string.punctuation for c in t))) < 1e-12
        assert r["urgent_keyword_count"] == sum(k in low for k in v.URGENT_KEYWORDS)
        assert r["urgency_word_count"] == sum(low.count(w) for w in v.URGENCY_WORDS)
        assert r["contains_currency"] == bool(re.search(r"\$\d+|\d+\s*dollars|\d+\s*USD", t)), t
        assert r["large_sum_mentioned"] == bool(re.search(r"\$\d{4,}|\d{4,}\s*dollars", t))
        assert r["html_tags_present"] == bool(re.search(r"<[^>]+>", t))
        assert r["url_count_in_text"] == len(re.findall(r"https?://[^\s]+", t))


def test_null_text_counts_as_empty(spark):
    row = with_text_features(spark.createDataFrame([(None,)], "text string")).first()
    assert all(row[n] == 0 for n in v.TEXT_FEATURES)


def random_urls(n, seed=2):
    rng = random.Random(seed)
    pieces = [
        "a.com", "www.google.com", "goggle.com", "192.168.1.1", "u:p@", "h:8080", ":443", ":80", "/",
        "//", "?", "&", "x=1", ";p", "#f", "%20", "://", "token", "Login", ":99999", ":007", "-", ".tk",
        "sub.", "paypal", ".", "@", ":", "t.co", "é",
    ]
    return [
        rng.choice(["http://", "https://"]) + "".join(rng.choices(pieces, k=rng.randrange(1, 9)))
        for _ in range(n)
    ]


def port_of(parsed):
    try:
        return parsed.port
    except ValueError:
        return None


def test_url_features_agree_with_urlparse(spark):
    urls = random_urls(1500)
    rows = spark.createDataFrame(list(enumerate(urls)), "id int, text string")
    got = {r["id"]: r for r in with_url_features(rows).collect()}
    for i, u in enumerate(urls):
        r, p = got[i], urlparse(u)
        host = p.netloc.lower()
        assert r["url_count"] == 1
        assert r["domain_length"] == len(host), u
        assert r["domain_dots_count"] == host.count(".")
        assert r["path_length"] == len(p.path), u
        assert r["query_param_count"] == (len(p.query.split("&")) if p.query else 0), u
        port = port_of(p)
        assert r["uses_non_standard_port"] == (port is not None and port not in (80, 443)), u
        assert r["url_has_redirection"] == ("//" in u.split("://")[1]), u
        assert r["uses_https"] == u.startswith("https")
        known = any(host == g or host.endswith("." + g) for g in v.GOOD_DOMAINS)
        assert r["possible_brand_spoofing"] == (any(b in host for b in v.BRAND_WORDS) and not known)
        alike = any(
            host != g and host and SequenceMatcher(None, host, g).ratio() > 0.8
            for g in v.GOOD_DOMAINS
        )
        assert r["potential_typosquatting"] == alike, u


def test_typosquatting_examples(spark):
    flags = {
        "g00gle.com": 0, "goggle.com": 1, "www.google.com": 1, "mail.google.com": 0,
        "micros0ft.com": 1, "www.microsoft.com": 1, "www.apple.com": 1, "zoom.us": 0,
        "google.com": 0,
    }
    rows = spark.createDataFrame([(h, f"see http://{h}/x") for h in flags], "h string, text string")
    got = {r["h"]: r["potential_typosquatting"] for r in with_url_features(rows).collect()}
    assert got == flags


def test_length_pruning_loses_no_look_alike(spark):
    rng = random.Random(3)
    hosts = set()
    for good in v.GOOD_DOMAINS:
        for _ in range(150):
            chars = list(good)
            for _ in range(rng.randrange(1, 6)):
                at = rng.randrange(len(chars))
                rng.choice([
                    lambda: chars.insert(at, rng.choice("abc1.-")),
                    lambda: chars.pop(at) if len(chars) > 1 else None,
                    lambda: chars.__setitem__(at, rng.choice("xyz0")),
                ])()
                if not chars:
                    break
            hosts.add("".join(chars))
    rows = spark.createDataFrame([(h,) for h in hosts if h], "h string")
    kept = {r["h"] for r in rows.filter(candidate(F.col("h"))).collect()}
    for h in hosts - kept:
        assert not any(SequenceMatcher(None, h, g).ratio() > 0.8 for g in v.GOOD_DOMAINS)


def test_no_url_and_many_urls(spark):
    texts = ["nothing here", "http://a.tk https://b.com/login " * 4]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    none, many = with_url_features(rows).orderBy("id").collect()
    assert all(none[n] == 0 for n in v.URL_FEATURES)
    assert (many["url_count"], many["excessive_urls"], many["uses_https"]) == (8, 1, 0)
    assert many["domain_has_suspicious_tld"] == 1 and many["path_has_suspicious_keywords"] == 1


def test_preprocess_examples(spark):
    bodies = [
        ("<p>URGENT! Your account is suspended. Verify at http://fake-bank.com</p>", 65, 1, 3, False),
        ("Hi, the meeting is at 3pm. Here is the link: https://zoom.us/meeting", 68, 1, 0, False),
        ("Click here immediately: http://192.168.1.1/verify", 49, 1, 3, True),
        ("", 0, 0, 0, False),
    ]
    rows = spark.createDataFrame([(i, b[0]) for i, b in enumerate(bodies)], "id int, body string")
    got = with_preprocessed(rows).orderBy("id").collect()
    for r, b in zip(got, bodies):
        found = (r["text_length"], r["url_count"], r["urgency_score"], r["has_ip_url"])
        assert found == b[1:]


def test_typosquatting_query_against_brute_force(spark, sf_dir):
    mail = {r["doc_id"]: r["body"] for r in derived_mail(spark, sf_dir).collect()}
    pages = {-r["page_id"] - 1: r["url"] for r in table(spark, sf_dir, "pages").collect()}
    got = {r["id"]: r for r in QUERIES["typosquatting"](spark, sf_dir).collect()}
    assert set(got) == set(mail) | set(pages)
    for i, text in {**mail, **pages}.items():
        urls = re.findall(r'https?://[^\s<>"{}|\\^`\[\]]+', text)
        hosts = {urlparse(u).netloc.lower() for u in urls}
        alike = any(
            h and h != g and SequenceMatcher(None, h, g).ratio() > 0.8
            for h in hosts for g in v.GOOD_DOMAINS
        )
        assert got[i]["url_count"] == len(urls)
        assert got[i]["potential_typosquatting"] == alike


def test_scripts_set_aside_have_no_digits(spark):
    """The digit count leaves common scripts out at once: none of their characters is a digit, and odd digits stay counted."""
    from mailprism.functions.strings import NO_DIGITS, count_digits

    def odd(c):
        return chr(c).isdigit() or unicodedata.category(chr(c)) == "Nd"

    ends = [int(c.strip("{}"), 16) for c in re.findall(r"\\x([0-9a-f]{2}|{[0-9a-f]+})", NO_DIGITS)]
    for low, high in zip(ends[::2], ends[1::2], strict=True):
        assert not any(odd(c) for c in range(low, high + 1)), (low, high)
    texts = ["", "12 ab", "é١٢ x²³¹½", "中文3五", "日本①②", "한국 ४५ 9", "Ж7"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", count_digits(F.col("t"), F.length("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [sum(c.isdigit() for c in t) for t in texts]
