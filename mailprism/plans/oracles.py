"""SQL twins of the named queries, for an independent engine over the same tables."""

from __future__ import annotations

from mailprism.functions import fixed_values as v
from mailprism.functions.strings import ODD_DIGITS
from mailprism.plans.derived_mail import MAIL_ORACLE, RAW_ORACLE, SCORE_ORACLE

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def i(expr: str) -> str:
    return f"CAST(({expr}) AS INTEGER)"


def has(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def ends(text: str, *tails: str) -> str:
    return "(" + " OR ".join(f"ends_with({text}, {q(t)})" for t in tails) + ")"


def n_present(text: str, words) -> str:
    return i(" + ".join(i(has(text, w)) for w in words))


def n_times(text: str, words) -> str:
    return i(
        " + ".join(
            f"(length({text}) - length(replace({text}, {q(w)}, ''))) // {len(w)}" for w in words
        )
    )


def drop(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(by)}, 'g')"


def n_matches(text: str, pattern: str) -> str:
    return i(f"len(regexp_extract_all({text}, {q(pattern)}))")


def finds(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} ELSE 0.0 END"


def strip(text: str) -> str:
    return drop(text, f"^[{v.SPACE}]+|[{v.SPACE}]+$")


# --- text ------------------------------------------------------------------------------------
def text_exprs(t: str, low: str) -> dict[str, str]:
    words = f"list_filter(regexp_split_to_array({t}, {q(f'[{v.SPACE}]+')}), lambda w: w <> '')"
    n_words = f"len({words})"
    letters = f"length(array_to_string({words}, ''))"
    size = f"length({t})"
    out = {
        "text_length": i(size),
        "word_count": i(n_words),
        "avg_word_length": share(letters, n_words),
        "sentence_count": n_matches(drop(t, v.PLAIN_URL), v.SENTENCE_END),
        "uppercase_ratio": share(f"length({drop(t, '[^' + chr(92) + 'p{Lu}]')})", size),
        "digit_ratio": share(f"length({drop(t, f'[^{chr(92)}p{{Nd}}{ODD_DIGITS}]')})", size),
        "special_char_ratio": share(f"length({drop(t, '[^[:punct:]]')})", size),
        "exclamation_count": n_times(t, ["!"]),
        "question_count": n_times(t, ["?"]),
        "excessive_punctuation": i(f"{n_times(t, ['!'])} > 3 OR {has(t, '!!')}"),
        "urgent_keyword_count": n_present(low, v.URGENT_KEYWORDS),
        "financial_keyword_count": n_present(low, v.FINANCIAL_KEYWORDS),
        "threat_keyword_count": n_present(low, v.THREAT_KEYWORDS),
        "has_click_here": i(has(low, "click here")),
        "has_verify_account": i(f"{has(low, 'verify')} AND {has(low, 'account')}"),
        "has_act_now": i(has(low, "act now", "act immediately")),
        "has_limited_time": i(has(low, "limited time")),
        "has_congratulations": i(has(low, "congratulations")),
        "requests_password": i(has(low, "password")),
        "requests_ssn": i(has(low, "social security", "ssn")),
        "requests_credit_card": i(has(low, "credit card")),
        "requests_bank_info": i(has(low, "bank account", "routing number", "account number")),
        "generic_greeting": i(has(low, *v.GENERIC_GREETINGS)),
        "misspelling_count": n_present(low, v.MISSPELLINGS),
        "contains_currency": i(finds(t, v.CURRENCY)),
        "large_sum_mentioned": i(finds(t, v.LARGE_SUM)),
        "html_tags_present": i(finds(t, v.HTML_TAG)),
        "url_count_in_text": n_matches(t, v.PLAIN_URL),
        "suspicious_phrase_count": n_present(low, v.SUSPICIOUS_PHRASES),
        "urgency_word_count": n_times(low, v.URGENCY_WORDS),
        "contains_threat": i(has(low, *v.THREAT_WORDS)),
        "contains_reward": i(has(low, *v.REWARD_WORDS)),
    }
    return {n: out[n] for n in v.TEXT_FEATURES}


def listed(exprs: dict[str, str]) -> str:
    return ",\n  ".join(f"{e} AS {n}" for n, e in exprs.items())


def with_lower(sql: str, text: str) -> str:
    return f"SELECT *, lower({text}) AS low FROM ({sql})"


TEXT_EXPRS = text_exprs("body", "low")
ORACLES["text_features"] = (
    f"SELECT doc_id, {listed(TEXT_EXPRS)} FROM ({with_lower(MAIL_ORACLE, 'body')})"
)
DOC_TEXT = text_exprs("text", "low")
ORACLES["streamed_text_features"] = (
    f"SELECT doc_id, {listed(DOC_TEXT)} FROM ({with_lower('SELECT * FROM documents', 'text')})")
_profile = {n: DOC_TEXT[n] for n in (
    "word_count", "uppercase_ratio", "contains_currency", "urgency_word_count")}
ORACLES["text_profile"] = f"""
SELECT source, count(*) AS docs, round(avg(word_count), 6) AS avg_words,
  round(avg(uppercase_ratio), 6) AS avg_upper,
  CAST(sum(contains_currency) AS BIGINT) AS with_currency,
  CAST(sum(urgency_word_count) AS BIGINT) AS urgency_words
FROM (SELECT source, {listed(_profile)} FROM ({with_lower('SELECT * FROM documents', 'text')}))
GROUP BY source"""


def preprocessed(sql: str, extra: str) -> str:
    """Cleaned text and counts of ``raw_body``."""
    return f"""
SELECT {extra}, clean AS text, {i('length(clean)')} AS text_length,
  {i('len(urls)')} AS url_count, {n_times('clean', v.PREPROCESS_URGENCY_WORDS)} AS urgency_score,
  len(list_filter(urls, lambda u: {finds('u', v.ANY_IPV4)})) > 0 AS has_ip_url,
  sender, CAST(label AS INTEGER) AS label
FROM (SELECT *, {strip(f"lower({drop('raw_body', v.HTML_TAG, ' ')})")} AS clean,
        regexp_extract_all(raw_body, {q(v.CORPUS_URL)}) AS urls FROM ({sql}))"""


ORACLES["preprocess"] = preprocessed(
    f"SELECT doc_id, body AS raw_body, concat(source, '@', lang) AS sender, label "
    f"FROM ({MAIL_ORACLE})", "doc_id")

# --- URLs ------------------------------------------------------------------------------------
_KNOWN = " OR ".join(
    f"p.netloc = {q(g)} OR ends_with(p.netloc, {q('.' + g)})" for g in v.GOOD_DOMAINS)
_DOTS = n_times("p.netloc", ["."])
_URL_FACTS = {
    "domain_length": i("length(p.netloc)"),
    "domain_has_ip": i(finds("p.netloc", v.FULL_IPV4)),
    "domain_has_hyphen": i(has("p.netloc", "-")),
    "domain_has_at_symbol": i(has("p.url", "@")),
    "domain_dots_count": _DOTS,
    "excessive_subdomains": i(f"{_DOTS} > 3"),
    "domain_has_suspicious_tld": i(ends("p.netloc", *v.RISKY_TLDS)),
    "domain_length_suspicious": i("length(p.netloc) > 30"),
    "possible_brand_spoofing": i(f"{has('p.netloc', *v.BRAND_WORDS)} AND NOT ({_KNOWN})"),
    "path_length": i("length(p.path)"),
    "path_has_suspicious_keywords": i(has("lower(p.path)", *v.PATH_WORDS)),
    "url_has_encoding": i(has("p.url", "%")),
    "url_has_redirection": i("contains(string_split(p.url, '://')[2], '//')"),
    "has_query_params": i("p.query <> ''"),
    "query_param_count": i("CASE WHEN p.query = '' THEN 0 ELSE len(string_split(p.query, '&')) END"),
    "suspicious_param_count": n_present("lower(p.query)", v.PARAM_WORDS),
    "uses_non_standard_port": i(
        "coalesce(TRY_CAST(p.port AS BIGINT) BETWEEN 0 AND 65535 "
        "AND TRY_CAST(p.port AS BIGINT) NOT IN (80, 443), false)"),
    "is_shortened_url": i(has("p.netloc", *v.SHORTENERS)),
    "uses_https": i("starts_with(p.url, 'https://')"),
}
_PATH = drop("regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1)", ";[^/]*$")


def url_parts(text: str) -> str:
    """Split URLs; the port is what follows the first colon behind the last '@', if digits."""
    urls = f"regexp_extract_all({text}, {q(v.FEATURE_URL)})"
    netloc = "regexp_extract(u, '^https?://([^/?#]*)', 1)"
    host = f"list_last(string_split({netloc}, '@'))"
    port = f"regexp_extract({host}, '^[^:]*:([0-9]+)$', 1)"
    return (
        f"list_transform({urls}, lambda u: {{'url': u, 'netloc': lower({netloc}), "
        f"'path': {_PATH}, 'query': regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), 'port': {port}}})"
    )


def url_facts(parts: str) -> str:
    fields = ", ".join(f"'{n}': {e}" for n, e in _URL_FACTS.items())
    return f"list_transform({parts}, lambda p: {{{fields}}})"


# --- look-alike locations ----------------------------------------------------------------------
# Own statement of the rule: twice the characters in common blocks over all characters, above
# 0.8. The longest common block comes first (the leftmost one in the location, then in the domain);
# what stands left of it and right of it is matched in the same way.
_KNOWN_SITES = (
    "google.com", "microsoft.com", "apple.com", "amazon.com", "facebook.com", "linkedin.com",
    "twitter.com", "instagram.com",
)


def look_alikes(sql: str) -> str:
    """CTEs ``src`` (``sql`` with ``parts``) and ``alike(h)``, the locations close to a known site."""
    block = (
        "list_max(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda s: "
        "list_transform(range(1, length(a) - s + 2), lambda n: "
        "{'k': CASE WHEN contains(b, substr(a, s, n)) THEN n ELSE 0 END, 's': 0 - s}))), lambda x: x.k > 0))"
    )
    sites = ", ".join(f"({q(site)})" for site in _KNOWN_SITES)
    return f"""
RECURSIVE src AS ({sql}),
pairs AS (
  SELECT h, g FROM (SELECT DISTINCT unnest(list_transform(parts, lambda p: p.netloc)) AS h FROM src),
    (VALUES {sites}) known(g)
  WHERE h <> '' AND h <> g
    AND 2.0 * least(length(h), length(g)) / (length(h) + length(g))::DOUBLE > 0.8),
todo(h, g, a, b) AS (
  SELECT h, g, h, g FROM pairs
  UNION ALL
  SELECT h, g, side.a, side.b FROM (
    SELECT h, g, unnest([
      {{'a': substr(a, 1, place - 1), 'b': substr(b, 1, strpos(b, substr(a, place, size)) - 1)}},
      {{'a': substr(a, place + size), 'b': substr(b, strpos(b, substr(a, place, size)) + size)}}]) AS side
    FROM (SELECT h, g, a, b, 0 - best.s AS place, best.k AS size
          FROM (SELECT h, g, a, b, {block} AS best FROM todo) WHERE best IS NOT NULL))
  WHERE side.a <> '' AND side.b <> ''),
common AS (
  SELECT h, g, sum(coalesce(best.k, 0)) AS n
  FROM (SELECT h, g, {block} AS best FROM todo) GROUP BY h, g),
alike AS (
  SELECT DISTINCT h FROM common
  WHERE 2.0 * n / (length(h) + length(g))::DOUBLE > 0.8)"""


LOOKS_ALIKE = i(
    "list_has_any(list_transform(parts, lambda p: p.netloc), "
    "coalesce((SELECT list(h) FROM alike), []))"
)


def url_exprs(facts: str) -> dict[str, str]:
    out = {
        "url_count": i(f"len({facts})"),
        "has_urls": i(f"len({facts}) > 0"),
        "excessive_urls": i(f"len({facts}) > 5"),
    }
    for name in _URL_FACTS:
        pick = "list_min" if name == "uses_https" else "list_max"
        out[name] = f"coalesce({pick}(list_transform({facts}, lambda f: f.{name})), 0)"
    return {n: out[n] for n in v.URL_FEATURES if n in out}


def url_table(sql: str, text: str, keep: str, alike: bool = True, more: dict | None = None) -> str:
    """``keep``, the URL features and ``more`` columns over ``sql``."""
    exprs = url_exprs("facts") | ({"potential_typosquatting": LOOKS_ALIKE} if alike else {})
    parts = f"SELECT *, {url_parts(text)} AS parts FROM ({sql})"
    source = f"WITH {look_alikes(parts)}" if alike else f"WITH src AS ({parts})"
    return f"""{source}
SELECT {keep}, {listed(exprs | (more or {}))}
FROM (SELECT *, {url_facts('parts')} AS facts FROM src)"""


ORACLES["url_features"] = url_table(MAIL_ORACLE, "body", "doc_id", alike=False)
_ids = "SELECT doc_id AS id, body FROM ({mail}) UNION ALL SELECT -page_id - 1, url FROM pages"
ORACLES["typosquatting"] = (
    f"SELECT id, url_count, potential_typosquatting FROM "
    f"({url_table(_ids.format(mail=MAIL_ORACLE), 'body', 'id')})")
ORACLES["page_url_features"] = url_table(
    "SELECT page_id AS url_id, url FROM pages", "url", "url_id")
ORACLES["text_url_features_55"] = url_table(
    with_lower(MAIL_ORACLE, "body"), "body", "doc_id AS row_id, label", more=TEXT_EXPRS)

# --- headers ---------------------------------------------------------------------------------
_ALL_LINES = "string_split(header_text, concat(chr(13), chr(10)))"


def hdr(name: str) -> str:
    return (
        f"coalesce(substr(list_filter(lines, lambda h: starts_with(lower(h), {q(name + ': ')}))[1],"
        f" {len(name) + 3}), '')"
    )


def dom(value: str) -> str:
    return f"regexp_extract({value}, '[\\w.\\-]+@([\\w.\\-]+\\.\\w+)', 1)"


def mismatch(value: str) -> str:
    return i(f"{value} <> '' AND {dom(value)} <> sender")


_RECEIVED = "list_filter(lines, lambda h: starts_with(lower(h), 'received: '))"
_HEADER_EXPRS = {
    "sender_domain_length": i("length(sender)"),
    "sender_has_subdomain": i(f"{n_times('sender', ['.'])} > 1"),
    "sender_has_digits": i(finds("sender", r"\p{Nd}")),
    "sender_has_hyphen": i(has("sender", "-")),
    "reply_to_mismatch": mismatch("reply_to"),
    "has_reply_to": i("reply_to <> ''"),
    "return_path_mismatch": mismatch("return_path"),
    "spf_pass": i("contains(spf, 'pass') AND NOT contains(spf, 'fail')"),
    "spf_fail": i("contains(spf, 'fail') AND NOT contains(spf, 'softfail')"),
    "spf_softfail": i("contains(spf, 'softfail')"),
    "spf_none": i("spf = '' OR contains(spf, 'none')"),
    "dkim_pass": i(has("auth", "dkim=pass")),
    "dkim_fail": i(has("auth", "dkim=fail")),
    "dkim_none": i("contains(auth, 'dkim=none') OR NOT contains(auth, 'dkim')"),
    "dmarc_pass": i(has("auth", "dmarc=pass")),
    "dmarc_fail": i(has("auth", "dmarc=fail")),
    "dmarc_none": i("contains(auth, 'dmarc=none') OR NOT contains(auth, 'dmarc')"),
    "num_received_headers": i(f"len({_RECEIVED})"),
    "excessive_received_headers": i(f"len({_RECEIVED}) > 10"),
    "suspicious_ip_count": i(
        f"len(list_filter({_RECEIVED}, lambda h: {finds('h', v.PRIVATE_IP)}))"),
    "subject_length": i("length(subject)"),
    "subject_has_re": i("starts_with(lower(subject), 're:')"),
    "subject_has_fwd": i("starts_with(lower(subject), 'fwd:')"),
    "subject_all_caps": i(
        "regexp_matches(subject, '[A-Z]') AND NOT regexp_matches(subject, '[a-z]') "
        "AND length(subject) > 5"),
    "subject_excessive_punctuation": i(f"{n_times('subject', ['!', '?'])} > 3"),
    "subject_urgent_keywords": n_present("lower(subject)", v.URGENT_KEYWORDS),
    "message_id_domain_mismatch": mismatch("message_id"),
    "has_message_id": i("message_id <> ''"),
    "num_x_headers": i("len(list_filter(lines, lambda h: starts_with(h, 'X-')))"),
    "has_x_mailer": i("len(list_filter(lines, lambda h: starts_with(h, 'X-Mailer:'))) > 0"),
    "has_x_originating_ip": i(
        "len(list_filter(lines, lambda h: starts_with(h, 'X-Originating-IP:'))) > 0"),
    "has_date": i(f"{hdr('date')} <> ''"),
    "has_mime_version": i(f"{hdr('mime-version')} <> ''"),
    "mime_version_1_0": i(f"{hdr('mime-version')} = '1.0'"),
    "is_multipart": i("doc_id % 9 = 7"),
    "is_html": i("doc_id % 9 = 4"),
    "high_priority": i(
        f"contains({hdr('x-priority')}, '1') OR contains(lower({hdr('x-priority')}), 'high') "
        f"OR contains(lower({hdr('importance')}), 'high')"),
}
_HEADER_EXPRS = {n: _HEADER_EXPRS[n] for n in v.HEADER_FEATURES}
HEADERS = f"""
SELECT *, {dom(hdr('from'))} AS sender, {hdr('reply-to')} AS reply_to,
  {hdr('return-path')} AS return_path, lower({hdr('received-spf')}) AS spf,
  lower({hdr('authentication-results')}) AS auth, {hdr('subject')} AS subject,
  {hdr('message-id')} AS message_id
FROM (SELECT *, {_ALL_LINES} AS lines FROM ({RAW_ORACLE}))"""
ORACLES["mail_header_features"] = (
    f"SELECT doc_id AS msg_id, label, {listed(_HEADER_EXPRS)} FROM ({HEADERS})")

# Body of a derived mail: tags go only where the mail is HTML alone.
_NO_TAGS = drop("body", v.HTML_TAG, " ")
STRICT_BODY = f"CASE WHEN doc_id % 9 = 4 THEN {_NO_TAGS} ELSE body END"
_PARSED = f"SELECT * REPLACE ({STRICT_BODY} AS body) FROM ({HEADERS})"
ORACLES["flat_features_92"] = url_table(
    with_lower(_PARSED, "body"), "body", "doc_id AS msg_id, label",
    more=TEXT_EXPRS | _HEADER_EXPRS)
ORACLES["nested_feature_groups"] = url_table(
    with_lower(_PARSED, "body"), "body", "doc_id AS msg_id", more=TEXT_EXPRS | _HEADER_EXPRS)
# A mail that is not multipart keeps its tags in the explained and batch forms.
ORACLES["body_choice"] = f"""
SELECT doc_id AS msg_id, {STRICT_BODY} AS strict, {STRICT_BODY} AS corpus,
  {strip('body')} AS explained, body AS batch FROM ({RAW_ORACLE})"""
ORACLES["scoring_texts"] = f"""
SELECT doc_id AS msg_id, concat(subject, chr(10), chr(10), {strip('body')}) AS explained_text,
  {strip("concat('Subject: ', subject, chr(10), chr(10), body)")} AS batch_text
FROM ({HEADERS})"""
ORACLES["preprocess_raw"] = preprocessed(
    f"SELECT doc_id AS msg_id, label, {STRICT_BODY} AS raw_body, {hdr('from')} AS sender "
    f"FROM ({HEADERS})", "msg_id")
ORACLES["html_strip"] = (
    f"SELECT page_id, {strip(drop('html', v.HTML_TAG, ' '))} AS text FROM pages")
ORACLES["mail_body_corpus"] = (
    f"SELECT doc_id AS msg_id, {STRICT_BODY} AS text, label, source FROM ({RAW_ORACLE})")

# --- sources ---------------------------------------------------------------------------------
ORACLES["ham_envelope"] = f"""
SELECT doc_id, concat('From: ', CASE WHEN doc_id % 3 <> 0 THEN source ELSE {q(v.HAM_SENDER)} END,
  chr(13), chr(10), 'Subject: ', CASE WHEN doc_id % 4 <> 0 THEN lang ELSE '' END, chr(13), chr(10),
  'Date: {v.HAM_DATE}', chr(13), chr(10), 'Message-ID: {v.HAM_MESSAGE_ID}', chr(13), chr(10),
  chr(13), chr(10), text) AS raw_bytes, 0 AS label
FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 10 >= 3"""
ORACLES["ranked_domains"] = """
SELECT concat('https://', regexp_extract(url, '^https?://([^/?#]*)', 1), '/') AS url_text,
  0 AS label
FROM pages WHERE page_id % 11 <> 0"""
ORACLES["phishing_urls"] = "SELECT url AS url_text, 1 AS label FROM pages WHERE page_id % 13 <> 0"
# The caps count rows (or ranks) before null URLs go; ham is capped by its key.
ORACLES["capped_corpora"] = """
SELECT 'urls' AS kind, url AS text FROM pages WHERE page_id < 100 AND page_id % 13 <> 0
UNION ALL
SELECT 'domains', concat('https://', regexp_extract(url, '^https?://([^/?#]*)', 1), '/')
FROM pages WHERE page_id < 100 AND page_id % 11 <> 0
UNION ALL
(SELECT 'ham', text FROM documents WHERE doc_id % 10 >= 3 ORDER BY doc_id LIMIT 100)"""
_page_domain = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
ORACLES["csv_corpora"] = f"""
SELECT 'phishing' AS kind, url AS text, 1 AS label, count(*) AS n FROM pages GROUP BY url
UNION ALL
SELECT 'ranked', concat('https://', {_page_domain}, '/'), 0, count(*) FROM pages GROUP BY 2
UNION ALL
SELECT 'labelled', text, CASE WHEN doc_id % 10 < 3 THEN 1 ELSE 0 END, count(*) FROM documents
GROUP BY 2, 3"""
ORACLES["split_corpora"] = """
SELECT 'train' AS part, doc_id, lang FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT 'all', doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END FROM documents"""
ORACLES["mail_corpus"] = f"""
SELECT label, source, count(*) AS n, CAST(sum(copies) AS BIGINT) AS mails, max(number) AS most
FROM (
  SELECT 1 AS label, {q(v.SOURCE_MBOX)} AS source, doc_id AS mail, 1 AS copies, 1 AS number
  FROM documents, (VALUES ('a'), ('b')) box WHERE doc_id % 4 <> 0
  UNION ALL
  SELECT 0, {q(v.SOURCE_HAM)}, min(doc_id), count(*), count(*) FROM documents
  WHERE doc_id % 10 >= 3 GROUP BY text)
GROUP BY label, source"""
ORACLES["preprocess_mbox"] = preprocessed(
    f"""SELECT CASE doc_id % 9 WHEN 7 THEN body ELSE concat({STRICT_BODY}, chr(10)) END AS raw_body,
    {hdr('from')} AS sender, CAST(NULL AS INTEGER) AS label
    FROM (SELECT * REPLACE (regexp_replace(body, '(^|\n)From ', '\\1>From ', 'g') AS body)
          FROM ({HEADERS}))""", "sender AS mail").replace("sender, CAST(label", "sender, CAST(label")
ORACLES["default_rows"] = url_table(
    with_lower("""SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN concat(' ', chr(10)) WHEN 2 THEN coalesce(text, '') ELSE '' END AS body
                  FROM documents""", "body"), "body", "doc_id", more=TEXT_EXPRS)
_ZEROS = ", ".join(f"CASE WHEN msg_id % 4 < 2 THEN 0 ELSE {n} END AS {n}" for n in _HEADER_EXPRS)
ORACLES["default_headers"] = f"SELECT msg_id, {_ZEROS} FROM ({ORACLES['mail_header_features']})"
ORACLES["text_column_choice"] = """
SELECT doc_id, ['text', 'body', 'email_body', 'content', 'email', 'Email Text'][doc_id % 6 + 1] AS chosen, text FROM documents"""


def url_corpus(sql: str, body: str, extra: str = "") -> str:
    return f"""
SELECT url_text, CAST(label AS INTEGER) AS label, source, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all({body}, {q(v.CORPUS_URL)})) AS url_text, label,
    concat('eml_', source) AS source FROM ({sql}) {extra})
GROUP BY ALL"""


ORACLES["mail_url_corpus"] = url_corpus(
    MAIL_ORACLE, "body",
    f"UNION ALL SELECT url, 0, {q(v.SOURCE_RANKED_DOMAINS)} FROM pages")
ORACLES["parsed_url_corpus"] = url_corpus(RAW_ORACLE, STRICT_BODY)

# --- labels, JSON, filters -------------------------------------------------------------------
ORACLES["label_harmonise"] = (
    "SELECT doc_id, CAST(doc_id % 4 = 1 AS INTEGER) AS label FROM documents")
ORACLES["label_by_word"] = ORACLES["label_harmonise"]
ORACLES["normalised_corpus"] = f"""
SELECT text, CAST(doc_id % 4 = 1 AS INTEGER) AS label, count(*) AS n FROM documents
WHERE doc_id % 17 <> 0 AND {finds('text', f'[^{v.SPACE}]')} GROUP BY ALL"""
ORACLES["json_flatten"] = """
SELECT event_id, concat(chr(10), 'k: ', json_extract_string(props, '$.k')) AS text FROM events"""
ORACLES["json_flatten_mail"] = """
SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 7 = 0 THEN text ELSE
  concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Subject: ', lang, chr(10)) END,
    'From: ', source, chr(10), 'To: team@example.com', chr(10), chr(10),
    CASE WHEN doc_id % 5 = 0 THEN concat('note: ', text) ELSE text END) END AS text
FROM documents"""
ORACLES["year_filter"] = """
SELECT doc_id AS msg_id, CAST(CASE doc_id % 4 WHEN 1 THEN 2022 WHEN 3 THEN 2023 END AS INTEGER)
  AS date_year
FROM documents WHERE doc_id % 4 <> 0"""
# A text or HTML body written to an mbox ends with the line end that separates the messages.
ORACLES["mbox_messages"] = f"""
SELECT doc_id, 1 AS label,
  CAST(CASE doc_id % 4 WHEN 1 THEN 2022 WHEN 3 THEN 2023 END AS INTEGER) AS date_year, subject,
  CASE doc_id % 9 WHEN 7 THEN body ELSE concat({STRICT_BODY}, chr(10)) END AS body
FROM (SELECT * REPLACE (regexp_replace(body, '(^|\n)From ', '\\1>From ', 'g') AS body)
      FROM ({HEADERS})) WHERE doc_id % 4 <> 0"""
ORACLES["year_of_date_header"] = """
SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 2001 WHEN 1 THEN 2022 WHEN 3 THEN 2023 END
  AS INTEGER) AS year
FROM documents"""
ORACLES["short_and_class_filter"] = """
SELECT conv_id, turn, text, 0 AS label FROM conversations
WHERE role = 'user' AND length(text) > 10"""

# --- set operations --------------------------------------------------------------------------
_TEXTS = """SELECT doc_id AS row_id, text,
  CASE WHEN doc_id % 10 < 3 THEN 1 ELSE 0 END AS label, source FROM documents"""
_UNION = f"""
SELECT row_id, text, label, source, 0 AS priority FROM ({_TEXTS})
UNION ALL SELECT item_id, text, 0, 'benchmark', 1 FROM benchmark
UNION ALL SELECT conv_id * 1000 + turn, text, 0, 'conversations', 2 FROM conversations"""
ORACLES["union_clean"] = f"""
SELECT * FROM ({_UNION}) WHERE length(text) > 10 AND {finds('text', f'[^{v.SPACE}]')}"""
ORACLES["dedup_keep_first"] = f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY text ORDER BY priority, row_id) AS rn FROM ({_UNION}) WHERE length(text) > 10)
WHERE rn = 1"""
ORACLES["dedup_counts"] = f"""
SELECT count(*) AS before, count(DISTINCT text) AS after,
  count(*) - count(DISTINCT text) AS removed FROM ({_UNION})"""

# --- profiles --------------------------------------------------------------------------------
ORACLES["class_distribution"] = f"""
SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 4)
  AS percent FROM ({_TEXTS}) GROUP BY label"""
ORACLES["source_counts"] = f"SELECT source, count(*) AS n FROM ({_UNION}) GROUP BY source"
ORACLES["corpus_summary"] = f"""
SELECT coalesce(source, 'ALL') AS source, count(*) FILTER (label = 1) AS phishing,
  count(*) FILTER (label = 0) AS legitimate, count(*) AS total
FROM ({_UNION}) GROUP BY ROLLUP (source)"""
ORACLES["text_length_profile"] = """
SELECT round(avg(length(text)), 6) AS mean_chars, quantile_cont(length(text), 0.5) AS median_chars,
  CAST(max(length(text)) AS INTEGER) AS max_chars FROM documents"""
_columns = ("doc_id", "text", "lang", "source", "n_chars")
ORACLES["low_card_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM documents "
    f"WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) FROM documents) < 5 GROUP BY {c}"
    for c in _columns)
ORACLES["balance_ratio"] = f"""
SELECT round(count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1), 3)
  AS balance_ratio FROM ({_TEXTS})"""
ORACLES["class_weights"] = f"""
SELECT row_id, label, round(CAST((SELECT count(*) FROM documents) AS DOUBLE)
  / (2 * count(*) OVER (PARTITION BY label)), 9) AS weight FROM ({_TEXTS})"""

# --- sampling --------------------------------------------------------------------------------
_RANKED = f"""
SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', row_id))) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM ({_TEXTS})"""
ORACLES["class_ratio_sample"] = f"""
SELECT row_id, text, label, source FROM ({_RANKED})
WHERE rn <= CASE WHEN label = 0 THEN 280 ELSE 120 END"""
ORACLES["class_ratio_sample_short"] = f"""
SELECT row_id, label, source FROM ({_RANKED})
WHERE rn <= CASE WHEN label = 0 THEN 14000 ELSE 6000 END"""
ORACLES["seeded_shuffle"] = f"""
SELECT row_id, label, md5(concat('42|', row_id)) AS order_hash FROM ({_TEXTS}) ORDER BY 3"""
ORACLES["stratified_split"] = f"""
WITH c AS (SELECT label, count(*) AS n FROM ({_TEXTS}) GROUP BY label),
t AS (SELECT label, n, ceil(sum(n) OVER () * 0.3::DOUBLE) AS test,
  n * ceil(sum(n) OVER () * 0.3::DOUBLE) / sum(n) OVER () AS exact FROM c),
r AS (SELECT label, floor(exact) AS base, test - sum(floor(exact)) OVER () AS missing,
  row_number() OVER (ORDER BY exact - floor(exact) DESC, label) AS place FROM t)
SELECT row_id, x.label,
  CAST(rn <= base + CASE WHEN place <= missing THEN 1 ELSE 0 END AS INTEGER) AS is_test
FROM ({_RANKED}) x JOIN r ON r.label = x.label"""
ORACLES["stratified_folds"] = f"""
SELECT row_id, label, CAST(ntile(5) OVER (
  PARTITION BY label ORDER BY md5(concat('42|', row_id))) - 1 AS INTEGER) AS fold
FROM ({_TEXTS})"""

# --- evaluation ------------------------------------------------------------------------------
def cells(sql: str) -> str:
    return f"""
SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM ({sql})"""


_CELLS = cells(SCORE_ORACLE)
ORACLES["confusion"] = _CELLS


def auc(sql: str) -> str:
    """Mean rank of the positives among all scores, ties at their middle."""
    return f"""
(SELECT (sum(place) FILTER (label = 1) - count(*) FILTER (label = 1)
    * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
   / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))
 FROM (SELECT label, rank() OVER (ORDER BY score)
     + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS place
   FROM ({sql}) WHERE label IN (0, 1)))"""


_AUC = auc(SCORE_ORACLE)


def rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part}) / ({whole}) ELSE 0.0 END"


ORACLES["roc_auc"] = f"SELECT round({_AUC}, 6) AS roc_auc"


def twelve(sql: str) -> str:
    """The twelve metrics of ``label, prediction, score`` rows."""
    return f"""
SELECT round({rate('tp + tn', '(tp + tn + fp + fn)')}, 6) AS accuracy,
  round({rate('tp', '(tp + fp)')}, 6) AS precision, round({rate('tp', '(tp + fn)')}, 6) AS recall,
  round({rate('2 * tp', '(2 * tp + fp + fn)')}, 6) AS f1_score,
  tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
  round({rate('fp', '(fp + tn)')}, 6) AS false_positive_rate,
  round({rate('fn', '(fn + tp)')}, 6) AS false_negative_rate,
  round({rate('tn', '(tn + fp)')}, 6) AS true_negative_rate,
  round({auc(sql)}, 6) AS roc_auc
FROM ({cells(sql)})"""


ORACLES["metrics"] = twelve(SCORE_ORACLE)
ORACLES["stored_metrics"] = ORACLES["metrics"]


def curve(sql: str, digits: int) -> str:
    return f"""
WITH s AS ({sql}),
g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
      FROM s GROUP BY score)
SELECT round(score, {digits}) AS threshold,
  round(sum(neg) OVER w / (SELECT sum(neg) FROM g), {digits}) AS fpr,
  round(sum(pos) OVER w / (SELECT sum(pos) FROM g), {digits}) AS tpr
FROM g WINDOW w AS (ORDER BY score DESC)"""


ORACLES["roc_curve"] = curve(SCORE_ORACLE, 6)
ORACLES["roc_curve_fine"] = curve(
    "SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, value AS score FROM events",
    9)
ORACLES["classification_report"] = f"""
WITH c AS ({_CELLS}),
k AS (
  SELECT 'Legitimate' AS class, {rate('tn', '(tn + fn)')} AS p, {rate('tn', '(tn + fp)')} AS r,
    {rate('2 * tn', '(2 * tn + fn + fp)')} AS f, tn + fp AS s FROM c
  UNION ALL SELECT 'Phishing', {rate('tp', '(tp + fp)')}, {rate('tp', '(tp + fn)')},
    {rate('2 * tp', '(2 * tp + fp + fn)')}, tp + fn FROM c),
a AS (
  SELECT * FROM k
  UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM c
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM k
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s),
    sum(s) FROM k)
SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1_score,
  CAST(s AS BIGINT) AS support FROM a"""


# --- scoring ---------------------------------------------------------------------------------
def scores(factor: int = 37, where: str = "true") -> str:
    p1 = f"(CAST(doc_id * {factor} % 101 AS DOUBLE) / 101)"
    return f"SELECT doc_id AS msg_id, 1 - {p1} AS p0, {p1} AS p1 FROM documents WHERE {where}"


ORACLES["verdicts"] = f"""
SELECT msg_id, CASE WHEN p1 > p0 THEN 'Phishing' ELSE 'Legitimate' END AS verdict,
  round(greatest(p0, p1), 6) AS confidence, round(p1, 6) AS phishing_probability,
  round(p0, 6) AS legitimate_probability FROM ({scores()})"""
ORACLES["mail_verdicts"] = f"""
SELECT msg_id, round(p0, 6) AS p0, round(p1, 6) AS p1,
  CASE WHEN p1 > p0 THEN 'PHISHING' ELSE 'SAFE' END AS label_text,
  round(greatest(p0, p1), 6) AS confidence FROM ({scores()})"""
ORACLES["threshold_verdicts"] = f"""
SELECT msg_id, round(p0, 6) AS p0, round(p1, 6) AS p1,
  CASE WHEN p1 > 0.5 THEN 'PHISHING' ELSE 'SAFE' END AS verdict FROM ({scores()})"""
ORACLES["fusion"] = f"""
SELECT msg_id, round(p, 6) AS p1, round(1 - p, 6) AS p0, round(t, 6) AS p_text,
  round(u, 6) AS p_url, round(h, 6) AS p_header,
  CASE WHEN p > 0.5 THEN 'Phishing' WHEN p IS NOT NULL THEN 'Legitimate' END AS verdict
FROM (SELECT *, (2 * coalesce(t, 0) + coalesce(u, 0) + coalesce(h, 0)) / nullif(
    CASE WHEN t IS NULL THEN 0 ELSE 2 END + CASE WHEN u IS NULL THEN 0 ELSE 1 END
    + CASE WHEN h IS NULL THEN 0 ELSE 1 END, 0) AS p
  FROM (SELECT t.msg_id, CASE WHEN t.msg_id % 35 <> 0 THEN t.p1 END AS t,
      CASE WHEN t.msg_id % 7 <> 0 THEN u.p1 END AS u, h.p1 AS h
    FROM ({scores(37)}) t JOIN ({scores(53)}) u USING (msg_id)
    LEFT JOIN ({scores(71, 'doc_id % 5 <> 0')}) h USING (msg_id)))"""


def percent(p: str) -> str:
    return f"format('{{:.2f}}%', {p} * 100)"


def top(sign: str) -> str:
    return f"CASE WHEN p1 {sign} 0.5 THEN lang WHEN p1 = 0.5 THEN 'n/a' ELSE source END"


ORACLES["batch_table"] = f"""
SELECT concat(msg_id, '.eml') AS "File",
  CASE msg_id % 9 WHEN 4 THEN '(parse error: ValueError)'
    WHEN 5 THEN CASE WHEN body = '' THEN '(empty)' ELSE substr(body, 1, 80) END
    ELSE concat(substr(body, 1, 80), CASE WHEN length(body) > 80 THEN '...' ELSE '' END) END
    AS "Subject",
  CASE WHEN bad THEN 'ERROR' WHEN p1 > p0 THEN 'Phishing' ELSE 'Safe' END AS "Verdict",
  CASE WHEN bad THEN 'n/a' ELSE {percent('greatest(p0, p1)')} END AS "Confidence",
  CASE WHEN bad THEN 'n/a' ELSE {percent('p0')} END AS "P(Safe)",
  CASE WHEN bad THEN 'n/a' ELSE {percent('p1')} END AS "P(Phishing)",
  CASE WHEN msg_id % 9 = 4 THEN 'bad boundary' WHEN bad THEN '(empty body)' ELSE {top('>')} END
    AS "Top phishing tokens",
  CASE WHEN bad THEN 'n/a' ELSE {top('<')} END AS "Top safe tokens"
FROM (SELECT s.*, d.lang, d.source, d.text AS body,
    s.msg_id % 9 = 4 OR s.msg_id % 9 = 5 OR length(d.text) < 5 AS bad
  FROM ({scores()}) s JOIN documents d ON d.doc_id = s.msg_id)"""
ORACLES["batch_summary"] = f"""
SELECT k.verdict, count(b."Verdict") AS n,
  format('{{:.0f}}', count(b."Verdict") * 100.0::DOUBLE / (SELECT count(*) FROM documents))
    AS percent
FROM (VALUES ('Phishing'), ('Safe'), ('ERROR')) k(verdict)
LEFT JOIN ({ORACLES['batch_table']}) b ON b."Verdict" = k.verdict GROUP BY k.verdict"""
ORACLES["token_details"] = f"""
SELECT msg_id, concat('  ', rpad(CAST(msg_id AS VARCHAR), 25, ' '), '  →  ',
  format('{{:+.4f}}', p1 - 0.5), '  (', CASE WHEN p1 > 0.5 THEN 'phishing' ELSE 'safe' END, ')')
  AS detail FROM ({scores()})"""
_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}]+"
ORACLES["truncated_tokens"] = f"""
SELECT doc_id, {i('len(w)')} AS n_words, array_to_string(w[1:{v.TRAIN_TOKENS}], ' ') AS read
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), {q(_WORD)}),
  lambda x: x <> '') AS w FROM documents)"""


def scaled(name: str) -> str:
    return (
        f"CASE WHEN stddev_pop({name}) OVER () > 0 THEN round(({name} - avg({name}) OVER ()) "
        f"/ stddev_pop({name}) OVER (), 6) ELSE 0.0 END AS {name}"
    )


_scaled = ("text_length", "word_count", "digit_ratio", "requests_ssn")
ORACLES["standard_scale"] = f"""
SELECT doc_id, {', '.join(scaled(n) for n in _scaled)}
FROM (SELECT doc_id, {listed({n: DOC_TEXT[n] for n in _scaled})}
      FROM ({with_lower('SELECT * FROM documents', 'text')}))"""
ORACLES["aligned_features"] = f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text_length ELSE 0 END AS text_length,
  0 AS url_count, word_count
FROM (SELECT doc_id, {listed({n: DOC_TEXT[n] for n in ('text_length', 'word_count')})}
      FROM ({with_lower('SELECT * FROM documents', 'text')}))"""


# --- stored tables and models ----------------------------------------------------------------
ORACLES["stored_batch"] = ORACLES["batch_table"]
ORACLES["stored_explanations"] = f"""
SELECT concat(doc_id, '.eml') AS file, source AS subject,
  CASE WHEN p1 > 0.5 THEN 'PHISHING' ELSE 'SAFE' END AS prediction,
  round(greatest(p0, p1), 6) AS confidence, round(p0, 6) AS p_safe, round(p1, 6) AS p_phishing,
  lang AS token, round(p1, 6) AS weight
FROM ({scores()}) s JOIN documents d ON d.doc_id = s.msg_id"""


def held_out(rows: str, share: float = 0.3) -> str:
    """The share of ``id, label, rule`` rows that the split holds out, in md5 order per class."""
    return f"""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', id))) AS rn
           FROM ({rows})),
c AS (SELECT label, count(*) AS n FROM x GROUP BY label),
t AS (SELECT label, ceil(sum(n) OVER () * {share}::DOUBLE) AS test,
  n * ceil(sum(n) OVER () * {share}::DOUBLE) / sum(n) OVER () AS exact FROM c),
r AS (SELECT label, floor(exact) + CASE WHEN row_number() OVER (
    ORDER BY exact - floor(exact) DESC, label) <= test - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS size
  FROM t)
SELECT id, x.label, rule FROM x JOIN r ON r.label = x.label WHERE rn <= size"""


# What the headers show: a result of the sender check other than the ones legitimate mail has.
_MAIL_RULE = """SELECT doc_id AS id, CAST(doc_id % 10 < 3 AS INTEGER) AS label,
  CASE WHEN contains(header_text, 'X-Mailer: m') THEN
    CASE WHEN contains(header_text, 'softfail') OR contains(header_text, 'SPF: fail') THEN 1 ELSE 0 END
  WHEN contains(header_text, 'SPF: Pass') THEN 1 ELSE 0 END AS rule FROM ({mail})"""
_HEADER_HELD = held_out(_MAIL_RULE.format(mail=MAIL_ORACLE))
ORACLES["header_forest_verdicts"] = (
    f"SELECT id AS msg_id, label, rule AS prediction FROM ({_HEADER_HELD})")
ORACLES["header_forest_metrics"] = twelve(
    f"SELECT label, rule AS prediction, rule AS score FROM ({_HEADER_HELD})")
# What the URLs show: an address of numbers, a user name, a risky ending or a look-alike.
_URL_RULE = """SELECT doc_id AS id, CAST(doc_id % 7 IN (0, 1, 5, 6) AS INTEGER) AS label,
  CAST(contains(body, '.tk/') OR contains(body, '//192.168.') OR contains(body, 'u:p@')
    OR contains(body, 'goggle.com') AS INTEGER) AS rule FROM ({mail})"""
_URL_HELD = held_out(_URL_RULE.format(mail=MAIL_ORACLE))
ORACLES["url_forest_verdicts"] = (
    f"SELECT id AS url_id, label, rule AS prediction FROM ({_URL_HELD})")
ORACLES["stored_agent"] = f"SELECT count(*) AS n, count(*) AS equal FROM ({_URL_HELD})"
# Every fold's forest finds the rule in the four other folds.
ORACLES["fold_verdicts"] = f"""
SELECT id AS url_id, label, CAST(ntile(5) OVER (
  PARTITION BY label ORDER BY md5(concat('42|', id))) - 1 AS INTEGER) AS fold, rule AS prediction
FROM ({_URL_RULE.format(mail=MAIL_ORACLE)})"""
# What the texts show: one of the four phishing lines.
_TEXT_RULE = """SELECT doc_id AS id, CAST(doc_id % 8 < 4 AS INTEGER) AS label,
  CAST(contains(body, 'URGENT! Verify your account') OR contains(body, 'you won a prize')
    OR contains(body, 'update your billing details') OR contains(body, 'Unauthorized access')
    AS INTEGER) AS rule FROM ({mail})"""
_TEXT_HELD = held_out(_TEXT_RULE.format(mail=MAIL_ORACLE), 0.2)
ORACLES["text_verdicts"] = f"SELECT id AS row_id, label, rule AS prediction FROM ({_TEXT_HELD})"
ORACLES["text_agent_metrics"] = twelve(
    f"SELECT label, rule AS prediction, rule AS score FROM ({_TEXT_HELD})")
