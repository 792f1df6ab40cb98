"""The 23 features of the URLs in a mail text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions import fixed_values as v
from mailprism.functions.similarity import any_look_alike, candidate
from mailprism.functions.strings import any_of, count_char, ends_with_any, flag, present

_PARTS, _FACTS = "__parts", "__facts"

ANY_FEATURES = (
    "domain_has_ip", "domain_has_hyphen", "domain_has_at_symbol", "excessive_subdomains",
    "domain_has_suspicious_tld", "domain_length_suspicious", "possible_brand_spoofing",
    "path_has_suspicious_keywords", "url_has_encoding", "url_has_redirection",
    "has_query_params", "uses_non_standard_port", "is_shortened_url",
)
MAX_FEATURES = (
    "domain_length", "domain_dots_count", "path_length", "query_param_count",
    "suspicious_param_count",
)


def extract_urls(text: Column, pattern: str = v.FEATURE_URL) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def split_url(url: Column) -> Column:
    """URL, lower-cased network location, path without the last segment's parameters, query."""
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.struct(
        url.alias("url"),
        F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1)).alias("netloc"),
        F.regexp_replace(path, r";[^/]*$", "").alias("path"),
        F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        # digits after the first colon behind the last '@', without leading zeros
        F.regexp_extract(url, r"^https?://(?:[^/?#]*@)?[^/?#:@]*(:[0-9]+)(?:[/?#]|$)", 1).alias(
            "port"
        ),
    )


def _odd_port(port: Column) -> Column:
    digits = F.regexp_replace(port, r"^:0*", "")
    number = F.when(F.length(digits) <= 5, F.coalesce(digits.try_cast("int"), F.lit(0)))
    return (port != "") & (number <= 65535) & ~number.isin(80, 443)


def url_facts(part: Column) -> Column:
    """Flags and counts of one split URL."""
    url, netloc, path, query = (part[f] for f in ("url", "netloc", "path", "query"))
    dots = count_char(netloc, ".")
    known = F.lit(False)
    for good in v.GOOD_DOMAINS:
        known = known | (netloc == good) | netloc.endswith("." + good)
    facts = {
        "domain_length": F.length(netloc),
        "domain_has_ip": flag(netloc.rlike(v.FULL_IPV4)),
        "domain_has_hyphen": flag(netloc.contains("-")),
        "domain_has_at_symbol": flag(url.contains("@")),
        "domain_dots_count": dots,
        "excessive_subdomains": flag(dots > 3),
        "domain_has_suspicious_tld": flag(ends_with_any(netloc, v.RISKY_TLDS)),
        "domain_length_suspicious": flag(F.length(netloc) > 30),
        "possible_brand_spoofing": flag(any_of(netloc, v.BRAND_WORDS) & ~known),
        "path_length": F.length(path),
        "path_has_suspicious_keywords": flag(any_of(F.lower(path), v.PATH_WORDS)),
        "url_has_encoding": flag(url.contains("%")),
        # only the piece between the first and the second '://' counts
        "url_has_redirection": flag(
            F.regexp_extract(url, r"^https?://(.*?)(?:://|$)", 1).contains("//")
        ),
        "has_query_params": flag(query != ""),
        "query_param_count": F.when(query == "", 0).otherwise(count_char(query, "&") + 1),
        "suspicious_param_count": present(F.lower(query), v.PARAM_WORDS),
        "uses_non_standard_port": flag(_odd_port(part["port"])),
        "is_shortened_url": flag(any_of(netloc, v.SHORTENERS)),
        "uses_https": flag(url.startswith("https://")),
    }
    return F.struct(*(c.alias(n) for n, c in facts.items()))


def with_url_features(
    df: DataFrame, text_col: str = "text", typosquatting: bool = True
) -> DataFrame:
    """Append the URL features. Narrow: no row is exploded, joined or shuffled.

    URLs are split once into an array of structs, judged once into a second one, and rolled up per
    mail: flags by any, counts by maximum, https by all. The look-alike test sees only the distinct
    network locations whose length allows a hit. ``typosquatting=False`` leaves that column out.
    """
    keep = df.columns
    staged = (
        df.withColumn(_PARTS, F.transform(extract_urls(F.col(text_col)), split_url))
        .withColumn(_FACTS, F.transform(_PARTS, url_facts))
    )
    count = F.size(_PARTS)
    worst = {
        n: F.coalesce(F.array_max(F.col(f"{_FACTS}.{n}")), F.lit(0))
        for n in ANY_FEATURES + MAX_FEATURES
    }
    out = {
        "url_count": count,
        "has_urls": flag(count > 0),
        "excessive_urls": flag(count > 5),
        **worst,
        "uses_https": F.coalesce(F.array_min(F.col(f"{_FACTS}.uses_https")), F.lit(0)),
    }
    names = [n for n in v.URL_FEATURES if typosquatting or n != "potential_typosquatting"]
    if typosquatting:
        hosts = F.array_distinct(F.filter(F.col(f"{_PARTS}.netloc"), candidate))
        out["potential_typosquatting"] = any_look_alike(hosts)
    return staged.select(*keep, *(out[n].alias(n) for n in names))
