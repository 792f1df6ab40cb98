"""The 37 header features, read from the ordered header list of a parsed message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions import fixed_values as v
from mailprism.functions.strings import any_of, count_char, flag, present

# Headers the features read; one that cannot be decoded zeroes the row.
READ_HEADERS = (
    "from", "reply-to", "return-path", "received-spf", "authentication-results", "received",
    "subject", "message-id", "date", "mime-version", "content-type", "x-priority", "importance",
)


def header_names(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.lower(h["name"]))


def _value(names: Column, values: Column, name: str) -> Column:
    found = F.get(values, (F.array_position(names, F.lit(name)) - 1).cast("int"))
    return F.coalesce(found, F.lit(""))


def header(headers: Column, name: str) -> Column:
    """First value of a header, '' if absent; names compare case-insensitively."""
    return _value(header_names(headers), headers["value"], name.lower())


def header_values(headers: Column, name: str) -> Column:
    """All values of a header, in order."""
    return F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())["value"]


def mail_domain(value: Column) -> Column:
    """Domain of the first address in a header value, '' if there is none; case is kept."""
    return F.regexp_extract(value, r"(?U)[\w.\-]+@([\w.\-]+\.\w+)", 1)


def _header_columns(headers: Column) -> dict[str, Column]:
    c = F.col
    spf, auth, subject = c("__spf"), c("__auth"), c("__subject")
    sender = c("__sender")
    soft = spf.contains("softfail")
    hard = spf.contains("fail") & ~soft
    names, received = c("__names"), c("__received")
    low_subject = F.lower(subject)

    def mismatch(name: str) -> Column:
        return flag((c(name) != "") & (mail_domain(c(name)) != sender))

    out = {
        "sender_domain_length": F.length(sender),
        "sender_has_subdomain": flag(count_char(sender, ".") > 1),
        "sender_has_digits": flag(sender.rlike(r"\p{Nd}")),
        "sender_has_hyphen": flag(sender.contains("-")),
        "reply_to_mismatch": mismatch("__reply_to"),
        "has_reply_to": flag(c("__reply_to") != ""),
        "return_path_mismatch": mismatch("__return_path"),
        "spf_pass": flag(spf.contains("pass") & ~soft & ~hard),
        "spf_fail": flag(hard),
        "spf_softfail": flag(soft),
        "spf_none": flag((spf == "") | spf.contains("none")),
        "num_received_headers": F.size(received),
        "excessive_received_headers": flag(F.size(received) > 10),
        "suspicious_ip_count": F.size(F.filter(received, lambda r: r.rlike(v.PRIVATE_IP))),
        "subject_length": F.length(subject),
        "subject_has_re": flag(low_subject.startswith("re:")),
        "subject_has_fwd": flag(low_subject.startswith("fwd:")),
        "subject_all_caps": flag(
            subject.rlike(r"\p{IsUppercase}")
            & ~subject.rlike(r"[\p{IsLowercase}\p{Lt}]")
            & (F.length(subject) > 5)
        ),
        "subject_excessive_punctuation": flag(
            count_char(subject, "!") + count_char(subject, "?") > 3
        ),
        "subject_urgent_keywords": present(low_subject, v.URGENT_KEYWORDS),
        "message_id_domain_mismatch": mismatch("__message_id"),
        "has_message_id": flag(c("__message_id") != ""),
        "num_x_headers": F.size(F.filter(headers, lambda h: h["name"].startswith("X-"))),
        "has_x_mailer": flag(F.array_contains(names, "x-mailer")),
        "has_x_originating_ip": flag(F.array_contains(names, "x-originating-ip")),
        "has_date": flag(c("__date") != ""),
        "has_mime_version": flag(c("__mime") != ""),
        "mime_version_1_0": flag(c("__mime") == "1.0"),
        "is_multipart": flag(c("__ctype").contains("multipart")),
        "is_html": flag(c("__ctype").contains("text/html")),
        "high_priority": flag(
            any_of(c("__priority"), ("high", "1")) | c("__importance").contains("high")
        ),
    }
    for check in ("dkim", "dmarc"):
        out[f"{check}_pass"] = flag(auth.contains(f"{check}=pass"))
        out[f"{check}_fail"] = flag(auth.contains(f"{check}=fail"))
        out[f"{check}_none"] = flag(auth.contains(f"{check}=none") | ~auth.contains(check))
    return {name: out[name] for name in v.HEADER_FEATURES}


def with_header_features(df: DataFrame, headers_col: str = "headers") -> DataFrame:
    """Append the 37 header features. Narrow.

    A message whose headers could not be read at all (null list) or in which one of the read
    headers has no decodable value gets zeros throughout, unlike a message without headers.
    """
    keep = df.columns
    headers = F.col(headers_col)
    names, values = F.col("__names"), F.col("__values")
    # names are lower-cased once; each lookup is then a plain search in an array
    staged = df.withColumns({"__names": header_names(headers), "__values": headers["value"]})
    staged = staged.withColumns(
        {
            "__from": _value(names, values, "from"),
            "__reply_to": _value(names, values, "reply-to"),
            "__return_path": _value(names, values, "return-path"),
            "__spf": F.lower(_value(names, values, "received-spf")),
            "__auth": F.lower(_value(names, values, "authentication-results")),
            "__subject": _value(names, values, "subject"),
            "__message_id": _value(names, values, "message-id"),
            "__date": _value(names, values, "date"),
            "__mime": _value(names, values, "mime-version"),
            "__ctype": F.lower(_value(names, values, "content-type")),
            "__priority": F.lower(_value(names, values, "x-priority")),
            "__importance": F.lower(_value(names, values, "importance")),
            "__received": header_values(headers, "received"),
            "__readable": headers.isNotNull()
            & ~F.exists(
                headers,
                lambda h: h["value"].isNull() & F.lower(h["name"]).isin(*READ_HEADERS),
            ),
        }
    ).withColumn("__sender", mail_domain(F.col("__from")))
    readable = F.coalesce(F.col("__readable"), F.lit(False))
    return staged.select(
        *keep,
        *(
            F.when(readable, c).otherwise(F.lit(0)).alias(n)
            for n, c in _header_columns(headers).items()
        ),
    )
