"""Word lists, patterns and column orders that define the features."""

# --- fixed values: keyword lists -------------------------------------------------------------
URGENT_KEYWORDS = (
    "urgent", "immediate", "action required", "verify", "suspend", "limited time", "act now",
    "confirm", "click here", "update", "security alert", "unusual activity", "locked", "expired",
    "validate", "authenticate", "prize", "winner", "congratulations", "claim", "refund",
    "suspended", "verify your account",
)
FINANCIAL_KEYWORDS = (
    "bank", "credit card", "account", "payment", "transaction", "paypal", "western union",
    "wire transfer", "social security", "tax", "irs", "refund", "invoice", "billing",
)
THREAT_KEYWORDS = (
    "legal action", "lawsuit", "suspended", "terminated", "blocked", "restricted", "violation",
    "unauthorized", "fraud", "illegal",
)
GOOD_DOMAINS = (
    "google.com", "microsoft.com", "apple.com", "amazon.com", "facebook.com", "linkedin.com",
    "twitter.com", "instagram.com",
)
GENERIC_GREETINGS = (
    "dear customer", "dear user", "dear member", "dear account holder", "valued customer",
)
MISSPELLINGS = ("recieve", "occured", "seperate", "untill", "payed")
SUSPICIOUS_PHRASES = (
    "verify your identity", "confirm your identity", "update your information",
    "suspended account", "unusual activity", "security alert", "account locked",
)
URGENCY_WORDS = ("immediately", "urgent", "asap", "now", "today", "expires")
THREAT_WORDS = ("legal action", "lawsuit", "police", "fbi")
REWARD_WORDS = ("prize", "winner", "won", "lottery", "reward")
ACT_NOW_PHRASES = ("act now", "act immediately")
SSN_PHRASES = ("social security", "ssn")
BANK_INFO_PHRASES = ("bank account", "routing number", "account number")
BRAND_WORDS = (
    "paypal", "amazon", "google", "microsoft", "apple", "facebook", "netflix", "bank", "secure",
)
SHORTENERS = ("bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly")
PATH_WORDS = ("verify", "account", "signin", "login", "update", "confirm")
RISKY_TLDS = (".tk", ".ml", ".ga", ".cf", ".gq", ".xyz")
PARAM_WORDS = ("user", "id", "token", "session", "redirect")
PREPROCESS_URGENCY_WORDS = (
    "urgent", "immediately", "verify", "suspended", "confirm", "action required", "act now",
    "limited time", "security alert", "unusual activity", "locked", "expired", "validate",
    "authenticate", "click here", "update your", "verify your account",
)

# --- fixed values: column and JSON key candidates, in order of preference --------------------
LABEL_COLUMNS = ("label", "is_phishing", "target", "class", "phishing", "Email Type")
TEXT_COLUMNS = ("text", "body", "email_body", "content", "email", "Email Text")
SUBJECT_KEYS = ("subject", "Subject", "subj")
SENDER_KEYS = ("sender", "from", "From")
RECIPIENT_KEYS = ("recipient", "to", "To")
BODY_KEYS = ("body", "content", "text", "message", "email_body", "plain_text", "html")
ENVELOPE_KEYS = (
    "subject", "Subject", "sender", "from", "From", "recipient", "to", "To",
)

# --- fixed values: patterns, in the syntax Java and RE2 share --------------------------------
# Whitespace as Python's str.split and \s see it; Java's and RE2's \s are narrower.
SPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}"
)
FEATURE_URL = r'https?://[^' + SPACE + r'<>"{}|\\^`\[\]]+'
CORPUS_URL = r"https?://[^" + SPACE + r"<>\"']+"
PLAIN_URL = r"https?://[^" + SPACE + r"]+"
HTML_TAG = r"<[^>]+>"
SENTENCE_END = r"[.!?]+"
CURRENCY = r"\$\p{Nd}|\p{Nd}[" + SPACE + r"]*(dollars|USD)"
LARGE_SUM = r"\$\p{Nd}{4}|\p{Nd}{4}[" + SPACE + r"]*dollars"
FULL_IPV4 = r"^\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}$"
ANY_IPV4 = r"\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+"
PRIVATE_IP = r"192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\."
MAIL_YEAR = r"\b\d{1,2}\s+[A-Za-z]{3}\s+(\d{4})\b"

# --- fixed values: envelope of rebuilt ham ---------------------------------------------------
HAM_SENDER = "enron@enron.com"
HAM_DATE = "Mon, 01 Jan 2001 12:00:00 +0000"
HAM_MESSAGE_ID = "<enron-ham@enron.com>"

# --- fixed values: corpus names written to the source column ---------------------------------
SOURCE_EML = "phishing_pot"
SOURCE_MBOX = "nazario"
SOURCE_HAM = "enron"
SOURCE_URL_LIST = "phishtank"
SOURCE_RANKED_DOMAINS = "umbrella"

# --- fixed values: forest options, grid and thresholds ---------------------------------------
SEED = 42
SIMILARITY_LIMIT = 0.8
FOREST_TREES = 100
FOREST_DEPTH = 20
FOREST_MIN_LEAF = 2
GRID_TREES = (50, 100, 200)
GRID_DEPTH = (10, 20, 30)
GRID_MIN_LEAF = (1, 2, 4)
TRAIN_TOKENS = 256
DEMO_TOKENS = 512

# --- fixed values: feature names in canonical order ------------------------------------------
TEXT_FEATURES = (
    "text_length", "word_count", "avg_word_length", "sentence_count", "uppercase_ratio",
    "digit_ratio", "special_char_ratio", "exclamation_count", "question_count",
    "excessive_punctuation", "urgent_keyword_count", "financial_keyword_count",
    "threat_keyword_count", "has_click_here", "has_verify_account", "has_act_now",
    "has_limited_time", "has_congratulations", "requests_password", "requests_ssn",
    "requests_credit_card", "requests_bank_info", "generic_greeting", "misspelling_count",
    "contains_currency", "large_sum_mentioned", "html_tags_present", "url_count_in_text",
    "suspicious_phrase_count", "urgency_word_count", "contains_threat", "contains_reward",
)
URL_FEATURES = (
    "url_count", "has_urls", "excessive_urls", "domain_length", "domain_has_ip",
    "domain_has_hyphen", "domain_has_at_symbol", "domain_dots_count", "excessive_subdomains",
    "domain_has_suspicious_tld", "domain_length_suspicious", "possible_brand_spoofing",
    "path_length", "path_has_suspicious_keywords", "url_has_encoding", "url_has_redirection",
    "has_query_params", "query_param_count", "suspicious_param_count", "uses_non_standard_port",
    "is_shortened_url", "uses_https", "potential_typosquatting",
)
HEADER_FEATURES = (
    "sender_domain_length", "sender_has_subdomain", "sender_has_digits", "sender_has_hyphen",
    "reply_to_mismatch", "has_reply_to", "return_path_mismatch", "spf_pass", "spf_fail",
    "spf_softfail", "spf_none", "dkim_pass", "dkim_fail", "dkim_none", "dmarc_pass", "dmarc_fail",
    "dmarc_none", "num_received_headers", "excessive_received_headers", "suspicious_ip_count",
    "subject_length", "subject_has_re", "subject_has_fwd", "subject_all_caps",
    "subject_excessive_punctuation", "subject_urgent_keywords", "message_id_domain_mismatch",
    "has_message_id", "num_x_headers", "has_x_mailer", "has_x_originating_ip", "has_date",
    "has_mime_version", "mime_version_1_0", "is_multipart", "is_html", "high_priority",
)
ALL_FEATURES = TEXT_FEATURES + URL_FEATURES + HEADER_FEATURES
