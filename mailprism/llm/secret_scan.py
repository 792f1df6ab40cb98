"""Secret scans: patterns, and passwords judged by the cost of guessing them.

Three patterns give the base spans. Besides, values that stand in a credential context (``pwd: ...``,
``passphrase is ...``, ``user:...@host``) are put to a guess-cost dynamic program: the value is cut into
common words, dates, repeats, keyboard walks, sequences and brute-force spans so that the cost, the logarithm
of the number of guesses, is least. A value that would take ``LEAST_COST`` or more is a secret, one like
"password" or "changeme" is not. Base spans always stay; added ones have kind ``guess``. A value is left out only
where one span covers the whole of it: a base span that ends inside a value does not stand for the rest.

The words are the common ones of passwords and all runs of letters that the corpus has ``LEAST_SEEN`` times or more, ranked
by how often they stand in it, so that ordinary prose behind "is" costs little. They are counted on Spark before the scan;
the values of credential contexts are not counted, as a secret in many copies would become a word by them. The ranked words
stay a table: the parts of the values, of which there are few, are joined to it, so no list of words reaches the driver or
a task. Texts are read twice and never shuffled.

Offsets are code points, ends exclusive. Null text counts as empty and has no spans. Repeated rows are
scanned one by one; values of any length are scanned whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mailprism.llm.common import batches, cut_lineage

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a shorter one cannot hide a longer one
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Contexts of values that the guess cost decides on; the value is the last group.
CONTEXTS = (
    re.compile(
        r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"""
        r"""|credentials?|auth(?:entication|orization)?|pin)["']?(?:\x20*(?:[:=]|=>|->)\x20*|\x20+is\x20+)["']?([^\s"'<>,;]+)""",
        re.A | re.I,
    ),
    # a scheme begins where a word does, so that a long word is read once
    re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@]++:([^\s/@]++)@"),
    re.compile(r"(?<![A-Za-z])Bearer\x20+([A-Za-z0-9+/_.=-]+)"),
)
#: A word of the corpus: its letters, how often it has to stand there at least, and words a task counts at a time.
LETTERS = re.compile(r"[^\W\d_]{3,}")
LEAST_SEEN = 3
COUNTED_AT_ONCE = 1 << 18
#: Shares that rows with the same value, or words with the same frequency, are dealt to.
SHARES = 64
#: log10 of the guesses from which on a value counts as a secret.
LEAST_COST = 10.0

# fixed values: common words of passwords, most common first
WORDS = (
    "password", "admin", "welcome", "login", "user", "root", "test", "guest", "letmein", "master", "secret", "dragon",
    "monkey", "football", "baseball", "sunshine", "princess", "shadow", "superman", "iloveyou", "trustno", "access",
    "hello", "freedom", "whatever", "change", "changeme", "default", "example", "sample", "demo", "pass", "passwd",
    "token", "key", "apikey", "your", "my", "the", "none", "null", "true", "false", "required", "optional", "value",
    "string", "enter", "here", "reset", "forgot", "invalid", "incorrect", "expired", "please", "field", "hidden",
    "summer", "winter", "spring", "autumn", "monday", "friday", "january", "love", "money", "house", "computer",
)
# fixed values: rows of a keyboard
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301$57", "aaeoisst")
DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|"
    r"(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d"
)
#: Each further piece multiplies the guesses, as a guesser has to find out how the pieces are joined.
JOINT = log10(4)


class Words:
    """Cost of each word: log10 of its rank, in the fixed list or among the corpus' own, given as ``{word: rank}``."""

    def __init__(self, ranks: dict[str, int] | None = None):
        self.cost = {w: log10(rank + 1) for w, rank in (ranks or {}).items()}
        for i, w in enumerate(WORDS):
            self.cost[w] = min(self.cost.get(w, 99.0), log10(i + 2))
        self.longest = max(map(len, self.cost))


@lru_cache(1)
def _fixed() -> Words:
    return Words()


@lru_cache(1)
def _neighbours() -> dict[str, frozenset[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for c, key in enumerate(row):
            for rr, cc in ((r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c - 1), (r + 1, c)):
                if 0 <= rr < len(KEY_ROWS) and 0 <= cc < len(KEY_ROWS[rr]):
                    near.setdefault(key, set()).add(KEY_ROWS[rr][cc])
    return {k: frozenset(v) for k, v in near.items()}


def _symbols(c: str) -> float:
    """log10 of the characters of the same kind, the guesses for one brute-force place."""
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return log10(26) if c.isascii() else 2.0
    return log10(33)


def pieces(value: str, words: Words | None = None) -> list[tuple[int, int, float, str]]:
    """``start, end, cost, kind`` of all words, dates, and maximal repeats, walks and sequences of ``value``."""
    words = words or _fixed()
    ranks, longest = words.cost, words.longest
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    out = []
    for i in range(n):
        for j in range(i + 2, min(n, i + longest) + 1):
            cost = ranks.get(low[i:j])
            leet = 0.0
            if cost is None:
                cost, leet = ranks.get(plain[i:j]), log10(2)
            if cost is not None:
                capitals = log10(2) if value[i:j] != low[i:j] else 0.0
                out.append((i, j, cost + leet + capitals, "word"))
    for m in DATE.finditer(value):
        out.append((m.start(), m.end(), log10(365 * 120 * 4), "date"))
    # runs, found in one pass: the same character, a step up or down, a walk over the keyboard
    near = _neighbours()
    for kind, joined in (
        ("repeat", lambda a, b: a == b),
        ("up", lambda a, b: ord(b) - ord(a) == 1),
        ("down", lambda a, b: ord(b) - ord(a) == -1),
        ("walk", lambda a, b: b in near.get(a, ())),
    ):
        start = 0
        for i in range(1, n + 1):
            if i == n or not joined(low[i - 1], low[i]):
                if i - start >= 3:
                    size = i - start
                    turns = 0.35 * size if kind == "walk" else 0.0
                    out.append((start, i, _symbols(value[start]) + log10(size) + turns, kind))
                start = i
    # a unit said over and over: the shortest unit at each start
    for m in re.finditer(r"(.{2,16}?)\1+", value):
        unit = m.group(1)
        out.append((m.start(), m.end(), sum(map(_symbols, unit)) + log10((m.end() - m.start()) / len(unit)), "repeat"))
    return out


def guess_cost(value: str, words: Words | None = None) -> float:
    """log10 of the guesses for ``value``: least over all ways to cut it up. One pass over the ends."""
    n = len(value)
    by_end: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost, _ in pieces(value, words):
        by_end.setdefault(end, []).append((start, cost))
    best = np.zeros(n + 1)  # least cost of value[:i]
    brute = np.zeros(n + 1)  # the same, with a brute-force span up to i
    brute[0] = 0.0
    for i in range(1, n + 1):
        c = value[i - 1]
        # a brute-force span goes on, or begins behind a joint
        goes_on = brute[i - 1] if i > 1 else 0.0
        begins = best[i - 1] + (JOINT if i > 1 else 0.0)
        brute[i] = min(goes_on, begins) + _symbols(c)
        best[i] = brute[i]
        for start, cost in by_end.get(i, ()):
            best[i] = min(best[i], best[start] + cost + (JOINT if start else 0.0))
    return float(best[n])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Values in a credential context, in the order of the contexts, but for those that lie in a base span."""
    found = (m.span(m.lastindex) for context in CONTEXTS for m in context.finditer(text))
    return [(a, b) for a, b in found if not any(x <= a and b <= y for _, x, y in base)]


def chosen(values: list[tuple[int, int, bool]]) -> list[tuple[str, int, int]]:
    """The spans of the secret values, but for those that lie in an earlier one."""
    out: list[tuple[str, int, int]] = []
    for a, b, secret in values:
        if secret and not any(x <= a and b <= y for _, x, y in out):
            out.append(("guess", a, b))
    return out


def guessed_spans(
    text: str, base: list[tuple[str, int, int]], least_cost: float = LEAST_COST, words: Words | None = None
) -> list[tuple[str, int, int]]:
    """Values in a credential context that would take too many guesses, but for those that lie in another span."""
    return chosen([(a, b, guess_cost(text[a:b], words) >= least_cost) for a, b in candidates(text, base)])


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def words_of(text: str) -> Counter[str]:
    """How often each word in small letters stands in the text, apart from the values of credential contexts."""
    values = sorted(m.span(m.lastindex) for context in CONTEXTS for m in context.finditer(text))
    at, rest = 0, []
    for a, b in values:
        if a >= at:
            rest.append(text[at:a])
        at = max(at, b)
    rest.append(text[at:])
    found: Counter[str] = Counter()
    for token, n in Counter(" ".join(rest).lower().split()).items():
        for word in (token,) if token.isalpha() and len(token) > 2 else LETTERS.findall(token):
            found[word] += n
    return found


def ranked_words(docs: DataFrame, least_seen: int = LEAST_SEEN) -> DataFrame:
    """``word, rank`` of all words seen ``least_seen`` times: how many words are seen as often or more.

    The running sum is over the different frequencies, of which there are far fewer than words.
    """

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in found:
            for text in batch.column(0).to_pylist():
                total.update(words_of(text))
                if len(total) >= COUNTED_AT_ONCE:
                    yield told()
                    total.clear()
        yield told()

    counts = docs.select("text").where("text is not null").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.where(F.col("n") >= least_seen))
    often = Window.orderBy(F.desc("n"))
    ranks = counts.groupBy("n").agg(F.count("*").alias("words")).select("n", F.sum("words").over(often).alias("rank"))
    # most words are seen three or four times, so a frequency is dealt to several shares
    ranks = ranks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    counts = counts.withColumn("share", F.pmod(F.xxhash64("word"), F.lit(SHARES)).cast("int"))
    return counts.join(ranks, ["n", "share"]).select("word", "rank")


def word_parts(value: str, lengths: list[int]) -> set[str]:
    """Parts of the value that could be words: runs of letters of these lengths, as they stand or with stand-ins read as letters."""
    low = value.lower()
    out = set()
    for run in {r for text in {low, low.translate(LEET)} for r in LETTERS.findall(text)}:
        for size in lengths:
            out.update(run[i:i + size] for i in range(len(run) - size + 1))
    return out


def secret_values(values: DataFrame, ranked: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """``value, secret`` for the different ``value`` of the rows."""
    lengths = sorted(r[0] for r in ranked.select(F.length("word")).distinct().collect())  # few: words of n lengths hold n * n / 2 letters
    values = values.select("value").distinct()

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(v, w) for v in batch.column(0).to_pylist() for w in word_parts(v, lengths)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["value", "word"])

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = zip(batch.column("value").to_pylist(), batch.column("words").to_pylist())
        verdicts = [guess_cost(v, Words({w["word"]: w["rank"] for w in words or ()})) >= least_cost for v, words in found]
        return pa.RecordBatch.from_arrays([batch.column("value"), pa.array(verdicts, pa.bool_())], ["value", "secret"])

    known = values.mapInArrow(batches(part, 64), "value string, word string").join(ranked, "word")
    known = known.groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("words"))
    return values.join(known, "value", "left").select("value", "words").mapInArrow(batches(judge), "value string, secret boolean")


def scan(docs: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans`` for each row of ``docs(doc_id, text)``."""
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base"]

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans, values = [], [], [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            kinds = [k for k, _, _ in base]
            counts.append([*map(kinds.count, KINDS[:3])])
            spans.append(listed(base))
            digests.append(hashlib.sha256(spans[-1].encode()).hexdigest())
            values.append([{"a": a, "b": b, "value": text[a:b]} for a, b in candidates(text, base)])
        numbers = np.array(counts, np.int64)
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("value", pa.string())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(numbers[:, i]) for i in range(3)], pa.array(digests), pa.array(spans, pa.string()), pa.array(values, kind)],
            [*columns, "found"],
        )

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        more = [
            chosen([(v["a"], v["b"], v["secret"]) for v in sorted(values or (), key=lambda v: v["place"])])
            for values in batch.column("judged").to_pylist()
        ]
        spans = [
            listed([(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)] + added) if added else base
            for base, added in zip(batch.column("base").to_pylist(), more)
        ]
        kept = [batch.column(c) for c in columns[:4]]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(list(map(len, more)), pa.int64()), batch.column("base_sha256"), pa.array(spans, pa.string())],
            [*columns[:4], "n_guess", "base_sha256", "spans"],
        )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        batches(find),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, found array<struct<a:long,b:long,value:string>>",
    )
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))  # narrow; the numbers stay as written
    values = rows.select("row", F.posexplode("found").alias("place", "v")).select("row", "place", "v.*")
    verdicts = secret_values(values, ranked_words(docs), least_cost)
    # a value in a third of all rows is dealt to several shares
    verdicts = verdicts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    judged = values.withColumn("share", F.pmod("row", F.lit(SHARES)).cast("int")).join(verdicts, ["value", "share"])
    judged = judged.groupBy("row").agg(F.collect_list(F.struct("place", "a", "b", "secret")).alias("judged"))
    return rows.drop("found").join(judged, "row", "left").select(*columns, "judged").mapInArrow(
        batches(settle),
        "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string",
    )
