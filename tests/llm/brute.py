"""Plain restatements of what the operators must return, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def removed_bytes(docs: dict, least: int = 50) -> dict:
    """doc -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    first = {}
    raw = {d: (t or "").encode() for d, t in docs.items()}
    for d in sorted(raw):
        for i in range(len(raw[d]) - least + 1):
            first.setdefault(raw[d][i:i + least], d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if first[b[i:i + least]] < d:
                gone[i:i + least] = b"\x01" * least
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def simhash(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: dict, most: int = 3) -> dict:
    """id -> smallest id reachable over fingerprints that differ in few bits."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def lines_kept(docs: dict) -> dict:
    """doc -> its text without the lines that go."""
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in docs.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < 3 or d == max(holders[key(x)])]
        out[d] = "\n".join(stay)
    return out


def line_drops(docs: dict) -> dict:
    """doc -> (n_lines, n_dropped, kept_sha256), where a document that loses all lines has none left."""
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in docs.items():
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    out = {}
    for d, text in lines_kept(docs).items():
        lines = (docs[d] or "").split("\n")
        gone = sum(len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and d < max(holders[key(x)]) for x in lines)
        out[d] = (len(lines), gone, sha(text))
    return out


def quality_counts(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def base_secrets(text: str) -> list:
    """(kind, start, end), the patterns as the task words them, with a plain search."""
    out = []
    ci = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    names = "|".join(ci(x) for x in ("password", "passwd", "secret", "token")) + "|" + ci("api") + "_?" + ci("key")
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]


def spans_digest(spans: list) -> str:
    order = {"assign": 0, "access": 1, "hex": 2}
    return sha(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]]))))


def mix_plan(rows: list) -> dict:
    """(doc_id, source, text) rows -> doc_id -> (size, source_size, target, taken); targets shared round by round."""
    size = {d: len(WORD.findall(t or "")) for d, _, t in rows}
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size[d] for d, x, _ in rows if x == s) for s in sources}
    budget = sum(total.values())
    full, target = set(), {}
    while True:
        left = budget - sum(3 * total[s] for s in full)
        free = [s for s in sources if s not in full]
        share = sum(weight[s] for s in free)
        target = {s: float(3 * total[s]) if s in full else left / share * weight[s] for s in sources}
        more = {s for s in free if 3 * total[s] <= target[s]}
        if not more:
            break
        full |= more
    queue = []
    for s in sources:
        mine = sorted((hashlib.md5(str(d).encode()).hexdigest(), d) for d, x, _ in rows if x == s)
        done = 0
        for h, d in mine:
            done += size[d]
            for r in range(3):
                if size[d]:
                    queue.append(((r * total[s] + done) / target[s], s is None, s or "", h, d, r))
    taken, used = Counter(), 0
    for item in sorted(queue):
        used += size[item[4]]
        if used > budget:
            break
        taken[item[4]] += size[item[4]]
    return {d: (size[d], total[s], target[s], taken[d]) for d, s, _ in rows}


def outlier_distances(counts: dict, group: dict) -> dict:
    """Squared robust distances: ``counts`` of a document as seven numbers, its group; all in numpy, group by group."""
    import math

    import numpy as np

    from mailprism.llm import quality as q

    def vector(c):
        words, chars, symbols, dup, repeat, lines, capitals = c
        each = [math.log(words), chars / words, *[math.sqrt(a / max(b, 1)) for a, b in (
            (symbols, words), (dup, lines), (repeat, words), (capitals, chars))]]
        return [math.floor(min(v, 64.0) * 256 + 0.5) for v in each]

    floor = np.array(list(q.FLOORS.values())) * 256
    out = {}
    for g in set(group.values()):
        ids = [d for d in counts if group[d] == g and counts[d][0] > 0]
        if not ids:
            continue
        x = np.array([vector(counts[d]) for d in ids], float)
        mean = np.median(x, axis=0)
        inverse = np.diag(1 / ((1.4826 * np.median(np.abs(x - mean), axis=0)) ** 2 + floor**2))
        point = q.chi2_point(0.5, 6)
        factor = 0.5 / (1 - math.exp(-point / 2) * sum((point / 2) ** k / math.factorial(k) for k in range(4)))
        for step in range(q.STEPS + 1):
            off = x - mean
            d = np.einsum("ni,ij,nj->n", off, inverse, off)
            if step == q.STEPS:
                break
            bins = np.floor(np.log2(np.maximum(d, 0) + 2**-20) * q.BINS_PER_DOUBLING)
            edge = np.sort(bins)[math.ceil(len(bins) * 0.5) - 1]
            near = x[bins <= edge]
            mean = near.mean(axis=0)
            inverse = np.linalg.inv((near.T @ near / len(near) - np.outer(mean, mean)) * factor + np.diag(floor**2))
        out |= dict(zip(ids, d.tolist()))
    return out
