"""The operators' own parts, hot groups, and odd rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from mailprism.llm import (
    components, exact_dedup, html_extract, line_dedup, mixing, quality, secret_scan, simhash, substring_dedup,
    suffix_sort, token_files, viterbi_pieces,
)
from mailprism.llm.wavelet import WaveletMatrix
from tests.llm import brute
from tests.llm.conftest import EDGES


# --- odd rows: one result per row, extra columns and clashing names do no harm ------------------
OPERATORS = {
    "substrings": substring_dedup.remove_repeats, "simhash": simhash.near_duplicates, "mix": mixing.mix,
    "pieces": viterbi_pieces.encoded_and_decoded, "exact": exact_dedup.exact_dedup, "quality": quality.quality_rules,
    "tokens": token_files.token_report, "lines": line_dedup.line_dedup_report, "secrets": secret_scan.scan,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_result_per_row(edges, name):
    got = OPERATORS[name](edges).collect()
    key = lambda d: (d is not None, d)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in EDGES), key=key)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def test_odd_rows_in_the_stages(spark, edges, nothing):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, "").columns == nothing.columns
        assert stage(spark, nothing, "").collect() == []
        out = stage(spark, edges, "")
        assert out.columns == edges.columns
        out.collect()
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, edges, "").collect()} <= {4, 5}


def test_odd_rows_one_by_one(edges):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    exact = by(exact_dedup.exact_dedup(edges))
    assert [exact[d]["keep_id"] for d in (1, 2, 9, 10, 3)] == [1, 1, 9, 9, 3]
    assert exact[10]["group_size"] == 3 and not exact[10]["kept"]
    near = by(simhash.near_duplicates(edges))
    assert near[1]["fingerprint"] == "0" * 16 and near[3]["component_id"] == 1
    lines = by(line_dedup.line_dedup_report(edges))
    assert (lines[6]["n_dropped"], lines[7]["n_dropped"], lines[8]["n_dropped"], lines[1]["n_lines"]) == (2, 1, 0, 1)
    cut = by(substring_dedup.remove_repeats(edges))
    assert cut[4]["n_removed"] == 0 and cut[5]["n_bytes"] - cut[5]["n_removed"] == len(" tail")
    assert cut[12]["n_removed"] == 200 and cut[12]["n_spans"] == 1 and cut[1]["n_bytes"] == 0
    judged = by(quality.quality_rules(edges))
    assert judged[1]["base_failed"] and judged[1]["distance"] is None and judged[4]["kept"]
    found = by(secret_scan.scan(edges))
    assert found[13]["n_assign"] == 1 and found[13]["n_access"] == 1 and found[13]["n_guess"] == 1


# --- dedup ---------------------------------------------------------------------------------------
def test_heavy_digests_are_split_off(spark):
    rows = [(i, "hot" if i % 3 else f"t{i // 2}") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counters=8).collect()
    want = {}
    for d, t in rows:
        want.setdefault(t, []).append(d)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {d: (min(want[t]), len(want[t])) for d, t in rows}


def test_misra_gries_keeps_what_is_frequent():
    random.seed(5)
    stream = ["a"] * 400 + ["b"] * 300 + [str(i) for i in range(600)]
    random.shuffle(stream)
    counts = {}
    for at in range(0, len(stream), 50):
        batch = {}
        for x in stream[at:at + 50]:
            batch[x] = batch.get(x, 0) + 1
        counts = exact_dedup.merge_counts(counts, batch, 5)
        assert len(counts) <= 5
    assert {"a", "b"} <= set(counts)


@pytest.mark.parametrize("seed", range(6))
def test_line_stream_over_cut_partitions(seed):
    """However the sorted lines are cut into partitions and batches, the same lines go."""
    random.seed(seed)
    rows = sorted({(random.choice((1, 1, 1, 2, 3, 4)), 0, -random.randrange(8), random.randrange(3)) for _ in range(120)})
    rows = [(a, b, -d, p) for a, b, d, p in rows]
    cuts = sorted(random.sample(range(1, len(rows)), 4))
    settled, waiting = set(), []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        part, batches = rows[a:b], []
        while part:
            k = random.randint(1, 7)
            columns = list(zip(*part[:k]))
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "doc", "pos"]))
            part = part[k:]
        for out in line_dedup.stream(iter(batches)):
            for h1, _, doc, pos, done, more in zip(*(c.to_pylist() for c in out.columns)):
                settled.add((h1, doc, pos)) if done else waiting.append((h1, doc, pos, more))
    for h1, doc, pos, _ in waiting:
        same = [w for w in waiting if w[0] == h1]
        if doc < max(w[1] for w in same) and (len({w[1] for w in same}) >= 3 or any(w[3] for w in same)):
            settled.add((h1, doc, pos))
    holders = {}
    for h1, _, doc, _ in rows:
        holders.setdefault(h1, set()).add(doc)
    assert settled == {(h, d, p) for h, _, d, p in rows if len(holders[h]) >= 3 and d < max(holders[h])}


def test_keep_bitmap_round_trip(spark):
    rows = [(d, "\n".join(["a common line of enough length"] * 3 + [f"own {d}"] * d)) for d in range(1, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in line_dedup.keep_bitmaps(docs).collect():
        assert line_dedup.unpack(r["keep"], 3 + r["doc"]).tolist() == [False] * 3 + [True] * r["doc"]


def test_links_over_long_posting_lists(spark):
    """Near fingerprints in long lists are posted again, and nothing is lost."""
    rng = np.random.default_rng(3)
    near = [int(b) for b in np.unique([0x0123456789ABCDEF ^ sum(1 << int(x) for x in rng.choice(62, 2)) for _ in range(300)])]
    values = near + [int(x) for x in rng.integers(0, 1 << 62, 300)]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute.classes(dict(zip(values, values)))
    for list_rows in (4096, 20):
        found = {r["node"]: r["root"] for r in components.components(simhash.links(frame, list_rows)).collect()}
        assert {v: found.get(v, v) for v in values} == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    random.seed(seed)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    root = {x: x for e in links for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_suffixes_are_sorted():
    rng = np.random.default_rng(0)
    for n, width, shallow in ((0, 50, 24), (1, 50, 24), (400, 50, 24), (900, 26, 16), (300, 13, 8)):
        rows = rng.integers(97, 99, (n, width), dtype=np.uint8)
        if n > 100:
            rows[n // 2:] = rows[:n - n // 2]
            rows[::3, :width - 4] = 97
        order = suffix_sort.deep_shallow(rows, shallow)
        got = [bytes(rows[i]) for i in order]
        assert got == sorted(bytes(x) for x in rows)
        prefix = suffix_sort.common_prefixes(rows, order).tolist()
        assert prefix[1:] == [next((k for k in range(width) if a[k] != b[k]), width) for a, b in zip(got, got[1:])]


@pytest.mark.parametrize("chunk_bytes", [1 << 9, 1 << 12, 1 << 22])
def test_repeats_over_chunks(spark, chunk_bytes):
    """Low-entropy texts with passages in common, dealt into few or many chunks."""
    random.seed(11)
    passage = ["".join(random.choices("ab ", k=random.choice((49, 50, 51, 70, 140)))) for _ in range(8)]
    docs = {}
    for d in range(120):
        docs[d] = "".join(random.choice([random.choice(passage), "".join(random.choices("abé ", k=random.randrange(60))), "ab" * 40]) for _ in range(4))
    docs[120] = docs[5]
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame, chunk_bytes=chunk_bytes).collect()}
    assert got == brute.removed_bytes(docs)
    kept = substring_dedup.remove_repeats(frame, with_bytes=True, chunk_bytes=chunk_bytes).where("n_removed = 0").select("doc_id", "kept").collect()
    assert kept and all(bytes(r["kept"]).decode() == docs[r["doc_id"]] for r in kept)


@pytest.mark.parametrize("hot_rows", [0, 40])
def test_repeats_around_hot_anchors(spark, hot_rows):
    """A line of most documents with other text around it: the same bytes go, and no call gets a row per document."""
    random.seed(12)
    line = "This text may be copied under the terms of a licence that nobody has ever read whole."
    docs = {}
    for d in range(150):
        own = ["".join(random.choices("abcdé \n", k=random.randrange(5, 90))) for _ in range(2)]
        docs[d] = own[0] + (line if d % 3 else line[9:70]) + own[1] + "xy" * (d % 5) * 20
    docs[150] = docs[3]
    frame = spark.createDataFrame([*docs.items(), (7, docs[8])], "doc_id long, text string")
    want = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame.where("doc_id != 7"), hot_rows=1 << 40).collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(frame.where("doc_id != 7"), hot_rows=hot_rows, chunk_bytes=1 << 11).collect()}
    assert got == want == brute.removed_bytes({d: t for d, t in docs.items() if d != 7})
    twice = [sorted(map(tuple, substring_dedup.remove_repeats(frame, hot_rows=h, chunk_bytes=1 << 11).collect())) for h in (hot_rows, 1 << 40)]
    assert twice[0] == twice[1]


def test_hot_anchors_are_no_group():
    """Contexts of a hot anchor in many documents are not sent to its bucket."""
    random.seed(13)
    line = "This text may be copied under the terms of a licence that nobody has ever read whole."
    texts = ["".join(random.choices("abcdefgh", k=60)) + line + "".join(random.choices("abcdefgh", k=60)) for _ in range(400)]
    rows = lambda part: pa.table({"doc_id": pa.array(part), "raw": pa.array([texts[i].encode() for i in part])})
    chunks = {c: rows(list(range(c, 400, 4))) for c in range(4)}
    buckets = 8
    sent = pa.concat_tables([substring_dedup._send_hashes(buckets)((pa.scalar(c),), t) for c, t in chunks.items()])
    most = {}
    for hot_rows in (1 << 40, 50):
        told = []
        for b in sorted(set(sent.column("bucket").to_pylist())):
            part = sent.filter(pa.compute.equal(sent.column("bucket"), b))
            told.append(substring_dedup._find_repeated(hot_rows)((pa.scalar(b),), part))
        told = pa.concat_tables(told)
        grams = {}
        windows = 0
        for c, t in chunks.items():
            out = substring_dedup._send_contexts(buckets, 50)((pa.scalar(c),), t, told.filter(pa.compute.equal(told.column("chunk"), c)))
            for b, blob in zip(out.column("bucket").to_pylist(), out.column("blob").to_pylist()):
                windows += b >= buckets
                if 0 <= b < buckets:
                    for row in substring_dedup._unpack(blob, np.uint8, np.int64, np.int32, np.int32, np.int64)[0].reshape(-1, 76):
                        grams[bytes(row[26:50])] = grams.get(bytes(row[26:50]), 0) + 1
        most[hot_rows] = max(grams.values(), default=0), windows
    assert most[1 << 40][0] >= 300 and most[1 << 40][1] == 0
    assert most[50][0] <= 50 * substring_dedup.FEW and most[50][1] > 0


# --- mixing, quality -----------------------------------------------------------------------------
def test_targets_share_what_is_over(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), ("d", 1), ("e", 0), ("f", 70)]
    frame = spark.createDataFrame([(False, s, n) for s, n in sizes], "no_source boolean, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate(sizes)]
    want = {s: brute.mix_plan(rows)[i][2] for i, s, _ in rows}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1581)


def test_mix_is_near_its_targets(spark):
    random.seed(8)
    rows = [(i, random.choice(["a"] * 6 + ["b", "c", "d", None]), "w " * random.randrange(1, 40)) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    by = {}
    source = {d: s for d, s, _ in rows}
    for r in got:
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
        by.setdefault(source[r["doc_id"]], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 40 for t, n in by.values())


def test_chi2_points():
    assert quality.chi2_point(0.95, 6) == pytest.approx(12.5916, abs=1e-3)
    assert quality.chi2_point(0.5, 2) == pytest.approx(1.3863, abs=1e-3)


def test_outliers_in_a_group_that_is_a_third_bad(spark):
    """The estimate holds although a third of the group is junk."""
    random.seed(4)
    words = ["".join(random.choices("abcdefgh", k=random.randrange(2, 9))) for _ in range(5000)]
    rows = []
    for i in range(300):
        text = random.sample(words, random.randrange(60, 300))
        rows.append((i, " ".join(w + "###" if i % 3 == 0 else w for w in text), "en", "s"))
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 != 0) for r in got)


# --- tokens ------------------------------------------------------------------------------------
HARD = ["", "  a", "a   b\n\n c \n d", "x\t y\xa0z", "\n\n", "a \n", "don't 'll  's", "<|endoftext|> a", "a\x1c b \x85 c", "1 22 $$ a_b", "\r\n x\r\ny", "▁", "a▁ b", "日本 \U0001f600"]


def test_encoder_is_the_tokenizer():
    random.seed(1)
    use = token_files.encoder(token_files.public_model())
    texts = HARD + ["".join(random.choices(" \n\tab.1'é \x1c", k=30)) for _ in range(300)]
    want = [x.ids for x in use.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(use.encode(t), use.dtype).tolist() for t in texts] == want


def test_special_tokens_as_the_library_alone():
    """Wanted ids come from a tokenizer of the test's own, with nothing set."""
    from tokenizers import Tokenizer

    random.seed(2)
    use, plain = token_files.Encoder(token_files.public_model()), Tokenizer.from_file(token_files.public_model())
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "\n\n", "a", "word,", "é", "'s", "\t", "1"]
    texts = HARD + ["a <|endoftext|> b"] + ["".join(random.choices(parts, k=12)) for _ in range(500)]
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(use.encode(t), use.dtype).tolist() for t in texts] == want
    assert want[len(HARD)] == [64, 220, 50256, 275]


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        ids = np.minimum(rng.zipf(1.3, n), 50256).astype(np.uint16)
        matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 16).to_bytes())
        assert matrix.all().tolist() == [matrix.access(i) for i in range(n)] == ids.tolist()
        for v in set(ids[:20].tolist()) | {4711}:
            assert matrix.occurrences(v) == np.flatnonzero(ids == v).tolist()
            assert matrix.count(v, n // 3, n // 2) == int((ids[n // 3:n // 2] == v).sum())


def test_shards_end_between_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(60)], "doc_id long, text string")
    token_files.write_token_files(docs, token_files.public_model(), f"{tmp_path}/t", shard_tokens=100)
    files = spark.read.parquet(f"{tmp_path}/t").collect()
    assert len(files) > 10
    for f in files:
        ids, lengths, matrix = token_files.unpack_shard(bytes(f["shard"]))
        assert lengths.sum() == matrix.n == f["n_tokens"] and ids[0] == f["first_doc"]


def test_best_pieces():
    """Scores of the pieces found equal those of a dynamic program over all substrings; texts come back."""
    random.seed(2)
    use = viterbi_pieces.pieces(viterbi_pieces.public_model())
    worth = {p: use.automaton.get(p) for p in use.automaton.keys()}
    score = {i: s for i, _, s in worth.values()}
    longest = max(map(len, worth))
    for text in HARD + ["".join(random.choices([" ", "\n", "a", "the", "tion", "é", "日", "  "], k=20)) for _ in range(300)]:
        ids = np.frombuffer(use.encode(text), use.dtype)
        assert use.decode(ids) == text
        if not text or "▁" in text:
            continue
        word = "▁" + text.replace(" ", "▁")
        best = [0.0]
        for i in range(1, len(word) + 1):
            best.append(max([best[-1] + use.by_bytes] + [best[i - k] + worth[word[i - k:i]][2] for k in range(1, min(i, longest) + 1) if word[i - k:i] in worth]))
        got = sum(score.get(i, use.by_bytes if (use.texts[i][0] & 0xC0) != 0x80 else 0.0) for i in ids.tolist())
        assert got == pytest.approx(best[-1])


# --- secrets, pages ----------------------------------------------------------------------------
def test_guess_cost_is_least_over_all_cuts():
    def by_hand(value):
        n = len(value)
        pieces = {(a, b): c for a, b, c, _ in sorted(secret_scan.pieces(value), key=lambda p: -p[2])}
        costs = []
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), k) for k in range(n)):
            ends, total = [0, *cuts, n], 0.0
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                brute_force = sum(map(secret_scan._symbols, value[a:b]))
                total += min(pieces.get((a, b), 1e9), brute_force) + (secret_scan.JOINT if i else 0)
            costs.append(total)
        return min(costs)

    for value in ("password1", "qwerty99", "aaaaabcd", "x7Kq2", "2019-05-06", "abab", "p@ssword", "Zq"):
        assert secret_scan.guess_cost(value) == pytest.approx(by_hand(value))
    assert secret_scan.guess_cost("password") < 2 < 8 < secret_scan.guess_cost("kX9#vQ2m")
    assert secret_scan.guess_cost("qwertyuiop") < secret_scan.guess_cost("qmxzvktjwp")


def test_added_spans():
    text = 'pwd: changeme, passphrase is vK8#xQp2!mZ7 and postgres://bob:Xk29vLq7TzPw@db/x password="aaaaaaaaaaaa"'
    base = secret_scan.base_spans(text)
    added = secret_scan.guessed_spans(text, base)
    assert [text[a:b] for _, a, b in base] == ['password="aaaaaaaaaaaa']
    assert sorted(text[a:b] for _, a, b in added) == ["Xk29vLq7TzPw", "vK8#xQp2!mZ7"]
    assert secret_scan.guess_cost("y" * 5000) < 10


def test_values_beyond_a_base_span():
    """A base span that ends inside a value leaves the value to the guess cost; one around it does not."""
    for text, value in (
        ("password=Sup3rSecr$t!x9 end", "Sup3rSecr$t!x9"), ('api_key: "abcDEF1#kq9?Zz" end', "abcDEF1#kq9?Zz"), ("token = kbzqrf1%9Kq end", "kbzqrf1%9Kq"),
    ):
        base = secret_scan.base_spans(text)
        assert len(base) == 1 and [text[a:b] for _, a, b in secret_scan.guessed_spans(text, base)] == [value]
    for text in ("password=Sup3rSecrtx9 end", "password=password! end"):
        base = secret_scan.base_spans(text)
        assert len(base) == 1 and secret_scan.guessed_spans(text, base) == []


def test_words_of_the_corpus_are_cheap(spark):
    """Prose behind a credential word is no secret if the corpus uses its words; a copied secret is no word."""
    prose = "A number generated by machines. The art of persuasion, they say; Department of state."
    secret = "my passphrase is qhzvkwmrtjx now"
    rows = [(i, prose) for i in range(5)] + [(10, "the token is generated by us"), (11, "the secret is persuasion"), (12, "authorization: Department of")]
    rows += [(20 + i, secret) for i in range(50)] + [(90, None), (91, "pwd: kV9generated%xQz7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    assert [got[d]["n_guess"] for d in (0, 10, 11, 12, 90)] == [0] * 5
    assert got[20]["spans"] == "guess:17:28" and got[91]["n_guess"] == 1
    ranked = {r["word"]: r["rank"] for r in secret_scan.ranked_words(docs).collect()}
    assert "qhzvkwmrtjx" not in ranked and "persuasion" in ranked
    words = secret_scan.Words(ranked)  # all words at once judge as the joined parts do
    for doc_id, text in rows:
        base = secret_scan.base_spans(text or "")
        assert got[doc_id]["spans"] == secret_scan.listed(base + secret_scan.guessed_spans(text or "", base, words=words))


@pytest.mark.parametrize("seed", range(20))
def test_cut_is_least(seed):
    random.seed(seed)
    n = random.randint(1, 9)
    scores = [round(random.uniform(-3, 3), 2) for _ in range(n)]
    edges = [(i, i + 1, random.random() * 2) for i in range(n - 1)] + [(random.randrange(n), random.randrange(n), random.random()) for _ in range(n // 2)]
    edges = [e for e in edges if e[0] != e[1]]

    def cost(labels):
        return sum(-s if not k and s < 0 else 0 for s, k in zip([0] * n, labels)) + sum(
            max(s, 0) if not k else max(-s, 0) for s, k in zip(scores, labels)
        ) + sum(w for a, b, w in edges if labels[a] != labels[b])

    assert cost(html_extract.min_cut(scores, edges)) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=n))))


def test_pages_of_other_makes():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
    <div class="cookie-notice">We use cookies &amp; more.</div><div id="content"><h2>Real title</h2>
    <p>A long paragraph of the real <b>arti</b>cle, with words enough to count as content of the page.<p>The second one is shorter.
    <form><label>Email</label><input></form><div class="sidebar"><p>Other stories that you may like to read are listed here.</p></div>
    <ul><li>one item</li><li>two</li></ul><p>The last paragraph&nbsp;ends &lt;here&gt;.</p></div>
    <section class="comments"><article><p>I love this, it is really a great piece of writing.</p></article></section>
    <script>var a = "<p>no</p>";</script><footer>&copy; 2020</footer></body></html>"""
    text = html_extract.main_text(page)
    assert text.startswith("Real title A long paragraph of the real article, with") and text.endswith("paragraph ends <here>.")
    assert not any(x in text for x in ("cookies", "Email", "Other stories", "great piece", "2020", "Site", "no</p>"))


def test_names_inside_the_article():
    """Names alone drop nothing of an article; names with links do."""
    page = """<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>The first paragraph of the article has words enough.</p>
    <section id="discussion"><h2 class="section-header">Results</h2><p>We discuss what was found, at some length and with care.</p></section>
    <p id="share-price">The price rose by a tenth.</p><div class="legal-text">The law asks for a longer statement at this place, so here it is.</div>
    <div class="share"><a href=/t>Tweet this</a> <a href=/f>Send it on</a></div></article>
    <section class="comments"><p>I love this, it is really a great piece of writing.</p></section></body>"""
    text = html_extract.main_text(page)
    for kept in ("Results", "We discuss", "The price rose", "The law asks", "first paragraph"):
        assert kept in text
    assert not any(x in text for x in ("Tweet", "I love", "Home"))


@pytest.mark.parametrize("tag", ["<svg class=i />", "<svg>", "<canvas/>", '<object data="x">', '<video src="v"/>', "<template>", "<textarea>", "<select>"])
def test_raw_elements_without_an_end(tag):
    name = tag[1:].split()[0].strip("<>/")
    first, last = "<p>One paragraph that is long enough to be kept.</p>", "<p>Another one that follows it, to be kept as well.</p>"
    want = "One paragraph that is long enough to be kept. Another one that follows it, to be kept as well."
    assert html_extract.main_text(f"<article>{first}{tag}{last}</article>") == want
    if name not in html_extract.PLAIN:
        assert html_extract.main_text(f"<article>{first}{tag}{last}<{name}>no<{name}>no</{name}>no</{name}></article>") == want
    assert html_extract.main_text(f"<article>{first}<{name}>no</{name}>{last}<script>no</article>") == want
    assert html_extract.main_text(f"<svg>no</svg><iframe>no</iframe><article>{first}{last}</article><iframe>") == want


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x<"), (4, "u", "<nav>" * 3000), (5, "u", "<!-- never closed <p>hello</p>"), (5, "u", "<article>kept</article>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert [(r["page_id"], r["text"]) for r in got if r["text"]] == [(5, "kept")] and len(got) == len(rows)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_secret_spans_are_those_of_all_words(spark, sf_dir):
    """Whole table, with contexts of all three kinds in its texts, against one dictionary of every ranked word."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    value = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12)
    prose = F.regexp_extract(text, r"([A-Za-z]{4,})", 1)
    more = F.element_at(F.array(
        F.concat(F.lit("the passphrase is "), prose, F.lit("$"), value), F.concat(F.lit("Bearer "), F.base64(value)),
        F.concat(F.lit("db://me:"), value, F.lit("%x@host/")), F.concat(F.lit("token is "), prose),
    ), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    docs = table.select("doc_id", F.concat_ws(" ", text, more, F.lit("end")).alias("text"))
    words = secret_scan.Words({r["word"]: r["rank"] for r in secret_scan.ranked_words(docs).collect()})
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    guessed = {0: 0, 1: 0, 2: 0, 3: 0}
    for doc_id, text in docs.collect():
        base = secret_scan.base_spans(text)
        want = secret_scan.guessed_spans(text, base, words=words)
        assert got[doc_id]["spans"] == secret_scan.listed(base + want) and got[doc_id]["n_guess"] == len(want)
        guessed[doc_id % 4] += len(want) > 0
    assert min(guessed[k] for k in (0, 1, 2)) > 0 and guessed[3] < guessed[0]


LONG = "The council met on Monday to speak about the new bridge, which is to open in spring. It will cost more than was planned."
NAV = "<nav><a href=/>Home</a><a href=/b>News</a></nav>"


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><meta charset=utf-8><body>{nav}<article><p>{a}</p><p>{b}</p></article></body></html>",
    "<head><title>T</title>{nav}<article><p>{a}<p>{b}</article>",
    "<head><title>T</title><p>{a}<p>{b}",
    "<body><form method=post>{nav}<article><p>{a}</p><p>{b}</p></article><input type=submit></form><footer>Imprint</footer>",
    "<body><form method=post>{nav}<div><p>{a}</p><p>{b}</p></div></form>",
    "<body>{nav}<div><p>{a}</p><p>{b}</p></div><form><p>Your mail address</p></form><footer>Imprint</footer>",
    "<body>{nav}<p>{a}<p>{b}<footer>Imprint</footer>",
    "<body><article><ul><li>{a}<li>{b}</ul></article><aside><article><p>{a}</article></aside>",
])
def test_pages_as_they_are_written(page):
    """Optional end tags, forms around the page, no main element."""
    a, b = LONG, LONG.replace("Monday", "Friday")
    assert html_extract.main_text(page.format(nav=NAV, a=a, b=b)) == f"{a} {b}"


def test_hidden_and_comment_forms_stay_out():
    for mark in ("hidden", "class=comments"):
        assert html_extract.main_text(f"<body><form {mark}><p>{LONG}</p><p>{LONG}</p></form>") == ""


@pytest.mark.parametrize("tag", ["<b>", "<font>", "<div>", "<unknown>", "<ul><li>", "<li>", "<p>"])
def test_deep_pages_take_linear_time(tag):
    import time

    times = []
    for n in (10_000, 100_000):
        start = time.process_time()
        assert html_extract.main_text("<article>" + (tag + "word. ") * n).count("word") == n
        times.append(time.process_time() - start)
    assert times[1] < 40 * max(times[0], 0.02)


def test_pages_without_a_main_element_keep_their_text(spark, sf_dir):
    """A main text of a few words has little but its tag to speak for it, so such pages are apart."""
    kept = total = 0
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        want = html_extract.main_text(row.html)
        if want.count(" ") < 20:
            continue
        for other in ("div", "section"):
            page = row.html.replace("<article>", f"<{other}>").replace("</article>", f"</{other}>")
            kept += html_extract.main_text(page) == want
            total += 1
    assert total > 80 and kept >= 0.98 * total
