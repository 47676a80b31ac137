"""Each operator against a brute-force version, and on awkward rows: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperspark.llm import (
    bpe, chat, components, decontaminate, html_text, jaccard_join, language_model, passage_dedup,
    quality_model, quality_rules, token_counts,
)
from paperspark.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in "ka lo mi ne ru so ta vi".split() for b in "ba de fo gu li no pe ri sa tu".split()]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def frame(spark, rows, schema=DOC):
    prepare(spark)
    return spark.createDataFrame(rows, schema)


def documents(spark, texts):
    return frame(spark, [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)])


AWKWARD = [None, "", " \t\n ", "one", "one two", "A b c \x1c d\x85e", "x" * 5000, "é ß 日本 ΑΣ İ ﬁ <|endoftext|> 12 it's we'll",
           "́combining", "same text here again", "same text here again", "a\n\n\na  b   c \n"]


# --- quality model -------------------------------------------------------

def test_trees_learn_and_the_flat_walk_equals_a_plain_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = quality_model.fit(x, y, n_trees=20)
    score = forest.score(x)
    assert ((score > 0.5) == y).mean() > 0.95

    def plain(row):
        total = forest.prior
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += v[k - len(f)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(score[:50], [plain(r) for r in x[:50]])


def test_quality_scores(spark):
    rng = random.Random(2)
    good = [prose(rng, rng.randint(40, 90)) for _ in range(150)]
    junk = [" ".join([rng.choice(VOCABULARY) + "###"] * 60) for _ in range(50)]
    texts = good + junk + [None, ""]
    labels = frame(spark, [(i, int(i < 150)) for i in range(200)] + [(3, None), (3, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_model.score_quality(documents(spark, texts), labels).collect()}
    assert len(out) == len(texts)
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert all(out[i]["predicted"] == int(i < 150) for i in range(200))
    empty = quality_model.score_quality(documents(spark, []), labels)
    assert empty.collect() == []


# --- token counts and codec ----------------------------------------------

def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path(name))


def random_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ñ", "日", "\U0001f600", "<|endoftext|>", "<|",
             "|>", "1", "²", " ", "\x1c", "\x85", "!", "***", "́", "Σ", "​", "\x00", "A", "Z'S"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    texts = AWKWARD + random_texts(300) + ["word " * 3000]
    tok = library(token_counts.TOKENIZER)
    rows = documents(spark, texts).repartition(3).checkpoint()
    out = {r["doc_id"]: r for r in token_counts.token_counts(rows).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i]["n_tokens"] == len(tok.encode(t or "", add_special_tokens=False).ids), repr(t)
        assert out[i]["n_bytes"] == len((t or "").encode())
    again = frame(spark, [(7, "a b", 1), (7, "a b", 2), (None, "c", 3)], "doc_id long, text string, n_tokens int")
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.token_counts(again).collect()) == [
        (-1, 1), (7, 2), (7, 2)]
    assert token_counts.token_counts(documents(spark, [])).collect() == []


def test_postings_split_blocks_and_large_counts(spark, monkeypatch):
    from paperspark.llm import postings

    term, doc, n = np.array([0, 0, 2]), np.array([1, 5, 0]), np.array([700, 1, 255])
    present, rows = postings.packed(term, doc, n)
    entries = [np.frombuffer(x, postings.ENTRY) for x in rows.to_pylist()]
    assert present.tolist() == [0, 2] and [int(e["n"].sum()) for e in entries] == [701, 255]
    assert entries[0]["gap"].tolist() == [1, 0, 0, 4]


def test_codec_equals_the_library(spark):
    tok = library(bpe.TOKENIZER)
    codec = bpe.codec(bpe.TOKENIZER)
    texts = [t for t in AWKWARD if t] + random_texts(2000) + ["a" * 3000, "abcdefgh" * 500, " " * 300]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        packed = codec.encode(t)
        assert list(memoryview(packed).cast("I")) == ids, repr(t)
        assert codec.decode(packed) == tok.decode(ids, skip_special_tokens=False)
    out = bpe.decode(bpe.encode(documents(spark, AWKWARD + ["x y"]))).collect()
    assert {r["doc_id"]: r["decoded"] for r in out} == {i: t or "" for i, t in enumerate(AWKWARD + ["x y"])}
    assert bpe.decode(bpe.encode(documents(spark, []))).collect() == []


def test_forced_cuts_are_never_inside_a_token():
    codec = bpe.codec(bpe.TOKENIZER)
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(30))
        parts = codec.cut(data)
        assert b"".join(parts) == data
        whole = codec.merge_long([codec.byte_ids[b] for b in data])
        assert np.array(whole, "<u4").tobytes() == b"".join(map(codec.encode_fragment, parts))


# --- language model ------------------------------------------------------

def test_model_is_a_distribution_and_scores_match(spark):
    rng = random.Random(7)
    one, two = VOCABULARY[:40], VOCABULARY[40:]
    texts = [" ".join(rng.choice(one if i % 2 else two) for _ in range(60)) for i in range(120)] + [None, "", "ZZZ new word"]
    docs = documents(spark, texts)
    out = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    tokens = {i: [*WORD.findall(lower(t)), "\n"] for i, t in enumerate(texts)}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = out[i]
        assert (r["n_tokens"], r["train_tokens"]) == (len(ws), n)
        assert r["n_known"] == sum(count[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    held = [i for i in tokens if out[i]["held_out"] and i < 120]
    assert sum(out[i]["score"] for i in held) > sum(out[i]["base_score"] for i in held)
    # Sum of probabilities of all continuations of a history.
    counts = language_model.term_counts(docs, ~language_model.held_out(docs.doc_id))
    model, weights, _ = language_model.first_model(counts)
    language_model.update(model, language_model.gradient_sum(docs, model))
    tail = {r["term"].encode(): r["tail_score"] for r in weights.where("n_known > 0").collect()}
    symbols = model.symbols()
    history = [symbols[w.encode()] for w in texts[0].split()[:3]]
    total = 0.0
    for w, t in tail.items():
        total += 10 ** (float(language_model.score_texts(model, [np.array([*history, symbols[w]])])[0]) + t)
    base = 10 ** float(language_model.score_texts(model, [np.array(history)])[0])
    unknown = 1 - total / base  # the unknown word of every tail class
    assert -1e-4 < unknown < 0.2
    assert language_model.score_documents(documents(spark, [])).collect() == []


def test_skip_features_reach_both_factors():
    m = language_model
    rng = np.random.default_rng(73)
    head = [w.encode() for w in VOCABULARY]

    def model(**weights):
        return m.Model(head, np.zeros(m.CLASSES), np.zeros((m.HEAD_CLASSES, m.HEAD_SIZE)), **weights)

    factors = [model(weight=rng.normal(size=(m.BUCKETS, m.CLASSES))),
               model(head_weight=rng.normal(size=(m.BUCKETS, m.HEAD_SIZE)))]
    for factor, back in itertools.product(factors, (2, 3)):
        text = np.array([1, 2, 3, 4, 5])
        other = text.copy()
        other[4 - back] = 40
        score, last = (lambda t: m.score_texts(factor, [t, t[:-1]])), []
        for t in (text, other):
            whole, start = score(t)
            last.append(whole - start)
        assert abs(last[0] - last[1]) > 1e-6, back


# --- quality rules -------------------------------------------------------

def rule_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {i for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for i in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_rules(spark):
    rng = random.Random(11)
    good = [prose(rng, rng.randint(30, 80)) for _ in range(120)]
    bad = [" ".join(rng.choice(VOCABULARY) + "#%" for _ in range(50)) for _ in range(6)]
    caps = [prose(rng, 50).upper() for _ in range(6)]
    texts = good + bad + caps + AWKWARD + ["same line here\n" * 12, prose(rng, 10)]
    docs = documents(spark, texts).withColumn("grp", F.lit("x"))
    out = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        base = rule_base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base, repr(t)
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(out[i]["kept"] for i in range(120))
    assert not any(out[i]["kept"] for i in range(120, 132))
    assert quality_rules.judge(documents(spark, [])).collect() == []
    odd = frame(spark, [(1, good[0], None, None, 1), (1, good[0], None, None, 1), (None, good[1], "x", None, 1)])
    assert [r["kept"] for r in quality_rules.judge(odd).collect()] == [True] * 3


def test_robust_distance_matches_numpy(spark):
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(25, 60)) + "." * rng.randint(0, 9) + "#" * rng.randint(0, 4) for _ in range(80)]
    rows = quality_rules.judge(documents(spark, texts), group_cols=("lang",)).collect()
    names = list(quality_rules.FLOORS)
    floors = np.diag([quality_rules.FLOORS[n] ** 2 for n in names])
    x = np.array([[r[n] for n in names] for r in rows])
    centre = np.median(np.round(x, 2), axis=0)
    spread = 1.4826 * np.median(np.round(np.abs(x - centre), 2), axis=0)
    scatter = np.diag(spread ** 2) + floors
    for _ in range(quality_rules.STEPS):
        d = x - centre
        u = np.round(np.log(np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d) + 1e-6), 2)
        inner = x[u <= np.quantile(u, quality_rules.KEEP_SHARE)]
        centre = inner.mean(axis=0)
        scatter = quality_rules.CONSISTENCY * np.cov(inner.T, bias=True) + floors
    d = x - centre
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d)
    assert np.allclose([r["d2"] for r in rows], want, rtol=1e-6)


# --- html ----------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=a>Home</a><li><a href=b>About</a></ul></nav>
<script>var x="<p>no</p>";</script><div class="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; line</h1><p>First <b>bo</b>ld para.<br>next&nbsp;line<p>Second one, unclosed.
<div class="ad">Buy now</div><p>Et.</p></article><aside>See also</aside>
<div id="comments"><p>Nice post, I liked it a lot, thank you for writing it.</p></div>
<form><p>Search</p><input></form><footer>&copy; us</footer></body>"""


def test_page_text():
    assert html_text.main_text(PAGE)[0] == "Head & line First bold para. next line Second one, unclosed. Et."
    assert html_text.main_text(None)[0] == "" and html_text.main_text("")[0] == ""
    assert html_text.main_text("<p")[0] == "" and html_text.main_text("<script>x")[0] == ""
    assert html_text.main_text("<!-- open <p>x</p>")[0] == ""
    plain = "<div><p>" + "A long plain paragraph of words. " * 5 + "</p></div>"
    assert html_text.main_text(plain)[0].startswith("A long plain")


def test_cut_is_minimal():
    rng = random.Random(17)
    for _ in range(300):
        n = rng.randint(1, 8)
        costs = [rng.choice([-2, -1, -0.5, 0.3, 1, 2.2]) * rng.random() for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, min(n, i + 3))]

        def price(labels):
            return (sum(abs(c) for c, x in zip(costs, labels) if (c > 0) != x)
                    + sum(w for i, j, w in edges if labels[i] != labels[j]))

        best = min(map(price, itertools.product([True, False], repeat=n)))
        assert price(html_text.min_cut(costs, edges)) == pytest.approx(best)


def test_extract_rows(spark):
    pages = frame(spark, [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "", 9)],
                  "page_id long, url string, html string, text long")
    out = html_text.extract(pages).collect()
    assert sorted(len(r["text"]) > 0 for r in out) == [False, False, True, True]
    assert html_text.extract(pages.limit(0)).collect() == []


# --- passages ------------------------------------------------------------

def test_passages(spark):
    rng = random.Random(19)
    passage = prose(rng, 70).split()
    fuzzy = list(passage)
    fuzzy[30] = "other"
    del fuzzy[50]
    texts = [prose(rng, 80) + " " + " ".join(passage) + " " + prose(rng, 30),
             prose(rng, 20) + " " + " ".join(passage) + " " + prose(rng, 90),
             " ".join(fuzzy).upper() + " " + prose(rng, 60),
             prose(rng, 200), None, "", "short", prose(rng, 40) + " " + " ".join(passage[:30])]
    docs = documents(spark, texts)
    out = passage_dedup.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in out} == {1, 2} and {r["source"] for r in out} == {0}
    exact = next(r for r in out if r["doc_id"] == 1)
    assert (exact["start"], exact["end"], exact["source_start"], exact["n_equal"]) == (20, 90, 80, 70)
    near = next(r for r in out if r["doc_id"] == 2)
    assert near["start"] == 0 and 66 <= near["end"] <= 70 and near["n_equal"] >= 66
    left = {r["doc_id"]: r for r in passage_dedup.without_passages(docs).collect()}
    assert left[0]["text"] == texts[0] and left[3]["text"] == texts[3]
    assert left[1]["text"].split() == texts[1].split()[:20] + texts[1].split()[90:]
    assert left[1]["n_chars"] == len(left[1]["text"]) and set(left) == set(range(8))
    assert passage_dedup.repeated_passages(documents(spark, [])).collect() == []
    copies = documents(spark, [texts[3]] * 4)
    assert [r["doc_id"] for r in passage_dedup.without_passages(copies).collect()] == [0]


def test_fuzzy_passages_against_every_diagonal(spark):
    rng = random.Random(59)
    sources = [prose(rng, 150).split() for _ in range(12)]
    fuzzy = []
    for n, source in itertools.product((60, 100), sources[:6]):
        patterns = [[k % step != step // 2 for k in range(n)] for step in (5, 6, 7, 8, 10)]
        for share in (0.05, 0.1, 0.15, 0.2):
            out = set(rng.sample(range(n), int(share * n)))
            patterns.append([k not in out for k in range(n)])
        for equal in patterns:
            a = rng.randrange(150 - n)
            words = [w if e else w + "x" for w, e in zip(source[a:a + n], equal)]
            fuzzy.append(prose(rng, 30).split() + words + prose(rng, 30).split())
    texts = [*sources, *fuzzy]

    def longest(a, b):
        """Words of the longest passage on one diagonal with equal ends."""
        best = 0
        for shift in range(-len(b) + 50, len(a) - 49):
            same = [0 <= k - shift < len(b) and w == b[k - shift] for k, w in enumerate(a)]
            at, total = [k for k, e in enumerate(same) if e], np.cumsum([0, *same])
            best = max([best, *(j + 1 - i for i, j in itertools.combinations(at, 2)
                                if j + 1 - i >= 50 and total[j + 1] - total[i] >= 0.8 * (j + 1 - i))])
        return best

    want = {12 + i for i, f in enumerate(fuzzy) if longest(f, sources[i // 9 % 6]) >= 50}
    out = {r["doc_id"] for r in passage_dedup.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()}
    assert len(want) > 90 and out == want


def test_long_runs_of_a_word(spark):
    rng = random.Random(61)
    texts = [prose(rng, 60) + " the" * n + " " + prose(rng, 60) for n in (6, 12, 20, 40, 80, 90)]
    out = passage_dedup.repeated_passages(documents(spark, texts)).collect()
    assert {(r["doc_id"], r["source"]) for r in out} == {(5, 4)}


def test_passages_share_seven_seeds():
    k, least, share = passage_dedup.K, passage_dedup.MIN_WORDS, passage_dedup.MIN_EQUAL
    for n in range(least, 4 * least):
        # Fewest seeds by changed words used and length of the current run.
        states = {(0, 0): 0}
        for _ in range(n):
            after = {}
            for (changed, run), seeds in states.items():
                for to, s in (((changed, min(run + 1, k)), seeds + (run + 1 >= k)), ((changed + 1, 0), seeds)):
                    if to[0] <= (1 - share) * n + 1e-9:
                        after[to] = min(after.get(to, n), s)
            states = after
        assert min(states.values()) >= 7 > passage_dedup.MIN_SEEDS


def test_chains_are_best_among_all():
    rng = random.Random(23)
    for _ in range(100):
        n = rng.randint(1, 7)
        parts = np.array(sorted([x, x + 7, y, 7] for x, y in (
            (rng.randrange(60), rng.randrange(60)) for _ in range(n))))
        found = passage_dedup.chains_of(parts)
        assert sorted(i for c in found for i in c) == list(range(n))

        def value(chain):
            total = 0
            for k, i in enumerate(chain):
                total += parts[i][3]
                if k:
                    j = chain[k - 1]
                    if parts[j][1] > parts[i][0] or parts[j][2] + 7 > parts[i][2]:
                        return -1e9
                    total -= passage_dedup.GAP * (parts[i][0] - parts[j][1] + parts[i][2] - parts[j][2] - 7)
            return total

        best = max(value(c) for k in range(1, n + 1) for c in itertools.combinations(
            sorted(range(n), key=lambda i: (parts[i][0], parts[i][2])), k))
        assert value(found[0]) == pytest.approx(best)


# --- decontamination -----------------------------------------------------

def test_overlaps(spark):
    rng = random.Random(29)
    item = prose(rng, 24).split()
    swapped = list(item)
    swapped[3], swapped[15] = "xx", "yy"
    short = "quite a short item of nine words in all"
    texts = [prose(rng, 50), prose(rng, 9) + " " + " ".join(item).upper() + ". " + prose(rng, 9),
             " ".join(swapped), short + "!", None, "", " ".join(item[:7]) + " " + prose(rng, 30)]
    docs = documents(spark, texts).withColumnRenamed("lang", "item_id")
    bench = frame(spark, [(1, " ".join(item)), (2, short), (3, None), (4, ""), (5, "of it"), (1, " ".join(item))],
                  "item_id long, text string")
    out = sorted((r["doc_id"], r["item_id"], r["offset"], r["n_equal"], r["n_item"])
                 for r in decontaminate.overlaps(docs, bench).collect())
    assert out == [(1, 1, 9, 24, 24), (2, 1, 0, 22, 24), (3, 2, 0, 9, 9)]
    left = decontaminate.without_overlaps(documents(spark, texts), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 4, 5, 6]
    assert decontaminate.overlaps(docs, bench.limit(0)).collect() == []
    assert decontaminate.overlaps(docs.limit(0), bench).collect() == []


def most_equal_unseen(masks, n):
    """Most equal words of a pattern of ``n`` words that holds no mask."""
    span = max(map(len, masks))
    bits = [sum(1 << (len(m) - 1 - k) for k, c in enumerate(m) if c == "1") for m in masks]
    states = {0: 0}
    for _ in range(n):
        after = {}
        for state, equal in states.items():
            for bit in (0, 1):
                last = (state << 1 | bit) & ((1 << span) - 1)
                if not any(last & m == m for m in bits):
                    last &= (1 << span - 1) - 1
                    after[last] = max(after.get(last, 0), equal + bit)
        states = after
    return max(states.values())


def test_masks_meet_every_pattern_of_least_share():
    for n in range(decontaminate.LEAST_WORDS, 200):
        masks = decontaminate.SEED_MASKS if n >= decontaminate.SPAN else decontaminate.SHORT_MASKS
        assert most_equal_unseen(masks, n) < decontaminate.LEAST_SHARE * n - 1e-9, n


def test_overlaps_against_every_offset(spark):
    rng = random.Random(53)
    items = [prose(rng, n).split() for n in (5, 6, 8, 9, 11, 12, 13, 16, 28, 40, 59)]
    texts = []
    for item in items:
        patterns = [[k % step != 1 for k in range(len(item))] for step in (3, 4, 5)]
        patterns += [[rng.random() > share for _ in item] for share in (0.2, 0.3, 0.4) for _ in range(6)]
        for equal in patterns:
            words = [w if e else w + "x" for w, e in zip(item, equal)]
            texts.append(" ".join([prose(rng, rng.randint(0, 20)), *words, prose(rng, rng.randint(0, 20))]))
    want = {}
    for d, text in enumerate(texts):
        words = text.split()
        for i, item in enumerate(items):
            same = [(sum(0 <= o + k < len(words) and words[o + k] == w for k, w in enumerate(item)), -o)
                    for o in range(-len(item), len(words))]
            n, o = max(same)
            if n >= decontaminate.LEAST_SHARE * len(item):
                want[d, i] = (-o, n)
    bench = frame(spark, [(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): (r["offset"], r["n_equal"])
           for r in decontaminate.overlaps(documents(spark, texts), bench).collect()}
    assert len(want) > 100 and {k: out.get(k) for k in want} == want


# --- Jaccard join --------------------------------------------------------

def test_components_of_random_graphs(spark):
    rng = random.Random(31)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    out = {r["node"]: r["component"] for r in components.components(frame(spark, edges, "a long, b long")).collect()}
    assert all(out.get(x, x) == find(x) for x in parent)


@pytest.mark.parametrize("rounds", [1, 3])
def test_jaccard_components(spark, rounds):
    rng = random.Random(37)
    texts = [None, "", "one", "ONE", "two words", "two  words", "a b c", "a b c"]
    for _ in range(12):  # chains of edits: ends may link only through others
        words = prose(rng, rng.randint(30, 90)).split()
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(words))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY) + "x"
    line = prose(rng, 13)
    texts += [line + " " + w for w in VOCABULARY[:30]]
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    out = {r["doc_id"]: r for r in jaccard_join.similar_components(documents(spark, texts), rounds=rounds).collect()}
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i in range(len(texts))] == [
        (len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_unlinked_copies(spark, monkeypatch):
    """Near copies of one text, each with an edit of its own: every two share
    most of their shingles, few link. The pairs compared stay in proportion."""
    base = [f"{w}{k}" for k, w in enumerate(prose(random.Random(43), 62).split())]
    texts = []
    for i in range(240):  # edits at one place leave links, at two none
        k = 3 + 5 * (i % 12)
        texts.append(" ".join([*base[:k], f"own{i}", *base[k + 1:]]))
    pairs, compared = [], jaccard_join.possible

    def counted(found, *rest):
        found = found.localCheckpoint()
        pairs.append(found.count())
        return compared(found, *rest)

    monkeypatch.setattr(jaccard_join, "possible", counted)
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", 16)
    want = brute_force_components(texts)
    found = jaccard_join.similar_components(documents(spark, texts), rounds=0)
    out = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert [out[i] for i in range(len(texts))] == want
    assert len(set(want)) == 12
    assert sum(pairs) < 20 * len(texts)  # of 28,680


def brute_force_components(texts, percent=90):
    sets = [{tuple(w[k:k + 3]) for k in range(len(w) - 2)} for w in (t.split() for t in texts)]
    least = list(range(len(sets)))
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
             if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while True:
        again = list(least)
        for i, j in links:
            again[i] = again[j] = min(again[i], again[j])
        if again == least:
            return least
        least = again


def test_jaccard_awkward_rows(spark):
    rows = frame(spark, [(5, "a b c", "x"), (5, "a b c", "y"), (None, "a b c", "z")], "doc_id long, text string, key string")
    out = jaccard_join.similar_components(rows).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in out) == [(-1, 1), (5, 1), (5, 1)]
    assert jaccard_join.similar_components(rows.limit(0)).collect() == []


# --- chat ----------------------------------------------------------------

def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", r"[\TURN]\\<s>", "[ROLE]", "", None, "<", "[", "<</s>", "a[/ROLE]b", "日本<s>"]
    rng = random.Random(41)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", "[ROLE]", None]),
                         "".join(x or "" for x in rng.choices(nasty, k=2)) if t else rng.choice(nasty), "x"))
    rows += [(99, None, "user", "first", "x"), (99, 0, "user", "tie b", "x"), (99, 0, "user", "tie a", "x"),
             (99, 0, "user", "tie a", "x")]
    out = chat.format_chat(frame(spark, rows, "conv_id long, turn long, role string, text string, formatted string"))
    read = {r["conv_id"]: r["turns"] for r in chat.read_chat(out).collect()}
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or "", role == "assistant"))
    assert {c: [tuple(t) for t in turns] for c, turns in read.items()} == want
    for r in out.collect():  # the mask covers the escaped assistant texts
        at, covered = 0, ""
        for chars, loss in r["loss_mask"]:
            covered += r["formatted"][at:at + chars] if loss else ""
            at += chars
        assert at == len(r["formatted"])
        plain = re.sub(chat.ESCAPED_RE, r"\1\2", covered)
        if not any("\\" in t or "<" in t or "[" in t for _, t, loss in want[r["conv_id"]] if loss):
            assert plain == "".join(t for _, t, loss in want[r["conv_id"]] if loss)
    assert chat.format_chat(out.limit(0).selectExpr("conv_id", "conv_id turn", "formatted role", "formatted text")).collect() == []


def test_digests_are_of_the_plain_turns(spark, tmp_path):
    from paperspark.llm.queries import op10_chat_format

    frame(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    out = {r["conv_id"]: r for r in op10_chat_format(spark, str(tmp_path)).collect()}
    assert set(out) == {-1, 1}
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\na\n").hexdigest()
    assert out[1]["loss_sha256"] == hashlib.sha256(b"a").hexdigest() and out[1]["loss_chars"] == 1
    assert out[-1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


# --- what workers hold and repeat -----------------------------------------

def test_no_worker_keeps_the_memos_of_an_encoder(spark):
    import pyarrow as pa

    rng = random.Random(3)
    docs = documents(spark, [prose(rng, 50) for _ in range(64)]).repartition(16)
    assert bpe.decode(bpe.encode(docs)).count() == 64

    def held(batches):
        codec = bpe.codec(bpe.TOKENIZER)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(codec.memo) + len(codec.spaced)] * batch.num_rows, pa.int64())], names=["held"])

    assert {r["held"] for r in docs.select("doc_id").mapInArrow(held, "held long").collect()} == {0}


def small_model(seed=0):
    m, rng = language_model, np.random.default_rng(seed)
    shapes = (m.CLASSES,), (m.HEAD_CLASSES, m.HEAD_SIZE), (m.BUCKETS, m.CLASSES), (m.BUCKETS, m.HEAD_SIZE)
    head = [b"\n", *(w.encode() for w in VOCABULARY[:40])]
    return m.Model(head, *(rng.normal(size=s).astype(np.float32) for s in shapes),
                   common={w: i for i, w in enumerate([*head, b"www"])}, base_score=-np.ones(len(head) + 1),
                   tail_score=np.append(np.zeros(len(head)), -0.5))


def test_a_history_is_computed_once_and_counts_as_often_as_it_occurs(monkeypatch):
    m, model, rng = language_model, small_model(), random.Random(5)
    symbols = model.symbols()
    texts = [np.array([symbols[t] for t in m.tokens_of(prose(rng, n))]) for n in (0, 3, 40)] * 30
    computed = []

    class Step(m.Step):
        def __init__(self, *args):
            super().__init__(*args)
            computed.append(len(self.total))

    monkeypatch.setattr(m, "Step", Step)
    got = m.Gradient()
    got.add(model, texts)
    seen = [np.zeros((m.BUCKETS, n)) for n in (m.CLASSES, m.HEAD_SIZE)]
    expected = [np.zeros((m.BUCKETS, n)) for n in (m.CLASSES, m.HEAD_SIZE)]
    histories, scores = [set(), set()], []
    for text in texts:
        log, past = 0.0, [m.BEGIN] * 3
        for s in text:
            p3, p2, p1 = (np.array([p]) for p in past)
            buckets = [int(b[0]) for b in (m.hashed(1, p1), m.hashed(2, p2), m.hashed(3, p3), m.hashed(4, p1, p2))]
            group = int(m.class_of(np.array([s]))[0])
            factors = [(0, buckets, model.bias, model.weight, group)]
            histories[0].add(tuple(past))
            if s < m.HEAD:
                own = [(b * 31 + group * 2053) % m.BUCKETS for b in buckets]
                factors.append((1, own, model.head_bias[group], model.head_weight, s % m.HEAD_SIZE))
                histories[1].add((*past, group))
            for level, own, bias, weight, target in factors:
                total = np.exp(bias.astype(float) + sum(weight[b].astype(float) for b in own))
                log += math.log10(total[target] / total.sum())
                for b in own:
                    seen[level][b, target] += 1
                    expected[level][b] += total / total.sum()
            past = [*past[1:], s]
        scores.append(log)
    assert sum(computed) == sum(map(len, histories))
    for level in range(2):
        assert (got.seen[level].reshape(seen[level].shape) == seen[level]).all()
        assert np.allclose(got.expected[level], expected[level], rtol=1e-4, atol=1e-5)
    assert np.allclose(m.score_texts(model, texts), scores, rtol=1e-5)


def test_common_words_have_no_postings():
    model = small_model()
    words = language_model.Words(model)
    texts = ["kaba zzz kaba", None, "kaba", "yyy zzz www zzz www"]
    from paperspark.llm.postings import block_frequencies

    names, term, doc, n = block_frequencies(words, [words.add(t) for t in texts])
    assert {(names[t], int(d), int(k)) for t, d, k in zip(term, doc, n)} == {
        ("zzz", 0, 1), ("yyy", 3, 1), ("zzz", 3, 2)}
    assert [(f[0], *f[2:]) for f in words.facts] == [
        (4, 3, -3.0, 0.0), (1, 1, -1.0, 0.0), (2, 2, -2.0, 0.0), (6, 3, -3.0, -1.0)]
