"""The pipeline on planted documents, stage by stage and end to end."""

import hashlib
import itertools
import random

import numpy as np

import corpus_pipeline
from paperspark.llm import bpe
from paperspark.llm.common import table

from .test_operators import DOC, VOCABULARY, WORD, frame, library, lower, prose, rule_base


def swapped(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = rng.choice(VOCABULARY) + "z"
    return " ".join(words)


def corpus():
    """(doc_id, text, fate): kept whole, ``gone`` or ``cut``."""
    rng = random.Random(43)
    item = prose(rng, 30)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.randint(60, 120)), "kept") for i in range(60)]
    add = lambda text, fate: rows.append((len(rows), text, fate))
    add(" ".join(rng.choice(VOCABULARY) + "#$%" for _ in range(60)), "gone")
    add(prose(rng, 12), "gone")
    add((prose(rng, 10) + "\n") * 8, "gone")
    add(None, "gone")
    add("", "gone")
    copied = prose(rng, 200)
    add(copied, "kept")
    add(copied, "gone")
    add(swapped(rng, copied, 2), "gone")
    head, tail = prose(rng, 60), prose(rng, 60)
    add(f"{head} {passage}\n{tail}", "kept")
    head, tail = prose(rng, 60), prose(rng, 60)
    add(f"{head} {passage}\n{tail}", ("cut", f"{head} \n{tail}"))
    add(f"{prose(rng, 40)} {item} {prose(rng, 40)}", "gone")
    add(f"{prose(rng, 40)} {swapped(rng, item, 3)} {prose(rng, 40)}", "gone")
    return rows, item


def written(spark, tmp_path, rows, items):
    frame(spark, [(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_end_to_end(spark, tmp_path):
    rows, item = corpus()
    path = written(spark, tmp_path, [r[:2] for r in rows], [item])
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    tok = library(bpe.TOKENIZER)
    want = {i: text if fate == "kept" else fate[1] for i, text, fate in rows if fate != "gone"}
    assert set(out) == set(want)
    for i, text in want.items():
        ids = tok.encode(text, add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert out[i]["n_tokens"] == len(ids) and bytes(out[i]["ids"]) == packed, (i, text)
        assert out[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_against_brute_force(spark, tmp_path):
    rows, item = corpus()
    path = written(spark, tmp_path, [r[:2] for r in rows], [item])
    docs = table(spark, path, "documents")
    stages = dict(corpus_pipeline.STAGES)
    ruled = stages["quality rules"](spark, docs, path)
    assert ruled.columns == docs.columns
    kept = {r["doc_id"] for r in ruled.collect()}
    for i, text, fate in rows:
        base = rule_base(text)
        assert i not in kept or not (base[0] < 20 or 100 * base[4] > 30 * base[0])
    assert {i for i, _, fate in rows if fate == "kept"} <= kept

    def shingles(text):
        w = WORD.findall(lower(text))
        return {tuple(w[k:k + 3]) for k in range(len(w) - 2)}

    sets = {r["doc_id"]: shingles(r["text"]) for r in ruled.collect()}
    least = {i: i for i in sets}
    for _ in sets:  # labels spread along links
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
        if all(least[least[i]] == least[i] for i in least):
            break
    single = stages["n-gram Jaccard join"](spark, ruled, path)
    assert single.columns == docs.columns
    assert {r["doc_id"] for r in single.collect()} == {i for i in least if least[i] == i}


def test_near_copies_by_five_words(spark, tmp_path):
    rng = random.Random(67)
    texts = [prose(rng, 100) for _ in range(6)]
    texts += [swapped(rng, t, n) for t in texts for n in (1, 2, 2, 3, 5)]

    def shingles(text):
        w = WORD.findall(lower(text))
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    sets = [shingles(t) for t in texts]
    least = list(range(len(sets)))
    for _ in sets:
        for a, b in itertools.combinations(range(len(sets)), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    path = written(spark, tmp_path, list(enumerate(texts)), [])
    single = corpus_pipeline.drop_near_copies(spark, table(spark, path, "documents"), path)
    assert {r["doc_id"] for r in single.collect()} == {i for i, x in enumerate(least) if i == x}


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    rng = random.Random(71)
    item = prose(rng, 30)
    clean = [(i, prose(rng, 80)) for i in (None, None, None, 7, 7, 8, (1 << 63) - 1)]
    junk = [(i, " ".join(rng.choice(VOCABULARY) + "#$%" for _ in range(60))) for i in (None, 7)]
    leaks = [(i, f"{prose(rng, 40)} {item} {prose(rng, 40)}") for i in (None, 7)]
    copies = [(None, clean[0][1]), (7, clean[3][1]), (None, clean[5][1].upper())]
    rest = [(100 + i, prose(rng, 80)) for i in range(30)]
    path = written(spark, tmp_path, clean + junk + leaks + copies + rest, [item])
    out = corpus_pipeline.run(spark, path).collect()
    found = sorted((r["doc_id"] or -1, r["decoded_sha256"]) for r in out)
    assert found == sorted((i or -1, hashlib.sha256(t.encode()).hexdigest()) for i, t in clean + rest)


def test_awkward_tables(spark, tmp_path):
    path = written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, path).collect() == []
    rng = random.Random(47)
    text = prose(rng, 80)
    rows = [(1, text), (1, text), (None, prose(rng, 50)), (2, text.upper()), (3, prose(rng, 90))]
    other = tmp_path / "again"
    other.mkdir()
    out = corpus_pipeline.run(spark, written(spark, other, rows, [None, ""])).collect()
    assert sorted((r["doc_id"] or -1) for r in out) == [-1, 1, 3]
