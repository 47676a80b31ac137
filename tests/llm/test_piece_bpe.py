"""The piece codec against the sentencepiece library, and on awkward rows."""

import random
from array import array

import pytest

from paperspark.llm import piece_bpe
from paperspark.llm.common import prepare

DOC = "doc_id long, text string, ids string, decoded int"
PARTS = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "é", "日本", "\U0001f600", "<s>", "</s>", "<0x41>", "<unk>", "▁",
         "▁▁", "1", "²", "\x1c", "\x85", "!", "***", "\u0301", "Σ", "\x00", " " * 17, "Hello", "ization", "qu", "aaaa"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.tokenizer_path(piece_bpe.MODEL))


def unpacked(ids):
    return array("I", ids).tolist()


def texts(library, n, seed):
    """Strings of odd parts, and of pieces whose neighbours join otherwise."""
    rng = random.Random(seed)
    pieces = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    for k in range(n):
        if k % 2:
            yield "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        else:
            yield "".join(rng.choice(pieces).replace("▁", rng.choice(["", " "])) for _ in range(rng.randint(0, 30)))


def test_ids_and_texts_equal_the_library(library):
    enc = piece_bpe.codec(piece_bpe.MODEL)
    for text in texts(library, 3000, 1):
        ids = enc.encode(text)
        assert unpacked(ids) == library.encode(text, add_bos=True, add_eos=True), repr(text)
        assert enc.decode(ids) == library.decode(unpacked(ids)), repr(text)


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(2)
    enc = piece_bpe.codec(piece_bpe.MODEL)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(rng.randint(0, 10))]
        assert enc.decode(array("I", ids).tobytes()) == library.decode(ids), ids


def test_backtracking_equals_merging(library):
    """The laid tokens are those of plain merges over the whole chunk."""
    rng = random.Random(3)
    enc = piece_bpe.codec(piece_bpe.MODEL)
    for _ in range(3000):
        word = "".join(rng.choice("abeinorst▁") for _ in range(rng.randint(1, 24)))
        assert enc.split(word) == enc.merged(list(word)), word


def test_chunks_cut_no_piece():
    enc = piece_bpe.codec(piece_bpe.MODEL)
    assert enc.chunks("▁▁a(b\n▁c1▁") == ["▁▁a", "(", "b", "\n", "▁c", "1", "▁"]
    assert all(enc.chunks(p) == [p] for p in enc.id_of)


def test_rows(spark, library):
    prepare(spark)
    long = "x" * 60_000 + " " * 50_000 + "日" * 20_000 + "\n" * 1000
    rows = [(1, None), (2, ""), (3, " "), (4, "same text"), (4, "same text"), (None, "no id"), (5, long),
            (6, "word " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOC)
    out = piece_bpe.decode(piece_bpe.encode(docs)).collect()
    got = sorted((r["doc_id"] or -1, unpacked(r["ids"]), r["n_tokens"], r["decoded"]) for r in out)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i or -1, ids, len(ids), library.decode(ids)))
    assert got == sorted(want)
    assert piece_bpe.decode(piece_bpe.encode(docs.limit(0))).collect() == []
    bare = piece_bpe.encode(docs.where("doc_id = 2"), begin=False, end=False).first()
    assert (bare["n_tokens"], bytes(bare["ids"])) == (0, b"")


def test_plan_has_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = piece_bpe.decode(piece_bpe.encode(docs))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError):
        piece_bpe.PieceCodec(str(path))
