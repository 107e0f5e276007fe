"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import pieces as M
from lectern.llm.queries import op13_pieces, piece_model_path

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
OURS = M.Pieces(piece_model_path())
LETTERS = "ab  \n\teé▁.,0中字\0😀x"


def ids_of(text, ours=OURS):
    return ours.encode([text])[0].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=60), max_size=6))
def test_encode(texts):
    """Texts of few letters, full of ties, spaces and characters without a piece; many texts at once."""
    ids, at = OURS.encode(texts)
    for i, text in enumerate(texts):
        got = ids[at[i] : at[i + 1]]
        assert got.tolist() == LIBRARY.encode(text)
        assert OURS.decode(got) == LIBRARY.decode(got.tolist())


def test_encode_pieces_of_the_vocabulary():
    """Pieces put side by side make merges whose results have better ranks than what is left of the round."""
    rng = random.Random(3)
    words = [LIBRARY.id_to_piece(i).replace(M.SPACE, " ") for i in range(259, OURS.n)]
    for _ in range(400):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(40)))
        assert ids_of(text) == LIBRARY.encode(text)


@pytest.mark.parametrize("long", [0, 3, 20])
def test_queue_of_long_words(monkeypatch, long):
    monkeypatch.setattr(M, "LONG", long)
    monkeypatch.setattr(M, "CHUNK", 50)
    monkeypatch.setattr(M, "KEPT", 20)
    ours, rng = M.Pieces(piece_model_path()), random.Random(long)
    texts = ["".join(rng.choice(LETTERS + "thequick") for _ in range(rng.randrange(90))) for _ in range(120)]
    ids, at = ours.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [LIBRARY.encode(t) for t in texts]


@pytest.mark.parametrize("text", ["x" * 60_000, "ab" * 20_000, " " * 20_000, "\n" * 5000, "word " * 30_000, "é́" * 9000])
def test_very_long_texts(text):
    ids, _ = OURS.encode([text, "", text])
    assert ids.tolist() == 2 * LIBRARY.encode(text)
    assert OURS.decode(np.array(LIBRARY.encode(text))) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.sampled_from([28705, 13164, 0, 1, 2])), max_size=9))
def test_decode_any_ids(ids):
    """Also ids no text encodes to: lone bytes, controls between bytes, unknowns."""
    assert OURS.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for doc_id, text in docs:
        ids = LIBRARY.encode(text or "")
        want.add((doc_id, len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids))))
    assert {tuple(r) for r in op13_pieces(spark, tiny).collect()} == want


def test_rows(spark):
    rows = [(None, "some text"), (1, None), (2, ""), (3, "a▁b"), (3, "a▁b"), (4, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as decoded").repartition(2)
    encoded = M.encode_pieces(df, piece_model_path())
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in encoded.collect()) == sorted((str(i), LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t in rows)
    assert M.encode_pieces(df.limit(0), piece_model_path()).count() == 0
    again = M.decode_pieces(encoded.select("doc_id", "ids", "decoded").unionByName(spark.createDataFrame([(9, None, None)], "doc_id long, ids array<int>, decoded string")), piece_model_path())
    assert sorted(str(r.text) for r in again.collect()) == sorted(["None", *(str(r.decoded) for r in encoded.collect())])
    with pytest.raises(Exception, match="vocabulary"):
        M.decode_pieces(spark.createDataFrame([(1, [40_000])], "doc_id long, ids array<int>"), piece_model_path()).collect()


def test_other_models(tmp_path):
    with open(piece_model_path(), "rb") as f:
        raw = f.read()
    (tmp_path / "m").write_bytes(raw.replace(b"\x1a\x12\n\x08identity\x12\x00\x18\x01 \x00", b"\x1a\x12\n\x08identity\x12\x00\x18\x01 \x01"))
    with pytest.raises(ValueError):
        M.Pieces(str(tmp_path / "m"))
