"""Cross-tokenizer alignment against a token-by-token version with both libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import alignment as X
from lectern.llm.queries import op12_alignment, piece_model_path, tokenizer_path

WHOLE = Tokenizer.from_file(tokenizer_path())
WHOLE.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def b_bytes(i):
    piece = PIECES.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if PIECES.is_byte(i) else piece.replace("▁", " ").encode()


def brute(rows):
    """(id, columns of the contract) of every row, from links listed one by one; A tokens' bytes come from the tokens' offsets in the text."""
    tokens = X.byte_tokens(tokenizer_path())[1]
    docs, held = [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a, b = WHOLE.encode(" " + (text or ""), add_special_tokens=False).ids, PIECES.encode(text or "")
        if not text or b"".join(tokens[i] for i in a) != raw or b"".join(map(b_bytes, b)) != raw:
            docs.append((doc_id, [], [], []))
            continue
        a_end, b_end = np.cumsum([len(tokens[i]) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()
        out, i, j = [], 0, 0
        for cut in sorted(set(a_end) & set(b_end)):
            p, q = a_end.index(cut) + 1, b_end.index(cut) + 1
            out.append((a[i:p], b[j:q]))
            i, j = p, q
        docs.append((doc_id, a, b, out))
        held.update({(x, y) for g in out for x in g[0] for y in g[1]})
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    result = []
    for doc_id, a, b, out in docs:
        pairs = [(x, y) for g in out for x in g[0] for y in g[1]]
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in out)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        result.append((doc_id, len(a), len(b), len(out), len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs), digest))
    return sorted(result, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ROWS = [(None, "some text"), (1, None), (2, ""), (3, "a▁b"), (3, "same words here"), (3, "same words here"), (4, " \n\t "), (5, "中文字 é😀 naïve"), (6, "<|endoftext|> and </s> <0x41>"), (7, "x" * 3000), (8, "word " * 900)]


def aligned(df):
    return sorted((tuple(r) for r in X.digests(X.align(df, tokenizer_path(), piece_model_path())).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("most", [4, 50, 1 << 20])
def test_awkward_rows(spark, monkeypatch, most):
    """Also with so few links at a time that groups are reduced to distinct ids and made in parts."""
    monkeypatch.setattr(X, "LINKS", most)  # workers are forked with it or not; the parts are also held below
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as block", "2 as part", "3 as n_a", "4 as groups").repartition(3)
    assert aligned(df) == brute(ROWS)
    assert aligned(df.limit(0)) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.lists(st.integers(0, 3), min_size=1, max_size=5)), max_size=8), min_size=1, max_size=4), st.sampled_from([1, 2, 7, 1000]))
def test_links_in_parts(docs, most):
    """Multiplicities, document counts and groups survive a block, however many links are made at a time."""
    rows = []
    for i, parts in enumerate(docs):
        a, b = (np.array([x for p in parts for x in p[k]], np.int64) for k in (0, 1))
        rows.append((i if i else None, a, b, *(np.array([len(p[k]) for p in parts], np.int64) for k in (0, 1))))
    before, X.LINKS = X.LINKS, most
    try:
        block = X.Encoded.unpack(X.Encoded.of(rows).pack())
    finally:
        X.LINKS = before
    held, names = Counter(), X.spelled(*block.parts)
    for i, (parts, (pair, times)) in enumerate(zip(docs, block.documents(), strict=True)):
        got = Counter()
        for key, n in zip(block.pairs[pair].tolist(), times.tolist()):
            got[key] += n
        want = Counter(x << 32 | y for p in parts for x in p[0] for y in p[1])
        assert got == want
        held.update(want.keys())
        assert [names[g] for g in block.places[block.at[i] : block.at[i + 1]]] == [f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in parts]
    assert dict(zip(block.pairs.tolist(), block.document_counts().tolist())) == held
    assert block.missing.tolist() == [not i for i in range(len(docs))]


def test_query(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op12_alignment(spark, tiny).select(*COLUMNS).collect()), key=str) == brute(docs)


def test_hot_pair_is_added_up_in_two_stages(spark):
    """A pair that every document holds arrives once a task and salt, and its count is that of all documents."""
    rows = [(i, "the same") for i in range(3000)]
    blocks = X.encoded_blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(24), tokenizer_path(), piece_model_path(), "doc_id", "text")
    counts = X.document_counts(blocks)
    assert {r.n for r in counts.collect()} == {3000}
    plan = counts._jdf.queryExecution().toString()
    assert plan.count("hashpartitioning(a") >= 1 and "salt" in plan


def test_bytes_of_both_vocabularies():
    text = "".join(map(chr, range(32, 0x250))) + "\0\x01\n\t中😀"
    encode, a, model, b = X.coders(tokenizer_path(), piece_model_path())
    assert a.join(np.array(encode([text])[0])) == text.encode()
    assert encode([text])[0] == WHOLE.encode(text, add_special_tokens=False).ids
    assert b.join(model.encode([text])[0]) == b" " + text.encode()
