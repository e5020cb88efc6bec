"""Queries that SQL cannot express, against brute force over whole tables."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import edit_counts, pieces, token_records, toxicity

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_op2(spark, docs):
    tok, start = Tokenizer.from_file(token_records.tokenizer_path()), 0
    got = {r.doc_id: r for r in token_records.query(spark, DIR).collect()}
    assert len(got) == len(docs)
    for i in sorted(docs):
        ids = np.array(tok.encode(docs[i], add_special_tokens=False).ids + [0], dtype="<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def plain_nbest(model, text):
    """The n best scores and the best ids of a whole text, by lists of n best scores per position; ties go to the longest last piece."""
    text = model.normalize(text)
    scores, back = [[0.0]], [0]
    for p in range(1, len(text) + 1):
        ways = [(size, model.ids.get(text[p - size : p])) for size in range(1, min(model.longest, p) + 1)]
        ways = [(size, float(model.score[i]) if i is not None else model.fallback) for size, i in ways if i is not None or size == 1]
        scores.append(sorted((x + w for size, w in ways for x in scores[p - size]), reverse=True)[: model.n])
        back.append(max(size for size, w in ways if scores[p - size][0] + w == scores[p][0]))
    p, pieces = len(text), []
    while p:
        pieces.append(text[p - back[p] : p])
        p -= back[p]
    return scores[-1], [i for x in reversed(pieces) for i in model._ids_of(x)]


def test_op3(spark, docs):
    """Scores and best ids of every whole document."""
    model = pieces.Pieces(pieces.model_path())
    got = {r.doc_id: r for r in pieces.query(spark, DIR).collect()}
    assert len(got) == len(docs) and all(r.round_trip for r in got.values())
    for i, text in docs.items():
        scores, ids = plain_nbest(model, text)
        assert got[i].scores == pytest.approx(scores, rel=1e-12) and got[i].n_pieces == len(ids)
        assert got[i].ids_crc32 == got[i].nbest_crc32[0] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    for i in list(docs)[::10]:
        want = [zlib.crc32(np.array(ids, dtype="<u4").tobytes()) for _, ids in model.nbest(docs[i])]
        assert got[i].nbest_crc32 == want and len(set(want)) == len(want)


def test_op7(spark, docs):
    tok = Tokenizer.from_file(token_records.tokenizer_path())
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: r for r in edit_counts.query(spark, DIR).collect()}
    for i, t in docs.items():
        at = len(t) // 2
        edited = t[:at] + f" [edit {i}] " + t[at + 7 :]
        edited = "Re: " + edited[3:]
        cut = min(len(t) + 100, len(edited))
        edited = edited[:cut] + "\n-- end" + edited[cut:]
        assert (got[i].n_tokens, got[i].n_tokens_edited) == (n(t), n(edited))


def test_op6(spark, docs):
    out = toxicity.query(spark, DIR).collect()
    assert len(out) == len(docs) and all(0 <= r.severity <= toxicity.GRADES - 1 and r.toxic == (r.p_toxic >= 0.5) for r in out)
