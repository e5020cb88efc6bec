import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quillspark.llm import token_records, words

ODD = ["", " ", "a", "Hello  world", "foo\n bar\n\n  baz\t", "x<|endoftext|> y <|endoftext|>", "!\x1c! a\x1cb", "don't we'll  'RE", "naïve ﬁ ½² 你好 🙂　z\xa0q \x85", "  lead", "trail  \n", "aя a² aª e\u0301x a_b a’s x3y3"]


def test_words_match_plain_split():
    texts = ODD + ["A bC\x0bd", "é\x0cÉ"]
    seen = {}
    for first, data, s, e, h, at in words.words_of(pa.array(texts), most=20):
        for k in range(len(at) - 1):
            got = [bytes(data[a:b]).decode() for a, b in zip(s[at[k] : at[k + 1]], e[at[k] : at[k + 1]])]
            want = [w for w in __import__("re").split("[\x20\x09-\x0d]+", texts[first + k]) if w]
            assert got == want
            for w, x in zip(got, h[at[k] : at[k + 1]]):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    low = [h for *_, h, _ in words.words_of(pa.array(["AbÉ abÉ aBé"]), lower=True)][0]
    assert low[0] == low[1] != low[2]


def test_windows():
    x = np.arange(1, 6, dtype=np.uint64)
    assert len(words.windows(x, 3)) == 3 and len(words.windows(x[:2], 3)) == 1 and len(words.windows(x[:0], 3)) == 0


def test_encoder_equals_whole_text_encoding():
    path = token_records.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), token_records.Encoder(path, most=50)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", "Be", " ", "  ", "\n", "'s", "1", "é", "!", "\x1c", "\xa0", "<|endoftext|>", " "]) for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert enc(t).tolist() == enc(t, chunk=7).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_records_round_trip(spark):
    path = token_records.new_path(spark, "t")
    rows = [(3, "c d"), (1, "a b"), (2, None), (None, "n"), (3, "c d"), (5, "x " * 3000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, start string")
    manifest = token_records.write(docs, path)
    out = token_records.read(manifest, path).collect()
    tok = Tokenizer.from_file(token_records.tokenizer_path())
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 3), (True, 5)]
    start = 0
    for r, (i, t) in zip(sorted(out, key=lambda r: r.start), sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    first = manifest.orderBy("shard").first()
    assert token_records.read_at(path, first.file, 0)[0] is None
    empty = token_records.write(docs.limit(0), token_records.new_path(spark, "t"))
    assert empty.count() == 0 and token_records.read(empty, path).count() == 0


def test_damage_is_found(tmp_path):
    data = bytearray(token_records.frame(b"abcdef"))
    data[14] ^= 1
    import io

    import pytest

    with pytest.raises(ValueError):
        list(token_records.unframe(io.BytesIO(bytes(data))))
