import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import lexicons as lx
from quillspark.functions import text as tx
from quillspark.functions import vectors as vx
from quillspark.operators import features as fe


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,want",
    [(None, ""), ("  a ​b\r\n ", "a b"), ("１２３ ﬁ", "123 fi"), ("a\xa0b", "a b"), ("﻿x", "x")],
)
def test_normalize(spark, raw, want):
    assert tx.normalize_value(raw) == want
    assert one(spark, raw, tx.normalize(F.col("t"))) == want


@pytest.mark.parametrize(
    "raw,want",
    [("It’s OK", ["it's", "ok"]), ("it's2", ["it's2"]), ("a_b", ["a", "b"]), ("éx", ["e", "x"]), ("🙂 !", []), ("٣ Ⅷ", ["٣", "ⅷ"]), ("", [])],
)
def test_tokens(spark, raw, want):
    assert one(spark, raw, tx.tokenize(F.col("t"))) == want


def test_letter_suffix_tokens(spark):
    assert one(spark, "it's2", tx.tokenize(F.col("t"), tx.TOKEN_LETTER_SUFFIX)) == ["it's", "2"]


def test_phrases(spark):
    hits = lambda t, p: one(spark, t, tx.phrase_hits(tx.phrase_text(F.col("t")), p))
    assert hits("This revision is clearer.", ["vision"]) == 0
    assert hits("Let’s dive in. Let's dive in!", ["let's dive in"]) == 2
    assert hits("vision vision", ["vision"]) == 2
    assert hits("I cannot provide it", lx.HEDGE) == 3
    assert hits("tl;dr game-changer", ["tl;dr", "game-changer"]) == 2
    assert one(spark, "As such, overall", tx.phrase_match(tx.phrase_text(F.col("t")), lx.TRANSITION)) == ["overall", "as such"]


def test_units_and_hash(spark):
    assert one(spark, "a🙂b", tx.utf16_length(F.col("t"))) == 4
    assert one(spark, "abc", tx.fnv1a(tx.utf16_units(F.col("t")))) == 440920331
    from quillspark.streaming.rescore import fingerprint

    for text in ("", "abc", "é🙂 x"):
        assert one(spark, text, tx.fingerprint(F.lit("post"), F.col("t"))) == fingerprint("post", text)


def test_sentences(spark):
    assert one(spark, " One. Two!? three\nfour ", tx.sentences(F.col("t"))) == ["One", "Two", "three\nfour"]
    assert one(spark, "One. Two!? three\nfour", tx.sentences_cue(F.col("t"))) == ["One.", "Two!?", "three", "four"]


@pytest.mark.parametrize("n", [0, 1, 5, 24, 25, 26, 40, 90])
def test_token_stats_against_windows(spark, n):
    rng = np.random.default_rng(n)
    tokens = [f"w{i}" for i in rng.integers(0, 12, n)]
    got = spark.createDataFrame([(tokens,)], "t array<string>").select(tx.token_stats(F.col("t")).alias("x")).first().x
    counts = {t: tokens.count(t) for t in tokens}
    assert (got.distinct, got.hapax, got.top) == (len(counts), sum(c == 1 for c in counts.values()), max(counts.values(), default=0))
    if n > 25:
        assert got.mattr_sum == sum(len(set(tokens[i : i + 25])) for i in range(n - 24))


def test_excerpt_and_percent(spark):
    assert one(spark, "x" * 110, tx.excerpt(F.col("t"))) == "x" * 110
    assert one(spark, "x" * 111, tx.excerpt(F.col("t"))) == "x" * 107 + "…"
    assert one(spark, "a", tx.percent(F.lit(0.125))) == 13


def test_profile_against_plain_loop():
    for text in ("", "ab", "abc", "A b-12’s 🙂 end", "x" * 50):
        flat = " ".join("".join("0" if c in "0123456789" else c for c in text.replace("’", "'").lower()).split())
        raw = flat.encode("utf-16-le")
        u = [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]
        want = [0.0] * 128
        for size in (3, 4, 5):
            for i in range(len(u) - size + 1):
                h = 2166136261
                for x in u[i : i + size]:
                    h = ((h ^ x) * 16777619) % 2**32
                want[h % 128] += -1 if h >> 30 & 1 else 1
        assert vx.profile_counts(text).tolist() == want
    assert abs(np.linalg.norm(vx.profile("A varied sample with punctuation, contractions, and 123 numbers.")) - 1) < 1e-12


def feature_rows(spark, texts, kind="post"):
    df = spark.createDataFrame([(i, t, kind) for i, t in enumerate(texts)], "id int, text string, kind string")
    return {r.id: r for r in fe.extract(df).collect()}


def test_features_by_hand(spark):
    text = "I like tea. You like tea too: (yes)\n- one, two; three!\n2) four? www.x.io @me #tag \"q\"... 🙂"
    f = feature_rows(spark, [text])[0]
    m, x = f.metrics, f.features
    words = "i like tea you like tea too yes one two three 2 four www x io me tag q".split()
    assert f.tokens == words and m.wordCount == 19
    assert (m.urlCount, m.mentionCount, m.hashtagCount, m.listMarkerCount) == (1, 1, 1, 2)
    assert x.firstPersonRatio == 2 / 19 and x.secondPersonRatio == 1 / 19 and m.numberTokenRatio == 1 / 19
    assert m.typeTokenRatio == 17 / 19 and m.hapaxRatio == 15 / 19 and m.topWordShare == 2 / 19
    assert m.bigramRepeatRatio == pytest.approx(1 - 17 / 18) and m.trigramRepeatRatio == 0
    assert x.colonPer100w == pytest.approx(100 / 19 / 10) and x.semicolonPer100w == pytest.approx(100 / 19 / 6)
    assert x.punctuationVariety == 1.0 and x.emojiPresent == 1.0
    # sentences of the collapsed text: a newline ends none
    lengths = [3, 8, 2, 2, 4]
    sentences = ["I like tea", "You like tea too: (yes) - one, two; three", "2) four", "www", "x", "io @me #tag \"q\"", "🙂"]
    lengths = [3, 8, 2, 1, 1, 4]
    mean = sum(lengths) / len(lengths)
    cv = math.sqrt(sum((n - mean) ** 2 for n in lengths) / len(lengths)) / mean
    assert len(sentences) == 7 and m.sentenceCount == 6 and m.avgSentenceLen == pytest.approx(mean) and m.sentenceLenCV == pytest.approx(cv)
    assert x.newlineRatio == pytest.approx(min(1, 2 / (len(text) + 1) / 0.15))


def test_features_are_bounded_and_defined(spark):
    texts = ["", None, "   ", "🙂🙂", "你好世界", "word " * 30, "a", "x" * 5000, "1 2 3", "Great point. I agree!"]
    rows = feature_rows(spark, texts)
    for r in rows.values():
        assert all(0 <= v <= 1 for v in r.features) and all(v == v for v in r.metrics)
        norm = np.linalg.norm(r.char_ngrams)
        assert norm == 0 or abs(norm - 1) < 1e-12
    assert rows[0].features == rows[1].features and rows[0].metrics.sentenceCount == 1
    assert rows[4].language_support.state == "unsupported" and rows[5].language_support.state == "uncertain"
    assert rows[9].metrics.wordCount == 4 and rows[9].metrics.sentenceCount == 2


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(i, f"Text {i}. It's {i % 3} words, again and again!") for i in range(40)], "id int, text string")
    a, b = (sorted(map(str, fe.extract(x, kind=None).select("id", "features", "metrics").collect())) for x in (df.repartition(1), df.repartition(7)))
    assert a == b


def test_document_fingerprints(spark, tmp_path):
    """The registered query on whole texts: long ones, nulls and characters beyond the BMP included."""
    from quillspark.plans import registry
    from quillspark.streaming.rescore import fingerprint

    texts = [None, "", "a", "é\n😀 x", "\U0001f600" * 3, "word é 😀\n" * 20_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, registry.queries()["document_fingerprints"](spark, str(tmp_path)).collect()))
    assert got == {i: fingerprint("post", t or "") for i, t in enumerate(texts)}
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = dict(map(tuple, registry.document_fingerprints(spark, d).collect()))
    assert got == {r.doc_id: fingerprint("post", r.text or "") for r in docs}
