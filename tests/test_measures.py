"""A batch's measures against plain counting, text by text."""

import random
import re
from collections import Counter
from math import sqrt

import numpy as np
import pytest

from quillspark.functions import lexicons as lx
from quillspark.functions import measures as ms
from quillspark.functions import phrases, vectors
from quillspark.functions.text import phrase_pattern

ODD = [
    "", "   ", "a", "it's it's. It's!", "ABC Def. Ghi jkl", "step by step by step by step", "here are here are. As an AI, I cannot provide. in addition", "‘quoted’ “text” … ... — –", "\n\n- a\n* b\n1) c\n• d\n",
    "😀😁 ☀ text ½ İstanbul ΑΣ ΑΣ.", "http://a.b www.c @me u/x #tag /r/abc", "x\x0by\x1cz w", "Hello World. Foo?! Bar.\n\n\nBaz  \n qux", "a'b'c d'e", "word " * 3000,
]


def texts():
    rng = random.Random(1)
    signs, words = "aAbB zZ.!?\n',:;()\"é’…—1 2", ["the", "Leverage", "moreover", "tldr", "I", "you", "can't", "robust", "here's", "the thing", "x.", "Y!", "z?\n"]
    out = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    return [ms.normalized(t) for t in out + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(100)]]


def tokens(text):
    return [t.lower() for t in re.findall(r"[^\W_]+(?:'[^\W_]+)?", text.replace("‘", "'").replace("’", "'"))]


def variation(values):
    mean = sum(values) / len(values) if values else 0
    return sqrt(sum((x - mean) ** 2 for x in values) / len(values)) / mean if mean else 0.0


def plain(raw, reply):
    """Those metrics that are easy to state, by name."""
    cleaned = " ".join(raw.split())
    ts = tokens(cleaned)
    n, seen = len(ts), Counter(ts)
    sentences = [x for x in map(tokens, re.split("[.!?]+", cleaned)) if x]
    lengths, starters = [len(s) for s in sentences], [tuple(s[:2]) for s in sentences]
    share = lambda a, b: a / b if b else 0.0
    grams = lambda k: [tuple(ts[i : i + k]) for i in range(n - k + 1)]
    repeats = lambda xs: 1 - len(set(xs)) / len(xs) if xs else 0.0
    u = cleaned.lower().encode("utf-16-le")
    ws = [w for w in cleaned.split(" ") if w]
    windows = [len(set(ts[i : i + 25])) / 25 for i in range(n - 24)]
    return {
        "wordCount": n, "charCount": len(cleaned.encode("utf-16-le")) // 2, "sentenceCount": max(1, len(sentences)), "avgSentenceLen": sum(lengths) / len(lengths) if lengths else n, "sentenceLenCV": variation(lengths),
        "wordLenCV": variation([x for x in (len(t.replace("'", "")) for t in ts) if x]), "paragraphLenCV": variation([x for x in (len(tokens(p)) for p in raw.split("\n")) if x]), "typeTokenRatio": share(len(seen), n),
        "mattr25": sum(windows) / len(windows) if n > 25 else share(len(seen), n), "hapaxRatio": share(sum(c == 1 for c in seen.values()), n), "stopwordRatio": share(sum(t in lx.STOPWORDS for t in ts), n),
        "bigramRepeatRatio": repeats(grams(2)), "trigramRepeatRatio": repeats(grams(3)), "charTrigramRepeatRatio": repeats([u[i : i + 6] for i in range(0, len(u) - 4, 2)]), "sentenceStarterRepeatRatio": repeats(starters),
        "topWordShare": share(max(seen.values(), default=0), n), "numberTokenRatio": share(sum(bool(re.search(r"\d", t)) for t in ts), n),
        "properNounishRatio": share(sum(a[-1] not in ".!?" and bool(re.match("[^A-Za-z]*[A-Z][a-z]+", b)) for a, b in zip(ws, ws[1:])), n),
        "latinRatio": share(sum(c.isascii() and c.isalpha() for c in raw), sum(c.isalpha() for c in raw)), "isReply": reply,
        "urlCount": len(re.findall(r"(?i)\bhttps?://\S+|\bwww\.\S+", cleaned)), "mentionCount": len(re.findall(r"@\w+|(?:^|\s)/?[ur]/[A-Za-z0-9_-]+", cleaned)), "hashtagCount": len(re.findall(r"#\w+", cleaned)),
        "listMarkerCount": sum(bool(re.match(r"\s*(?:•|-|\*|\d+[.)])\s+", x)) for x in raw.split("\n")),
    }


@pytest.mark.parametrize("block", [1, 200, 1 << 19])
def test_metrics(monkeypatch, block):
    monkeypatch.setattr(ms, "BLOCK", block)
    raws, row = texts(), 0
    for i, j in ms.blocks(raws):
        m = ms.Batch(raws[i:j], [k % 3 == 0 for k in range(i, j)])
        profiles, cues = m.profiles(), m.cues()
        for k in range(i, j):
            want = plain(raws[k], k % 3 == 0)
            assert set(want) == set(ms.METRICS)
            for name, value in zip(ms.METRICS, m.metrics[k - i].tolist(), strict=True):
                assert value == pytest.approx(float(want[name]), abs=1e-12), (name, raws[k][:60])
            assert m.tokens()[k - i] == tokens(raws[k]) if block == 1 else True
            assert ((m.features[k - i] >= 0) & (m.features[k - i] <= 1)).all()
            assert np.allclose(profiles[k - i], vectors.profile(m.cleaned[k - i]), atol=1e-12)
            assert sum(cues[k - i]["sentences"]["lengths"]) == len(tokens(raws[k]))
            row += 1
    assert row == len(raws)


def test_one_scan_finds_what_patterns_find():
    every = [(f, i, re.compile(phrase_pattern(p))) for f, own in enumerate(lx.FAMILIES.values()) for i, p in enumerate(own)]
    some = [p for own in lx.FAMILIES.values() for p in own]
    rng = random.Random(2)
    for text in ["", "step by step by step", "tl;dr tldr, tldr", *(rng.choice([" ", "", ", ", "a", ". "]).join(rng.choice(some) for _ in range(30)) for _ in range(60))]:
        got, want = Counter(phrases.scan(text)), Counter()
        for f, i, pattern in every:
            if n := len(pattern.findall(text)):
                want[f, i] = n
        assert got == want, text
