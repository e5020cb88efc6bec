"""Language identification: a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, so that all windows of a batch take their steps
together. Within a window one network reads forwards and one backwards; at every position both states give the
probabilities of the languages, so each byte gets a label. A document's probabilities are the means over
all its positions. A unit is gated as usual (update gate z, reset gate r, candidate c; the reset follows the
product with the state); the gates are piecewise linear, clip(x, 0, 1), which costs a third of a sigmoid.

    z, r = clip(E_zr[byte] + U_zr h, 0, 1)    c = tanh(E_c[byte] + r * (U_c h))    h' = c + z * (h - c)

Fitting is backpropagation through time in numpy with Adam, on the driver, over a bounded sample: about PER_LANG
documents of each of the LANGS most frequent languages (chosen by a hash of the id, among those that may be
learned from), SAMPLE_WINDOWS windows of each. The driver gets these windows alone, WINDOW bytes each. Prediction
covers every byte of every text in one pass without a shuffle; what the tasks carry is some thousand weights.

Defined cases: a text that is null or has no letter is ``und`` with score 0; where nothing can be learned
everything is; where only one language is known it has score 1. Rows without a doc_id are predicted and learned from as
others (their id counts as the empty text); repeated rows are predicted row by row; an empty table gives an
empty result. A very long text is worked off in blocks of BLOCK windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import text_of

WINDOW, HIDDEN, BLOCK = 64, 8, 4096
LANGS, PER_LANG, SAMPLE_WINDOWS = 64, 400, 4
STEPS, BATCH, RATE, SEED = 300, 128, 0.02, 7
UND = "und"
#: Documents whose id's crc32 has this remainder by four are never learned from.
HELD_OUT = 2


@dataclass
class Network:
    """langs; for each direction E (3H x 256) and U (3H x H); V (2 x L x H) and bias (L) of the output."""

    langs: list[str]
    e: np.ndarray
    u: np.ndarray
    v: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        e, u = rng.normal(0, 0.3, (2, 3 * hidden, 256)), rng.normal(0, 0.5 / hidden**0.5, (2, 3 * hidden, hidden))
        e[:, : 2 * hidden] = e[:, : 2 * hidden] / 4 + 0.5
        u[:, : 2 * hidden] /= 4
        v = rng.normal(0, 0.3, (2, len(langs), hidden))
        return cls(langs, *(x.astype(np.float32) for x in (e, u, v, np.zeros(len(langs)))))

    def weights(self) -> list[np.ndarray]:
        return [self.e, self.u, self.v, self.bias]


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _step(net: Network, d: int, x: np.ndarray, h: np.ndarray, out: np.ndarray, work: tuple[np.ndarray, np.ndarray]) -> None:
    """One step of direction ``d`` for all windows: bytes x and states h to states ``out``."""
    n, k = len(x), h.shape[0]
    a, g = work[0][:, :n], work[1][:, :n]
    np.take(net.e[d], x, axis=1, out=a, mode="clip")
    np.matmul(net.u[d], h, out=g)
    gates, c = g[: 2 * k], g[2 * k :]
    gates += a[: 2 * k]
    np.clip(gates, 0, 1, out=gates)
    c *= gates[k:]
    c += a[2 * k :]
    np.tanh(c, out=c)
    np.subtract(h, c, out=out)
    out *= gates[:k]
    out += c


def windows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, bytes) of all windows of texts that lie between the offsets ``at``, longest windows first."""
    n = -(-np.diff(at) // WINDOW)
    text = np.repeat(np.arange(len(n)), n)
    first = at[text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    size = np.minimum(WINDOW, at[text + 1] - first)
    order = np.argsort(-size, kind="stable")
    return text[order], first[order], size[order]


def pooled(net: Network, data: np.ndarray, at: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Mean probabilities (text x language) of texts that lie in ``data`` between the offsets ``at``; ``labels`` takes each byte's language."""
    k, n_langs = net.u.shape[2], len(net.langs)
    out = np.zeros((len(at) - 1, n_langs))
    if not n_langs:
        return out
    text, first, size = windows_of(at)
    width = min(BLOCK, max(len(text), 1))
    states, work = np.zeros((WINDOW, k, width), np.float32), (np.empty((3 * k, width), np.float32), np.empty((3 * k, width), np.float32))
    for b in range(0, len(text), BLOCK):
        own, start, length = text[b : b + BLOCK], first[b : b + BLOCK], size[b : b + BLOCK]
        live = np.searchsorted(-length, -np.arange(WINDOW), side="left")  # windows that have a byte at each step
        bytes_at = lambda t, start=start, live=live: data[start[: live[t]] + t].astype(np.intp)
        h = np.zeros((k, len(own)), np.float32)
        for t in range(int(length[0])):
            _step(net, 0, bytes_at(t), h[:, : live[t]], states[t, :, : live[t]], work)
            h = states[t]
        h, gathered = np.zeros((k, len(own)), np.float32), np.zeros((n_langs, len(own)), np.float32)
        spare = np.empty_like(h)
        for t in reversed(range(int(length[0]))):
            m = live[t]
            _step(net, 1, bytes_at(t), h[:, :m], spare[:, :m], work)
            h[:, :m] = spare[:, :m]
            p = net.v[0] @ states[t, :, :m]
            p += net.v[1] @ h[:, :m]
            p += net.bias[:, None]
            _softmax(p)
            gathered[:, :m] += p
            if labels is not None:
                labels[start[:m] + t] = p.argmax(axis=0)
        for j in range(n_langs):
            out[:, j] += np.bincount(own, gathered[j], len(out))
    return out / np.maximum(np.diff(at), 1)[:, None]


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of whole windows x (steps x windows) of languages y, and its gradient."""
    steps, n = x.shape
    k = net.u.shape[2]
    kept, states = [], np.zeros((2, steps, k, n), net.u.dtype)
    for d in (0, 1):
        h, own = np.zeros((k, n), net.u.dtype), {}
        for t in range(steps) if d == 0 else reversed(range(steps)):
            a, g = net.e[d][:, x[t]], net.u[d] @ h
            raw = a[: 2 * k] + g[: 2 * k]
            gates = np.clip(raw, 0, 1)
            c = np.tanh(a[2 * k :] + gates[k:] * g[2 * k :])
            own[t] = (h, gates, (raw > 0) & (raw < 1), g[2 * k :], c)
            h = c + gates[:k] * (h - c)
            states[d, t] = h
        kept.append(own)
    flat = states.transpose(0, 2, 1, 3).reshape(2, k, steps * n)
    p = _softmax(net.v[0] @ flat[0] + net.v[1] @ flat[1] + net.bias[:, None])
    target = np.tile(y, steps)
    loss = -float(np.log(np.maximum(p[target, np.arange(steps * n)], 1e-30)).mean())
    p[target, np.arange(steps * n)] -= 1
    p /= steps * n
    grads = [np.zeros_like(w) for w in net.weights()]
    grads[2][:] = p @ flat[0].T, p @ flat[1].T
    grads[3][:] = p.sum(axis=1)
    for d in (0, 1):
        from_output = (net.v[d].T @ p).reshape(k, steps, n)
        back, by_byte = np.zeros((k, n), net.u.dtype), np.empty((3 * k, steps, n), net.u.dtype)
        for t in reversed(range(steps)) if d == 0 else range(steps):
            h, gates, inside, g, c = kept[d][t]
            back = back + from_output[:, t]
            d_c = back * (1 - gates[:k]) * (1 - c * c)
            d_gates = np.concatenate([back * (h - c), d_c * g]) * inside
            d_g = np.concatenate([d_gates, d_c * gates[k:]])
            by_byte[: 2 * k, t], by_byte[2 * k :, t] = d_gates, d_c
            grads[1][d] += d_g @ h.T
            back = back * gates[:k] + net.u[d].T @ d_g
        for j in range(3 * k):
            grads[0][d, j] = np.bincount(x.ravel(), by_byte[j].ravel(), 256)
    return loss, grads


def train(langs: list[str], windows: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Network:
    """A network from windows (n x WINDOW bytes) and the numbers of their languages; the same for the same rows in the same order."""
    net, rng = Network.fresh(langs), np.random.default_rng(SEED)
    if len(langs) < 2:
        return net
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    x = windows.T.astype(np.intp)
    for i in range(1, steps + 1):
        at = rng.choice(len(y), BATCH)
        _, grads = gradients(net, x[:, at], y[at])
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
        rate = RATE * min(1.0, i / 20) * (1 - 0.9 * i / steps)
        for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
            m += 0.1 * (g / norm - m)
            v += 0.01 * ((g / norm) ** 2 - v)
            w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return net


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def has_letter() -> Column:
    return text_of().rlike(r"\p{L}")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offsets of its texts in them."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """lang and ``win`` (WINDOW bytes) of the windows to learn from: SAMPLE_WINDOWS of each of about ``per_lang`` documents of a language."""
    known = docs.where(~held_out() & has_letter() & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not counts:
        return known.sparkSession.createDataFrame([], "lang string, win binary")
    most = 2**32
    upto = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(most, most * per_lang // n)))), F.col("lang"))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", F.length("text")), F.lit(most)) < upto)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                raw = raw * -(-WINDOW // len(raw)) if len(raw) < WINDOW else raw  # a short text is repeated to fill a window
                rng = np.random.default_rng(zlib.crc32(raw))
                for at in rng.integers(0, len(raw) - WINDOW + 1, SAMPLE_WINDOWS).tolist():
                    langs.append(lang)
                    found.append(raw[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "win"])

    return chosen.select("lang", text_of().alias("text")).mapInArrow(cut, "lang string, win binary")


def fit(docs: DataFrame, per_lang: int = PER_LANG, steps: int = STEPS) -> Network:
    """A network learned from the text and lang of documents that are not held out."""
    got = sorted((r.lang, bytes(r.win)) for r in sample(docs, per_lang).collect())
    langs = sorted({lang for lang, _ in got})
    number = {lang: i for i, lang in enumerate(langs)}
    windows = np.frombuffer(b"".join(w for _, w in got), dtype=np.uint8).reshape(-1, WINDOW)
    return train(langs, windows, np.array([number[lang] for lang, _ in got], dtype=np.int64), steps)


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ``probabilities`` (lang to mean probability over all positions; empty for ``und``) of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = pooled(net, *_bytes(batch.column(3)))
            known = batch.column(2).to_numpy(zero_copy_only=False) & bool(net.langs)
            best = p.argmax(axis=1) if net.langs else np.zeros(len(known), np.int64)
            score = [float(min(1.0, p[i, j])) if k else 0.0 for i, (j, k) in enumerate(zip(best.tolist(), known.tolist(), strict=True))]
            lang = [net.langs[j] if k else UND for j, k in zip(best.tolist(), known.tolist(), strict=True)]
            maps = [list(zip(net.langs, row, strict=True)) if k else [] for row, k in zip(p.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "held_out", "lang_pred", "score", "probabilities"],
            )

    # a text without letters need not be read through
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), has_letter().alias("known"), F.when(has_letter(), text_of()).otherwise("").alias("text"))
    return rows.mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double, probabilities map<string,double>")


def spans(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and ``spans`` of each row: the runs of bytes with one language each (first byte, byte after the last, lang), over the whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes(batch.column(1))
            labels = np.zeros(len(data), np.int16)
            pooled(net, data, at, labels)
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                cut = np.flatnonzero(np.diff(labels[a:b])) + 1
                bounds = [0, *cut.tolist(), b - a] if b > a and net.langs else [0]
                out.append([{"start": i, "end": j, "lang": net.langs[labels[a + i]]} for i, j in zip(bounds[:-1], bounds[1:], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(task, "doc_id long, spans array<struct<start:long,end:long,lang:string>>")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: language of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
