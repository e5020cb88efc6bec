"""SentencePiece encoding and decoding: N-best segmentation by A-star over the piece lattice.

A text is normalised as the model asks (a leading space where it adds one, spaces as U+2581) and its
lattice holds an edge for every piece that matches; a character that is no piece by itself has an edge
that falls back to byte pieces. Forward Viterbi gives the best score from the start to each position.
The search then goes backward from the end: a hypothesis of score g at position p is ranked by
viterbi[p] + g, which is what its best completion scores exactly, so complete hypotheses are popped in
order of score and each pop lies on one of the n best paths. What is kept is how far that lies below the
best: an edge on a best way adds exactly 0, so rounding makes no ties or breaks them. Ties go to the
hypothesis pushed last, the longest piece last, so a complete path is reached after its length in pops
however many paths tie. Hypotheses on the agenda have no path in common and each completes to its rank, so
all beyond the first n - found can be let go: an agenda never holds more than n, and time and memory grow
with a part's length.

Pieces never hold a U+2581 after another character, so a lattice falls apart before each run of them, and
between a letter and a mark where the model has no piece across (both are checked as it is loaded); the
parts are searched once per distinct part and cached (bounded). For a document, the n least sums of
losses are combined from its parts: only the n - 1 parts with the least first losses can take part.
Parts of up to LONG characters are searched many at a time in arrays, longer ones one by one; both
follow the same order of pushes and give the same paths.

Decoding joins pieces and bytes; a text comes back as it was, but for U+2581, which becomes a space,
and damaged byte sequences, which become U+FFFD.

Defined cases: null or empty text has no ids and the single score 0; scores are shorter than n where
fewer segmentations exist; repeated rows are encoded row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import kept_by_worker, text_of

SPACE = "▁"
N_BEST, LONG, BATCH = 4, 48, 4096
#: Parts that a worker keeps, and how many where its executor has other stages' memory to hold as well.
PARTS, FEW_PARTS = 800_000, 250_000
#: Characters and ids of kept parts: text without spaces has long parts that never come back.
UNITS = 32_000_000
_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Finer, for models without pieces that go on from a letter to one of these marks.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r".,;:!?|\"$%&*#()\n-"
_FINE = re.compile(f"{SPACE}*+[{_LETTERS}]++(?=[{SPACE}{_MARKS}]|\\Z)|{SPACE}*+[^{SPACE}]+?(?:(?<=[{_LETTERS}])(?=[{_MARKS}])|(?={SPACE})|\\Z)|{SPACE}+".replace(r'\"', '"'))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _hash(points: np.ndarray) -> np.ndarray:
    """Prefix hashes of the rows of a matrix of code points."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), dtype=np.uint64)
    for j in range(points.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + points[:, j] + np.uint64(1)
    return out


class Pieces:
    """A model's pieces, and segmentations of texts by them; ``most`` parts are kept at a time."""

    def __init__(self, path: str, n: int = N_BEST, most: int = PARTS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.most = n, most
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in ids}
        self.score = np.array([sp.get_score(i) for i in range(sp.get_piece_size())])
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("the model has pieces that go on after a space; its lattices do not fall apart")
        crossing = re.compile(f"[{_LETTERS}][{_MARKS}]")
        self.parts = _PARTS if any(crossing.search(p) for p in self.ids) else _FINE
        self.fallback = float(min((s for s in self.score if s > -1e8), default=0.0)) - 10
        self.prefix = sp.normalize("a") == f"{SPACE}a"
        by_hash = {}
        for p, i in self.ids.items():
            by_hash[int(_hash(np.array([[ord(c) for c in p]], dtype=np.uint64))[0, -1]) ^ len(p)] = i
        if len(by_hash) != len(self.ids):
            raise ValueError("two pieces have one hash")
        self.hashes = np.array(sorted(by_hash), dtype=np.uint64)
        self.at_hash = np.array([by_hash[int(h)] for h in self.hashes])
        raw = [b""] * sp.get_piece_size()
        for p, i in self.ids.items():
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            raw[i] = bytes([b])
        self.raw, self.raw_n = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_n) - self.raw_n
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.letters = 0
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        # of each part: its n best segmentations' place and length in flat, and scores
        room = 1 << 14
        self.at, self.len, self.scores = np.zeros((room, self.n), np.int64), np.zeros((room, self.n), np.int32), np.full((room, self.n), -np.inf)

    def normalize(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def _ids_of(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.byte[b] for b in piece.encode("utf-8", "replace")]

    def search(self, part: str, n: int | None = None) -> list[tuple[float, list[str]]]:
        """The n best segmentations of one lattice, best first."""
        best = [0.0] + [-np.inf] * len(part)

        def edges(p: int) -> Iterator[tuple[int, float]]:
            for size in range(1, min(self.longest, p) + 1):
                i = self.ids.get(part[p - size : p])
                if i is not None or size == 1:
                    yield size, float(self.score[i]) if i is not None else self.fallback

        for p in range(1, len(part) + 1):
            best[p] = max(best[p - size] + score for size, score in edges(p))
        # (loss, position, score of what follows, path), the next to be popped first
        agenda, out, n = [(0.0, len(part), 0.0, None)], [], n or self.n
        while agenda and len(out) < n:
            loss, p, g, path = agenda.pop(0)
            if p == 0:
                sizes = []
                while path:
                    size, path = path
                    sizes.append(size)
                ends = np.cumsum(sizes).tolist()
                out.append((g, [part[e - s : e] for e, s in zip(ends, sizes, strict=True)]))
                continue
            more = [(loss + (best[p] - (best[p - size] + score)), p - size, score + g, (size, path)) for size, score in edges(p)]
            agenda = sorted(more[::-1] + agenda, key=lambda x: x[0])[: n - len(out)]
        return out

    def _search_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``search`` for parts of up to LONG characters, in lockstep: (part, nth, ids, score) of each path.

        Ids are padded with -2; -3 less a place stands for the character there, which falls back to bytes.
        """
        m, n, width = len(parts), self.n, max(map(len, parts))
        size = np.array([len(p) for p in parts])
        points = np.zeros((m, width), dtype=np.uint64)
        for i, p in enumerate(parts):
            points[i, : len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
        prefix, powers = _hash(points), np.cumprod(np.append(np.uint64(1), np.full(self.longest, _BASE)))
        reach = min(self.longest, width)
        edge = np.full((m, width + 1, reach), -np.inf)
        piece = np.full((m, width + 1, reach), -1, dtype=np.int32)
        for s in range(1, reach + 1):
            key = (prefix[:, s:] - prefix[:, :-s] * powers[s]) ^ np.uint64(s)
            slot = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
            hit = self.hashes[slot] == key
            piece[:, s:, s - 1] = np.where(hit, self.at_hash[slot], -1)
            edge[:, s:, s - 1] = np.where(hit, self.score[self.at_hash[slot]], self.fallback if s == 1 else -np.inf)
        best = np.full((m, width + 1), -np.inf)
        best[:, 0] = 0
        for p in range(1, width + 1):
            for s in range(1, min(reach, p) + 1):
                np.maximum(best[:, p], best[:, p - s] + edge[:, p, s - 1], out=best[:, p])
        gap = np.full((m, width + 1, reach), np.inf)
        for s in range(1, reach + 1):
            gap[:, s:, s - 1] = best[:, s:] - (best[:, :-s] + edge[:, s:, s - 1])
        # agendas of n places in order; nodes keep what paths are made of
        loss, g = np.full((m, n), np.inf), np.zeros((m, n))
        pos, node = np.zeros((m, n), dtype=np.int32), np.zeros((m, n), dtype=np.int64)
        loss[:, 0], pos[:, 0], node[:, 0] = 0, size, np.arange(m)
        parent, step, at, total = [np.full(m, -1, dtype=np.int64)], [np.zeros(m, dtype=np.int32)], [size.astype(np.int32)], m
        found, ends, scores = np.zeros(m, dtype=np.int64), np.zeros((m, n), dtype=np.int64), np.zeros((m, n))
        rows = np.arange(m)
        while len(rows := rows[(loss[rows, 0] < np.inf) & (found[rows] < n)]):
            p = pos[rows, 0]
            d = rows[p == 0]
            ends[d, found[d]], scores[d, found[d]] = node[d, 0], g[d, 0]
            found[d] += 1
            for x in (loss, g, pos, node):
                x[d, :-1] = x[d, 1:]
            loss[d, -1] = np.inf
            r, p = rows[p > 0], p[p > 0]
            if not len(r):
                continue
            weight = np.concatenate([gap[r, p][:, ::-1] + loss[r, :1], loss[r, 1:]], axis=1)
            order = np.argsort(weight, axis=1, kind="stable")[:, :n]
            fresh = order < reach
            s, old = np.where(fresh, reach - order, 1), np.where(fresh, 0, order - reach + 1)
            top = r[:, None]
            now = np.take_along_axis(weight, order, axis=1)
            fresh &= now < np.inf
            new_g = np.where(fresh, edge[top, p[:, None], s - 1] + g[r, :1], g[top, old])
            new_pos = np.where(fresh, p[:, None] - s, pos[top, old])
            new_node = node[top, old]
            parent.append(new_node[fresh])
            step.append(s[fresh].astype(np.int32))
            at.append(new_pos[fresh].astype(np.int32))
            new_node[fresh] = total + np.arange(len(step[-1]))
            total += len(step[-1])
            loss[r], g[r], pos[r], node[r] = now, new_g, new_pos, new_node
        parent, step, at = np.concatenate(parent), np.concatenate(step), np.concatenate(at)
        row, k = np.nonzero(np.arange(n)[None, :] < found[:, None])
        here, columns = ends[row, k], []
        while (here >= m).any():
            inside = here >= m
            s, place = step[here], at[here]
            i = np.where(inside, piece[row, np.minimum(place + s, width), np.maximum(s, 1) - 1], -2)
            columns.append(np.where(i == -1, -3 - place, i))
            here = np.where(inside, parent[here], here)
        return row, k, np.stack(columns, axis=1), scores[row, k]

    def _learn(self, new: list[str]) -> None:
        order = sorted((p for p in new if len(p) <= LONG), key=len)
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            base = self._room(batch)
            part, nth, ids, scores = self._search_many(batch)
            self.scores[base + part, nth] = scores
            plain = ids.min(axis=1) > -3
            used = ids[plain] != -2
            self._put(base + part[plain], nth[plain], used.sum(axis=1), ids[plain][used])
            if not plain.all():
                rest = [[j for x in path if x != -2 for j in ([x] if x >= 0 else self._ids_of(batch[p][-3 - x]))] for p, path in zip(part[~plain].tolist(), ids[~plain].tolist(), strict=True)]
                self._put(base + part[~plain], nth[~plain], np.array([len(x) for x in rest]), np.array([j for x in rest for j in x]))
        for p in new:
            if len(p) > LONG:
                found = self.search(p)
                base, whole = self._room([p]), [[i for x in pieces for i in self._ids_of(x)] for _, pieces in found]
                self.scores[base, : len(found)] = [score for score, _ in found]
                self._put(np.full(len(found), base), np.arange(len(found)), np.array([len(x) for x in whole]), np.array([j for x in whole for j in x]))

    def _room(self, parts: list[str]) -> int:
        """Codes for new parts; the first of them."""
        base = len(self.codes)
        while base + len(parts) > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len))
            self.scores = np.concatenate([self.scores, np.full_like(self.scores, -np.inf)])
        self.codes.update(zip(parts, range(base, base + len(parts)), strict=True))
        self.letters += sum(map(len, parts))
        return base

    def _put(self, code: np.ndarray, nth: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[code, nth] = self.used + np.cumsum(sizes) - sizes
        self.len[code, nth] = sizes
        self.used += len(ids)

    def coded(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The codes of each text's parts. New parts of all of them are searched together."""
        parts = [self.parts.findall(self.normalize(t)) for t in texts]
        if len(self.codes) > self.most or self.letters + self.used > UNITS:
            self.clear()
        if new := set().union(*parts).difference(self.codes):
            self._learn(sorted(new))
        for t in parts:
            yield np.fromiter(map(self.codes.__getitem__, t), np.int64, len(t))

    def encode(self, text: str, codes: np.ndarray | None = None) -> tuple[np.ndarray, list[float], list[list[tuple[int, list[int]]]], np.ndarray]:
        """(ids of the best segmentation, the n best scores, for each the parts that differ from the best, where parts begin in the ids)."""
        codes = next(self.coded([text])) if codes is None else codes
        if not len(codes):
            return self.flat[:0], [0.0], [[]], np.zeros(1, dtype=np.int64)
        n = self.len[codes, 0]
        ends = np.cumsum(n, dtype=np.int64)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.at[codes, 0] - ends + n, n)]
        best = self.scores[codes, 0]
        sums: list[tuple[float, list[tuple[int, list[int]]]]] = [(0.0, [])]
        if self.n > 1:
            loss = best - self.scores[codes, 1]
            few = np.argpartition(loss, self.n - 1)[: self.n - 1] if len(loss) >= self.n else np.arange(len(loss))
            for i in sorted(few.tolist()):
                others = [(float(best[i] - self.scores[codes[i], k]), k) for k in range(1, self.n) if self.scores[codes[i], k] > -np.inf]
                more = [(x + y, [*how, (i, k)]) for x, how in sums for y, k in others]
                sums = sorted(sums + more, key=lambda x: x[0])[: self.n]
        total = float(best.sum())
        changes = [[(i, self.flat[self.at[codes[i], k] : self.at[codes[i], k] + self.len[codes[i], k]].tolist()) for i, k in how] for _, how in sums]
        return ids, [total - x for x, _ in sums], changes, np.append(0, ends)

    def encode_all(self, texts: Iterator[str], most: int = 4_000_000) -> Iterator[tuple]:
        """``encode`` of each text, by groups of about ``most`` characters."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= most:
                yield from (self.encode(t, c) for t, c in zip(group, self.coded(group), strict=True))
                group, size = [], 0
        yield from (self.encode(t, c) for t, c in zip(group, self.coded(group), strict=True))

    def nbest(self, text: str, found: tuple | None = None) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text as ids."""
        ids, scores, changes, at = found or self.encode(text)
        out = []
        for score, how in zip(scores, changes, strict=True):
            whole, last = [], 0
            for i, other in sorted(how, key=lambda x: x[0]):
                whole += ids[last : at[i]].tolist() + other
                last = at[i + 1]
            out.append((score, whole + ids[last:].tolist()))
        return out

    def bytes_of(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        n = self.raw_n[ids]
        ends = np.cumsum(n)
        return self.raw[np.arange(ends[-1]) + np.repeat(self.raw_at[ids] - ends + n, n)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        text = self.bytes_of(ids).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def segmenter(path: str, n: int = N_BEST, most: int = PARTS) -> Pieces:
    """The worker's segmenter: its parts stay from task to task."""
    return kept_by_worker(("pieces", path, n, most), lambda: Pieces(path, n, most))


def encode(docs: DataFrame, n: int = N_BEST, model: str | None = None) -> DataFrame:
    """doc_id, ids of the best segmentation, the n best as (score, ids)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = segmenter(model or model_path(), n)
        best = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for batch in batches:
            found = [pieces.nbest("", x) for x in pieces.encode_all(t.as_py() for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0][1] for x in found], pa.list_(pa.int32())), pa.array([[{"score": s, "ids": i} for s, i in x] for x in found], best)], names=["doc_id", "ids", "nbest"]
            )

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(task, "doc_id long, ids array<int>, nbest array<struct<score: double, ids: array<int>>>")


def tokens(docs: DataFrame, n: int = N_BEST, model: str | None = None, most: int = FEW_PARTS) -> DataFrame:
    """doc_id, number of pieces, ids of the best segmentation, the n best scores, and the ``others``.

    Each other segmentation is given by its changes to the best: ids from ``start`` up to ``stop`` make way for ``ids``.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = segmenter(model or model_path(), n, most)
        change = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))])))
        for batch in batches:
            found = list(pieces.encode_all(t.as_py() for t in batch.column(1)))
            sizes = np.array([len(x[0]) for x in found], dtype=np.int64)
            flat = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat.astype(np.int32)))
            others = [[[{"start": int(at[i]), "stop": int(at[i + 1]), "ids": other} for i, other in how] for how in changes[1:]] for _, _, changes, at in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), ids, pa.array([x[1] for x in found], pa.list_(pa.float64())), pa.array(others, change)], names=["doc_id", "n_pieces", "ids", "scores", "others"]
            )

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(task, "doc_id long, n_pieces long, ids array<int>, scores array<double>, others array<array<struct<start: int, stop: int, ids: array<int>>>>")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of (doc_id, ids)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = segmenter(model or model_path())
        for batch in batches:
            texts = [pieces.decode(np.asarray(i.values)) if i.is_valid else "" for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(task, "doc_id long, text string")


def digest(docs: DataFrame, n: int = N_BEST, model: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` of whole documents in one pass, as counts, scores and checksums of all n segmentations."""
    schema = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, nbest_crc32 array<long>, round_trip boolean, decoded_sha256 string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = segmenter(model or model_path(), n)
        for batch in batches:
            count, scores, crcs, same, sha = [], [], [], [], []
            for t, (ids, s, changes, at) in zip(batch.column(1), pieces.encode_all(t.as_py() for t in batch.column(1)), strict=True):
                text, back, data = t.as_py(), pieces.decode(ids), memoryview(ids.astype("<u4").tobytes())
                ok, found = back == text, []
                for how in changes:
                    crc, last = 0, 0
                    for i, other in how:
                        crc = zlib.crc32(np.array(other, "<u4"), zlib.crc32(data[4 * last : 4 * at[i]], crc))
                        last = at[i + 1]
                        # elsewhere the ids are those that were decoded
                        ok = ok and pieces.bytes_of(np.array(other)) == pieces.bytes_of(ids[at[i] : at[i + 1]])
                    found.append(zlib.crc32(data[4 * last :], crc))
                count.append(len(ids))
                scores.append(s)
                crcs.append(found)
                same.append(ok)
                sha.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(count, pa.int64()), pa.array([x[0] for x in crcs], pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(crcs, pa.list_(pa.int64())),
                    pa.array(same, pa.bool_()), pa.array(sha, pa.string()),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "scores", "nbest_crc32", "round_trip", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(task, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: pieces, scores, checksums and round trip of each document's n best segmentations."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
