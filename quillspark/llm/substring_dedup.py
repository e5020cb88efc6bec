"""Substring dedup: compressed FM-indexes per shard, searched backward for windows seen in earlier documents.

A window is WINDOW consecutive words of a document. A word goes if it is covered by a window whose words
also start in a document with a smaller id. All texts against all others would not scale, so windows are
first brought together that can be equal:

1. The anchor of a window is the least of its hashed SPAN-word runs. Equal windows have equal anchors.
   Runs of windows with one anchor form a segment (some 17 words for 5 windows).
2. Anchors that only one document has cannot matter; they are sorted out by exchanging (anchor, id)
   pairs. Anchors shared within one Arrow batch of documents are settled there, and one pair is
   exchanged for them, so a passage that a third of all documents share does not fill a partition.
3. Segments of shared anchors are exchanged by anchor, as 32-bit word hashes. Of equal segments in one
   batch of documents only that of the smallest id travels: the others are covered by it for certain.
   A phrase that very many documents hold in different contexts would bring all their segments to one
   task, so anchors are counted first, in a fixed number of buckets; those of heavy buckets are not
   exchanged by anchor but window by window, by the hash of the whole window.
4. A task cuts its sorted segments into shards of about SHARD words at anchor bounds, and builds for
   each an FM-index over its distinct segments: suffixes sorted to depth 16 (enough for patterns of up
   to 16 words), the Burrows-Wheeler transform as a bit-packed wavelet matrix with rank counts, and
   the smallest id at each suffix. Every window streams through it from its last word to its first;
   the number of steps until its interval holds one suffix is its matching statistic. Windows that
   reach the threshold in several places look up the smallest id in their interval.
5. Intervals below the document's own id are reported, gathered per document and cut from the text.

Memory is bounded by a shard, or by the segments of one anchor. Hash collisions: two windows count as
equal if their anchors agree in 64 bits and each other word in 32.

Defined cases: null, empty and blank texts and those under WINDOW words lose nothing; rows that repeat
a doc_id never cover each other; a null doc_id counts as the smallest id; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import BUCKETS, FLOOR, NO_ID, RID, TAG, TXT, row_id, share_of, text_of
from quillspark.llm.words import windows, words_of

WINDOW, SPAN, DEPTH, SHARD = 13, 5, 16, 1_000_000


def anchored(hashes: np.ndarray, at: np.ndarray, window: int = WINDOW, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(anchor, row, first, last) of each segment: the first and last start of windows with one anchor, as word numbers."""
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    runs = windows(hashes, span)
    best, where = runs[:n].copy(), np.zeros(n, dtype=np.int32)
    for j in range(1, window - span + 1):
        other = runs[j : j + n]
        less = other < best
        np.copyto(best, other, where=less)
        where[less] = j
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(starts):
        return starts, starts, starts, starts
    place = starts + where[starts]
    change = np.flatnonzero((place[1:] != place[:-1]) | (row[starts[1:]] != row[starts[:-1]])) + 1
    first, last = np.append(0, change), np.append(change, len(starts)) - 1
    return runs[place[first]].view(np.int64), row[starts[first]], starts[first], starts[last]


class WaveletMatrix:
    """Rank over a sequence of integers, as one bit-packed level for each bit."""

    def __init__(self, values: np.ndarray, n_bits: int):
        self.n_bits, self.levels = n_bits, []
        for b in range(n_bits - 1, -1, -1):
            bits = (values >> b) & 1 == 1
            words = np.packbits(np.append(bits, np.zeros(64 + (-len(bits)) % 64, bool)), bitorder="little").view(np.uint64)
            counts = np.append(0, np.cumsum(np.bitwise_count(words)))[:-1].astype(np.int64)
            self.levels.append((words, counts, len(values) - int(bits.sum())))
            values = np.concatenate([values[~bits], values[bits]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """For each end: how often ``symbol`` occurs before it, less the same count at the symbol's block start."""
        out = [e.copy() for e in ends]
        for level, (words, counts, zeros) in enumerate(self.levels):
            one = (symbol >> (self.n_bits - 1 - level)) & 1 == 1
            for k, i in enumerate(out):
                word, bit = i >> 6, (i & 63).astype(np.uint64)
                ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
                out[k] = np.where(one, zeros + ones, i - ones)
        return out


class FMIndex:
    """Backward search over integer texts, for patterns of up to ``depth`` symbols; 0 separates texts."""

    def __init__(self, text: np.ndarray, depth: int = DEPTH):
        n, rank, h = len(text), text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while h < depth:
            key = rank * (int(rank.max()) + 1)
            key[: n - h] += rank[h:]
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, dtype=np.int64)
            fresh[order] = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
            rank, h = fresh, 2 * h
        self.suffixes = order
        self.before = np.append(0, np.cumsum(np.bincount(text)))
        transform = text[order - 1].astype(np.int64)
        bits = max(1, int(text.max()).bit_length())
        self.matrix = WaveletMatrix(transform, bits)
        # where each symbol's block starts in the last level, which rank() leaves in its results
        self.base = self.matrix.rank(np.arange(len(self.before) - 1), np.zeros(len(self.before) - 1, dtype=np.int64))[0]

    def search(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the positions before ``ends``: (steps, low, high).

        A search goes back from its end for ``most`` symbols, or stops when its interval holds one
        suffix. steps: symbols matched in more than one place; low, high: the interval where it is ``most``.
        """
        steps, low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        active = np.arange(len(ends))
        symbol = text[ends - 1]
        lo, hi = self.before[symbol], self.before[symbol + 1]
        for step in range(1, most + 1):
            if step > 1:
                symbol = text[ends[active] - step]
                lo, hi = (r - self.base[symbol] + self.before[symbol] for r in self.matrix.rank(symbol, lo, hi))
            several = hi - lo > 1
            active, lo, hi = active[several], lo[several], hi[several]
            steps[active] = step
        low[active], high[active] = lo, hi
        return steps, low, high


def covered(segments: list[bytes], ids: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id over all places of each window, where each segment's windows begin) of distinct segments.

    ``ids``: the smallest id of each segment.
    """
    sizes = np.array([len(s) // 4 for s in segments])
    words, dense = np.unique(np.frombuffer(b"".join(segments), "<u4"), return_inverse=True)
    ends = np.cumsum(sizes + 1)
    text = np.zeros(ends[-1], dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[ends - 1] = False
    text[inside] = dense + 1
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    n_windows = sizes - window + 1
    at = np.append(0, np.cumsum(n_windows))
    stops = np.repeat(ends - 1 - n_windows + 1 - at[:-1], n_windows) + np.arange(at[-1])
    least = np.repeat(ids, n_windows)
    if len(segments) == 1 and n_windows[0] == 1:
        return least, at
    index = FMIndex(text)
    steps, low, high = index.search(text, stops, window)
    several = np.flatnonzero(steps == window)
    if len(several):
        id_at = ids[owner[index.suffixes]]
        bounds, back = np.unique(np.stack([low[several], high[several]]), axis=1, return_inverse=True)
        flat = np.append(id_at, np.iinfo(np.int64).max)
        least[several] = np.minimum.reduceat(flat, bounds.T.ravel())[::2][back.ravel()]
    return least, at


def _anchor_rows(window: int, span: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            keys, ids = [], []
            for i, _, _, _, hashes, at in words_of(batch.column(1)):
                anchor, row, _, _ = anchored(hashes, at, window, span)
                keys.append(anchor)
                ids.append(rid[i + row])
            if not keys:
                continue
            key, ids = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((ids, key))
            key, ids = key[order], ids[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))[: len(key)]
            key, ids = key[fresh], ids[fresh]
            begins = np.append(True, key[1:] != key[:-1])[: len(key)]
            starts = np.flatnonzero(begins)
            shared = np.repeat(np.diff(np.append(starts, len(key))) > 1, np.diff(np.append(starts, len(key))))
            # shared here: all are settled, go by their id, and the first stands for them among the others
            keep = ~shared | begins
            route = np.concatenate([key[keep], ids[shared]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(route), pa.array(np.concatenate([key[keep], key[shared]])), pa.array(np.concatenate([ids[keep], ids[shared]])), pa.array(np.arange(len(route)) >= keep.sum())],
                names=["route", "anchor", RID, "settled"],
            )

    return task


def _heavy_buckets(texts: DataFrame, window: int, span: int, floor: int | None = None) -> tuple[np.ndarray, int]:
    """(those of the buckets of anchors that hold many segments, number of buckets); what comes to the driver is a count for each bucket."""
    share = 4 * share_of(texts.sparkSession)
    n = BUCKETS * share // 4

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, dtype=np.int64)
        for batch in batches:
            for _, _, _, _, hashes, at in words_of(batch.column(0)):
                counts += np.bincount((anchored(hashes, at, window, span)[0].view(np.uint64) % np.uint64(n)).astype(np.int64), minlength=n)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(counts[hit])], names=["bucket", "n"])

    counts = texts.select(TXT).mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    least = max(FLOOR if floor is None else floor, -(-sum(r.n for r in counts) // share))
    return np.sort(np.array([r.bucket for r in counts if r.n >= least], dtype=np.uint64)), n


_SEGMENT = f"route long, {RID} long, {TAG} long, starts array<int>, n int, seg binary"


def _segment_rows(window: int, span: int, heavy: np.ndarray, n_buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, tag, shared = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            route, row_of, start, segs = [], [], [], []
            for i, _, _, _, hashes, at in words_of(batch.column(2)):
                anchor, row, first, last = anchored(hashes, at, window, span)
                low = hashes.astype("<u4")
                if len(heavy):
                    # windows of heavy anchors go one by one, by their own hash
                    own = np.isin(anchor.view(np.uint64) % np.uint64(n_buckets), heavy)
                    times = np.where(own, last - first + 1, 1)
                    of = np.repeat(np.arange(len(anchor)), times)
                    begin = first[of] + np.where(own[of], np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times), 0)
                    by = np.where(own[of], windows(hashes, window).view(np.int64)[begin], anchor[of])
                    anchor, row, first, last = anchor[of], row[of], begin, np.where(own[of], begin, last[of])
                else:
                    by = anchor
                cuts = np.searchsorted(row, np.arange(len(at)))
                for k in range(len(at) - 1):
                    mine = slice(cuts[k], cuts[k + 1])
                    hit = np.flatnonzero(np.isin(anchor[mine], np.asarray(shared[i + k].values))) + cuts[k]
                    route += by[hit].tolist()
                    row_of += [i + k] * len(hit)
                    start += (first[hit] - at[k]).tolist()
                    segs += [low[a : b + window].tobytes() for a, b in zip(first[hit].tolist(), last[hit].tolist(), strict=True)]
            if not segs:
                continue
            ids, n = rid[row_of], np.array([len(s) // 4 for s in segs], dtype=np.int32)
            first_of: dict[tuple[int, bytes], int] = {}
            for x in zip(route, segs, ids.tolist(), strict=True):
                if first_of.setdefault(x[:2], x[2]) > x[2]:
                    first_of[x[:2]] = x[2]
            sure = np.array([first_of[x[:2]] < x[2] for x in zip(route, segs, ids.tolist(), strict=True)])
            # what is settled here goes as merged spans, by its document
            at, begin, stop = np.array(row_of)[sure], np.array(start)[sure], (np.array(start) + n)[sure]
            fresh = np.append(True, (at[1:] != at[:-1]) | (begin[1:] > stop[:-1]))[: len(at)]
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], len(at)) - 1 if len(heads) else heads
            at, begin, size = at[heads], begin[heads], (stop[tails] - begin[heads]).astype(np.int32)
            # a segment that a document holds many times travels once, with all its places
            places: dict[tuple[int, int, bytes], list[int]] = {}
            for i in np.flatnonzero(~sure).tolist():
                places.setdefault((route[i], row_of[i], segs[i]), []).append(start[i])
            where = np.concatenate([np.array([x[1] for x in places], dtype=np.int64), at.astype(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.array([x[0] for x in places], dtype=np.int64), rid[at]])), pa.array(rid[where]), pa.array(tag[where]), pa.array([*places.values(), *([x] for x in begin.tolist())], pa.list_(pa.int32())),
                    pa.array(np.concatenate([np.array([len(x[2]) // 4 for x in places], dtype=np.int32), size])), pa.array([x[2] for x in places] + [None] * len(at), pa.binary()),
                ],
                names=["route", RID, TAG, "starts", "n", "seg"],
            )

    return task


def _shard_rows(window: int, shard: int):
    """Sorted segments to intervals (id, tag, from, to), shard by shard."""

    def judged(rows: list[tuple[np.ndarray, ...]], segs: list[bytes]) -> pa.RecordBatch:
        rid, tag, start, which = (np.concatenate(x) for x in zip(*rows, strict=True))
        least_id = np.full(len(segs), np.iinfo(np.int64).max)
        np.minimum.at(least_id, which, rid)
        # equal segments of one anchor are one by now; those of several anchors would be the same windows twice
        least, at = covered(segs, least_id, window)
        top, bottom = np.maximum.reduceat(least, at[:-1]), np.minimum.reduceat(least, at[:-1])
        sizes = np.diff(at)
        whole = top[which] < rid
        out = [(rid[whole], tag[whole], start[whole], start[whole] + sizes[which[whole]] + window - 1)]
        part = np.flatnonzero(~whole & (bottom[which] < rid))
        if len(part):
            n = sizes[which[part]]
            row = np.repeat(part, n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            hit = least[at[which[row]] + offset] < rid[row]
            row, offset = row[hit], offset[hit]
            out.append((rid[row], tag[row], start[row] + offset, start[row] + offset + window))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[RID, TAG, "begin", "end"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, segs, words, route, last = [], [], 0, None, None
        for batch in batches:
            keys, rid, tag, n = (batch.column(c).to_numpy() for c in (0, 1, 2, 4))
            starts, seg = batch.column(3), batch.column(5)
            places, begins = starts.flatten().to_numpy(), np.append(0, np.cumsum(starts.value_lengths().to_numpy()))
            start = places[begins[:-1]]

            def spread(part: np.ndarray, which: list[int], rid=rid, tag=tag, places=places, begins=begins) -> tuple[np.ndarray, ...]:
                """One row for each place of the batch's rows ``part``."""
                times = begins[part + 1] - begins[part]
                at = np.arange(times.sum()) + np.repeat(begins[part] - np.cumsum(times) + times, times)
                return np.repeat(rid[part], times), np.repeat(tag[part], times), places[at].astype(np.int64), np.repeat(np.array(which), times)

            sure = np.asarray(seg.is_null())
            if sure.any():
                yield pa.RecordBatch.from_arrays([pa.array(rid[sure]), pa.array(tag[sure]), pa.array(start[sure].astype(np.int64)), pa.array((start + n)[sure].astype(np.int64))], names=[RID, TAG, "begin", "end"])
            which, begun = [], 0
            left = np.flatnonzero(~sure)
            for i, x in zip(left.tolist(), seg.drop_null().to_pylist(), strict=True):
                if keys[i] != route:
                    if words >= shard:
                        if which:
                            rows.append(spread(left[begun : begun + len(which)], which))
                        yield judged(rows, segs)
                        begun, which = begun + len(which), []
                        rows, segs, words = [], [], 0
                    route, last = keys[i], None
                if x != last:
                    segs.append(x)
                    words, last = words + len(x) // 4 + 1, x
                which.append(len(segs) - 1)
            if which:
                rows.append(spread(left[begun : begun + len(which)], which))
        if segs:
            yield judged(rows, segs)

    return task


def _rows(docs: DataFrame) -> DataFrame:
    """The same columns, joined on the same key, wherever texts are moved: Spark then moves them once."""
    return docs.select(row_id().alias(RID), text_of().alias(TXT)).withColumn(TAG, F.xxhash64(TXT))


def repeats(docs: DataFrame, window: int = WINDOW, span: int = SPAN, shard: int = SHARD, floor: int | None = None) -> DataFrame:
    """(RID, spans) of each id that has repeated windows: spans of word numbers (text hash, begin, end)."""
    texts = docs.select(row_id().alias(RID), text_of().alias(TXT))
    anchors = texts.mapInArrow(_anchor_rows(window, span), f"route long, anchor long, {RID} long, settled boolean").repartition("route")
    same = Window.partitionBy("route", "anchor", "settled")
    met = anchors.select("anchor", RID, "settled", F.min(RID).over(same).alias("lo"), F.max(RID).over(same).alias("hi"))
    shared = met.where("settled or lo < hi").select("anchor", RID)
    per_doc = shared.groupBy(RID).agg(F.collect_set("anchor").alias("shared"))
    heavy, n_buckets = _heavy_buckets(texts, window, span, floor)
    segments = _rows(docs).join(per_doc, RID).select(RID, TAG, TXT, "shared").mapInArrow(_segment_rows(window, span, heavy, n_buckets), _SEGMENT)
    dealt = segments.repartition("route").sortWithinPartitions("route", "seg", RID)
    spans = dealt.mapInArrow(_shard_rows(window, shard), f"{RID} long, {TAG} long, begin long, end long")
    return spans.groupBy(RID).agg(F.collect_list(F.struct(TAG, "begin", "end")).alias("spans"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, removed spans merged, and the kept words joined by single spaces."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tags, spans = batch.column(1), batch.column(2).to_numpy(), batch.column(3)
            n_words, n_removed, kept = [], [], []
            for i, data, starts, ends, _, at in words_of(texts):
                for k in range(len(at) - 1):
                    a, b = starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]]
                    n_words.append(len(a))
                    stay = np.ones(len(a), dtype=bool)
                    if (cut := spans[i + k]).is_valid and len(a):
                        tag, begin, end = (x.to_numpy() for x in cut.values.flatten())
                        mine = tag == tags[i + k]
                        depth = np.zeros(len(a) + 1, dtype=np.int64)
                        np.add.at(depth, begin[mine], 1)
                        np.add.at(depth, end[mine], -1)
                        stay = np.cumsum(depth)[:-1] == 0
                    n_removed.append(int(len(a) - stay.sum()))
                    raw = data.tobytes() if not k else raw
                    kept.append(b" ".join([raw[x:y] for x, y in zip(a[stay].tolist(), b[stay].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    rows = _rows(docs).join(repeats(docs, **options), RID, "left")
    rows = rows.select(F.nullif(F.col(RID), F.lit(NO_ID).cast("long")).alias("doc_id"), TXT, TAG, "spans")
    return rows.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: words, removed words and hash of the kept words of each document."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS (SELECT doc_id, unnest(CASE WHEN len(ws) < 13 THEN [] ELSE range(1, len(ws) - 11) END) AS i, ws FROM w),
x AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM v),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS hit FROM x),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS j FROM m WHERE hit),
a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
k AS (SELECT a.doc_id, a.word, a.j, c.j IS NOT NULL AS gone FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.j = a.j),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)
"""
