"""b-bit MinHash near-dedup: bands propose, packed low bits estimate, full shingle sets decide.

A document's set holds the hashes of its distinct ``k``-word shingles. From HASHES minima per set come
BANDS band keys of ROWS full minima each, and a packed signature of the low BITS bits of every minimum.
A pair that shares a band is compared by counting equal packed cells; the share of chance agreements
(2^-BITS) is taken out, which gives the estimate. Pairs are confirmed on the full sets, made again from the
texts, if their estimate is not below a bound that a pair at the threshold falls under with probability
LOST at most (summed from the binomial distribution).

At similarity 0.8 a pair shares no band with probability (1 - 0.8^5)^35 = 9e-7 and is estimated too low
with probability LOST at most; those are the only two ways to lose a link. Both take hash functions that are
as good as independent on sets of any size, so each mixes the 64-bit shingle with a seed of its own. Small
sets do not skip the estimate: short documents of one template share bands, and without it they would
all fall into one cluster. Bands of five minima and 192 cells keep documents apart that share much but are
not alike: at similarity 0.4 three in ten pairs share a band and 2 in 1,000,000 pass the estimate.

No group is ever expanded into all its pairs:

* documents with the same set are one class from the start, found by aggregation;
* round 1 takes from each bucket a spanning forest of its likely pairs, fewer pairs than members, and
  confirms these; a heavy bucket is dealt to tasks of about DEAL rows, the roots of their forests are dealt
  again, and so on while that leaves fewer of them;
* the components of all forests (and of each dealt bucket as a whole) are clusters outside of which no
  link can lie. Round 2 takes only clusters that still hold several components of confirmed links. The
  members outside the largest component are dealt to blocks of about BLOCK, all members to strips of
  about a block's size (STRIP at least), and a task for each pair of block and strip holds the block's sets and streams
  the strip past them, comparing exactly what may be alike and is not yet joined. It reports a link only
  where it joins two components of its own, so again fewer than members. Members of the largest
  component are never compared with each other.

Components are found by alternating large-star and small-star steps on written tables. Nothing but
counts comes to the driver.

Defined cases: null, empty or blank text has an empty set and is linked with nothing; fewer than k
words make one shingle of the whole; rows that repeat a doc_id are one document, linked to whatever
any of them is linked to; a null doc_id counts as the smallest id and is returned as null; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, RID, TAG, TXT, carried, dropped, heavy_keys, restored, row_id, rows_of, spread_join, stash, text_of
from quillspark.llm.words import mix, windows, words_of

HASHES, BITS, ROWS, BANDS = 192, 2, 5, 35
DEAL, BLOCK, STRIP, PARTNERS = 4_000, 2_000, 500, 500
#: Most loss by the estimate at the threshold.
LOST = 3e-7
CELLS = 64 // BITS
SIG = HASHES // CELLS
_rng = np.random.default_rng(7)
_SALT = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)
_STEPS = [(np.uint64(31), np.uint64(0x7FB5D329728EA185)), (np.uint64(27), np.uint64(0x81DADEF4BC2DD44D))]
_LOW = np.uint64(sum(1 << (BITS * i) for i in range(CELLS)))
_SEEDS = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)


def least_estimate(percent: int, lost: float = LOST) -> float:
    """The bound that the estimate of a pair at the threshold falls under with probability ``lost`` at most."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    same, below = 0, 0.0
    while same < HASHES and (below := below + math.comb(HASHES, same) * p**same * (1 - p) ** (HASHES - same)) <= lost:
        same += 1
    return ((same - 0.5) / HASHES - chance) / (1 - chance)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The high 32 bits of the least mixed hash under each of HASHES seeds.

    This is ``words.mix`` in place, less its last step, which leaves those bits as they are.
    """
    out = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 128):
        x = shingles[i : i + 128, None] ^ _SALT[None, :]
        for shift, factor in _STEPS:
            x ^= x >> shift
            x *= factor
        np.minimum(out, x.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima in SIG words of 64 bits."""
    cells = (low & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(SIG, CELLS)
    return np.bitwise_or.reduce(cells << (np.arange(CELLS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of a signature with each of ``many``, by bit counts."""
    differ = one[None, :] ^ many
    for b in range(1, BITS):
        differ = differ | (differ >> np.uint64(b))
    same = HASHES - np.bitwise_count(differ & _LOW).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return (same / HASHES - chance) / (1 - chance)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, _, _, hashes, at in words_of(texts, lower=True):
        for i in range(len(at) - 1):
            yield np.unique(windows(hashes[at[i] : at[i + 1]], k))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """RID, TAG, n (set size), s1, s2 (128 bits that name the set), sig, bands of each row; written."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, sigs, bands = [], [], [], []
            for s in shingle_sets(batch.column(2), k):
                n.append(len(s))
                low = minima(s)
                names.append((np.add.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(7))), np.add.reduce(mix(s ^ np.uint64(0xABCDEF)))))
                sigs.append(packed(low))
                rows = low[: ROWS * BANDS].astype(np.uint64).reshape(BANDS, ROWS)
                key = _SEEDS.copy()
                for r in range(ROWS):
                    key = mix(key ^ rows[:, r])
                bands.append(key)
            if not n:
                continue
            lists = lambda x, w: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * w), pa.array(np.concatenate(x).view(np.int64)))
            name = np.array(names, dtype=np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]), lists(sigs, SIG), lists(bands, BANDS)],
                names=[RID, TAG, "n", "s1", "s2", "sig", "bands"],
            )

    rows = rows_of(docs).select(RID, TAG, TXT)
    return stash(rows.mapInArrow(task, f"{RID} long, {TAG} long, n long, s1 long, s2 long, sig array<long>, bands array<long>"), "minhash")


def _groups(batch: pa.RecordBatch) -> Iterator[tuple]:
    """((key, salt), ids, signatures, set sizes) of each run of a sorted batch.

    Runs of one row are passed over unless they may go on from the batch before or into the next.
    """
    key, salt, ids, ns = (batch.column(c).to_numpy() for c in ("key", "salt", "id", "n"))
    if not len(key):
        return
    sigs = batch.column("sig").flatten().to_numpy().view(np.uint64).reshape(-1, SIG)
    cuts = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
    bounds = np.concatenate([[0], cuts, [len(key)]])
    for g in sorted({0, len(bounds) - 2, *np.flatnonzero(np.diff(bounds) > 1).tolist()}):
        i, j = bounds[g], bounds[g + 1]
        yield (key[i], salt[i]), ids[i:j], sigs[i:j], ns[i:j]


def _alike(sig, n, sigs: np.ndarray, ns: np.ndarray, percent: int, least: float) -> np.ndarray:
    """Which of many may be linked with one: sizes allow it, and the estimate does."""
    return (100 * np.minimum(ns, n) >= percent * np.maximum(ns, n)) & (estimates(sig, sigs) >= least)


def _forest(percent: int):
    """Over sorted buckets, held one at a time as packed signatures: (a, b) edges of a spanning forest of the likely pairs; roots of dealt buckets as rows of their own."""
    least = least_estimate(percent)

    def edges(at: tuple, held: list, out: list) -> None:
        ids, sigs, ns = (np.concatenate(x) for x in zip(*held, strict=True))
        left, queue = np.arange(len(ids)), []
        while len(left):
            if not queue:
                if at[1]:
                    out.append((ids[left[:1]], ids[left[:1]], at[0], True))
                queue, left = [left[0]], left[1:]
            x = queue.pop()
            hit = _alike(sigs[x], ns[x], sigs[left], ns[left], percent, least)
            found, left = left[hit], left[~hit]
            queue += found[::-1].tolist()
            if len(found):
                out.append((np.minimum(ids[x], ids[found]), np.maximum(ids[x], ids[found]), 0, False))

    def rows(out: list) -> pa.RecordBatch:
        n = [len(x[0]) for x in out]
        a, b = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.repeat(np.array([x[2] for x in out], np.int64), n)), pa.array(np.repeat(np.array([x[3] for x in out], bool), n))], names=["a", "b", "key", "root"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, out = None, [], []
        for batch in batches:
            for at, *group in _groups(batch):
                if at != before and held:
                    if before[1] or len(held) > 1 or len(held[0][0]) > 1:
                        edges(before, held, out)
                    held = []
                before = at
                held.append(group)
            yield rows(out)
            out = []
        if held:
            edges(before, held, out)
            yield rows(out)

    return task


def _joins(k: int, percent: int):
    """Round 2 over sorted (block, strip) tasks, the block's members first: links that join components."""
    least = least_estimate(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parent, sets, held, table = None, {}, [], [], None

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            found = []
            where = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            streamed, comp, one, n = (batch.column(c).to_pylist() for c in range(3, 7))
            sig = batch.column(7).flatten().to_numpy().view(np.uint64).reshape(-1, SIG)
            for r, s in enumerate(shingle_sets(batch.column(8), k)):
                if where[r] != at:
                    at, parent, sets, held, table = where[r], {}, [], [], None
                if not streamed[r]:
                    sets.append(s)
                    held.append((one[r], comp[r], n[r], sig[r]))
                elif held:
                    if table is None:
                        table = np.array([x[3] for x in held]), np.array([x[2] for x in held])
                    for j in np.flatnonzero(_alike(sig[r], n[r], *table, percent, least)).tolist():
                        if root(held[j][1]) != root(comp[r]):
                            both = len(np.intersect1d(sets[j], s, assume_unique=True))
                            if 100 * both >= percent * (len(sets[j]) + len(s) - both):
                                parent[root(held[j][1])] = root(comp[r])
                                found.append((min(held[j][0], one[r]), max(held[j][0], one[r])))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return task


def _buckets(reps: DataFrame) -> DataFrame:
    return reps.select("id", "n", "sig", F.explode("bands").alias("key"))


_PAIR = "a long, b long"


def _round1(reps: DataFrame, percent: int, deal: int = DEAL) -> tuple[DataFrame, DataFrame]:
    """(pairs to confirm, pairs that bind clusters besides), both fewer than the rows in buckets."""
    rows = _buckets(reps)

    def forest(x: DataFrame) -> DataFrame:
        x = x.select("key", "salt", "id", "n", "sig").repartition("key", "salt").sortWithinPartitions("key", "salt", "id")
        return stash(x.mapInArrow(_forest(percent), f"{_PAIR}, key long, root boolean"), "pairs")

    def dealt(size: str, seed: int) -> F.Column:
        """0 for what takes one task, else 1 and above."""
        tasks = F.expr(f"1 + {size} div {deal}")
        return F.when(tasks > 1, 1 + F.pmod(F.xxhash64(F.lit(seed), "id"), tasks)).otherwise(F.lit(0)).cast("int")

    hot = heavy_keys(rows.select("key"), ["key"])
    if hot is None:
        first = stash(forest(rows.withColumn("salt", F.lit(0))).select("a", "b").distinct(), "pairs")
        return first, first.limit(0)
    hot = stash(hot, "hot")
    rows = rows.join(F.broadcast(hot.withColumnRenamed("heavy_n", "size")), "key", "left")
    # a hot bucket takes salts even where it is small, so that its roots come back by its key
    salt = F.when(F.col("size").isNotNull(), 1 + F.pmod(F.xxhash64("id"), F.expr(f"1 + size div {deal}"))).otherwise(F.lit(0)).cast("int")
    level = forest(rows.withColumn("salt", salt))
    pairs, seed = [level.where("not root").select("a", "b")], 1
    roots = level.where("root").select("key", F.col("a").alias("id"))
    left = roots.count()
    while left:
        sizes = roots.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")  # at most as many rows as hot keys
        again = roots.join(F.broadcast(sizes), "key").withColumn("salt", dealt("size", seed)).join(reps.select("id", "n", "sig"), "id")
        level = forest(again)
        pairs.append(level.where("not root").select("a", "b"))
        roots = level.where("root").select("key", F.col("a").alias("id"))
        before, left, seed = left, roots.count(), seed + 1
        if 2 * left > before:  # what is left is not alike
            break
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    members = rows.where("size is not null").select("key", "id")
    heads = members.groupBy("key").agg(F.min("id").alias("a"))
    return stash(out.distinct(), "pairs"), stash(members.join(F.broadcast(heads), "key").select("a", F.col("id").alias("b")).where("a < b").distinct(), "bound")


def _round2(reps: DataFrame, comps: DataFrame, clusters: DataFrame, texts: DataFrame, k: int, percent: int, block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """Links that join components within clusters; written."""
    rows = reps.select("id", "n", "sig").join(clusters.withColumnRenamed("comp", "cluster"), "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = rows.groupBy("cluster", "comp").count()
    several = sizes.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("all"), F.max(F.struct("count", "comp")).alias("big")).where("parts > 1")
    several = several.select("cluster", F.col("big.comp").alias("big"), F.expr(f"1 + (all - big.count) div {block}").alias("blocks"), F.expr(f"1 + all div greatest({strip}, least(all - big.count, {block}))").alias("strips"))
    rows = rows.join(several, "cluster")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    one = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n))
    held = rows.where("comp <> big").select("*", F.lit(False).alias("streamed"), one("blocks", 1).alias("block"), F.explode(every("strips")).alias("strip"))
    past = rows.select("*", F.lit(True).alias("streamed"), F.explode(every("blocks")).alias("block"), one("strips", 2).alias("strip"))
    both = held.unionByName(past).join(texts.hint("merge"), "id").select("cluster", "block", "strip", "streamed", "comp", "id", "n", "sig", "text")
    dealt = both.repartition("cluster", "block", "strip").sortWithinPartitions("cluster", "block", "strip", "streamed", "id")
    return stash(dealt.mapInArrow(_joins(k, percent), _PAIR).distinct(), "joins")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, most: int = PARTNERS) -> DataFrame:
    """(a, b, ok): each pair's verdict on the full sets. ``docs``: id, text.

    A task gets the text of an ``a`` once, then its partners one by one; an ``a`` of many partners is dealt to several tasks.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            where = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            partner, out = batch.column(2).to_pylist(), []
            for i, s in enumerate(shingle_sets(batch.column(3), k)):
                if where[i] != at:
                    at, heads = where[i], []
                if partner[i] is None:
                    heads.append(s)
                else:
                    both = [(len(np.intersect1d(x, s, assume_unique=True)), len(x) + len(s)) for x in heads]
                    out.append((at[0], partner[i], any(n > 0 and 100 * n >= percent * (of - n) for n, of in both)))
            a, b, ok = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    parts = pairs.groupBy("a").agg(F.expr(f"1 + count(1) div {most}").alias("parts"))
    tails = spread_join(pairs, parts, ["a"]).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    rows = heads.withColumn("id", F.col("a")).unionByName(tails.withColumn("id", F.col("b")))
    # by exchange at every size: neither side has a bound that would let it be broadcast
    rows = rows.join(docs.hint("merge"), "id").select("a", "part", "b", "text")
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return stash(dealt.mapInArrow(task, f"{_PAIR}, ok boolean"), "confirmed")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the least id that each linked id but the least itself reaches, by alternating large-star and small-star steps."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        out = joined.where("b > a" if large else "b <> m").select(F.col("m").alias("a"), "b")
        if not large:
            out = out.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
        return out.where("a <> b").distinct()

    def done(e: DataFrame) -> bool:
        """Whether all edges are stars: each id hangs on one other, which hangs on none."""
        if e.groupBy("b").count().where("count > 1").limit(1).count():
            return False
        return not e.join(e.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()

    edges = stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    while not done(edges):
        before, edges = edges, stash(star(star(edges, True), False), "stars")
        dropped(before)
    return edges.select(F.col("b").alias("id"), F.col("a").alias("comp"))


def _labelled(reps: DataFrame, comps: DataFrame) -> DataFrame:
    return reps.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component and internal ids of each row of ``docs``."""
    sigs = signatures(docs, k)
    classes = sigs.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct(RID, TAG)).alias("rep"))
    rep = F.coalesce((F.col(f"rep.{RID}") == F.col(RID)) & (F.col(f"rep.{TAG}") == F.col(TAG)), F.lit(False))
    members = stash(spread_join(sigs, classes, ["n", "s1", "s2"], "left").select(RID, TAG, "n", F.coalesce(f"rep.{RID}", RID).alias("id"), rep.alias("own"), F.when(rep, F.col("sig")).alias("sig"), F.when(rep, F.col("bands")).alias("bands")), "classes")
    reps = members.where("own").select("id", "n", "sig", "bands").dropDuplicates(["id", "bands"])
    texts = docs.select(row_id().alias("id"), text_of().alias("text"))

    pairs, bound = _round1(reps, percent)
    links = confirmed(pairs, texts, k, percent).where("ok").select("a", "b").distinct()
    # a document with several texts joins their classes
    several = members.groupBy(RID).agg(F.min("id").alias("a"), F.max("id").alias("m")).where("a <> m").select(RID, "a")
    same = members.join(several, RID).select("a", F.col("id").alias("b")).where("a <> b").distinct()
    links = stash(links.unionByName(same), "links")
    comps = components(links)
    clusters = components(pairs.unionByName(bound))
    # the head of a star has no row of its own
    headed = lambda x: x.unionByName(x.select(F.col("comp").alias("id"), "comp").distinct())
    more = _round2(reps, comps, headed(clusters), texts, k, percent)
    if more.limit(1).count():
        comps = components(links.unionByName(more))
    ids = docs.select("doc_id", row_id().alias(RID), F.xxhash64(text_of()).alias(TAG))
    out = _labelled(members.select(RID, TAG, "n", "id").distinct(), comps)
    return ids.join(out, [RID, TAG]).select("doc_id", F.col("n").alias("n_shingles"), "comp", RID, TAG)


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: that with the least id."""
    keep = near_duplicates(docs, **options).where(F.col("comp") == F.col(RID)).select(RID, TAG).distinct()
    return restored(carried(docs).join(keep, [RID, TAG], "left_semi"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: set size and component of each document, on shingles of four words."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)
    return out.select("doc_id", "n_shingles", F.nullif(F.col("comp"), F.lit(NO_ID).cast("long")).alias("component_id"), (F.col("comp") == F.col(RID)).alias("kept"))


def oracle(k: int = 4) -> str:
    return _SQL.replace("{k}", str(k)).replace("{k-1}", str(k - 1)).replace("{k-2}", str(k - 2))


_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {k-2}), lambda i: array_to_string(ws[i:i+{k-1}], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN common USING (sh) JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_n >= 80 * (na.n + nb.n - both_n)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
