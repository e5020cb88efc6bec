"""Compression of vectors to short codes: one codebook per part position, searched through vantage-point trees.

Components become integers, floor(SCALE * x); a vector is cut into PARTS equal consecutive parts, each of which is
coded by the number of its nearest codebook entry. Codebooks start as the parts of the ENTRIES smallest
vec_ids. In each of ROUNDS rounds every part goes to its nearest entry, tasks add up their parts per entry, and each
entry moves to the componentwise floor of sum over count; entries that nobody took stay.

The nearest entry (squared Euclidean distance, ties to the lower number) is found by metric branch and bound in a
vantage-point tree over the entries of the part position. All of it is integer arithmetic: a node keeps the
least and greatest distance of each child's entries to its vantage point, rounded down and up to integers, and a
query's own distance to the vantage point lies between two neighbouring integers, so a child's lower bound is never too
high. A child is visited if the bound is not above the best distance (non-strictly, so that ties are
seen), and candidates are verified by their exact squared distances. All vectors of an Arrow batch go through the
tree together: one greedy descent gives each a first bound, one walk over the nodes takes those that may find better.

What goes to the driver and back to the tasks is the codebooks (PARTS x ENTRIES parts) and one sum per entry,
whatever the input.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped. The width is that of
the first row by (vec_id, vector; null vec_ids last) whose width PARTS divides; rows of other widths stay with null code
and error, and count as 0 in label_error. Rows that repeat a vec_id are all coded; the smallest vector of an id
is the one that may found an entry. With fewer rows than ENTRIES the codebooks are shorter. Components are held to what
keeps squared distances within 64 bits (370,000 in magnitude for parts of 16). An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import kept_by_worker, spread_join, stash

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 4, 256, 4, 1024, 8


def _root(x: np.ndarray) -> np.ndarray:
    """The floor of the square root of integers."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def _distances(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of q to all rows of e; what wraps around on the way cancels out."""
    return (q * q).sum(axis=1)[:, None] - 2 * (q @ e.T) + (e * e).sum(axis=1)[None, :]


@dataclass
class _Node:
    entries: np.ndarray  # the vantage point, or a leaf's entries in ascending order
    children: list[tuple[int, int, _Node]]  # least and greatest distance to the vantage point, rounded outwards


class Tree:
    """Nearest entries by metric branch and bound."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray) -> _Node:
        if len(own) <= LEAF:
            return _Node(own, [])
        e = self.entries[own]
        far = int(_distances(e.sum(axis=0, keepdims=True) // len(own), e).argmax())  # an outlying entry tells the others apart best
        rest = np.delete(own, far)
        d = _distances(self.entries[own[far : far + 1]], self.entries[rest])[0]
        order = np.argsort(d, kind="stable")
        children = []
        for half in np.array_split(order, 2):
            lo, hi = int(_root(d[half[:1]])[0]), int(_root(d[half[-1:]])[0]) + 1
            children.append((lo, hi, self._build(np.sort(rest[half]))))
        return _Node(own[far : far + 1], children)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the entry nearest to each row of q."""
        self.q, self.best = q, np.full(len(q), np.iinfo(np.int64).max)
        self.number = np.zeros(len(q), np.int64)
        if len(q):
            self._descend(self.top, np.arange(len(q)))
            self._visit(self.top, np.arange(len(q)))
        return self.number, self.best

    def _verify(self, node: _Node, rows: np.ndarray) -> np.ndarray:
        d = _distances(self.q[rows], self.entries[node.entries])
        at = d.argmin(axis=1)
        least, number = d[np.arange(len(rows)), at], node.entries[at]
        better = (least < self.best[rows]) | ((least == self.best[rows]) & (number < self.number[rows]))
        self.best[rows[better]], self.number[rows[better]] = least[better], number[better]
        return d[:, 0]

    def _descend(self, node: _Node, rows: np.ndarray) -> None:
        d = self._verify(node, rows)
        if node.children:
            inside = _root(d) <= node.children[0][1]
            for (_, _, child), own in zip(node.children, (rows[inside], rows[~inside]), strict=True):
                if len(own):
                    self._descend(child, own)

    def _visit(self, node: _Node, rows: np.ndarray) -> None:
        d = self._verify(node, rows)
        t = _root(d) if node.children else d
        for lo, hi, child in node.children:
            bound = np.maximum(0, np.maximum(t - hi, lo - t - 1))
            near = rows[bound * bound <= self.best[rows]]
            if len(near):
                self._visit(child, near)


@dataclass
class Codebooks:
    """The entries of each part position (parts x entries x width of a part)."""

    books: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def searcher(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A function from vectors (rows x width) to numbers and squared distances (rows x parts); trees stay with the worker."""
        trees = kept_by_worker(("vector trees", self.sha256()), lambda: [Tree(b) for b in self.books])

        def search(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = [tree.nearest(np.ascontiguousarray(q)) for tree, q in zip(trees, np.split(x, len(trees), axis=1), strict=True)]
            return np.stack([n for n, _ in got], axis=1), np.stack([d for _, d in got], axis=1)

        return search


def integers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and the integer components ``x`` of the rows whose vector is whole."""
    good = F.forall(vector, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    most = F.floor(F.sqrt(F.lit(2.0**60) / F.greatest(F.size(vector), F.lit(1)) * PARTS)).cast("double")
    x = F.transform(vector, lambda v: F.floor(F.greatest(-most, F.least(most, v.cast("double") * SCALE))).cast("int"))
    return vectors.where(F.col(vector).isNotNull() & good).select("vec_id", "label", x.alias("x"))


def _matrices(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have the width, and their vectors."""
    flat, at = np.asarray(column.values).astype(np.int64), np.asarray(column.offsets).astype(np.int64)
    fits = np.flatnonzero(np.diff(at) == width)
    return fits, flat[at[fits][:, None] + np.arange(width)] if width else np.zeros((len(fits), 0), np.int64)


def first_books(table: DataFrame) -> Codebooks | None:
    """The parts of the ENTRIES smallest vec_ids; None where no row can be coded."""
    fit = table.where(F.size("x") % PARTS == 0)
    order = F.col("vec_id").asc_nulls_last()
    head = fit.orderBy(order, "x").select("x").first()
    if head is None:
        return None
    fit = fit.where(F.size("x") == len(head.x))
    ids = F.broadcast(fit.select(F.col("vec_id").alias("id")).distinct().orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES))
    rows = fit.join(ids, F.col("vec_id").eqNullSafe(F.col("id"))).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy(order).collect()
    x = np.array([r.x for r in rows], dtype=np.int64).reshape(len(rows), PARTS, -1)
    return Codebooks(np.ascontiguousarray(x.transpose(1, 0, 2)))


def moved(table: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    parts, entries, width = books.books.shape
    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, n, sums = books.searcher(), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            _, x = _matrices(batch.column(0), books.width)
            number, _ = search(x)
            for p, q in enumerate(np.split(x, parts, axis=1)):
                n[p] += np.bincount(number[:, p], minlength=entries)
                np.add.at(sums[p], number[:, p], q)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, e, n[p, e], *sums[p, e].T)], names=names)

    rows = table.select("x").mapInArrow(task, ", ".join(f"{c} long" for c in names))
    out = books.books.copy()
    for r in rows.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:])).collect():
        out[r.part, r.entry] = np.array(r[3:], dtype=np.int64) // r.n
    return Codebooks(out)


def fit(table: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of a table of ``integers``, read once per round."""
    books = first_books(table)
    for _ in range(rounds if books else 0):
        books = moved(table, books)
    return books


def encode(table: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error of each row of ``integers``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = books.searcher() if books else None
        for batch in batches:
            code, error = np.full(batch.num_rows, None, dtype=object), np.full(batch.num_rows, None, dtype=object)
            if books:
                fits, x = _matrices(batch.column(2), books.width)
                number, distance = search(x)
                code[fits] = [bytes(r).hex() for r in number.astype(np.uint8).tolist()]
                error[fits] = distance.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(table.dtypes)
    return table.mapInArrow(task, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``vector``: the middle of the cells that the code's entries stand for."""
    parts, _, width = books.books.shape
    entries = F.array(*(F.array(*(F.array(*(F.lit((v + 0.5) / SCALE) for v in e)) for e in b)) for b in books.books.tolist()))
    number = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.concat(*(entries[p][number(p)] for p in range(parts)))))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: the error summed over all rows of the same label (nulls together); a label may hold any share of the rows."""
    rows = codes.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = rows.groupBy("__label").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error"))
    return spread_join(rows, totals, ["__label"]).drop("__label")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: code and errors of each vector."""
    table = stash(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    books = fit(table)
    codes = with_label_errors(stash(encode(table, books), "codes"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else hashlib.sha256().hexdigest()).alias("codebooks_sha256"))


def oracle(width: int = 64) -> str:
    """All rounds by plain comparison of each part with each entry, for vectors of ``width`` components."""
    w = width // PARTS
    distance = " + ".join(f"(q[{i}] - e[{i}]) * (q[{i}] - e[{i}])" for i in range(1, w + 1))
    mean = ", ".join(f"(sum(q[{i}]) - (sum(q[{i}]) % count(*) + count(*)) % count(*)) // count(*)" for i in range(1, w + 1))
    steps = []
    for r in range(ROUNDS + 1):
        # a distance and an entry's number in one integer: the least one has the least number among ties
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, any_value(q) AS q, min(({distance}) * {ENTRIES} + i) AS best FROM parts JOIN b{r} USING (p) GROUP BY vec_id, label, p)")
        if r < ROUNDS:
            steps.append(f"m{r} AS MATERIALIZED (SELECT p, best % {ENTRIES} AS i, [{mean}]::BIGINT[] AS e FROM a{r} GROUP BY p, best % {ENTRIES})")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, i, coalesce(m{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN m{r} USING (p, i))")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * {w} + 1, p * {w} + {w}) AS q FROM kept, range({PARTS}) t(p)
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, q AS e FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})
), {", ".join(steps)}, coded AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', best % {ENTRIES}), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, i)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded"""
