"""Edit-aware token counts: a segment tree of pre-tokens per document.

Leaves hold stretches of text that end where a pre-token ends; nodes hold sums of characters and
tokens. An edit (delete some characters at a place, insert a text) finds the leaves that it touches by
the sums of characters. Their text is edited and encoded again, together with a neighbour where the
edit changed what the bound depends on (a bound stands before a run of white space, after another
character); the new leaves take the place of the old ones and the sums above them are renewed.
Everything else keeps its counts. The result is the count of encoding the edited text as a whole.

Edits are an array of (pos, del, ins) in code points, applied in order, each to the text that the one
before it left; places beyond the end mean the end.

Defined cases: null or empty text counts 0 tokens and can be edited; null or missing edits change
nothing, and null fields of an edit count as 0 or empty; repeated rows are counted row by row; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import text_of
from quillspark.llm.token_records import _PIECES, Encoder, encoder, tokenizer_path

LEAF = 512
_WS = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | frozenset(map(chr, range(0x2000, 0x200B)))


class Node:
    __slots__ = ("chars", "tokens", "left", "right", "text", "depth")

    def __init__(self, left: Node | None = None, right: Node | None = None, text: str | None = None, tokens: int = 0):
        self.left, self.right, self.text = left, right, text
        if text is None:
            self.chars, self.tokens, self.depth = left.chars + right.chars, left.tokens + right.tokens, 1 + max(left.depth, right.depth)
        else:
            self.chars, self.tokens, self.depth = len(text), tokens, 0


class Counter:
    """Trees and edits for one tokenizer. ``encoded`` counts the characters that were encoded."""

    def __init__(self, encoder: Encoder, leaf: int = LEAF):
        self.encoder, self.leaf, self.encoded = encoder, leaf, 0

    def leaves(self, text: str) -> list[Node]:
        pieces = _PIECES.findall(text)
        if not pieces:
            return []
        self.encoded += len(text)
        counts = self.encoder.counts(pieces)
        stops = np.cumsum([len(p) for p in pieces])
        cuts, last = [], 0
        while last < len(pieces):
            begin = stops[last - 1] if last else 0
            last = max(last + 1, int(np.searchsorted(stops, begin + self.leaf, side="right")))
            cuts.append(last)
        sums = np.cumsum(counts)
        out, at, total = [], 0, 0
        for c in cuts:
            stop, upto = int(stops[c - 1]), int(sums[c - 1])
            out.append(Node(text=text[at:stop], tokens=upto - total))
            at, total = stop, upto
        return out

    def join(self, nodes: list[Node]) -> Node | None:
        while len(nodes) > 1:
            nodes = [Node(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0] if nodes else None

    def build(self, text: str) -> Node | None:
        return self.join(self.leaves(text))

    @staticmethod
    def around(root: Node, place: int) -> tuple[int, str]:
        """(where it begins, text) of the leaf that holds character ``place``."""
        node, begin = root, 0
        while node.text is None:
            if place < begin + node.left.chars:
                node = node.left
            else:
                begin, node = begin + node.left.chars, node.right
        return begin, node.text

    @staticmethod
    def texts(node: Node | None) -> Iterator[Node]:
        stack = [node] if node else []
        while stack:
            x = stack.pop()
            if x.text is None:
                stack += [x.right, x.left]
            else:
                yield x

    def splice(self, node: Node, a: int, b: int, new: list, begin: int = 0) -> Node | None:
        """``node`` without its leaves in [a, b), with ``new`` (a list of one subtree, taken once) where they began."""
        if begin + node.chars <= a or begin >= b:
            return node
        if node.text is not None or (begin >= a and begin + node.chars <= b):
            return new.pop() if new else None
        left, right = self.splice(node.left, a, b, new, begin), self.splice(node.right, a, b, new, begin + node.left.chars)
        return Node(left, right) if left and right else left or right

    def edit(self, root: Node | None, place: int, delete: int, insert: str) -> Node | None:
        if root is None:
            return self.build(insert)
        place = min(max(place, 0), root.chars)
        stop = min(place + max(delete, 0), root.chars)
        if place == stop and not insert:
            return root
        a, first = self.around(root, min(place, root.chars - 1))
        begin, last = self.around(root, max(place, stop - 1) if stop > place else min(place, root.chars - 1))
        b = begin + len(last)
        text = first[: place - a] + insert + last[stop - begin :]
        while a > 0:
            x, before = self.around(root, a - 1)
            if before[-1] not in _WS and text[:1] in _WS and text:
                break
            a, text = x, before + text
        while b < root.chars:
            x, after = self.around(root, b)
            if text and text[-1] not in _WS and after[0] in _WS:
                break
            b, text = x + len(after), text + after
        fresh = self.build(text)
        root = self.splice(root, a, b, [fresh] if fresh else [])
        if root and root.depth > 8 + 3 * math.log2(1 + root.chars / self.leaf):
            root = self.join(list(self.texts(root)))
        return root


def count(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, tokens before and after the row's ``edits``, characters after, and characters encoded for the edits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(encoder(tokenizer or tokenizer_path()), leaf)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                root = counter.build(text.as_py())
                before, counter.encoded = root.tokens if root else 0, 0
                for e in edits or []:
                    if e:
                        root = counter.edit(root, e["pos"] or 0, e["del"] or 0, e["ins"] or "")
                out.append((before, root.tokens if root else 0, root.chars if root else 0, counter.encoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))] if out else [batch.column(0), *[pa.array([], pa.int64())] * 4], names=["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of(), F.col("edits").cast("array<struct<pos: long, del: long, ins: string>>"))
    return rows.mapInArrow(task, "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: counts of each document before and after three edits: in its middle, at its start, at its end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.char_length(text_of())
    edit = lambda pos, cut, ins: F.struct(pos.cast("long").alias("pos"), F.lit(cut).cast("long").alias("del"), ins.alias("ins"))
    mark = F.concat(F.lit(" [edit "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("] "))
    edits = F.array(edit(F.floor(n / 2), 7, mark), edit(F.lit(0), 3, F.lit("Re: ")), edit(n + 100, 0, F.lit("\n-- end")))
    return count(docs.withColumn("edits", edits))
