"""One automaton for all phrases: a text is scanned once, and a hit counts if it stands between non-alphanumerics."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import lexicons as lx

_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_held: dict[str, ahocorasick.Automaton] = {}  # stays empty on the driver, so that no automaton travels with the code


def _automaton() -> ahocorasick.Automaton:
    if not _held:
        own: dict[str, list[tuple[int, int]]] = {}
        for family, phrases in enumerate(lx.FAMILIES.values()):
            for i, p in enumerate(phrases):
                own.setdefault(p, []).append((family, i))
        made = ahocorasick.Automaton()
        for p, places in own.items():
            made.add_word(p, (len(p), places))
        made.make_automaton()
        _held["all"] = made
    return _held["all"]


def scan(lowered: str) -> Iterator[tuple[int, int]]:
    """(family, phrase), by their numbers, of each occurrence in lower-case text; occurrences of one phrase do not share a character, nor the one before them."""
    ended: dict[tuple[int, int], int] = {}
    size = len(lowered)
    for at, (length, places) in _automaton().iter(lowered):
        begin, end = at - length + 1, at + 1
        if (begin and lowered[begin - 1] in _INSIDE) or (end < size and lowered[end] in _INSIDE):
            continue
        for place in places:
            if begin == 0 or begin - 1 >= ended.get(place, 0):
                ended[place] = end
                yield place


@F.arrow_udf(T.ArrayType(T.LongType()))
def phrase_counts(lowered: pa.Array) -> pa.Array:
    """Occurrences by family, in the families' order."""
    out = []
    for t in lowered.to_pylist():
        n = [0] * len(lx.FAMILIES)
        for family, _ in scan(t or ""):
            n[family] += 1
        out.append(n)
    return pa.array(out, pa.list_(pa.int64()))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def phrases_met(lowered: pa.Array) -> pa.Array:
    """The phrases that occur, in the lists' order, by family."""
    out = []
    for t in lowered.to_pylist():
        met: list[set] = [set() for _ in lx.FAMILIES]
        for family, phrase in scan(t or ""):
            met[family].add(phrase)
        out.append([[own[j] for j in sorted(m)] for own, m in zip(lx.FAMILIES.values(), met, strict=True)])
    return pa.array(out, pa.list_(pa.list_(pa.string())))
