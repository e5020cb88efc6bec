"""Quality rules: thresholds per language and source from mergeable quantile sketches.

Each document gets four integer measures (symbols per 1000 word characters, repeated lines per
1000 lines, words in repeated 3-word windows per 1000 words, word length in hundredths). A sketch is a
histogram over log-linear buckets (7 significant bits, so a relative error under 1/64): sketches
merge by adding counts, are exact in any order and need no random numbers. Repetition is rare, so its two
sketches hold the values above zero only; else their quartiles would be zero everywhere. A group of
(language, source) is judged by its own sketch merged with its language's, which is weighed down to
``prior`` values, and the language's by its own merged with that of all, weighed in the same way: a group of
few documents follows its language, a large one itself, and nothing changes at a single size. Limits lie
``reach`` interquartile ranges beyond the quartiles, plus a slack that keeps groups of nearly equal documents
from rejecting each other. A group's
limits are never wider than its language's, nor those of shares wider than those of all, so a source full
of junk cannot lift its own; what words' length is usual differs by language and is not bound by all.

All of it is DataFrame expressions: measures are made in one pass without a shuffle and written
once; what is shuffled afterwards are counts.

Defined cases: null or empty text has no words and fails the base rule; null language or source form
groups of their own; repeated rows are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import RID, TAG, WS, carried, let, restored, row_id, stash, text_of
from quillspark.llm.mixing import per_source

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Values that the coarser sketch counts for in a finer one; reach beyond the quartiles in interquartile ranges.
PRIOR, REACH = 100, 3
#: measure -> (slack, also a lower limit and not bound by other languages, of values above zero only)
MEASURES = {"symbols": (60, False, False), "dup_lines": (20, False, True), "repeats": (20, False, True), "word_len": (150, True, False)}


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array."""

    def covered(tri: Column) -> Column:
        pairs = F.array_sort(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def union(p: Column) -> Column:
            again = F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
            at = F.array_sort(F.transform(again, lambda x: x["i"]))
            start = F.struct(F.lit(-3).alias("prev"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                at,
                start,
                lambda acc, i: F.struct(i.alias("prev"), (acc["n"] + F.least(F.lit(3), i - acc["prev"])).alias("n")),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0).cast("long")).otherwise(let(pairs, union))

    def over(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(windows, covered))

    return let(words, over)


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each row, without the text."""
    t = F.col("t")
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    one = docs.select("doc_id", row_id().alias(RID), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_of().alias("t"))
    return one.select(
        "doc_id", RID, F.xxhash64(t).alias(TAG), "lang", "source",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("rep"))).alias("w"),
        F.length(F.translate(t, WS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    ).select(
        "doc_id", RID, TAG, "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.dup").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"), F.col("l.n").alias("n_lines"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _measures() -> dict[str, Column]:
    per = lambda n, k, d: F.expr(f"{k} * {n} div greatest({d}, 1L)")
    return {"symbols": per("n_symbols", 1000, "word_chars"), "dup_lines": per("n_dup_lines", 1000, "n_lines"), "repeats": per("n_repeat_words", 1000, "n_words"), "word_len": per("word_chars", 100, "n_words")}


def bucket_floor(value: Column) -> Column:
    """The least value of ``value``'s log-linear bucket: seven leading bits are kept."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))


def limits(base: DataFrame, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """lang_key, source_key and for each measure its limits: one row for each (language, source).

    A merged sketch is held in whole numbers: weights are counts times the coarser sketch's total, plus
    ``prior`` times the coarser sketch's weights.
    """
    values = _measures()
    cells = (
        base.where(~F.col("base_failed"))
        .select(_key("lang").alias("lang_key"), _key("source").alias("source_key"), F.explode(F.array(*(F.struct(F.lit(m).alias("m"), bucket_floor(v).alias("v")) for m, v in values.items()))).alias("x"))
        .where(~F.col("x.m").isin([m for m, (_, _, above) in MEASURES.items() if above]) | (F.col("x.v") > 0))
        .groupBy("lang_key", "source_key", "x.m", "x.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    big = lambda c: c.cast("decimal(38,0)")
    groups = base.select(_key("lang").alias("lang_key"), _key("source").alias("source_key")).distinct()
    of_all = cells.groupBy("m", "v").agg(big(F.sum("n")).alias("w"))

    def merged(own: DataFrame, parent: DataFrame, keys: list[str], heads: DataFrame) -> DataFrame:
        """keys, m, v, w: the sketches ``own`` (keys, m, v, n) with ``parent`` (some of keys, m, v, w) as prior, for each of ``heads``."""
        over = [c for c in parent.columns if c in keys]
        total = parent.withColumn("all", F.sum("w").over(Window.partitionBy(*over, "m")))
        each = heads.withColumn("m", F.explode(F.array(*map(F.lit, values))))
        # the sketch of all has a bounded number of cells, whatever the input
        support = each.join(total if over else F.broadcast(total), [*over, "m"])
        both = support.join(own, [*keys, "m", "v"], "left")
        return both.select(*keys, "m", "v", big(big(F.coalesce("n", F.lit(0).cast("long"))) * F.col("all") + prior * F.col("w")).alias("w"))

    def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
        """keys and for each measure its limits."""
        group = Window.partitionBy(*keys, "m")
        ranked = sketch.select("*", F.sum("w").over(group.orderBy("v")).alias("upto"), F.sum("w").over(group).alias("all"))
        at = lambda m, q: F.min(F.when((F.col("m") == m) & (100 * F.col("upto") >= q * F.col("all")), F.col("v"))).alias(f"{m}_{q}")
        table = ranked.groupBy(*keys).agg(*(at(m, q) for m in values for q in (25, 75)))
        lims = []
        for m, (slack, low, _) in MEASURES.items():
            spread = reach * (F.col(f"{m}_75") - F.col(f"{m}_25")) + slack
            lims.append(F.struct((F.col(f"{m}_75") + spread).alias("max"), (F.col(f"{m}_25") - spread if low else F.lit(-1).cast("long")).alias("min")).alias(m))
        return table.select(*keys, F.struct(*lims).alias("limits"))

    per_lang = cells.groupBy("lang_key", "m", "v").agg(F.sum("n").alias("n"))
    lang = merged(per_lang, of_all, ["lang_key"], groups.select("lang_key").distinct())
    own = merged(cells, lang, ["lang_key", "source_key"], groups)
    named = lambda t, name: t.withColumnRenamed("limits", name)
    out = groups.join(named(quartiles(own, ["lang_key", "source_key"]), "own"), ["lang_key", "source_key"], "left")
    out = out.join(named(quartiles(lang, ["lang_key"]), "of_lang"), "lang_key", "left")
    out = out.withColumn("one", F.lit(1)).join(F.broadcast(named(quartiles(of_all.withColumn("one", F.lit(1)), ["one"]), "of_all")), "one", "left")
    ends = []
    for m, (_, low, _) in MEASURES.items():
        for end, tighter in (("max", F.least), ("min", F.greatest)):
            bounds = [F.col(f"{name}.{m}.{end}") for name in (("own", "of_lang") if low else ("own", "of_lang", "of_all"))]
            ends.append(tighter(*bounds).alias(f"{m}_{end}"))
    return out.select("lang_key", "source_key", *ends)


def judge(docs: DataFrame, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """Base counts, verdict and internal ids of each row of ``docs`` (doc_id, text, lang, source)."""
    base = stash(base_measures(docs), "quality")
    out = base.withColumns({"lang_key": _key("lang"), "source_key": _key("source")}).join(per_source(stash(limits(base, prior, reach), "limits")), ["lang_key", "source_key"], "left")
    within = F.lit(True)
    for m, v in _measures().items():
        # with no sketch at all (every row failed the base rule) no limit exists
        within = within & F.coalesce(v.between(F.col(f"{m}_min"), F.col(f"{m}_max")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & within)


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the rules reject; columns as they were."""
    verdict = judge(docs, **options).where("kept").select(RID, TAG).distinct()
    return restored(carried(docs).join(verdict, [RID, TAG], "left_semi"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: verdict of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The same in SQL, sketches included."""
    per = {"symbols": "1000 * n_symbols // greatest(word_chars, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeats": "1000 * n_repeat_words // greatest(n_words, 1)", "word_len": "100 * word_chars // greatest(n_words, 1)"}
    floor = lambda v: f"(({v}) >> greatest(length(bin({v})) - 7, 0)) << greatest(length(bin({v})) - 7, 0)"
    cells = " UNION ALL ".join(f"SELECT lk, sk, '{m}' AS m, {floor(m)} AS v FROM x WHERE NOT base_failed" + (f" AND {m} > 0" if above else "") for m, (_, _, above) in MEASURES.items())
    limits = ", ".join(
        f"max(q75) FILTER (WHERE m = '{m}') + {REACH} * (max(q75) FILTER (WHERE m = '{m}') - max(q25) FILTER (WHERE m = '{m}')) + {slack} AS {m}_max, "
        + (f"max(q25) FILTER (WHERE m = '{m}') - {REACH} * (max(q75) FILTER (WHERE m = '{m}') - max(q25) FILTER (WHERE m = '{m}')) - {slack}" if low else "-1") + f" AS {m}_min"
        for m, (slack, low, _) in MEASURES.items()
    )
    level = lambda name, src, keys: f"{name} AS (SELECT {keys}, {limits} FROM (SELECT {keys}, m, min(v) FILTER (WHERE 100 * upto >= 25 * total) AS q25, min(v) FILTER (WHERE 100 * upto >= 75 * total) AS q75 FROM (SELECT *, sum(w) OVER (PARTITION BY {keys}, m ORDER BY v) AS upto, sum(w) OVER (PARTITION BY {keys}, m) AS total FROM {src}) GROUP BY {keys}, m) GROUP BY {keys})"
    within = " AND ".join(
        f"coalesce({m} BETWEEN " + (f"greatest(o.{m}_min, l.{m}_min) AND least(o.{m}_max, l.{m}_max)" if low else f"-1 AND least(o.{m}_max, l.{m}_max, a.{m}_max)") + ", true)" for m, (_, low, _) in MEASURES.items()
    )
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda z: z <> '') AS ws, list_filter(string_split(t, chr(10)), lambda z: trim(z, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, coalesce('=' || lang, '-') AS lk, coalesce('=' || source, '-') AS sk, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda z: length(z))), 0)::BIGINT AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN r USING (doc_id)),
x AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {', '.join(f'{e} AS {m}' for m, e in per.items())} FROM b),
cells AS (SELECT lk, sk, m, v, count(*)::HUGEINT AS n FROM ({cells}) GROUP BY ALL),
groups AS (SELECT DISTINCT lk, sk FROM x),
al AS (SELECT 1 AS one, m, v, sum(n) AS w FROM cells GROUP BY m, v),
la AS (SELECT g.lk, al.m, al.v, coalesce(c.n, 0) * (sum(al.w) OVER (PARTITION BY g.lk, al.m)) + {PRIOR} * al.w AS w
  FROM (SELECT DISTINCT lk FROM groups) g CROSS JOIN al LEFT JOIN (SELECT lk, m, v, sum(n) AS n FROM cells GROUP BY ALL) c ON c.lk = g.lk AND c.m = al.m AND c.v = al.v),
ow AS (SELECT g.lk, g.sk, la.m, la.v, coalesce(c.n, 0) * (sum(la.w) OVER (PARTITION BY g.lk, g.sk, la.m)) + {PRIOR} * la.w AS w
  FROM groups g JOIN la USING (lk) LEFT JOIN cells c ON c.lk = g.lk AND c.sk = g.sk AND c.m = la.m AND c.v = la.v),
{level('a', 'al', 'one')}, {level('l', 'la', 'lk')}, {level('o', 'ow', 'lk, sk')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept
FROM x LEFT JOIN o ON o.lk = x.lk AND o.sk = x.sk LEFT JOIN l ON l.lk = x.lk LEFT JOIN a ON true
"""
