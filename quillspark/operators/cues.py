"""The six-family cue rubric, coverage and tone, from extracted texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as tx

FAMILIES = 6
_FAMILY = "struct<id: string, name: string, points: int, detail: string>"


def _family(when: Column, key: str, name: str, points: Column | int, detail: Column) -> Column:
    points = points if isinstance(points, Column) else F.lit(points)
    return F.when(when, F.struct(F.lit(key).alias("id"), F.lit(name).alias("name"), points.cast("int").alias("points"), detail.alias("detail")))


def _join(items: Column, sep: str = ", ") -> Column:
    return F.array_join(items, sep)


def _counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"))


def short_run(lengths: Column) -> Column:
    """The longest run of lengths of at most 12."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, n: Column) -> Column:
        run = F.when(n <= 12, a["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(lengths, start, step, lambda a: a["best"])


def coverage() -> Column:
    m, language = (lambda k: F.col(f"metrics.{k}")), F.col("language_support")
    of = lambda a, t, r: F.struct(F.lit(a).alias("level"), F.lit(t).alias("text"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (
        F.when(language["state"] == "unsupported", of("unsupported", "Unsupported-language sample", language["reason"]))
        .when((m("wordCount") < 20) | (m("sentenceCount") < 2), of("short", "Short sample", "fewer than 20 words or 2 sentences"))
        .when((m("wordCount") >= 80) & (m("sentenceCount") >= 4) & (language["state"] == "supported"), of("long", "Long sample", "at least 80 words and 4 sentences"))
        .otherwise(of("standard", "Standard sample", "at least 20 words and 2 sentences, below the long-sample cutoff"))
    )


def assess(m: str = "cue_measures") -> Column:
    """level, text, points, families, coverage, contentRepeat from the extracted columns, cue measures among them."""
    c = lambda path: F.col(f"{m}.{path}")
    framing = F.concat(c("matched.template"), c("matched.transition"), c("matched.rhetorical"))
    buzz, hedge = c("matched.buzz"), c("matched.hedge")
    strength = F.size(framing) + F.when(F.size(buzz) >= 2, 1).otherwise(0)
    examples = F.slice(F.array_distinct(F.concat(framing, buzz)), 1, 4)
    starters, run, n = c("sentences.starters"), short_run(c("sentences.lengths")), c("sentences.n")
    repeats, runs = F.size(starters) > 0, run >= 3
    listed = _join(F.transform(F.slice(starters, 1, 3), lambda x: F.concat(x["word"], F.lit(" x"), x["count"].cast("string"))))
    rhythm = F.concat_ws("; ", F.when(repeats, F.concat(F.lit("repeated openings ("), listed, F.lit(")"))), F.when(runs, _counted(run, "consecutive short rhetorical sentences")))
    lists, colons, dashes = c("lists"), c("colons"), c("dashes")
    structured = (lists >= 3) | ((colons >= 2) & (dashes >= 1)) | ((dashes >= 3) & (n >= 4))
    parts = F.concat_ws(", ", F.when(lists > 0, _counted(lists, "list markers")), F.when(colons > 0, _counted(colons, "colons")), F.when(dashes > 0, _counted(dashes, "dash asides")))
    words, repeat = F.col("metrics.wordCount"), c("repeat")
    families = F.filter(F.array(
        _family(F.size(hedge) > 0, "self-disclosure", "AI self-reference", 3, F.concat(F.lit("Explicit wording: "), _join(F.slice(hedge, 1, 2)))),
        _family(strength > 0, "formulaic-framing", "Formulaic framing", F.when(strength >= 3, 2).otherwise(1), F.concat(F.lit("Stock framing or promotional phrases: "), _join(examples))),
        _family(repeats | runs, "parallel-rhythm", "Parallel rhetorical rhythm", F.when(repeats & runs, 2).otherwise(1), rhythm),
        _family(structured, "structured-presentation", "Highly structured presentation", 1, parts),
        _family((n >= 5) & (F.col("metrics.sentenceLenCV") <= 0.28), "sentence-uniformity", "Uniform sentence cadence", 1,
                F.concat(F.lit("Sentence-length variation is low across "), n.cast("string"), F.lit(" sentences"))),
        _family((words >= 60) & (repeat >= 0.08), "content-repetition", "Repeated content phrasing", 1,
                F.concat(tx.percent(repeat).cast("string"), F.lit("% repeated content-word pairs after stopword removal"))),
    ), lambda x: x.isNotNull())

    def result(fs: Column) -> Column:
        level = F.when(F.size(fs) == 0, "cue-none").when(F.size(fs) == 1, "cue-one").otherwise("cue-multiple")
        return F.struct(
            level.alias("level"), F.concat(F.size(fs).cast("string"), F.lit(f"/{FAMILIES} cue families")).alias("text"),
            F.aggregate(fs, F.lit(0), lambda a, x: a + x["points"]).alias("points"), fs.alias("families"), F.lit(FAMILIES).alias("totalFamilies"),
            coverage().alias("coverage"), repeat.alias("contentRepeat"), tone(fs).alias("tone"))

    return tx.let(families.cast(f"array<{_FAMILY}>"), result)


def tone(families: Column) -> Column:
    n = F.size(families)
    return F.when(n == 0, "clear").when(n <= 3, "caution").otherwise("alert")
