"""Queries of sources, imports, augmentation, splits, training, evaluation and streams, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import models as md
from quillspark.functions import text as tx
from quillspark.operators import augment, evaluate, prepare, split, train
from quillspark.plans.style import CALIBRATED, _quoted
from quillspark.sources import html, readers
from quillspark.streaming import rescore

#: Spellings of labels that rows of ``labels`` get in turn, and what training and import make of each.
LABELS = [
    ("Human", 0, "human"), ("hwt", 0, "human"), ("real", None, "human"), ("1", 1, "ai"), ("AI_generated", 1, "ai"), ("fake", None, "ai"), ("2", 2, "mixed"), ("human-polished", 2, "mixed"), ("co_authored", 2, None),
    ("ai-polished", 2, None), ("true", 1, None), ("perhaps", None, None), (None, None, None),
]
_TITLE = "Notes on a repair, part "
#: Markup of a turn as a page of each site; T is its text, N its number.
MARKUP = {
    "linkedin": '<main><div class="feed-shared-update-v2" id="post"><div class="update-components-actor__container"><span>Somebody with a very long line about their present position</span></div>'
    '<div class="update-components-text">T<button>see more</button></div><ul><li class="comments-comment-item" id="reply"><span class="comments-comment-item__main-content">In reply to N: T</span></li></ul></div></main>',
    "reddit": f'<shreddit-post id="post"><h1 slot="title">{_TITLE}N</h1><div slot="text">T&nbsp;</div></shreddit-post>'
    '<shreddit-comment id="reply"><div slot="comment">In reply to N: T</div><shreddit-comment id="nested"><div slot="comment">Once  more: T</div></shreddit-comment></shreddit-comment>',
    "x": '<article role="article" id="post"><div data-testid="tweetText">N</div><div data-testid="tweetText">T and N</div></article>'
    '<article role="article" id="reply"><div data-testid="socialContext">Replying to @a</div><div data-testid="tweetText">In reply to N: T</div></article>',
}


def _site_pages(spark: SparkSession, d: str, platform: str) -> DataFrame:
    """The turns of every third conversation as pages of a site: page_id and html."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").where((F.pmod("conv_id", F.lit(3)) == list(MARKUP).index(platform)) & F.col("turn").isNotNull())
    text = F.coalesce("text", F.lit(""))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    number = F.concat_ws("-", "conv_id", "turn")
    pieces = [F.lit(x) if x not in ("T", "N") else text if x == "T" else number for x in re.split(r"\b([TN])\b", MARKUP[platform])]
    return turns.select(number.alias("page_id"), F.concat(*pieces).alias("html"))


def site_elements(spark: SparkSession, d: str) -> DataFrame:
    """Posts and comments of conversations that were put into the markup of the three sites, each with the element around it."""
    out = None
    for platform in MARKUP:
        found = html.elements(_site_pages(spark, d, platform), platform)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("parent_id", F.coalesce("parent_id", F.lit("")))


def posts_only(spark: SparkSession, d: str) -> DataFrame:
    """The pages of one site without comments."""
    return html.elements(_site_pages(spark, d, "reddit"), "reddit", comments=False).select("page_id", "element_id")


def _spelled(spark: SparkSession, d: str) -> DataFrame:
    """``labels`` with a spelling for each row."""
    cell = F.get(F.array(*(F.lit(x).cast("string") for x, _, _ in LABELS)), F.pmod("doc_id", F.lit(len(LABELS))).cast("int"))
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", cell.alias("label"))


def label_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Each row's spelling of a label as the target and the authorship that it stands for."""
    rows = _spelled(spark, d)
    return rows.select("doc_id", F.coalesce(prepare.target_of(F.col("label")), F.lit(-1)).cast("long").alias("target"), F.coalesce(prepare.authorship_of(F.col("label")), F.lit("none")).alias("authorship"))


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Documents with spelled labels, imported where they can be: rows kept and rejected by reason, and the counts observed on the way."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.when(F.pmod("doc_id", F.lit(11)) != 5, F.col("text")).alias("text"), "lang")
    found = prepare.sort_out(docs.join(_spelled(spark, d), "doc_id"), readers.scratch(spark, "sorted"), row="doc_id")
    of = lambda df, what: df.groupBy(what.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.substring("source_id", 5, 20).cast("long")).alias("ids"))
    rows = of(found.kept, F.concat(F.lit("kept "), F.col("authorship"))).unionByName(of(found.rejected, F.concat(F.lit("rejected "), F.col("reason"))))
    rows.collect()  # the counts are there once the rows were written
    seen = spark.createDataFrame([(f"observed {k}", v, 0) for k, v in found.counts.items()], "state string, n long, ids long")
    return rows.unionByName(seen)


def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Documents written to several files of JSON lines and of CSV, read in small splits: each record's number among all."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("source").alias("content"), F.when(F.pmod("doc_id", F.lit(9)) != 4, F.lit("human")).alias("label"))
    key, out = "spark.sql.files.maxPartitionBytes", None
    before = spark.conf.get(key)
    try:
        for kind in ("jsonl", "csv"):
            path = readers.scratch(spark, kind)
            spark.conf.set(key, before)
            # by file and then by id, so that a record's place follows from its id
            dealt = rows.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")
            dealt.write.json(path) if kind == "jsonl" else dealt.write.option("header", True).csv(path)
            # several splits a file, as many however large the files are, up to the size that the session splits at
            spark.conf.set(key, f"{readers.split_size(spark, path, before)}b")
            numbered = readers.numbered(readers.read_records(spark, path))
            kept = prepare.import_records(numbered.withColumnRenamed("doc_id", "number"), row="row")
            found = numbered.repartition(7).join(kept.select("source_id"), F.col("source_id") == F.concat(F.lit("row-"), F.col("row").cast("string")), "left")
            found = readers.written(found.select(F.lit(kind).alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), "row", F.coalesce("source_id", F.lit("left out")).alias("source_id")), "numbers")
            out = found if out is None else out.unionByName(found)
    finally:
        spark.conf.set(key, before)
    return out


def read_back(spark: SparkSession, d: str) -> DataFrame:
    """Nations written as JSON lines, JSON, CSV and Parquet and read by kind of file."""
    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("text"), F.col("n_regionkey").cast("long").alias("label"))
    out = None
    for kind in ("jsonl", "json", "csv", "parquet"):
        path = readers.scratch(spark, kind)
        if kind == "jsonl":
            readers.write_jsonl(rows, path)
        elif kind == "json":
            whole = F.to_json(F.struct(F.collect_list(F.struct("id", "text", "label")).alias("data")))  # the 25 nations
            rows.agg(whole.alias("value")).write.text(path)
        elif kind == "csv":
            rows.write.option("header", True).csv(path)
        else:
            rows.write.parquet(path)
        got = readers.read_records(spark, path).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "text", F.col("label").cast("long").alias("label"))
        out = got if out is None else out.unionByName(got)
    return out


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("target"), F.lit("post").alias("kind"), F.col("source").alias("source_id"))


def split_audit(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in groups of the three parts when whole sources are dealt, and groups that two parts share."""
    parts, about = split.split(_labelled(spark, d))
    found = split.audit(parts, about)
    groups = {r.part: r.n for r in parts.select("part", "source_id").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(found["method"], sum(found[f"n_{p}"] for p in split.PARTS)), *((f"groups {p}", groups.get(p, 0)) for p in split.PARTS), *((f"overlap {k}", n) for k, n in found["group_overlap"].items())]
    return spark.createDataFrame(rows, "item string, n long")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows by part and target when every row is a group of its own."""
    parts, _ = split.split(_labelled(spark, d).withColumn("source_id", F.col("doc_id").cast("string")))
    return parts.groupBy("part", F.col("target").cast("long").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated scores of logits from -60 to 60, made of the documents' lengths: clipped, never exactly 0 or 1."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.pmod("n_chars", F.lit(121)) - 60).alias("logit"))
    value = train.calibrated(F.col("logit").cast("double"), {"slope": 0.75, "intercept": -0.5})
    return rows.select("doc_id", F.round(value, 12).alias("score"), (value > 0).alias("above_0"))


def mixed_slices(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of mixed rows (here: toxic ones) by slice."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    score = (F.pmod(F.col("n_chars") * 13, F.lit(1000)) / 1000.0).alias("score")
    rows = docs.join(labels, "doc_id").select(F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).cast("int").alias("target"), score, F.col("source").alias("platform"), F.col("lang").alias("language"), F.regexp_count("text", F.lit(r"\S+")).alias("words"))
    out = evaluate.slice_report(rows, 0.5).where("mixed_n is not null")
    return out.select("dimension", "value", "mixed_n", *(F.round(f"mixed_{c}", 6).alias(c) for c in ("mean_signal", "median_signal", "share_at_or_above_strong")))


def threshold_report(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff for one class at several rates: quantile, moderate cutoff, rate on that class, least rate that it can resolve."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select(F.col("quality").cast("int").alias("target"), ((F.pmod(F.col("n_chars") * 7919, F.lit(9973)) + 1) / 9974.0).alias("score"))
    out = []
    for rate in (0.01, 0.05, 0.25):
        t = evaluate.human_threshold(rows, rate)
        out.append((rate, round(t["strong"], 9), round(t["moderate"], 9), t["calibration_human_n"], round(t["empirical_calibration_fpr"], 9), round(t["minimum_resolvable_fpr"], 9)))
    return spark.createDataFrame(out, "rate double, strong double, moderate double, n long, fpr double, resolvable double")


def subsets(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one platform and kind, and those of two classes among them, in conversations."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.when(F.col("role") == "user", "comment").otherwise("post").alias("kind"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "x").otherwise("reddit").alias("platform"), F.pmod("turn", F.lit(3)).cast("int").alias("target"))
    own = prepare.subset(rows, "x", "comment")
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rows"), "n")
    return count("all", rows).unionByName(count("subset", own)).unionByName(count("binary", prepare.binary(own)))


def published_model(spark: SparkSession, d: str) -> DataFrame:
    """Models of one platform of a bundle after one was put in whose numbers come from labelled documents."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select(F.col("quality").cast("int").alias("target"), (F.pmod("n_chars", F.lit(997)) / 997.0).alias("score"))
    share = rows.agg(F.avg("target")).first()[0]
    own = {"intercept": float(share), "weights": {"mattr25": float(share) * 2}, "charNgramWeights": [float(share)] * 128, "calibration": {"slope": 1.0, "intercept": 0.0}, "thresholds": evaluate.human_threshold(rows, 0.1)}
    key, model = md.exported({"models": {"x:comment": CALIBRATED["models"]["reddit:post"], "x:post": own}}, "x:post")
    bundle = md.for_platform(md.published(md.DEFAULT_BUNDLE, key, model, "documents"), "x")
    md.as_json(bundle)
    table = md.model_table(spark, bundle)
    return table.select("model_key", F.round("intercept", 9).alias("intercept"), F.size("weight_keys").cast("long").alias("n_weights"), F.coalesce(F.size("char_weights"), F.lit(0)).cast("long").alias("n_chars"), F.col("slope").isNotNull().alias("calibrated"), F.round("moderate", 9).alias("moderate"), F.round("strong", 9).alias("strong"))


#: Least rows of a model in ``trained``.
LEAST_ROWS = 60


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as training records: quality is the target, sources stand for platforms and kinds."""
    docs, labels = readers.read_table(spark, f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    number = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(3))
    rows = docs.join(labels, "doc_id").where("quality in (0, 1) and text is not null")
    platform = F.when(number == 0, "linkedin").when(number == 1, "reddit").otherwise("x")
    return rows.select("doc_id", "text", F.col("quality").cast("int").alias("label"), platform.alias("platform"), F.when(F.pmod("doc_id", F.lit(4)) == 0, "comment").otherwise("post").alias("kind"), F.col("doc_id").cast("string").alias("source_id"))


def trained(spark: SparkSession, d: str) -> DataFrame:
    """All seven models of labelled documents: sizes of parts, and whether each is trained or left out for want of rows."""
    weights, report = train.train_all(prepare.normalize_rows(_records(spark, d)), min_total=LEAST_ROWS, target_fpr=0.1)
    out = []
    for k, m in weights["models"].items():
        r = report["models"][k]
        out.append((k, "trained", r["split"]["n_train"], r["split"]["n_calibration"], r["split"]["n_test"], r["test"]["n"], len(m["charNgramWeights"])))
    out += [(k, "skipped", 0, 0, 0, r["n_total"], 0) for k, r in report["skipped_models"].items()]
    return spark.createDataFrame(out, "model string, state string, n_train long, n_calibration long, n_test long, n long, n_chars long")


def fit_gradients(spark: SparkSession, d: str) -> DataFrame:
    """The gradient of each source's penalised likelihood, and of all sources' together, where one fit of all of them ends: 0 in each coordinate."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    n = lambda p: F.regexp_count("text", F.lit(p)) / F.greatest(F.char_length("text"), F.lit(1))
    inputs = F.array(n("[aeiou]") * 10, n("[.,]") * 50, F.log1p(F.col("n_chars").cast("double")))
    rows = docs.join(labels, "doc_id").where("quality in (0, 1) and source is not null").select("source", inputs.alias("inputs"), F.col("quality").cast("int").alias("target"))
    both = [r.source for r in rows.groupBy("source").agg(F.count_distinct("target").alias("n")).where("n = 2").collect()]
    rows = rows.withColumn("models", F.when(F.col("source").isin(both), F.array("source", F.lit("all"))).otherwise(F.array(F.lit("all"))))
    fitted = train.fit_many(rows, balanced=False)
    each = rows.select("inputs", "target", F.explode("models").alias("model"))
    of = lambda values: F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), F.col("model"))
    weights = of({k: F.array(*map(F.lit, [*w, b])) for k, (w, b) in fitted.items()})
    each = each.withColumns({"z": F.concat("inputs", F.array(F.lit(1.0))), "w": weights})
    each = each.withColumn("residual", 1.0 / (1.0 + F.exp(-F.aggregate(F.zip_with("z", "w", lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x))) - F.col("target"))
    parts = [F.sum(F.col("residual") * F.col("z")[i]) + (F.first(F.col("w")[i]) if i < 3 else 0.0) for i in range(4)]
    got = each.groupBy("model").agg(*(F.round(p, 6).alias(f"g{i}") for i, p in enumerate(parts)))
    return got.select("model", F.posexplode(F.array("g0", "g1", "g2", "g3")).alias("part", "gradient")).select("model", F.col("part").cast("long").alias("part"), F.abs("gradient").alias("gradient"))


def typing_errors(spark: SparkSession, d: str) -> DataFrame:
    """Documents with one typing error: their characters in order, and whether two places differ (or none, where alike letters were swapped)."""
    rows = readers.read_table(spark, f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = F.array_join(F.filter(F.split("text", tx.SPACE + "+"), lambda w: w != ""), " ")
    typo = augment.add_typo(F.col("text"), F.col("doc_id").cast("string"))
    rows = rows.select("doc_id", tx.fixed(F.split(typo, "")).alias("a"), F.split(F.col("text"), "").alias("b"), F.split(joined, "").alias("c"))
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p.eqNullSafe(q), 0).otherwise(1)), F.lit(0), lambda m, p: m + p)
    n = F.least(apart("a", "b"), apart("a", "c"))
    return rows.select("doc_id", F.md5(F.encode(F.array_join(F.array_sort("a"), ""), "UTF-8")).alias("letters_md5"), n.isin(0, 2).alias("one_swap"))


def close_scores(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of scores that all lie within a millionth of each other."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    score = 0.25 + (F.pmod(F.col("n_chars") * 7 + F.col("quality") * 311, F.lit(1000)) * 1e-9)
    rows = docs.join(labels, "doc_id").select("lang", F.col("quality").cast("int").alias("target"), score.alias("score"))
    out = evaluate.binary_metrics(rows, ["lang"], 0.5).join(evaluate.medians(rows, ["lang"]), "lang")
    return out.select("lang", "n", F.round("roc_auc", 6).alias("roc_auc"), F.round("average_precision", 6).alias("average_precision"), F.round((F.col("median") - 0.25) * 1e9, 3).alias("median"))


def fit_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The gradient of the penalised likelihood where a fit on labelled documents ends: 0 in each coordinate."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    n = lambda p: F.regexp_count("text", F.lit(p)) / F.greatest(F.char_length("text"), F.lit(1))
    rows = docs.join(labels, "doc_id").select(F.array(n("[aeiou]") * 10, n("[.,]") * 50, F.log1p(F.col("n_chars").cast("double"))).alias("inputs"), F.col("quality").cast("int").alias("target"))
    w, b = train.fit(rows, balanced=False)
    residual = 1.0 / (1.0 + F.exp(-train.logit(w, b))) - F.col("target")
    each = [F.sum(residual * F.element_at("inputs", i + 1)) + w[i] for i in range(3)]
    got = rows.agg(*(F.round(g, 3).alias(f"g{i}") for i, g in enumerate(each)), F.round(F.sum(residual), 3).alias("g3"))
    return got.select(F.posexplode(F.array("g0", "g1", "g2", "g3")).alias("part", "gradient")).select(F.col("part").cast("long").alias("part"), F.abs("gradient").alias("gradient"))


def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits of one element per user, read as a file stream: which of them the stream would have scored again."""
    source, target, checkpoint = (readers.scratch(spark, k) for k in ("events", "changes", "checkpoint"))
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select(F.col("user_id").cast("string").alias("element_id"), F.unix_micros(F.col("ts").cast(T.TimestampType())).alias("seq"), F.lit("reddit").alias("platform"), F.lit("post").alias("kind"), F.col("event_type").alias("text"))
    rows = rows.where("seq is not null and element_id is not null")
    lo, hi = rows.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    write = lambda batch, n: batch.select("element_id", "seq", "text", "fingerprint").write.mode("overwrite").parquet(f"{target}/batch={n}")
    for i in range(4):  # a quarter of the time has as many files as the table has splits; all of them are one micro-batch
        rows.where(F.least(F.floor((F.col("seq") - lo) * 4 / max(hi - lo, 1)), F.lit(3)) == i).write.mode("append").json(source)
        stream = spark.readStream.schema(rows.schema).json(source)
        rescore.changes(stream, forget=0).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("element_id string, seq long, text string, fingerprint string").parquet(f"{target}/batch=*")
    return found.groupBy("element_id", "text").agg(F.count(F.lit(1)).alias("scored"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The beginnings of texts, at most 110 characters."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))


# ---- SQL ----


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else _quoted(v) if isinstance(v, str) else repr(v) + ("::DOUBLE" if isinstance(v, float) else "::BIGINT")
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


def _fingerprint_sql() -> str:
    digit = lambda i: f"substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // {36**i}) % 36 + 1)::INT, 1)"
    units = "list_transform(string_split('post' || chr(10) || coalesce(text, ''), ''), lambda ch: ord(ch)::BIGINT)"
    return (
        f"SELECT doc_id, CASE WHEN h = 0 THEN '0' ELSE ltrim({' || '.join(digit(i) for i in range(6, -1, -1))}, '0') END AS fingerprint FROM (SELECT doc_id, "
        f"list_reduce(list_prepend(2166136261::BIGINT, {units}), lambda a, u: (xor(a, u) * 16777619) & 4294967295) AS h FROM documents)"
    )


def _trained_sql() -> str:
    """Sizes of the parts of each model by strata of target (a model's kind is one, but for the default's)."""
    cut = lambda of, n, name, by: f"""{name}q AS (SELECT *, floor({of} * {n})::BIGINT AS whole, {of} * {n} - floor({of} * {n}) AS rest, sum({n}) OVER ({by}) AS total FROM {{0}}),
{name} AS (SELECT *, whole + CASE WHEN row_number() OVER ({by} ORDER BY -rest, s) <= ceil({of} * total) - sum(whole) OVER ({by}) THEN 1 ELSE 0 END AS {name}_n FROM {name}q)"""  # noqa: E731
    by, share = "PARTITION BY model", "(0.2::DOUBLE / (1 - 0.2::DOUBLE))"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(source, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, "
        "b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"
    )
    return f"""WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8), r AS MATERIALIZED (
  SELECT quality AS y, CASE {crc} % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'reddit' ELSE 'x' END AS platform, CASE WHEN doc_id % 4 = 0 THEN 'comment' ELSE 'post' END AS kind
  FROM documents JOIN labels USING (doc_id), crc WHERE quality IN (0, 1) AND text IS NOT NULL
), e AS (
  SELECT platform || ':' || kind AS model, y, y || ':' || kind AS s FROM r UNION ALL SELECT 'default', y, y || ':' || kind FROM r
), names AS (
  SELECT 'default' AS model UNION ALL SELECT p || ':' || k FROM (VALUES ('linkedin'), ('reddit'), ('x')) a(p), (VALUES ('post'), ('comment')) b(k)
), sizes AS (
  SELECT model, count(y) AS n, count(y) FILTER (WHERE y = 0) AS zeros, count(y) FILTER (WHERE y = 1) AS ones FROM names LEFT JOIN e USING (model) GROUP BY model
), strata AS (
  SELECT model, s, count(*) AS n FROM e JOIN sizes z USING (model) WHERE z.n >= {LEAST_ROWS} AND zeros >= {train.MIN_CLASS} AND ones >= {train.MIN_CLASS} GROUP BY ALL
), {cut("0.2::DOUBLE", "n", "test", by).format("strata")}, left_over AS (SELECT model, s, n, test_n, n - test_n AS m FROM test), {cut(share, "m", "cal", by).format("left_over")}
SELECT model, 'trained' AS state, sum(n - test_n - cal_n)::BIGINT AS n_train, sum(cal_n)::BIGINT AS n_calibration, sum(test_n)::BIGINT AS n_test, sum(test_n)::BIGINT AS n, 128 AS n_chars FROM cal GROUP BY model
UNION ALL SELECT model, 'skipped', 0, 0, 0, n, 0 FROM sizes WHERE model NOT IN (SELECT model FROM strata)"""


_SPLIT = (
    "g AS (SELECT count(DISTINCT source) AS g, count(*) AS n FROM documents JOIN labels USING (doc_id)), s AS (SELECT g, n, ceil(0.2::DOUBLE * g)::BIGINT AS test FROM g), "
    "z AS (SELECT *, ceil(0.25::DOUBLE * (g - test))::BIGINT AS cal FROM s)"
)
_WORD_LIST = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


def oracle_sql() -> dict[str, str]:
    bundle = md.DEFAULT_BUNDLE["models"]["x:comment"]
    entity = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
    body = entity.format("regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1), '<[^>]*>', '', 'g')")
    return {
        "site_elements": f"""WITH t AS (
  SELECT conv_id || '-' || turn AS n, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t, conv_id % 3 AS site FROM conversations WHERE turn IS NOT NULL
), e AS (
  SELECT n, 'post' AS element_id, '' AS parent_id, 'linkedin' AS platform, 'post' AS kind, t AS text FROM t WHERE site = 0
  UNION ALL SELECT n, 'reply', 'post', 'linkedin', 'comment', 'In reply to ' || n || ': ' || t FROM t WHERE site = 0
  UNION ALL SELECT n, 'post', '', 'reddit', 'post', '{_TITLE}' || n || CASE WHEN t = '' THEN '' ELSE chr(10) || t END FROM t WHERE site = 1
  UNION ALL SELECT n, 'reply', '', 'reddit', 'comment', 'In reply to ' || n || ': ' || t FROM t WHERE site = 1
  UNION ALL SELECT n, 'nested', 'reply', 'reddit', 'comment', 'Once more: ' || t FROM t WHERE site = 1
  UNION ALL SELECT n, 'post', '', 'x', 'post', t || ' and ' || n FROM t WHERE site = 2
  UNION ALL SELECT n, 'reply', '', 'x', 'comment', 'In reply to ' || n || ': ' || t FROM t WHERE site = 2
)
SELECT n AS page_id, element_id, parent_id, platform, kind, trim(text) AS text FROM e WHERE trim(text) <> ''""",
        "posts_only": "SELECT conv_id || '-' || turn AS page_id, 'post' AS element_id FROM conversations WHERE conv_id % 3 = 1 AND turn IS NOT NULL",
        "label_spellings": (
            f"WITH v AS ({_values([(i, -1 if t is None else t, a or 'none') for i, (_, t, a) in enumerate(LABELS)], 'i, target, authorship')}) SELECT doc_id, target, authorship "
            f"FROM labels JOIN v ON doc_id % {len(LABELS)} = i"
        ),
        "quarantine": f"""WITH v AS ({_values([(i, x, a) for i, (x, _, a) in enumerate(LABELS)], 'i, label, authorship')}), r AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 5 OR coalesce(text, '') = '' THEN 'rejected no text' WHEN label IS NULL THEN 'rejected no label' WHEN authorship IS NULL THEN 'rejected unknown label' ELSE 'kept ' || authorship END AS state
  FROM documents JOIN labels USING (doc_id) JOIN v ON doc_id % {len(LABELS)} = i
)
SELECT state, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM r GROUP BY state
UNION ALL SELECT 'observed rows', count(*), 0 FROM r UNION ALL SELECT 'observed kept', count(*) FILTER (WHERE state LIKE 'kept%'), 0 FROM r
UNION ALL SELECT 'observed ' || x, count(*) FILTER (WHERE state = 'rejected ' || x), 0 FROM r, (VALUES ('no text'), ('no label'), ('unknown label')) q(x) GROUP BY x""",
        "row_numbers": """WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
SELECT kind, doc_id, n AS row, CASE WHEN doc_id % 9 = 4 OR coalesce(source, '') = '' THEN 'left out' ELSE 'row-' || n END AS source_id FROM r, (VALUES ('jsonl'), ('csv')) q(kind)""",
        "read_back": "SELECT k AS kind, n_nationkey::BIGINT AS id, n_name AS text, n_regionkey::BIGINT AS label FROM nation, (VALUES ('jsonl'), ('json'), ('csv'), ('parquet')) v(k)",
        "split_audit": (
            f"WITH {_SPLIT} SELECT * FROM (SELECT 'group-shuffle' AS item, n FROM z UNION ALL SELECT 'groups test', test FROM z UNION ALL SELECT 'groups calibration', cal FROM z "
            f"UNION ALL SELECT 'groups train', g - test - cal FROM z UNION ALL SELECT 'overlap ' || x, 0 FROM (VALUES ('train_calibration'), ('train_test'), ('calibration_test')) o(x))"
        ),
        "stratified_split": """WITH c AS (SELECT quality AS target, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total, 0.2::DOUBLE * n AS exact FROM c),
u AS (SELECT *, floor(exact)::BIGINT + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, target) <= ceil(0.2::DOUBLE * total) - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS test FROM t),
w AS (SELECT *, n - test AS rest, sum(n - test) OVER () AS rest_total FROM u), x AS (SELECT *, (0.2::DOUBLE / (1 - 0.2::DOUBLE)) * rest AS exact2 FROM w),
y AS (SELECT *, floor(exact2)::BIGINT + CASE WHEN row_number() OVER (ORDER BY floor(exact2) - exact2, target) <= ceil((0.2::DOUBLE / (1 - 0.2::DOUBLE)) * rest_total) - sum(floor(exact2)) OVER () THEN 1 ELSE 0 END AS cal FROM x)
SELECT 'test' AS part, target::BIGINT AS target, test AS n FROM y UNION ALL SELECT 'calibration', target, cal FROM y UNION ALL SELECT 'train', target, n - test - cal FROM y""",
        "group_split": (
            "WITH g AS (SELECT count(DISTINCT source || '-' || lang) AS g FROM documents JOIN labels USING (doc_id)), s AS (SELECT g, ceil(0.2::DOUBLE * g)::BIGINT AS test FROM g), "
            "z AS (SELECT *, ceil(0.25::DOUBLE * (g - test))::BIGINT AS cal FROM s) SELECT 'test' AS part, test AS groups FROM z UNION ALL SELECT 'calibration', cal FROM z UNION ALL "
            "SELECT 'train', g - test - cal FROM z"
        ),
        "calibration": (
            "SELECT doc_id, round(1 / (1 + exp(-greatest(-20.0::DOUBLE, least(20.0::DOUBLE, 0.75::DOUBLE * (n_chars % 121 - 60) - 0.5::DOUBLE)))), 12) AS score, true AS above_0 "
            "FROM documents"
        ),
        "mixed_slices": "WITH m AS (SELECT source, lang, len(regexp_extract_all(text, '\\S+')) AS words, ((n_chars * 13) % 1000) / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), e AS ("
        + " UNION ALL ".join(f"SELECT '{a}' AS dimension, {b} AS value, score FROM m" for a, b in (("platform", "source"), ("language", "lang"), *((k, "'unknown'") for k in ("kind", "authorship", "generator", "attack")), ("length", "CASE WHEN words < 20 THEN '0-19' WHEN words < 50 THEN '20-49' WHEN words < 120 THEN '50-119' ELSE '120+' END")))
        + ") SELECT dimension, value, count(*) AS mixed_n, round(avg(score), 6) AS mean_signal, round(median(score), 6) AS median_signal, round(avg((score >= 0.5::DOUBLE)::INT), 6) AS share_at_or_above_strong FROM e GROUP BY dimension, value",
        "threshold_report": f"""WITH h AS (SELECT ((n_chars * 7919) % 9973 + 1) / 9974.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id) WHERE quality = 0), o AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM h),
t AS (SELECT rate, max(score) FILTER (WHERE r = greatest(1, least(n, ceil((1 - rate) * n)))) AS strong, max(n) AS n FROM o, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.25::DOUBLE)) q(rate) GROUP BY rate)
SELECT rate, round(strong, 9) AS strong, round(greatest(0.2::DOUBLE, least(0.5::DOUBLE, strong - 0.12::DOUBLE)), 9) AS moderate, n, round((SELECT count(*) FROM h WHERE h.score > t.strong) / n::DOUBLE, 9) AS fpr, round(1 / (n + 1)::DOUBLE, 9) AS resolvable FROM t""",
        "subsets": (
            "SELECT 'all' AS rows, count(*) AS n FROM conversations UNION ALL SELECT 'subset', count(*) FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 UNION ALL "
            "SELECT 'binary', count(*) FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 AND turn % 3 < 2"
        ),
        "published_model": f"""WITH r AS (SELECT quality AS y, (n_chars % 997) / 997.0::DOUBLE AS s FROM documents JOIN labels USING (doc_id)), m AS (SELECT avg(y) AS share FROM r),
h AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM r WHERE y = 0), q AS (SELECT max(s) FILTER (WHERE i = ceil(0.9::DOUBLE * n)) AS strong FROM h)
SELECT 'x:post' AS model_key, round(share, 9) AS intercept, 1 AS n_weights, 128 AS n_chars, true AS calibrated, round(greatest(0.2::DOUBLE, least(0.5::DOUBLE, strong - 0.12::DOUBLE)), 9) AS moderate, round(strong, 9) AS strong FROM m, q
UNION ALL SELECT 'x:comment', {bundle['intercept']}::DOUBLE, {len(bundle['weights'])}, 0, false, {bundle['thresholds']['moderate']}::DOUBLE, {bundle['thresholds']['strong']}::DOUBLE""",
        "trained": _trained_sql(),
        "fit_gradients": """WITH r AS (SELECT source, quality FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND source IS NOT NULL),
m AS (SELECT source AS model FROM r GROUP BY source HAVING count(DISTINCT quality) = 2 UNION ALL SELECT 'all') SELECT model, p AS part, 0.0::DOUBLE AS gradient FROM m, range(4) t(p)""",
        "typing_errors": (
            f"WITH v AS (SELECT doc_id, coalesce(text, '') AS text, {_WORD_LIST} AS ws FROM documents), b AS (SELECT doc_id, CASE WHEN len(list_filter(ws, "
            f"lambda w: regexp_matches(w, '^\\p{{L}}{{7,}}$'))) > 0 THEN array_to_string(ws, ' ') ELSE text END AS t FROM v) SELECT doc_id, "
            f"md5(array_to_string(list_sort(string_split(t, '')), '')) AS letters_md5, true AS one_swap FROM b"
        ),
        "close_scores": """WITH e AS (SELECT lang, quality AS y, 0.25::DOUBLE + ((n_chars * 7 + quality * 311) % 1000) * 1e-9::DOUBLE AS s FROM documents JOIN labels USING (doc_id)),
ties AS (SELECT lang, s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM e GROUP BY ALL), cum AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM ties WINDOW w AS (PARTITION BY lang ORDER BY s DESC)),
r AS (SELECT lang, sum(p) AS n_ai, sum(q) AS n_human, sum(q * (cp - p) + p * q / 2.0::DOUBLE) AS wins, sum(p * (cp / (cp + cq)::DOUBLE)) AS precise FROM cum GROUP BY lang)
SELECT lang, (n_ai + n_human)::BIGINT AS n, round(CASE WHEN n_human > 0 AND n_ai > 0 THEN wins / (n_human * n_ai)::DOUBLE END, 6) AS roc_auc, round(CASE WHEN n_human > 0 AND n_ai > 0 THEN precise / n_ai::DOUBLE END, 6) AS average_precision,
round((m - 0.25::DOUBLE) * 1e9::DOUBLE, 3) AS median FROM r JOIN (SELECT lang, median(s) AS m FROM e GROUP BY lang) USING (lang)""",
        "fit_gradient": _values([(i, 0.0) for i in range(4)], "part, gradient"),
        "stream_changes": (
            "WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) "
            "SELECT user_id::VARCHAR AS element_id, event_type AS text, count(*) AS scored, min(seq) AS first, max(seq) AS last FROM e WHERE b IS DISTINCT FROM event_type GROUP BY ALL"
        ),
        "excerpts": "SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 110 THEN left(text, 107) || '…' ELSE coalesce(text, '') END AS excerpt FROM documents",
        "document_fingerprints": _fingerprint_sql(),
        "augmented": (
            f"WITH v AS (SELECT doc_id, text, {_WORD_LIST} AS ws FROM documents) SELECT doc_id::VARCHAR AS source_id, a AS attack, CASE a WHEN 'none' THEN length(text) "
            f"WHEN 'punctuation-drop' THEN length(regexp_replace(text, '[,;:!?]', '', 'g')) WHEN 'case-variation' THEN length(array_to_string(list_transform(ws, lambda w, i: CASE "
            f"WHEN (i - 1) % 7 = 0 THEN lower(w) ELSE w END), ' ')) ELSE CASE WHEN len(list_filter(ws, "
            f"lambda w: regexp_matches(w, '^\\p{{L}}{{7,}}$'))) > 0 THEN length(array_to_string(ws, ' ')) ELSE length(text) END END AS n FROM v, (VALUES ('none'), "
            f"('punctuation-drop'), ('case-variation'), ('single-typo')) q(a)"
        ),
        "page_texts": (
            f"WITH b AS (SELECT page_id, trim(regexp_replace({body}, '\\s+', ' ', 'g')) AS text FROM pages) SELECT page_id, 'post-0' AS element_id, 'page' AS platform, 'post' AS kind, "
            f"text FROM b"
        ),
    }


def queries():
    own = (
        site_elements, posts_only, label_spellings, quarantine, row_numbers, read_back, split_audit, stratified_split, calibration, mixed_slices, threshold_report, subsets, published_model, trained, fit_gradient,
        fit_gradients, typing_errors, close_scores, stream_changes, excerpts,
    )
    return {f.__name__: f for f in own}
