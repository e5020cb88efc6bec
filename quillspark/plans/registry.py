"""Named queries over the test tables, and the SQL that they are held against.

The tables hold other things than posts of people and machines, so some columns stand in: language or
source for platform, a conversation's role for kind, quality labels for authorship. Results are counts
and integer numerators wherever SQL is to agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import lexicons as lx
from quillspark.functions import text as tx
from quillspark.functions.phrases import phrase_counts
from quillspark.operators import augment, cues, evaluate, features, prepare, split
from quillspark.plans import flows, streams, style
from quillspark.sources import html
from quillspark.sources.readers import read_table
from quillspark.streaming import rescore


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return features.normalized(read_table(spark, f"{d}/documents.parquet").select("doc_id", "text", "lang", "source"))


def _long(c) -> F.Column:
    return c.cast("long")


def profile_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens, stopwords and distinct tokens in 25-token windows, by language."""
    rows = _docs(spark, d).select("lang", F.size("tokens").alias("n"), F.size(F.filter("tokens", lambda t: t.isin(lx.STOPWORDS))).alias("s"), tx.token_stats(F.col("tokens")).alias("x"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.sum("s").alias("stopwords"), F.sum("x.mattr_sum").alias("window_types"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, distinct, once-only and most frequent ones, and the numerator of the moving type-token ratio."""
    rows = _docs(spark, d).select("doc_id", F.size("tokens").alias("n"), tx.token_stats(F.col("tokens")).alias("x"))
    return rows.select("doc_id", _long(F.col("n")).alias("words"), *(_long(F.col(f"x.{k}")).alias(k) for k in ("distinct", "hapax", "top", "mattr_sum")))


def ngram_repeats(spark: SparkSession, d: str) -> DataFrame:
    two, three = ({"n": F.size(tx.ngrams(F.col("tokens"), k)), "d": F.size(F.array_distinct(tx.ngrams(F.col("tokens"), k)))} for k in (2, 3))
    return _docs(spark, d).select("doc_id", _long(two["n"]).alias("bigrams"), _long(two["d"]).alias("bigrams_distinct"), _long(three["n"]).alias("trigrams"), _long(three["d"]).alias("trigrams_distinct"))


def lexicon_hits(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the closed word lists and with digits or apostrophes."""
    one_of = lambda w: _long(F.size(F.filter("tokens", lambda t: t.isin(w))))
    like = lambda p: _long(F.size(F.filter("tokens", lambda t: F.rlike(t, F.lit(p)))))
    return _docs(spark, d).select("doc_id", one_of(lx.STOPWORDS).alias("stop"), one_of(lx.FIRST_PERSON).alias("first"), one_of(lx.SECOND_PERSON).alias("second"), like("'").alias("contractions"), like(r"(?U)\d").alias("numbers"))


def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """Phrase counts by family, over documents and, so that there are some, the phrases themselves."""
    own = spark.createDataFrame([(-1 - i, f"{p}. Re{p} {p} {p}, a{p}") for i, p in enumerate(lx.BUZZ + lx.HEDGE + lx.TRANSITION + lx.TEMPLATE)], "doc_id long, text string")
    rows = features.normalized(read_table(spark, f"{d}/documents.parquet").select("doc_id", "text").unionByName(own)).withColumn("low", tx.phrase_text(F.col("cleaned")))
    counts = rows.select("doc_id", phrase_counts(F.col("low")).alias("n"))
    return counts.select("doc_id", *(F.get("n", F.lit(i)).alias(k) for i, k in enumerate(lx.FAMILIES) if k != "rhetorical"))


def punctuation(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", tx.punctuation(F.col("cleaned")).alias("p"))
    return rows.select("doc_id", *(_long(F.col(f"p.{k}")).alias(k) for k in tx.PUNCTUATION))


def markup(spark: SparkSession, d: str) -> DataFrame:
    """Links, mentions, hashtags, list markers, newlines, UTF-16 lengths and letters."""
    c, r = F.col("cleaned"), F.col("raw")
    n = lambda t, p: _long(F.regexp_count(t, F.lit(p)))
    return _docs(spark, d).select(
        "doc_id", n(c, tx.URL).alias("urls"), n(c, tx.HASHTAG).alias("hashtags"), _long(tx.list_markers(r)).alias("list_markers"), n(r, "\n").alias("newlines"),
        _long(tx.utf16_length(c)).alias("chars"), n(r, r"\p{L}").alias("letters"), n(r, "[A-Za-z]").alias("latin"))


def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with tokens, their tokens, those of at most eight, and paragraphs with tokens."""
    lengths = lambda p: F.filter(F.transform(p, tx.count_tokens), lambda n: n > 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    rows = _docs(spark, d).select("doc_id", lengths(tx.sentences(F.col("cleaned"))).alias("s"), lengths(tx.paragraphs(F.col("raw"))).alias("p"))
    return rows.select("doc_id", _long(F.size("s")).alias("sentences"), total(F.col("s")).alias("tokens"), _long(F.size(F.filter("s", lambda n: n <= 8))).alias("short"), _long(F.size("p")).alias("paragraphs"))


def language_support(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.size("tokens").alias("n"), F.size(F.filter("tokens", lambda t: t.isin(lx.STOPWORDS))).alias("s"), "raw")
    state = tx.language_support(tx.latin_ratio(F.col("raw")), F.rlike("raw", F.lit(r"\p{L}")), F.col("n"), F.coalesce(F.try_divide("s", "n"), F.lit(0.0)))
    return rows.select("doc_id", state["state"].alias("state"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """FNV-1a of short texts."""
    rows = spark.read.parquet(f"{d}/nation.parquet")
    return rows.select("n_nationkey", tx.fnv1a(tx.utf16_units(F.concat(F.lit("post\n"), "n_name"))).alias("hash"))


def document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of whole documents as posts; a null text counts as an empty one."""
    rows = read_table(spark, f"{d}/documents.parquet")
    return rows.select("doc_id", tx.fingerprint(F.lit("post"), F.coalesce("text", F.lit(""))).alias("fingerprint"))


def surface_variants(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of texts without punctuation and with changed case."""
    rows = read_table(spark, f"{d}/documents.parquet")
    return rows.select("doc_id", F.md5(F.encode(augment.drop_punctuation(F.col("text")), "UTF-8")).alias("no_punctuation"), F.md5(F.encode(augment.vary_case(F.col("text")), "UTF-8")).alias("case_varied"))


def augmented(spark: SparkSession, d: str) -> DataFrame:
    """All four variants of each document."""
    rows = read_table(spark, f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_id"), "text")
    return augment.variants(rows).select("source_id", F.coalesce("attack", F.lit("none")).alias("attack"), F.char_length("text").cast("long").alias("n"))


def imported(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as training records: quality stands for authorship, source for platform."""
    docs, labels = (read_table(spark, f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").withColumn("label", F.col("quality").cast("string")).withColumnRenamed("doc_id", "id").drop("quality", "toxic", "n_chars")
    out = prepare.normalize_rows(prepare.import_records(rows, row="id"), row="source_id")
    return out.select("source_id", "authorship", "platform", "kind", "language", "attack", "target")


def kinds(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns by kind: a user's turn counts as a reply."""
    role = F.when(F.col("role") == "user", " Reply ").otherwise(F.col("role"))
    return spark.read.parquet(f"{d}/conversations.parquet").groupBy(prepare.kind_of(role).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a made score in thousandths and quality as target."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    words = F.regexp_count("text", F.lit(r"\S+"))
    score = (F.pmod(F.col("n_chars") * 7 + F.col("quality") * 311, F.lit(1000)) / 1000.0).alias("score")
    return docs.join(labels, "doc_id").select(F.col("quality").cast("int").alias("target"), score, F.col("source").alias("platform"), F.lit("post").alias("kind"), F.col("lang").alias("language"), F.col("quality").cast("string").alias("authorship"), words.alias("words"))


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    whole = ("n", "n_human", "n_ai")
    return df.select(*keys, *(F.col(c) if c in whole else F.round(c, 6).alias(c) for c in df.columns if c not in keys and not c.startswith("mixed")))


def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.binary_metrics(_scored(spark, d), [], 0.5), [])


def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.slice_report(_scored(spark, d), 0.5), ["dimension", "value"])


def record_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.counts(_scored(spark, d))


def human_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff that a tenth of one class may pass, with what it does on that class."""
    t = evaluate.human_threshold(_scored(spark, d), 0.1)
    return spark.createDataFrame([(round(t["strong"], 9), t["calibration_human_n"], round(t["empirical_calibration_fpr"], 9))], "strong double, n long, fpr double")


def group_split(spark: SparkSession, d: str) -> DataFrame:
    """Whole sources dealt to three parts: sizes in groups."""
    rows = _scored(spark, d).withColumn("source_id", F.concat_ws("-", "platform", "language"))
    parts, _ = split.split(rows)
    groups = parts.select("source_id", "part").distinct()
    return groups.groupBy("part").agg(F.count(F.lit(1)).alias("groups"))


def changes_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits of one element per user: how many of them change it, as the stream would score them."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select(F.col("user_id").alias("element_id"), nth.alias("seq"), F.lit("reddit").alias("platform"), F.lit("post").alias("kind"), F.col("event_type").alias("text"))
    scored = rescore.replay(rows).groupBy("element_id").agg(F.count(F.lit(1)).alias("n"))
    users = events.select("user_id").distinct()
    return users.join(scored, F.col("element_id").eqNullSafe(F.col("user_id").cast("string")), "left").select("user_id", F.coalesce("n", F.lit(0).cast("long")).alias("scored"))


def cue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cue sentences, the longest run of short ones, dashes and colons."""
    rows = features.extract(read_table(spark, f"{d}/documents.parquet").select("doc_id", "text"), kind=None, vectors=False, texts=False, cues=True)
    m = lambda c: F.col(f"cue_measures.{c}")
    return rows.select("doc_id", _long(m("sentences.n")).alias("sentences"), _long(cues.short_run(m("sentences.lengths"))).alias("short_run"), _long(m("colons")).alias("colons"), _long(m("dashes")).alias("dashes"))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Headings and articles of web pages."""
    return html.elements(read_table(spark, f"{d}/pages.parquet").select("page_id", "html"), "page").drop("parent_id")


_WORDS = (
    "t AS (SELECT doc_id, lang, trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS raw FROM documents), c AS (SELECT *, "
    "regexp_replace(raw, '\\s+', ' ', 'g') AS cleaned FROM t), w AS (SELECT *, "
    "list_transform(regexp_extract_all(replace(replace(cleaned, '‘', ''''), '’', ''''), '[\\p{L}\\p{N}]+(?:''[\\p{L}\\p{N}]+)?'), lambda x: lower(x)) AS tokens FROM c)"
)
_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_TOKENS = _WORDS + ", k AS (SELECT doc_id, lang, unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS i, len(tokens) AS n FROM w), p AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id, t ORDER BY i), -1) AS prev FROM k), m AS (SELECT *, greatest(0, least(i, greatest(n - 25, 0)) - greatest(prev + 1, i - 24, 0) + 1) AS share FROM p)"
_COUNT = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_SENTENCES = (
    "list_filter(list_transform(list_filter(list_transform(regexp_split_to_array({0}, '{1}'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), "
    "lambda x: len(regexp_extract_all(replace(replace(x, '‘', ''''), '’', ''''), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)?'))), lambda x: x > 0)"
)


def _phrase_sql() -> str:
    cases = []
    for family in ("buzz", "hedge", "transition", "template"):
        terms = []
        for p in getattr(lx, family.upper()):
            q = p.replace("'", "''")
            x = f"string_split(low, '{q}')"
            terms.append(f"len(list_filter(range(1, len({x})), lambda j: regexp_matches('.' || {x}[j], '[^a-z0-9]$') AND regexp_matches({x}[j + 1] || '.', '^[^a-z0-9]') AND (j = 1 OR {x}[j] <> '') AND (j + 1 = len({x}) OR {x}[j + 1] <> '')))".replace(f"'.' || {x}[j]", f"(CASE WHEN j = 1 THEN '.' ELSE '' END) || {x}[j]").replace(f"{x}[j + 1] || '.'", f"{x}[j + 1] || (CASE WHEN j + 1 = len({x}) THEN '.' ELSE '' END)"))
        cases.append(f"{' + '.join(terms)} AS {family}")
    own = ", ".join(f"({-1 - i}, '{(f'{p}. Re{p} {p} {p}, a{p}').replace(chr(39), chr(39) * 2)}')" for i, p in enumerate(lx.BUZZ + lx.HEDGE + lx.TRANSITION + lx.TEMPLATE))
    return (
        f"WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {own}) v(doc_id, text)), c AS (SELECT doc_id, "
        f"lower(replace(replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '‘', ''''), '’', '''')) AS low FROM t) SELECT doc_id, {', '.join(cases)} FROM c"
    )


_SCORED = (
    "s AS (SELECT quality AS target, ((n_chars * 7 + quality * 311) % 1000) / 1000.0::DOUBLE AS score, source AS platform, 'post' AS kind, lang AS language, "
    "quality::VARCHAR AS authorship, len(regexp_extract_all(text, '\\S+')) AS words FROM documents JOIN labels USING (doc_id))"
)


def _metrics_sql(keys: str, rows: str) -> str:
    k = f"{keys}, " if keys else ""
    on = lambda a: " AND ".join(f"{a}.{c.strip()} = b.{c.strip()}" for c in keys.split(",")) if keys else "true"
    part = f"PARTITION BY {keys}" if keys else ""
    group = lambda extra="": f"GROUP BY {', '.join(x for x in (keys, extra) if x)}" if keys or extra else ""
    return f"""WITH {_SCORED}, {rows},
b AS (SELECT {k} count(*) AS n, count(*) FILTER (WHERE target = 0) AS n_human, count(*) FILTER (WHERE target = 1) AS n_ai, count(*) FILTER (WHERE target = 1 AND score >= 0.5) AS tp,
  count(*) FILTER (WHERE target = 0 AND score >= 0.5) AS fp, avg((score - target) * (score - target)) AS brier FROM e {group()}),
bins AS (SELECT {k} least(floor(score * 10 + 1e-9), 9) AS bin, count(*) AS c, avg(score) AS ms, avg(target) AS my FROM e {group('bin')}),
g AS (SELECT {k} sum(c * abs(ms - my)) AS gap FROM bins {group()}),
ties AS (SELECT {k} score, count(*) FILTER (WHERE target = 1) AS p, count(*) FILTER (WHERE target = 0) AS q FROM e {group('score')}),
cum AS (SELECT *, sum(p) OVER ({part} ORDER BY score DESC) AS cp, sum(q) OVER ({part} ORDER BY score DESC) AS cq FROM ties),
r AS (SELECT {k} sum(q * (cp - p) + p * q / 2.0::DOUBLE) AS wins, sum(p * (cp / (cp + cq)::DOUBLE)) AS precise FROM cum {group()})
SELECT {', '.join(f'b.{c.strip()}' for c in keys.split(',')) + ', ' if keys else ''} b.n, n_human, n_ai, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN n_ai > 0 THEN tp / n_ai::DOUBLE ELSE 0 END, 6) AS recall,
 round(CASE WHEN tp + fp + n_ai > 0 THEN 2.0 * tp / (tp + fp + n_ai)::DOUBLE ELSE 0 END, 6) AS f1, round(CASE WHEN n_human > 0 THEN fp / n_human::DOUBLE END, 6) AS false_positive_rate,
 round(CASE WHEN n_human > 0 AND n_ai > 0 THEN wins / (n_human * n_ai)::DOUBLE END, 6) AS roc_auc, round(CASE WHEN n_human > 0 AND n_ai > 0 THEN precise / n_ai::DOUBLE END, 6) AS average_precision,
 round(brier, 6) AS brier, round(gap / b.n::DOUBLE, 6) AS expected_calibration_error
FROM b JOIN g ON {on('g')} JOIN r ON {on('r')}"""


def oracle_sql() -> dict[str, str]:
    n = _COUNT
    return {
        "profile_by_lang": (
            f"WITH {_TOKENS}, a AS (SELECT lang, count(*) AS docs FROM w GROUP BY lang), b AS (SELECT lang, count(*) AS tokens, "
            f"count(*) FILTER (WHERE t IN {_IN(lx.STOPWORDS)}) AS stopwords, sum(share)::BIGINT AS window_types FROM m GROUP BY lang) SELECT lang, docs, tokens, stopwords, "
            f"window_types FROM a JOIN b USING (lang)"
        ),
        "token_stats": f"WITH {_TOKENS}, f AS (SELECT doc_id, t, count(*) AS c FROM k GROUP BY ALL), g AS (SELECT doc_id, count(*) AS d, count(*) FILTER (WHERE c = 1) AS h, max(c) AS top FROM f GROUP BY doc_id), s AS (SELECT doc_id, sum(share)::BIGINT AS z FROM m GROUP BY doc_id) SELECT w.doc_id, len(tokens) AS words, coalesce(d, 0) AS distinct, coalesce(h, 0) AS hapax, coalesce(top, 0) AS top, coalesce(z, 0) AS mattr_sum FROM w LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id)".replace("AS distinct", 'AS "distinct"'),
        "ngram_repeats": (
            f"WITH {_WORDS}, g AS (SELECT doc_id, CASE WHEN len(tokens) < 2 THEN [] ELSE list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i+1]) END AS a, "
            f"CASE WHEN len(tokens) < 3 THEN [] ELSE list_transform(range(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i+1] || ' ' || tokens[i+2]) END AS b FROM w) "
            f"SELECT doc_id, len(a) AS bigrams, len(list_distinct(a)) AS bigrams_distinct, len(b) AS trigrams, len(list_distinct(b)) AS trigrams_distinct FROM g"
        ),
        "lexicon_hits": (
            f"WITH {_WORDS} SELECT doc_id, len(list_filter(tokens, lambda x: x IN {_IN(lx.STOPWORDS)})) AS stop, len(list_filter(tokens, "
            f"lambda x: x IN {_IN(lx.FIRST_PERSON)})) AS first, len(list_filter(tokens, lambda x: x IN {_IN(lx.SECOND_PERSON)})) AS second, len(list_filter(tokens, "
            f"lambda x: contains(x, ''''))) AS contractions, len(list_filter(tokens, lambda x: regexp_matches(x, '\\p{{Nd}}'))) AS numbers FROM w"
        ),
        "phrase_hits": _phrase_sql(),
        "punctuation": "WITH " + _WORDS + " SELECT doc_id, " + ", ".join(f"{n('cleaned', p.replace(chr(39), chr(39) * 2))} AS {k}" for k, p in tx.PUNCTUATION.items()) + " FROM w",
        "markup": (
            f"WITH {_WORDS} "
            f"SELECT doc_id, {n('cleaned', '(?i)' + chr(92) + 'bhttps?://' + chr(92) + 'S+|' + chr(92) + 'bwww' + chr(92) + '.' + chr(92) + 'S+')} AS urls, {n('cleaned', '#[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')} AS hashtags, "
            f"len(list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, '^\\s*(?:•|-|\\*|\\d+[.)])\\s+'))) AS list_markers, {n('raw', chr(92) + 'n')} AS newlines, "
            f"length(cleaned) + {n('cleaned', '[' + chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}]')} AS chars, {n('raw', chr(92) + 'p{L}')} AS letters, {n('raw', '[A-Za-z]')} AS latin "
            f"FROM w"
        ),
        "sentence_stats": (
            f"WITH {_WORDS}, s AS (SELECT doc_id, {_SENTENCES.format('cleaned', '[.!?]+')} AS s, {_SENTENCES.format('raw', chr(92) + 'n+')} AS p FROM w) SELECT doc_id, "
            f"len(s) AS sentences, coalesce(list_sum(s), 0)::BIGINT AS tokens, len(list_filter(s, lambda x: x <= 8)) AS short, len(p) AS paragraphs FROM s"
        ),
        "language_support": (
            f"WITH {_WORDS}, x AS (SELECT doc_id, len(tokens) AS n, len(list_filter(tokens, "
            f"lambda x: x IN {_IN(lx.STOPWORDS)})) AS s, {n('raw', chr(92) + 'p{L}')} AS letters, {n('raw', '[A-Za-z]')} AS latin FROM w) SELECT doc_id, CASE "
            f"WHEN letters = 0 THEN 'unsupported' WHEN latin / letters::DOUBLE < 0.72 THEN 'unsupported' WHEN n >= 20 AND s / n::DOUBLE < 0.055 THEN 'uncertain' "
            f"ELSE 'supported' END AS state FROM x"
        ),
        "fingerprints": (
            "SELECT n_nationkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('post' || chr(10) || n_name, ''), lambda x: ascii(x)::BIGINT)), lambda a, "
            "u: (xor(a, u) * 16777619) & 4294967295) AS hash FROM nation"
        ),
        "surface_variants": (
            "SELECT doc_id, md5(regexp_replace(text, '[,;:!?]', '', 'g')) AS no_punctuation, md5(array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), "
            "lambda x: x <> ''), lambda w, i: CASE WHEN (i - 1) % 7 = 0 THEN lower(w) ELSE w END), ' ')) AS case_varied FROM documents"
        ),
        "imported": (
            "SELECT doc_id::VARCHAR AS source_id, CASE quality WHEN 0 THEN 'human' ELSE 'ai' END AS authorship, source AS platform, 'post' AS kind, "
            "lang AS language, 'none' AS attack, quality AS target FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND text <> '' AND quality IS NOT NULL"
        ),
        "kinds": "SELECT CASE WHEN role = 'user' THEN 'comment' ELSE 'post' END AS kind, count(*) AS n FROM conversations GROUP BY 1",
        "binary_metrics": _metrics_sql("", "e AS (SELECT * FROM s)"),
        "slice_metrics": _metrics_sql("dimension, value", "e AS (" + " UNION ALL ".join(f"SELECT '{a}' AS dimension, {b} AS value, target, score FROM s" for a, b in (("platform", "platform"), ("kind", "kind"), ("authorship", "authorship"), ("language", "language"), ("generator", "'unknown'"), ("attack", "'unknown'"), ("length", "CASE WHEN words < 20 THEN '0-19' WHEN words < 50 THEN '20-49' WHEN words < 120 THEN '50-119' ELSE '120+' END"))) + ")"),
        "record_counts": f"WITH {_SCORED} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM s GROUP BY {c}" for c in ("authorship", "platform", "kind")),
        "human_threshold": (
            f"WITH {_SCORED}, h AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM s WHERE target = 0), "
            f"q AS (SELECT max(score) FILTER (WHERE r = ceil(0.9::DOUBLE * n)) AS s, max(n) AS n FROM h) SELECT round(q.s, 9) AS strong, q.n AS n, "
            f"round(count(*) FILTER (WHERE h.score > q.s) / q.n::DOUBLE, 9) AS fpr FROM h, q GROUP BY q.s, q.n"
        ),
        "changes_replay": (
            "WITH e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, "
            "count(*) FILTER (WHERE b IS DISTINCT FROM event_type) AS scored FROM e GROUP BY user_id"
        ),
    } | style.oracle_sql() | flows.oracle_sql() | streams.oracle_sql()


def queries():
    own = (
        profile_by_lang, token_stats, ngram_repeats, lexicon_hits, phrase_hits, punctuation, markup, sentence_stats, language_support, fingerprints, document_fingerprints, surface_variants, augmented,
        imported, kinds, binary_metrics, slice_metrics, record_counts, human_threshold, group_split, changes_replay, cue_counts, page_texts,
    )
    return {f.__name__: f for f in own} | style.queries() | flows.queries() | streams.queries()
