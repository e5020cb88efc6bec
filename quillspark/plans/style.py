"""Queries of features, metrics, profiles, scores, cues, segments and whole analyses, and their SQL.

Rows are the documents, dealt to platforms and kinds by their ids, and a few texts of our own (ids below
zero) in which the rules fire that the documents never meet. Doubles are rounded to six places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicons as lx
from quillspark.functions import models as md
from quillspark.functions import text as tx
from quillspark.functions import vectors as vx
from quillspark.operators import cues, features, scoring, segments
from quillspark.operators.analyze import analyze
from quillspark.sources.readers import read_table

PLATFORMS = ("linkedin", "reddit", "x", "mastodon")
SAMPLES = [
    "",
    " \n ",
    "Short and sweet. Agreed!",
    "\ufeffA \ufb01ne day\u2026 we \u200bsaid, for\u00a0once, \uff11\uff12 times!\r\nThen \uff21lice left the o\ufb03ce\u2026",
    "你好世界 再见",
    "Thrilled to share this journey. Here are the key takeaways: leverage a robust, scalable vision. Moreover, the bottom line is simple. In conclusion, unlock synergy and empower stakeholders.",
    "As an AI, I cannot provide it. As an AI, I don't have access to that — sorry; it’s not about me…",
    "Plan: ship it — then rest. Plan: test it — then rest. Plan: write it — then rest. Plan: read it — then rest.",
    "- one item here\n- another item here\n* a third item\n2) a fourth one\nThat is all: really.",
    "The red cart stopped near the old mill today. The blue cart stopped near the new mill today. The green cart stopped near the big mill today. The white cart stopped near the far mill today. The black cart stopped near the wet mill today. "
    "Every driver walked home past the quiet river bank. Every driver walked home past the quiet river bank. Some drivers walked home past the quiet river bank too.",
    "I mended the gate on Sunday, and my brother (who knows hinges) laughed at me! Did it hold? It did; the dog, Rex, tried twice... See https://example.org/gate and www.example.org #repair @rex u/hinge r/diy 🙂 10 20 30.",
    "We measured it again, and we wrote down 12 numbers: 7 were odd. Don't ask why! “Odd” is what Anna Berg of Oslo called them. You can't fix that; you can only measure again.",
    "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega quux corge grault garply waldo fred plugh xyzzy thud",
]
#: A bundle with calibrated models, to reach the labels that the shipped one never gives; the middle one weighs characters.
CALIBRATED = {
    "metadata": {"provenance": "made for queries"},
    "models": {
        "reddit:post": {"intercept": -2.0, "weights": {"mattr25": 3.0, "stopwordRatio": -1.5, "newlineRatio": 4.0, "commaPer100w": 2.0}, "calibration": {"slope": 3.0, "intercept": 0.1}, "thresholds": {"moderate": 0.3, "strong": 0.6}},
        "x:post": {"intercept": 0.25, "weights": {"hapaxRatio": 0.5, "sentenceLenCV": -2.0}, "charNgramWeights": [((7 * i) % 11 - 5) / 10 for i in range(vx.DIMENSION)], "calibration": {"slope": 1.2, "intercept": -0.2}, "thresholds": {"moderate": 0.35, "strong": 0.55, "target_fpr": 0.05, "method": "made"}},
        "default": {"intercept": 0.1, "weights": {"wordLenCV": 1.0, "typeTokenRatio": -1.0}, "calibration": {"slope": 2.0, "intercept": 0.3}},
    },
}


def rows(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, platform, kind of the documents and of our own texts."""
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(SAMPLES)], "doc_id long, text string")
    docs = read_table(spark, f"{d}/documents.parquet").select("doc_id", "text").unionByName(own)
    platform = F.element_at(F.array(*map(F.lit, PLATFORMS)), (F.pmod("doc_id", F.lit(len(PLATFORMS))) + 1).cast("int"))
    return docs.select("doc_id", "text", platform.alias("platform"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "comment").otherwise("post").alias("kind"))


def _six(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """The 33 features of each text."""
    out = features.extract(rows(spark, d), vectors=False, texts=False)
    return out.select("doc_id", *(_six(F.col(f"features.{k}")).alias(k) for k in lx.FEATURE_ORDER))


def metric_table(spark: SparkSession, d: str) -> DataFrame:
    """The 24 metrics of each text, and what language support it has."""
    out = features.extract(rows(spark, d), vectors=False, texts=False)
    return out.select("doc_id", *(_six(F.col(f"metrics.{k}")).alias(k) for k in out.schema["metrics"].dataType.names), F.col("language_support.state").alias("language"))


def char_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The 128 parts of each text's hashed character profile that are not 0."""
    out = features.normalized(rows(spark, d)).select("doc_id", F.posexplode(vx.char_profile(F.col("cleaned"))).alias("part", "value"))
    return out.where("value <> 0").select("doc_id", F.col("part").cast("long").alias("part"), _six(F.col("value")).alias("value"))


def _scored(spark: SparkSession, d: str, bundle: dict, vectors: bool) -> DataFrame:
    return scoring.score(scoring.with_model(features.extract(rows(spark, d), vectors=vectors, texts=False), bundle), "char_ngrams" if vectors else None)


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Model, logit, score and cutoffs of each text under the shipped bundle."""
    out = _scored(spark, d, md.DEFAULT_BUNDLE, False).withColumn("t", tx.fixed(scoring.cutoffs("conservative")))
    return out.select("doc_id", "model_key", "calibrated", _six(F.col("logit")).alias("logit"), _six(F.col("signal")).alias("signal"), tx.percent(F.round("signal", 9)).alias("percent"), _six(F.col("t.moderate")).alias("moderate"), _six(F.col("t.strong")).alias("strong"), F.col("t.method").alias("method"))


def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same under calibrated models, one of them with character weights, others by default."""
    out = _scored(spark, d, CALIBRATED, True).withColumn("t", tx.fixed(scoring.cutoffs("aggressive")))
    return out.select("doc_id", "model_key", "calibrated", _six(F.col("logit")).alias("logit"), _six(F.col("signal")).alias("signal"), _six(F.col("t.moderate")).alias("moderate"), _six(F.col("t.strong")).alias("strong"), F.col("t.method").alias("method"), _six(F.coalesce("t.target_fpr", F.lit(-1.0))).alias("target_fpr"))


def score_drivers(spark: SparkSession, d: str) -> DataFrame:
    """Contributions by size, and the drivers' names, under the shipped bundle."""
    out = _scored(spark, d, md.DEFAULT_BUNDLE, False)
    names = lambda up: F.array_join(F.transform(scoring.drivers(up), lambda x: x["name"]), "; ")
    sizes = F.aggregate(F.transform("contributions", lambda x: F.abs(x["contribution"])), F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", F.size("contributions").cast("long").alias("n"), _six(sizes).alias("sizes"), names(True).alias("raises"), names(False).alias("lowers"))


def evidence_levels(spark: SparkSession, d: str) -> DataFrame:
    """How much evidence each text gives, why not more, and signals against reading much into it."""
    out = features.extract(rows(spark, d), vectors=False, texts=False).withColumn("evidence", tx.fixed(scoring.evidence()))
    return out.select("doc_id", F.col("evidence.level").alias("level"), F.array_join("evidence.reasons", "; ").alias("reasons"), F.array_join(scoring.counter_signals(), "; ").alias("counter"))


def cue_rubric(spark: SparkSession, d: str) -> DataFrame:
    """The six families, points, tone and coverage of each text."""
    out = features.extract(rows(spark, d), vectors=False, texts=False, cues=True).withColumn("cues", tx.fixed(cues.assess()))
    each = lambda k: F.array_join(F.transform("cues.families", lambda x: x[k]), "; ")
    return out.select("doc_id", F.col("cues.level").alias("level"), F.col("cues.text").alias("text"), F.col("cues.points").cast("long").alias("points"), each("id").alias("families"), each("detail").alias("details"), F.col("cues.coverage.level").alias("coverage"), F.col("cues.tone").alias("tone"), _six(F.col("cues.contentRepeat")).alias("repeat"))


def segment_texts(spark: SparkSession, d: str) -> DataFrame:
    """The segments of each text."""
    return features.normalized(rows(spark, d)).select("doc_id", F.posexplode(segments.split(F.col("raw"))).alias("at", "segment")).select("doc_id", F.col("at").cast("long").alias("at"), "segment")


def segment_mix(spark: SparkSession, d: str) -> DataFrame:
    """Scores and excerpts of the segments of texts that are scored by segments."""
    base = features.extract(rows(spark, d), texts=False, parts=True, part_vectors=True)
    out = segments.score(scoring.score(scoring.with_model(base, CALIBRATED)))
    each = out.select("doc_id", "low", "high", F.posexplode("segments").alias("at", "x"))
    return each.select("doc_id", F.col("at").cast("long").alias("at"), _six(F.col("x.signal")).alias("signal"), F.col("x.words").cast("long").alias("words"), F.col("x.excerpt").alias("excerpt"), _six(F.col("low")).alias("low"), _six(F.col("high")).alias("high"))


def _analyzed(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "model_key", "calibrated", F.round("signal", 6).alias("signal"), F.col("label.level").alias("level"), F.col("label.text").alias("label"), F.col("evidence.level").alias("evidence"), "mixed", F.col("cues.points").cast("long").alias("points"), F.size("segments").cast("long").alias("segments"), scoring.hidden(True, True).alias("hidden"), "disclaimer")


def analysis(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis of each text under the shipped bundle."""
    return _analyzed(analyze(rows(spark, d), "doc_id"))


def calibrated_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis under calibrated models."""
    return _analyzed(analyze(rows(spark, d), "doc_id", CALIBRATED))


# ---- SQL ----

_TOKEN = "[\\p{L}\\p{N}]+(?:''[\\p{L}\\p{N}]+)?"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


def _straight(c: str) -> str:
    return f"replace(replace({c}, '‘', ''''), '’', '''')"


def _n(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {_quoted(pattern)}))"


def _tokens(c: str) -> str:
    return f"list_transform(regexp_extract_all({_straight(c)}, '{_TOKEN}'), lambda tk: lower(tk))"


def _token_count(c: str) -> str:
    return f"len(regexp_extract_all({_straight(c)}, '{_TOKEN}'))"


def _regex(phrase: str) -> str:
    return "".join(c if c.isalnum() else ("\\" + c) * 2 if c in ".-;" else c * 2 for c in phrase)


def _phrases(c: str, phrases: list[str]) -> str:
    """Hits of the phrases in ``c``, a text in which each character that is no letter or digit stands twice, so that neighbours share none."""
    return " + ".join(_n(c, f"(?:^|[^a-z0-9]){_regex(p)}(?:$|[^a-z0-9])") for p in phrases)


def _matched(c: str, phrases: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, {_quoted(f'(?:^|[^a-z0-9]){_regex(p)}(?:$|[^a-z0-9])')}) THEN {_quoted(p)} END" for p in phrases) + "], lambda ph: ph IS NOT NULL)"


def _cv(c: str) -> str:
    mean = f"list_aggregate({c}::DOUBLE[], 'avg')"
    return f"CASE WHEN len({c}) = 0 OR {mean} = 0 THEN 0.0::DOUBLE ELSE list_aggregate({c}::DOUBLE[], 'stddev_pop') / {mean} END"


def _units(c: str) -> str:
    """Code units of UTF-16."""
    return (
        f"flatten(list_transform(string_split({c}, ''), lambda ch: CASE WHEN ord(ch) > 65535 THEN [55296 + ((ord(ch) - 65536) >> 10), 56320 + ((ord(ch) - 65536) & 1023)] "
        f"ELSE [ord(ch)] END))"
    )


def _distinct_grams(c: str, k: int) -> str:
    gram = " || ' ' || ".join(f"{c}[gi + {j}]" for j in range(k))
    return f"CASE WHEN len({c}) < {k} THEN [] ELSE list_transform(range(1, len({c}) - {k - 2}), lambda gi: {gram}) END"


def _plain(c: str) -> str:
    """NFKC of those characters that our texts hold (the documents hold none), without zero-width ones and carriage returns."""
    for a, b in (("\ufb01", "fi"), ("\ufb03", "ffi"), ("\u2026", "..."), ("\u00a0", " "), ("\uff11", "1"), ("\uff12", "2"), ("\uff21", "A"), ("\u200b", ""), ("\ufeff", ""), ("\r", "")):
        c = f"replace({c}, {_quoted(a) if a != chr(13) else 'chr(13)'}, {_quoted(b)})"
    return c


def texts_sql() -> str:
    """The rows of the queries: id, text, platform, kind."""
    own = ", ".join(f"({-1 - i}, {_quoted(t)})" for i, t in enumerate(SAMPLES))
    platform = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLATFORMS))
    mod = lambda k: f"((id % {k}) + {k}) % {k}"
    return (
        f"src AS (SELECT id, text, CASE {mod(len(PLATFORMS))} {platform} END AS platform, CASE WHEN {mod(3)} = 0 THEN 'comment' ELSE 'post' END AS kind FROM (SELECT doc_id AS id, "
        f"text FROM documents UNION ALL SELECT * FROM (VALUES {own}) v(id, text)))"
    )


def counts_sql(src: str = "src", p: str = "") -> str:
    """CTEs up to ``{p}x``: every count of each row of ``src`` (id, text, platform, kind)."""
    sentences = f"list_filter(list_transform(regexp_split_to_array(cleaned, '[.!?]+'), lambda se: trim(se, {_WS})), lambda se: se <> '')"
    marks = ", ".join(f"{_n('cleaned', pattern)} AS {k}" for k, pattern in tx.PUNCTUATION.items())
    phrases = ", ".join(f"{_phrases('wide', getattr(lx, k.upper()))} AS {k}" for k in ("buzz", "hedge", "transition", "template"))
    one_of = lambda words: f"len(list_filter(tokens, lambda tk: tk IN {_in(words)}))"
    word = "[\\p{L}\\p{N}_]"
    return f"""
{p}r AS (SELECT id, platform, kind, text, trim({_plain("coalesce(text, '')")}, {_WS}) AS raw FROM {src}),
{p}c AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS cleaned FROM {p}r),
{p}w AS (SELECT *, {_tokens('cleaned')} AS tokens, regexp_replace(lower({_straight('cleaned')}), '([^a-z0-9])', '\\1\\1', 'g') AS wide, {sentences} AS ss, string_split(cleaned, ' ') AS ws,
  {_units("lower(cleaned)")} AS us FROM {p}c),
{p}k AS (SELECT id, unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS i, len(tokens) AS n FROM {p}w),
{p}m AS (SELECT id, sum(greatest(0, least(i, greatest(n - 25, 0)) - greatest(prev + 1, i - 24, 0) + 1))::BIGINT AS mattr FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY id, t ORDER BY i), -1) AS prev FROM {p}k) GROUP BY id),
{p}f AS (SELECT id, count(*) AS dist, count(*) FILTER (WHERE c = 1) AS hapax, max(c) AS top FROM (SELECT id, t, count(*) AS c FROM {p}k GROUP BY ALL) GROUP BY id),
{p}tr AS (SELECT id, count(*) AS tri_n, count(DISTINCT g) AS tri_d FROM (SELECT id, unnest(list_transform(range(1, len(us) - 1), lambda ui: (us[ui]::BIGINT << 32) | (us[ui + 1]::BIGINT << 16) | us[ui + 2]::BIGINT)) AS g FROM {p}w WHERE len(us) > 2) GROUP BY id),
{p}l AS (SELECT *, list_filter(list_transform(ss, lambda se: {_token_count('se')}), lambda sn: sn > 0) AS sl, list_filter(list_transform(regexp_split_to_array(raw, '\\n+'), lambda pa: {_token_count('pa')}), lambda pn: pn > 0) AS pl,
  list_filter(list_transform(tokens, lambda tk: length(replace(tk, '''', ''))), lambda tn: tn > 0) AS wl, list_filter(list_transform(ss, lambda se: array_to_string(list_slice({_tokens('se')}, 1, 2), ' ')), lambda st: st <> '') AS st,
  {_distinct_grams('tokens', 2)} AS g2, {_distinct_grams('tokens', 3)} AS g3 FROM {p}w),
{p}x AS (SELECT {p}l.*, len(tokens) AS words, length(cleaned) + {_n('cleaned', chr(92) + 'x{10000}')}* 0 + {_n('cleaned', '[' + chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}]')} AS chars,
  length(raw) + {_n('raw', '[' + chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}]')} AS raw_chars, coalesce(dist, 0) AS dist, coalesce(hapax, 0) AS hapax, coalesce(top, 0) AS top, coalesce(mattr, 0) AS mattr,
  coalesce(tri_n, 0) AS tri_n, coalesce(tri_d, 0) AS tri_d, len(sl) AS sn, coalesce(list_aggregate(sl::DOUBLE[], 'avg'), 0) AS smean, {_cv('sl')} AS scv, len(list_filter(sl, lambda sn: sn <= 8)) AS sshort, {_cv('wl')} AS wcv, {_cv('pl')} AS pcv,
  len(g2) AS bn, len(list_distinct(g2)) AS bd, len(g3) AS tn, len(list_distinct(g3)) AS td, len(st) AS stn, len(list_distinct(st)) AS std,
  {one_of(lx.STOPWORDS)} AS stop, {one_of(lx.FIRST_PERSON)} AS first, {one_of(lx.SECOND_PERSON)} AS second, len(list_filter(tokens, lambda tk: contains(tk, ''''))) AS contr, len(list_filter(tokens, lambda tk: regexp_matches(tk, '\\p{{Nd}}'))) AS nums,
  {phrases}, {marks}, len(list_filter(string_split(raw, chr(10)), lambda ln: regexp_matches(ln, '^\\s*(?:•|-|\\*|\\d+[.)])\\s+'))) AS lists, {_n('raw', chr(92) + 'n')} AS newlines,
  {_n('cleaned', '(?i)' + chr(92) + 'bhttps?://' + chr(92) + 'S+|' + chr(92) + 'bwww' + chr(92) + '.' + chr(92) + 'S+')} AS urls, {_n('cleaned', '@' + word + '+|(?:^|' + chr(92) + 's)/?[ur]/[A-Za-z0-9_-]+')} AS mentions, {_n('cleaned', '#' + word + '+')} AS hashtags,
  len(list_filter(range(2, len(ws) + 1), lambda wi: regexp_matches(ws[wi], '^[^A-Za-z]*[A-Z][a-z]+') AND NOT regexp_matches(ws[wi - 1], '[.!?]$'))) AS proper,
  {_n('raw', chr(92) + 'p{L}')} AS letters, {_n('raw', '[A-Za-z]')} AS latin_n, regexp_matches(cleaned, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]') AS emoji
  FROM {p}l LEFT JOIN {p}f USING (id) LEFT JOIN {p}m USING (id) LEFT JOIN {p}tr USING (id))"""


def _share(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN {n} / {d}::DOUBLE ELSE 0.0::DOUBLE END"


def _repeat(n: str, d: str) -> str:
    return f"CASE WHEN {n} > 0 THEN 1.0::DOUBLE - {d} / {n}::DOUBLE ELSE 0.0::DOUBLE END"


_TTR = _share("dist", "words")
_METRICS = {
    "wordCount": "words", "charCount": "chars", "sentenceCount": "greatest(1, sn)", "avgSentenceLen": "CASE WHEN smean <> 0 THEN smean ELSE words END", "sentenceLenCV": "scv", "wordLenCV": "wcv", "paragraphLenCV": "pcv",
    "typeTokenRatio": _TTR, "mattr25": f"CASE WHEN words > 25 THEN mattr / (25 * (words - 24))::DOUBLE ELSE {_TTR} END", "hapaxRatio": _share("hapax", "words"), "stopwordRatio": _share("stop", "words"),
    "bigramRepeatRatio": _repeat("bn", "bd"), "trigramRepeatRatio": _repeat("tn", "td"), "charTrigramRepeatRatio": _repeat("tri_n", "tri_d"), "sentenceStarterRepeatRatio": _repeat("stn", "std"), "topWordShare": _share("top", "words"),
    "listMarkerCount": "lists", "urlCount": "urls", "mentionCount": "mentions", "hashtagCount": "hashtags", "numberTokenRatio": _share("nums", "words"), "properNounishRatio": _share("proper", "words"), "latinRatio": _share("latin_n", "letters"),
    "isReply": "CASE WHEN kind = 'comment' THEN 1 ELSE 0 END",
}


def _features() -> dict[str, str]:
    per100 = lambda n: f"(CASE WHEN words > 0 THEN ({n}) * 100.0::DOUBLE / words ELSE 0.0::DOUBLE END)"
    kinds = " + ".join(f"({k} > 0)::INT" for k in tx.PUNCTUATION)
    m = {k: f"({v})" for k, v in _METRICS.items()}
    out = {k: m[k] for k in ("typeTokenRatio", "mattr25", "wordLenCV", "bigramRepeatRatio", "trigramRepeatRatio", "sentenceStarterRepeatRatio", "charTrigramRepeatRatio", "stopwordRatio", "hapaxRatio", "topWordShare")}
    out |= {"sentenceLenCV": "scv / 2", "avgSentenceLen": f"{m['avgSentenceLen']} / 40.0::DOUBLE", "paragraphLenCV": "pcv / 2", "contractionRatio": _share("contr", "words"), "firstPersonRatio": _share("first", "words"), "secondPersonRatio": _share("second", "words"),
            "shortSentenceRatio": _share("sshort", "sn"), "listMarkerCount": "lists / 4.0::DOUBLE", "newlineRatio": "newlines / greatest(1, raw_chars)::DOUBLE / 0.15::DOUBLE", "discoursePer100w": f"{per100('transition')} / 10", "templatePer100w": f"{per100('template')} / 6",
            "buzzPer100w": f"{per100('buzz')} / 6", "aiHedgePresent": "(hedge > 0)::INT", "quoteRatio": "quote / greatest(1, chars)::DOUBLE / 0.08::DOUBLE", "parenRatio": "parenthesis / greatest(1, chars)::DOUBLE / 0.08::DOUBLE", "punctuationVariety": f"({kinds}) / 8.0::DOUBLE", "emojiPresent": "emoji::INT"}
    out |= {f"{k}Per100w": f"{per100(c)} / {n}" for k, c, n in (("comma", "comma", 30), ("colon", "colon", 10), ("semicolon", "semicolon", 6), ("exclamations", "exclamation", 6), ("questions", "question", 6), ("ellipsis", "ellipsis", 4))}
    return {k: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({out[k]})::DOUBLE))" for k in lx.FEATURE_ORDER}


def values_sql(p: str = "") -> str:
    """``{p}v``: features, and metrics as m_ columns, beside the counts; ``{p}lang``: language support."""
    feats = ", ".join(f"{e} AS {k}" for k, e in _features().items())
    mets = ", ".join(f"({e})::DOUBLE AS m_{k}" for k, e in _METRICS.items())
    state = "CASE WHEN letters = 0 OR m_latinRatio < 0.72::DOUBLE THEN 'unsupported' WHEN words >= 20 AND m_stopwordRatio < 0.055::DOUBLE THEN 'uncertain' ELSE 'supported' END"
    reason = (
        "CASE WHEN letters = 0 THEN 'no letter evidence' WHEN m_latinRatio < 0.72::DOUBLE THEN 'non-Latin or mixed-script text' "
        "WHEN words >= 20 AND m_stopwordRatio < 0.055::DOUBLE THEN 'English language could not be established' ELSE '' END"
    )
    return f"{p}v0 AS (SELECT *, {feats}, {mets} FROM {p}x), {p}v AS (SELECT *, {state} AS language, {reason} AS language_reason FROM {p}v0)"


def profile_sql(p: str = "") -> str:
    """``{p}prof``: id, part, value of the character profile."""
    step = lambda h, u: f"((xor({h}, {u}) * 16777619) & 4294967295)"
    text = f"trim(regexp_replace(regexp_replace(lower({_straight('cleaned')}), '[0-9]', '0', 'g'), '\\s+', ' ', 'g'))"
    return f"""{p}pu AS (SELECT id, unnest(us2) AS u, generate_subscripts(us2, 1) AS i FROM (SELECT id, {_units(text)} AS us2 FROM {p}c)),
{p}pl AS (SELECT id, u::BIGINT AS a, lead(u, 1) OVER w::BIGINT AS b, lead(u, 2) OVER w::BIGINT AS c, lead(u, 3) OVER w::BIGINT AS d, lead(u, 4) OVER w::BIGINT AS e FROM {p}pu WINDOW w AS (PARTITION BY id ORDER BY i)),
{p}p3 AS (SELECT *, {step(step(step('2166136261::BIGINT', 'a'), 'b'), 'c')} AS h3 FROM {p}pl WHERE c IS NOT NULL), {p}p4 AS (SELECT *, {step('h3', 'd')} AS h4 FROM {p}p3), {p}p5 AS (SELECT *, {step('h4', 'e')} AS h5 FROM {p}p4),
{p}ph AS (SELECT id, h3 AS h FROM {p}p5 UNION ALL SELECT id, h4 FROM {p}p5 WHERE d IS NOT NULL UNION ALL SELECT id, h5 FROM {p}p5 WHERE e IS NOT NULL),
{p}pc AS (SELECT id, h % {vx.DIMENSION} AS part, sum(CASE WHEN h & 1073741824 <> 0 THEN -1 ELSE 1 END)::BIGINT AS c FROM {p}ph GROUP BY ALL),
{p}prof AS (SELECT id, part, c / sqrt((sum(c * c) OVER (PARTITION BY id))::DOUBLE) AS value FROM {p}pc WHERE c <> 0)""".replace("lead(u, 1) OVER w::BIGINT", "(lead(u, 1) OVER w)::BIGINT").replace("lead(u, 2) OVER w::BIGINT", "(lead(u, 2) OVER w)::BIGINT").replace("lead(u, 3) OVER w::BIGINT", "(lead(u, 3) OVER w)::BIGINT").replace("lead(u, 4) OVER w::BIGINT", "(lead(u, 4) OVER w)::BIGINT")


def scored_sql(bundle: dict, p: str = "") -> str:
    """``{p}s``: id, model, logit and signal of ``{p}v``."""
    models = bundle["models"]
    use = f"CASE WHEN wanted IN {_in(list(models))} THEN wanted" + (" ELSE 'default' END" if "default" in models else " END")
    chars = [(k, i, w) for k, m in models.items() for i, w in enumerate(m.get("charNgramWeights") or [])]
    weighed = f"{p}cw AS (SELECT id, model, sum(value * cw) AS chars FROM {p}prof JOIN (VALUES {', '.join(f'({_quoted(k)}, {i}, {w}::DOUBLE)' for k, i, w in chars)}) q(model, part, cw) USING (part) GROUP BY ALL)," if chars else ""
    logit = " ".join(f"WHEN {_quoted(k)} THEN {float(m.get('intercept') or 0)}::DOUBLE" + "".join(f" + ({float(w)!r})::DOUBLE * {f}" for f, w in m["weights"].items() if f in lx.FEATURE_ORDER) for k, m in models.items())
    cal = {k: m["calibration"] for k, m in models.items() if m.get("calibration")}
    pick = lambda of, field, missing: (f"CASE model " + " ".join(f"WHEN {_quoted(k)} THEN {of[k][field]!r}::DOUBLE" for k in of if of[k].get(field)) + f" ELSE {missing} END") if any(of[k].get(field) for k in of) else missing  # noqa: E731, F541
    linear = (f"CASE WHEN model IN {_in(list(cal))} THEN ({pick(cal, 'slope', '0.0')}) * logit + ({pick(cal, 'intercept', '0.0')}) ELSE logit END") if cal else "logit"
    cuts = {k: m["thresholds"] for k, m in models.items() if m.get("thresholds")}
    method = ("CASE model " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(c['method'])}" for k, c in cuts.items() if c.get("method")) + " ELSE 'unknown' END") if any(c.get("method") for c in cuts.values()) else "'unknown'"
    return f"""{weighed}
{p}sa AS (SELECT *, platform || ':' || CASE WHEN kind = 'comment' THEN 'comment' ELSE 'post' END AS wanted FROM {p}v), {p}sb AS (SELECT *, {use} AS model FROM {p}sa),
{p}sc AS (SELECT {p}sb.*, CASE model {logit} ELSE 0.0::DOUBLE END {f'+ coalesce({p}cw.chars, 0)' if chars else ''} AS logit, {f'model IN {_in(list(cal))}' if cal else 'false'} AS cal FROM {p}sb {f'LEFT JOIN {p}cw USING (id, model)' if chars else ''}),
{p}sd AS (SELECT *, {linear} AS z FROM {p}sc),
{p}s AS (SELECT *, coalesce(cal, false) AS calibrated, CASE WHEN model IS NULL THEN 0.5::DOUBLE WHEN z >= 20 THEN 1.0::DOUBLE WHEN z <= -20 THEN 0.0::DOUBLE ELSE 1 / (1 + exp(-z)) END AS signal,
  {pick(cuts, 'moderate', '0.58::DOUBLE')} AS cut_moderate, {pick(cuts, 'strong', '0.76::DOUBLE')} AS cut_strong, {pick(cuts, 'target_fpr', 'NULL')} AS cut_fpr, {method} AS cut_method FROM {p}sd)"""


def _cut(c: str, lo: float, hi: float, shift: float) -> str:
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {c} + ({shift})::DOUBLE))"


def evidence_sql() -> str:
    """``ev``: level, reasons and counter-signals of ``v``."""
    limit = lambda i: "CASE " + " ".join(f"WHEN {('platform = ' + _quoted(p)) if p != 'unknown' else 'true'} AND kind {'=' if k == 'comment' else '<>'} 'comment' THEN {v[i]}" for p, kinds in sorted(lx.EVIDENCE_LIMITS.items(), key=lambda x: x[0] == "unknown") for k, v in kinds.items()) + " END"
    some = "len(doubts) > 0"
    level = (
        f"CASE WHEN words >= high AND m_sentenceCount >= 3 THEN CASE WHEN {some} THEN 'medium' ELSE 'high' END WHEN words >= medium THEN CASE WHEN {some} THEN 'weak' "
        f"ELSE 'medium' END ELSE 'weak' END"
    )
    count = lambda c, word: f"CASE WHEN {c} > 0 THEN {c}::INT::VARCHAR || ' {word}' || CASE WHEN {c} = 1 THEN '' ELSE 's' END END"
    return f"""ea AS (SELECT *, {limit(0)} AS least_words, {limit(1)} AS medium, {limit(2)} AS high, list_filter([CASE WHEN language = 'uncertain' THEN language_reason END, CASE WHEN m_sentenceCount < 2 THEN 'too little sentence variation' END,
  CASE WHEN m_typeTokenRatio >= 0.9::DOUBLE AND words < 45 THEN 'lexical diversity is unstable at this length' END], lambda dd: dd IS NOT NULL) AS doubts FROM v),
eb AS (SELECT id, CASE WHEN language = 'unsupported' OR words < least_words THEN 'insufficient' ELSE {level} END AS evidence,
  CASE WHEN language = 'unsupported' THEN [language_reason] WHEN words < least_words THEN ['only ' || words || ' words; at least ' || least_words || ' are required'] ELSE doubts END AS reasons,
  list_filter([{count('urls', 'link')}, {count('mentions', 'mention')}, {count('hashtags', 'hashtag')}, CASE WHEN m_numberTokenRatio >= 0.1::DOUBLE THEN 'number-heavy text' END, CASE WHEN m_properNounishRatio >= 0.08::DOUBLE THEN 'many proper names' END], lambda dd: dd IS NOT NULL) AS own FROM ea),
ev AS (SELECT *, own || reasons AS counter FROM eb)"""


def cues_sql() -> str:
    """``cu``: the rubric of ``v``."""
    split = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(raw, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda se: trim(se, " + _WS + ")), lambda se: se <> '')"
    matched = ", ".join(f"{_matched('wide_raw', getattr(lx, k.upper()))} AS q_{k}" for k in ("hedge", "template", "transition", "rhetorical", "buzz"))
    content = f"list_filter(tokens, lambda tk: length(tk) + {_n('tk', '[' + chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}]')} > 2 AND NOT tk IN {_in(lx.STOPWORDS)})"
    family = lambda when, key, points, detail: f"CASE WHEN {when} THEN {{'id': '{key}', 'points': {points}, 'detail': {detail}}} END"
    counted = lambda c, word: f"CASE WHEN {c} > 0 THEN {c} || ' {word}' END"
    listed = lambda *items: f"array_to_string(list_filter([{', '.join(items)}], lambda it: it IS NOT NULL), '{{}}')"
    framing = "(q_template || q_transition || q_rhetorical)"
    examples = f"({framing} || q_buzz)"
    distinct = f"list_filter({examples}, lambda ph, pi: list_position({examples}, ph) = pi)"
    strength = f"(len({framing}) + CASE WHEN len(q_buzz) >= 2 THEN 1 ELSE 0 END)"
    families = ", ".join([
        family("len(q_hedge) > 0", "self-disclosure", 3, "'Explicit wording: ' || array_to_string(list_slice(q_hedge, 1, 2), ', ')"),
        family(f"{strength} > 0", "formulaic-framing", f"CASE WHEN {strength} >= 3 THEN 2 ELSE 1 END", f"'Stock framing or promotional phrases: ' || array_to_string(list_slice({distinct}, 1, 4), ', ')"),
        family("starters IS NOT NULL OR run >= 3", "parallel-rhythm", "CASE WHEN starters IS NOT NULL AND run >= 3 THEN 2 ELSE 1 END", listed("'repeated openings (' || starters || ')'", "CASE WHEN run >= 3 THEN run || ' consecutive short rhetorical sentences' END").format("; ")),
        family("lists >= 3 OR (colons >= 2 AND dashes >= 1) OR (dashes >= 3 AND cn >= 4)", "structured-presentation", 1, listed(counted("lists", "list markers"), counted("colons", "colons"), counted("dashes", "dash asides")).format(", ")),
        family("cn >= 5 AND m_sentenceLenCV <= 0.28::DOUBLE", "sentence-uniformity", 1, "'Sentence-length variation is low across ' || cn || ' sentences'"),
        family("words >= 60 AND repeat >= 0.08::DOUBLE", "content-repetition", 1, "floor(repeat * 100 + 0.5)::BIGINT || '% repeated content-word pairs after stopword removal'"),
    ])
    return f"""ca AS (SELECT id, raw, words, lists, tokens, language, m_wordCount, m_sentenceCount, m_sentenceLenCV, regexp_replace(lower({_straight('raw')}), '([^a-z0-9])', '\\1\\1', 'g') AS wide_raw, {split} AS cs, {content} AS content FROM v),
cb AS (SELECT *, {matched}, len(cs) AS cn, {_n('raw', ':')} AS colons, {_n('raw', '[—–]')} AS dashes, {_distinct_grams('content', 2)} AS pairs FROM ca),
ci AS (SELECT id, unnest(cs) AS s, generate_subscripts(cs, 1) AS i FROM cb),
cl AS (SELECT id, i, {_token_count('s')} AS n, ({_tokens('s')})[1] AS w FROM ci),
cr AS (SELECT id, max(c) AS run FROM (SELECT id, g, count(*) AS c FROM (SELECT *, r - row_number() OVER (PARTITION BY id, n <= 12 ORDER BY i) AS g FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM cl WHERE n > 0)) WHERE n <= 12 GROUP BY id, g) GROUP BY id),
co AS (SELECT id, string_agg(w || ' x' || c, ', ' ORDER BY c DESC, f) AS starters FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, f) AS r FROM (SELECT id, w, count(*) AS c, min(i) AS f FROM cl WHERE w IS NOT NULL AND NOT w IN {_in(lx.IGNORED_STARTERS)} GROUP BY id, w HAVING count(*) >= 2)) WHERE r <= 3 GROUP BY id),
cc AS (SELECT cb.*, coalesce(run, 0) AS run, starters, CASE WHEN len(content) < 12 THEN 0.0::DOUBLE ELSE (len(pairs) - len(list_distinct(pairs))) / greatest(1, len(content) - 1)::DOUBLE END AS repeat FROM cb LEFT JOIN cr USING (id) LEFT JOIN co USING (id)),
cd AS (SELECT *, list_filter([{families}], lambda fa: fa IS NOT NULL) AS fs FROM cc),
cu AS (SELECT id, CASE len(fs) WHEN 0 THEN 'cue-none' WHEN 1 THEN 'cue-one' ELSE 'cue-multiple' END AS cue_level, len(fs) || '/6 cue families' AS cue_text, coalesce(list_sum(list_transform(fs, lambda fa: fa.points)), 0)::BIGINT AS points,
  array_to_string(list_transform(fs, lambda fa: fa.id), '; ') AS families, array_to_string(list_transform(fs, lambda fa: fa.detail), '; ') AS details, CASE WHEN len(fs) = 0 THEN 'clear' WHEN len(fs) <= 3 THEN 'caution' ELSE 'alert' END AS tone, repeat,
  CASE WHEN language = 'unsupported' THEN 'unsupported' WHEN m_wordCount < 20 OR m_sentenceCount < 2 THEN 'short' WHEN m_wordCount >= 80 AND m_sentenceCount >= 4 AND language = 'supported' THEN 'long' ELSE 'standard' END AS coverage FROM cd)"""


def segments_sql() -> str:
    """``seg``: id, nr (from 1), text, of the raw texts in ``c``."""
    return f"""ga AS (SELECT id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT id, regexp_extract_all(raw, '[^.!?\\n]+(?:[.!?]+|\\n+|\\z)') AS ps FROM c)),
gb AS (SELECT id, i, trim(piece, {_WS}) AS piece, {_token_count('piece')} AS n FROM ga),
gc(id, i, s, n) AS (SELECT id, 1, 1, n FROM gb WHERE i = 1 UNION ALL SELECT gc.id, gc.i + 1, gc.s + CASE WHEN gc.n >= {segments.CLOSE} THEN 1 ELSE 0 END, CASE WHEN gc.n >= {segments.CLOSE} THEN gb.n ELSE gc.n + gb.n END FROM gc JOIN gb ON gb.id = gc.id AND gb.i = gc.i + 1),
gd AS (SELECT *, max(s) OVER (PARTITION BY id) AS tail FROM gc), ge AS (SELECT id, max(n) FILTER (WHERE s = tail) AS tail_n FROM gd GROUP BY id),
gf AS (SELECT gd.id, gd.i, CASE WHEN s = tail AND s > 1 AND tail_n < {segments.TAIL} THEN s - 1 ELSE s END AS s FROM gd JOIN ge USING (id)),
gg AS (SELECT id, s, string_agg(piece, ' ' ORDER BY i) AS text FROM gf JOIN gb USING (id, i) GROUP BY id, s),
gh AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) AS nr FROM gg WHERE {_token_count('text')} >= {segments.LEAST}), seg AS (SELECT id, nr, text FROM gh WHERE nr <= {segments.MOST})"""


def segment_scores_sql(bundle: dict) -> str:
    """``gm``: id, nr, signal, words, excerpt of scored segments; ``gl``: their least and greatest scores."""
    chars = any(m.get("charNgramWeights") for m in bundle["models"].values())
    return f"""gi AS (SELECT id FROM src WHERE {_token_count("coalesce(text, '')")} >= {segments.FROM_TOKENS}), gj AS (SELECT id FROM seg JOIN gi USING (id) GROUP BY id HAVING count(*) >= 2),
gsrc AS (SELECT seg.id * 16 + nr AS id, seg.text, platform, kind FROM seg JOIN gj USING (id) JOIN src USING (id)), {counts_sql('gsrc', 'z')}, {values_sql('z')}, {profile_sql('z') + ',' if chars else ''} {scored_sql(bundle, 'z')},
gm AS (SELECT (id - (((id % 16) + 16) % 16)) // 16 AS id, ((id % 16) + 16) % 16 - 1 AS nr, signal, words, CASE WHEN length(text) > 110 THEN left(text, 107) || '…' ELSE text END AS excerpt FROM zs),
gl AS (SELECT id, min(signal) AS low, max(signal) AS high, count(*) AS n_segments FROM gm GROUP BY id)"""


def _base(*more: str) -> str:
    return "WITH " + ", ".join([texts_sql(), counts_sql(), values_sql(), *more])


def analysis_sql(bundle: dict) -> str:
    chars = any(m.get("charNgramWeights") for m in bundle["models"].values())
    mod, strong = _cut("cut_moderate", 0.2, 0.9, 0), _cut("cut_strong", 0.35, 1.01, 0)
    parts = [profile_sql()] if chars else []
    tail = f"""fin AS (SELECT s.*, ev.evidence, cu.cue_level, cu.cue_text, cu.points, cu.coverage, coalesce(n_segments, 0) AS n_segments, coalesce((high - low >= 0.25::DOUBLE AND low < {mod} AND high >= {strong}) OR high - low >= 0.38::DOUBLE, false) AS mixed
  FROM s JOIN ev USING (id) JOIN cu USING (id) LEFT JOIN gl USING (id)),
lab AS (SELECT *, CASE WHEN NOT calibrated THEN cue_level WHEN evidence = 'insufficient' THEN 'insufficient' WHEN mixed THEN 'mixed' WHEN signal < {mod} THEN 'low' WHEN signal < {strong} OR evidence = 'weak' THEN 'moderate' ELSE 'strong' END AS level FROM fin)"""
    names = {"insufficient": "Insufficient signal", "mixed": "Mixed AI-style signals", "low": "Low AI-style signal", "moderate": "Moderate AI-style signal", "strong": "Strong AI-style signal"}
    return _base(*parts, scored_sql(bundle), evidence_sql(), cues_sql(), segments_sql(), segment_scores_sql(bundle), tail).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT id AS doc_id, wanted AS model_key, calibrated, round(signal, 6) AS signal, level, CASE WHEN NOT calibrated THEN cue_text ELSE CASE level {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} END END AS label, evidence, mixed, points, n_segments AS segments,
  level = 'insufficient' OR (NOT calibrated AND coverage IN ('short', 'unsupported')) OR level IN ('low', 'cue-none') AS hidden,
  CASE WHEN calibrated THEN 'Experimental style signal, not proof of authorship.' ELSE 'Explainable cue profile, not proof of AI use or authorship.' END AS disclaimer FROM lab"""


def drivers_sql() -> str:
    models = md.DEFAULT_BUNDLE["models"]
    items = lambda m: "[" + ", ".join(f"{{'k': {_quoted(lx.FEATURE_NAMES.get(f, f))}, 'c': ({float(w)!r})::DOUBLE * {f}, 'i': {i}}}" for i, (f, w) in enumerate(m["weights"].items())) + "]"
    of = "CASE model " + " ".join(f"WHEN {_quoted(k)} THEN {items(m)}" for k, m in models.items()) + " ELSE [] END"
    top = lambda op: f"(SELECT string_agg(k, '; ' ORDER BY a DESC, i) FROM (SELECT k, a, i, row_number() OVER (ORDER BY a DESC, i) AS r FROM (SELECT it.k AS k, it.i AS i, abs(it.c) AS a FROM (SELECT unnest(items) AS it) WHERE it.c {op})) WHERE r <= 4)"
    return _base(scored_sql(md.DEFAULT_BUNDLE), f"it AS (SELECT id, {of} AS items FROM s)") + f" SELECT id AS doc_id, len(items) AS n, round(coalesce(list_sum(list_transform(items, lambda it: abs(it.c))), 0), 6) AS sizes, coalesce({top('> 0.01::DOUBLE')}, '') AS raises, coalesce({top('< -0.01::DOUBLE')}, '') AS lowers FROM it"


def oracle_sql() -> dict[str, str]:
    six = lambda c: f"round(({c})::DOUBLE, 6)"
    return {
        "feature_table": _base() + f" SELECT id AS doc_id, {', '.join(f'{six(k)} AS {k}' for k in lx.FEATURE_ORDER)} FROM v",
        "metric_table": _base() + f" SELECT id AS doc_id, {', '.join(f'{six(f'm_{k}')} AS {k}' for k in _METRICS)}, language FROM v",
        "char_profiles": _base(profile_sql()) + f" SELECT id AS doc_id, part, {six('value')} AS value FROM prof",
        "scores": _base(scored_sql(md.DEFAULT_BUNDLE)) + f" SELECT id AS doc_id, wanted AS model_key, calibrated, {six('logit')} AS logit, {six('signal')} AS signal, floor(round(signal, 9) * 100 + 0.5)::BIGINT AS percent, {six(_cut('cut_moderate', 0.2, 0.9, 0.06))} AS moderate, {six(_cut('cut_strong', 0.35, 1.01, 0.06))} AS strong, CASE WHEN model IS NULL THEN 'unknown' ELSE cut_method END AS method FROM s",
        "calibrated_scores": _base(profile_sql(), scored_sql(CALIBRATED)) + f" SELECT id AS doc_id, wanted AS model_key, calibrated, {six('logit')} AS logit, {six('signal')} AS signal, {six(_cut('cut_moderate', 0.2, 0.9, -0.06))} AS moderate, {six(_cut('cut_strong', 0.35, 1.01, -0.06))} AS strong, cut_method AS method, {six('coalesce(cut_fpr, -1)')} AS target_fpr FROM s",
        "score_drivers": drivers_sql(),
        "evidence_levels": _base(evidence_sql()) + " SELECT id AS doc_id, evidence AS level, array_to_string(reasons, '; ') AS reasons, array_to_string(counter, '; ') AS counter FROM ev",
        "cue_rubric": _base(cues_sql()) + f" SELECT id AS doc_id, cue_level AS level, cue_text AS text, points, families, details, coverage, tone, {six('repeat')} AS repeat FROM cu",
        "cue_counts": _base(cues_sql()) + " SELECT id AS doc_id, cn AS sentences, run AS short_run, colons, dashes FROM cc WHERE id >= 0",
        "segment_texts": f"WITH RECURSIVE {texts_sql()}, c AS (SELECT id, trim({_plain("coalesce(text, '')")}, {_WS}) AS raw FROM src), {segments_sql()} SELECT id AS doc_id, nr - 1 AS \"at\", text AS segment FROM seg",
        "segment_mix": _base(segments_sql(), segment_scores_sql(CALIBRATED)).replace("WITH ", "WITH RECURSIVE ", 1) + f" SELECT id AS doc_id, nr AS \"at\", {six('signal')} AS signal, words, excerpt, {six('low')} AS low, {six('high')} AS high FROM gm JOIN gl USING (id)",
        "analysis": analysis_sql(md.DEFAULT_BUNDLE),
        "calibrated_analysis": analysis_sql(CALIBRATED),
    }


def queries():
    own = (feature_table, metric_table, char_profiles, scores, calibrated_scores, score_drivers, evidence_levels, cue_rubric, segment_texts, segment_mix, analysis, calibrated_analysis)
    return {f.__name__: f for f in own}
