"""Text operators over documents, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import language, media

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_SPACE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _quality(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang", T.quality_log(F.col("text")).alias("q"))


def quality_ladder(spark, sf_dir):
    got = _quality(spark, sf_dir).select("lang", F.coalesce("q.reason", F.lit("passed")).alias("reason"), "q.n_words")
    return got.groupBy("lang", "reason").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_words").cast("long")).alias("n_words"))


def quality_scores(spark, sf_dir):
    q = lambda k: F.round(F.col(f"q.{k}"), 6).alias(k)
    return _quality(spark, sf_dir).select("doc_id", q("diversity"), F.col("q.repetition").cast("long").alias("repetition"), q("third_person"), F.col("q.marks").cast("long").alias("marks"), q("score"), "q.reason")


_MARKS = " + ".join(
    rf"len(regexp_extract_all(lower(text), '{p}'))"
    for p in (
        r"\bonce upon a time\b", r"\bin a (?:land|kingdom|village|city|world|place)\b", r"\bthere (?:was|were|lived)\b", r"\bthe story (?:of|begins|continues)\b",
        r"\bchapter [0-9]+\b", r"\bto be continued\b", r"\bthe end\b", r"\blong ago\b", r"\bmany years (?:ago|later)\b",
    )
)
_QUALITY_CTE = rf"""
WITH d AS (SELECT doc_id, lang, text, {_WORDS} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
f AS (SELECT doc_id, i, w = lead(w, 1) OVER o AS s1, w = lead(w, 2) OVER o AS s2 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, s1, s2, i - row_number() OVER (PARTITION BY doc_id, s1 ORDER BY i) AS k1, i - row_number() OVER (PARTITION BY doc_id, s2 ORDER BY i) AS k2 FROM f),
r1 AS (SELECT doc_id, max(n) AS r FROM (SELECT doc_id, k1, count(*) AS n FROM g WHERE s1 GROUP BY doc_id, k1) GROUP BY doc_id),
r2 AS (SELECT doc_id, max(n) AS r FROM (SELECT doc_id, k2, count(*) AS n FROM g WHERE s2 GROUP BY doc_id, k2) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, len(ws) AS n,
    CASE WHEN len(ws) >= 10 THEN CAST(len(list_distinct(ws)) AS DOUBLE) / len(ws) ELSE 0 END AS diversity,
    CASE WHEN len(ws) >= 10 THEN greatest(coalesce(r1.r + 1, 0), 1 + coalesce(r2.r, 0) // 2) ELSE 0 END AS repetition,
    CASE WHEN len(ws) >= 50 THEN CAST(len(list_filter(ws, lambda w: w IN ('he','she','they','him','her','them','his','hers','their','theirs'))) AS DOUBLE) / len(ws) ELSE 0 END AS third_person,
    CASE WHEN len(ws) >= 50 THEN {_MARKS} ELSE 0 END AS marks
  FROM d LEFT JOIN r1 ON r1.doc_id = d.doc_id LEFT JOIN r2 ON r2.doc_id = d.doc_id
), s AS (
  SELECT *, CASE WHEN diversity > 0 THEN 0.5 * least(1.0, diversity / 0.4) ELSE 0 END + 0.3 * greatest(0.0, 1 - repetition / 5)
    + 0.2 * (greatest(0.0, 1 - third_person / 0.3) * greatest(0.0, 1 - marks / 3)) AS score FROM m
), q AS (
  SELECT *, CASE WHEN n = 0 THEN 'insufficient_words' WHEN n >= 10 AND diversity < 0.4 THEN 'low_lexical_diversity' WHEN repetition > 5 THEN 'excessive_phrase_repetition'
    WHEN third_person > 0.3 THEN 'high_third_person_ratio' WHEN marks > 3 THEN 'narrative_detected' WHEN score < 0.5 THEN 'low_quality_score' END AS reason FROM s
)"""
QUALITY_LADDER_SQL = _QUALITY_CTE + " SELECT lang, coalesce(reason, 'passed') AS reason, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM q GROUP BY 1, 2"
QUALITY_SCORES_SQL = _QUALITY_CTE + """ SELECT doc_id, round(CAST(diversity AS DOUBLE), 6) AS diversity, CAST(repetition AS BIGINT) AS repetition, round(CAST(third_person AS DOUBLE), 6) AS third_person,
 CAST(marks AS BIGINT) AS marks, round(CAST(least(1.0, score) AS DOUBLE), 6) AS score, reason FROM q"""


def quality_confusion(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = _quality(spark, sf_dir).join(labels.select("doc_id", "quality"), "doc_id")
    return judged.groupBy("quality", F.col("q.reason").isNull().alias("passed")).agg(F.count(F.lit(1)).alias("n"))


def _by_doc(name, made):
    def query(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in made(F.col("text")).items()])

    query.__name__ = name
    return query


def _nested(start, rules, options="'g'"):
    for pattern, by in rules:
        start = f"regexp_replace({start}, '{pattern}', '{by}', {options})"
    return start


_LITERALS = "text"
for _l in T.MEDIA_LITERALS:
    _LITERALS = f"replace({_LITERALS}, '{_l}', '[MEDIA_SENT]')"
_W = r"\p{L}\p{N}_"
_LOG = _nested(
    _LITERALS,
    (
        (r"https?://\S+", "[LINK]"), (r"www\.\S+", "[LINK]"), (rf"[{_W}.-]+@[{_W}.-]+\.[{_W}]+", "[EMAIL]"),
        (r"\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}", "[PHONE]"), (r"₹\s*[\d,]+\.?\d*", "[AMOUNT]"), (r"\$\s*[\d,]+\.?\d+", "[AMOUNT]"),
    ),
)
_EXPORT = _nested(
    "text",
    (
        (rf"@[{_W}][{_W}.]{{0,29}}", "[USER]"), (r"https?://\S+", "[LINK]"), (r"www\.\S+", "[LINK]"), (rf"[{_W}.-]+@[{_W}.-]+\.[{_W}]+", "[EMAIL]"),
        (r"\+91[-.\s]?\d{10}", "[PHONE]"), (r"\b[6-9]\d{9}\b", "[PHONE]"),
    ),
)
_EXPORT = f"regexp_replace({_EXPORT}, '\\b(?:{'|'.join(T.LOCATIONS)})\\b', '[LOCATION]', 'gi')"
_EXPORT = _nested(_EXPORT, ((r"₹\s*[\d,]+\.?\d*", "[AMOUNT]"), (r"\$\s*[\d,]+\.?\d+", "[AMOUNT]")))
_SPACED = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_SPACED = _nested(_SPACED, ((r"[ \t]+", " "), (r" *\n *", r"\n"), (r"\n{3,}", r"\n\n"), (r"\s+([,.;:!?])", r"\1"))).replace(r"'\n'", "chr(10)").replace(r"'\n\n'", "chr(10) || chr(10)")
# no look-ahead: a mark and the character after it are matched together, twice for neighbouring marks
_SPACED = _nested(_SPACED, ((r"([,.;:!?])([^\s,.;:!?])", r"\1 \2"), (r"([,.;:!?])([,.;:!?])", r"\1 \2"), (r"([,.;:!?])([,.;:!?])", r"\1 \2")))
_SPACED = rf"regexp_replace({_SPACED}, '^\s+|\s+$', '', 'g')"
_PHRASES = "text || ' SwipeToWatch, TAPTOSEE Readmore. OpenAI AIDARIO hasnever'"
for _p, _by in T.PHRASE_RULES:
    _PHRASES = f"regexp_replace({_PHRASES}, '{_p}', '{_by}', 'gi')"
_ENERGY = "(length({0}) + 5 * (length({0}) - length(replace({0}, '!', ''))) + 5 * (length({0}) - length(replace({0}, '?', ''))) + (length({0}) - length(replace({0}, '...', ''))) + 5 * length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')))"
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_STORY = " + ".join(f"CAST(contains(lower(text), '{p}') AS INTEGER)" for p in T.STORY_PHRASES)


def ocr_clean(spark, sf_dir):
    return media.ocr_cleaned(docs(spark, sf_dir).select("doc_id", F.upper("text").alias("text")), "text", "clean").select("doc_id", "clean")


def language_ids(spark, sf_dir):
    """The language that a model of four fifths of the documents gives each, and the English rule by it."""
    d = docs(spark, sf_dir)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.learnt(d.where(~held))
    got = language.identified(d.select("doc_id", "text"), model)
    return got.select("doc_id", held.alias("held_out"), "language", T.is_english(F.col("text"), F.col("language")).alias("english"))


def english_rule(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", T.is_english(F.col("text"), F.col("lang")).alias("english"))


QUERIES = {
    "quality_ladder": (quality_ladder, QUALITY_LADDER_SQL),
    "quality_scores": (quality_scores, QUALITY_SCORES_SQL),
    "quality_confusion": (quality_confusion, _QUALITY_CTE + " SELECT quality, reason IS NULL AS passed, count(*) AS n FROM q JOIN labels USING (doc_id) GROUP BY 1, 2"),
    "phrase_loops": (
        _by_doc("phrase_loops", lambda t: {"repetition": T.phrase_repetition(T.words(t)).cast("long")}),
        _QUALITY_CTE + " SELECT d.doc_id, CAST(CASE WHEN len(ws) < 2 THEN 0 ELSE greatest(coalesce(r1.r + 1, 0), CASE WHEN len(ws) >= 4 THEN 1 + coalesce(r2.r, 0) // 2 ELSE 0 END) END AS BIGINT) AS repetition FROM d LEFT JOIN r1 ON r1.doc_id = d.doc_id LEFT JOIN r2 ON r2.doc_id = d.doc_id",
    ),
    "sentence_loops": (_by_doc("sentence_loops", lambda t: {"repetition": T.sentence_repetition(t).cast("long")}), None),
    "pii_scrub_log": (_by_doc("pii_scrub_log", lambda t: {"clean": T.scrubbed_log(t)}), f"SELECT doc_id, {_SPACE.format(_LOG)} AS clean FROM documents"),
    "pii_scrub_export": (_by_doc("pii_scrub_export", lambda t: {"clean": T.scrubbed_export(t)}), f"SELECT doc_id, {_SPACE.format(_EXPORT)} AS clean FROM documents"),
    "unicode_clean": (
        _by_doc("unicode_clean", lambda t: {"clean": T.unicode_cleaned(t)}),
        "SELECT doc_id, replace(replace(translate(replace(text, 'â€¯', ' '), chr(8239) || chr(160) || chr(8201) || chr(8211) || chr(8212), '   --'), chr(8203), ''), chr(65279), '') AS clean FROM documents",
    ),
    "mojibake_repair": (_by_doc("mojibake_repair", lambda t: {"clean": T.mojibake_repaired(F.decode(F.encode(t, "UTF-8"), "ISO-8859-1"))}), None),
    "word_stats": (
        _by_doc("word_stats", lambda t: {"n_words": F.size(T.words(t)).cast("long"), "n_distinct": F.size(F.array_distinct(T.words(t))).cast("long")}),
        f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words, CAST(len(list_distinct({_WORDS})) AS BIGINT) AS n_distinct FROM documents",
    ),
    "spacing_normalise": (_by_doc("spacing_normalise", lambda t: {"clean": T.spaced(t)}), f"SELECT doc_id, {_SPACED} AS clean FROM documents"),
    "ocr_phrase_rules": (_by_doc("ocr_phrase_rules", lambda t: {"clean": T.phrases_repaired(F.concat(t, F.lit(" SwipeToWatch, TAPTOSEE Readmore. OpenAI AIDARIO hasnever")))}), f"SELECT doc_id, {_PHRASES} AS clean FROM documents"),
    "ocr_clean": (ocr_clean, None),
    "text_energy": (
        _by_doc("text_energy", lambda t: {"energy": T.energy(t).cast("long"), "question": T.is_question(t)}),
        f"SELECT doc_id, CAST({_ENERGY.format('text')} AS BIGINT) AS energy, contains(text, '?') OR coalesce(regexp_extract(lower(text), '[^\\s]+') IN ('what','where','when','who','why','how','which','can','could'), false) AS question FROM documents",
    ),
    "story_markers": (_by_doc("story_markers", lambda t: {"phrases": T.story_phrases(t).cast("long")}), f"SELECT doc_id, CAST({_STORY} AS BIGINT) AS phrases FROM documents"),
    "language_ids": (language_ids, None),
    "english_rule": (
        english_rule,
        f"""WITH d AS (SELECT doc_id, lang, {_WORDS} AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) = 0 THEN false WHEN list_has_any(ws, {_LIST(T.LOCAL_WORDS)}) THEN false
 WHEN len(ws) <= 3 AND list_has_any(ws, {_LIST(T.SAFE_WORDS)}) THEN true ELSE coalesce(lang = 'en', true) END AS english FROM d""",
    ),
    "upper_texts": (
        _by_doc("upper_texts", lambda t: {"mostly_upper": T.mostly_upper(t)}),
        r"WITH d AS (SELECT doc_id, regexp_replace(text, '[^\p{L}]', '', 'g') AS l FROM documents) SELECT doc_id, length(l) >= 12 AND length(regexp_replace(l, '[\p{Ll}]', '', 'g')) / greatest(length(l), 1) >= 0.72 AS mostly_upper FROM d",
    ),
    "file_names": (
        _by_doc("file_names", lambda t: {"name": T.file_name(t)}),
        r"""SELECT doc_id, regexp_replace(text, '[\\/*?:"<>|]', '', 'g') AS name FROM documents""",
    ),
}
