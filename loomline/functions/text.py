"""Text functions, Column to Column: clean-up, scrubbing, tokens, quality, spacing."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

# Fixed values of the rules below.
MEDIA_LITERALS = ("<Media omitted>", "image omitted", "video omitted", "audio omitted", "sticker omitted", "GIF omitted", "document omitted")
PRONOUNS_TEXT = ("he", "she", "they", "him", "her", "them", "his", "hers", "their", "theirs")
PRONOUNS_EXPORT = ("he", "she", "they", "him", "her", "them", "his", "hers", "their")
NARRATIVE_PATTERNS = (
    r"\bonce upon a time\b",
    r"\bin a (?:land|kingdom|village|city|world|place)\b",
    r"\bthere (?:was|were|lived)\b",
    r"\bthe story (?:of|begins|continues)\b",
    r"\bchapter [0-9]+\b",
    r"\bto be continued\b",
    r"\bthe end\b",
    r"\blong ago\b",
    r"\bmany years (?:ago|later)\b",
)
STORY_PHRASES = (
    "once upon a time", "long story short", "so basically", "funny story", "the other day", "remember when",
    "this one time", "back when", "used to", "would always", "never forget", "will never forget",
)
QUESTION_WORDS = ("what", "where", "when", "who", "why", "how", "which", "can", "could")
LOCATIONS = (
    "Bangalore", "Bengaluru", "Mumbai", "Delhi", "Hyderabad", "Chennai", "Kolkata", "Pune",
    "Koramangala", "Indiranagar", "Whitefield", "HSR Layout", "BTM Layout",
    "Embassy Tech Village", "Manyata", "Ecospace", "RMZ", "Prestige", "Brigade",
)
PHRASE_RULES = (
    (r"\bSWIPETOWATCH\b", "SWIPE TO WATCH"),
    (r"\bSWIPE\s*TO\s*WATCH\b", "SWIPE TO WATCH"),
    (r"\bTAPTO(?:READ|WATCH|SEE)\b", "TAP TO WATCH"),
    (r"\bREADMORE\b", "READ MORE"),
    (r"\bWATCHNOW\b", "WATCH NOW"),
    (r"\bLINKINBIO\b", "LINK IN BIO"),
    (r"\bBEFOREIN\b", "BEFORE IN"),
    (r"\bHASNEVER\b", "HAS NEVER"),
    (r"\bHAVENEVER\b", "HAVE NEVER"),
    (r"\bTHATHAS\b", "THAT HAS"),
    (r"\bTHATHAVE\b", "THAT HAVE"),
    (r"\bPREDICTSSOMETHING\b", "PREDICTS SOMETHING"),
    (r"\bSAYSSOMETHING\b", "SAYS SOMETHING"),
    (r"\bSHOWSSOMETHING\b", "SHOWS SOMETHING"),
    (r"\bECONOMICHISTORY\b", "ECONOMIC HISTORY"),
    (r"\bEVOLVINGAI\b", "EVOLVING AI"),
    (r"\bANTHROPICEVOLVING\b", "ANTHROPIC EVOLVING"),
    (r"\bOPENAI\b", "OPENAI"),
    (r"\bA[J1I]DARIO\b", "AI DARIO"),
)
# of each rule, letters that every text has that it changes
PHRASE_PARTS = (
    "swipe", "tapto", "readmore", "watchnow", "linkinbio", "beforein", "hasnever", "havenever", "thathas", "thathave", "predictssomething",
    "sayssomething", "showssomething", "economichistory", "evolvingai", "anthropicevolving", "openai", "dario",
)
LOCAL_WORDS = (
    "guru", "masth", "sari", "aithu", "aythu", "illa", "illva", "ilva", "hu", "huu", "houdu", "howdu", "hange", "hinge",
    "yen", "yenu", "yake", "yaake", "heli", "helu", "nange", "ninge", "namge", "nam", "ninu", "neenu", "naanu", "nanu",
    "ba", "baa", "banni", "hogu", "beku", "beda", "kodi", "kodu", "maadi", "maadu", "nodi", "nodu", "ivaga", "avaga",
    "yavaga", "elli", "hege", "estu", "astu", "kane",
)
SAFE_WORDS = (
    "ok", "okay", "k", "kk", "lol", "lmao", "rofl", "cool", "yeah", "yep", "yes", "no", "nope", "nah", "hm", "hmm",
    "hmmm", "wow", "nice", "thx", "thanks", "tysm", "great", "good", "bad", "why", "what", "who", "when", "where",
    "how", "really", "sure", "fine", "done",
)


def evaluated_once(value: Column, body) -> Column:
    """body(value) with value bound to a lambda variable, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replaced(text: Column, *rules: tuple[str, str]) -> Column:
    """regexp_replace by each rule in turn; replacements are literal but for groups."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unicode_cleaned(text: Column) -> Column:
    """Special blanks to blanks, zero-width marks dropped, dashes to hyphens."""
    text = F.replace(text, F.lit("â€¯"), F.lit(" "))
    return F.translate(text, "\u202f\u00a0\u2009\u2013\u2014\u200b\ufeff", "   --")


def scrubbed_log(text: Column) -> Column:
    """Tags for media notices, links, addresses, phones and amounts, in the order of a text log."""
    for literal in MEDIA_LITERALS:
        text = F.replace(text, F.lit(literal), F.lit("[MEDIA_SENT]"))
    text = replaced(  # fixed values
        text,
        (r"(?U)https?://\S+", "[LINK]"),
        (r"(?U)www\.\S+", "[LINK]"),
        (r"(?U)[\w.-]+@[\w.-]+\.\w+", "[EMAIL]"),
        (r"(?U)\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}", "[PHONE]"),
        (r"(?U)₹\s*[\d,]+\.?\d*", "[AMOUNT]"),
        (r"(?U)\$\s*[\d,]+\.?\d+", "[AMOUNT]"),
    )
    return squeezed(F.coalesce(text, F.lit("")))


def scrubbed_export(text: Column, locations: bool = True) -> Column:
    """Tags for users, links, addresses, phones, places and amounts, in the order of a JSON export."""
    text = replaced(  # fixed values
        text,
        (r"(?U)@\w[\w.]{0,29}", "[USER]"),
        (r"(?U)https?://\S+", "[LINK]"),
        (r"(?U)www\.\S+", "[LINK]"),
        (r"(?U)[\w.-]+@[\w.-]+\.\w+", "[EMAIL]"),
        (r"(?U)\+91[-.\s]?\d{10}", "[PHONE]"),
        (r"(?U)\b[6-9]\d{9}\b", "[PHONE]"),
        *([(r"(?iU)\b(?:" + "|".join(LOCATIONS) + r")\b", "[LOCATION]")] if locations else []),
        (r"(?U)₹\s*[\d,]+\.?\d*", "[AMOUNT]"),
        (r"(?U)\$\s*[\d,]+\.?\d+", "[AMOUNT]"),
    )
    return squeezed(text)


# Marks that stay broken where a text does not decode as a whole, and what they stand for.
BROKEN_MARKS = (("\u00e2\u0080\u009c", '"'), ("\u00e2\u0080\u009d", '"'), ("\u00e2\u0080\u0099", "'"), ("\u00e2\u0080\u00a6", "..."))


def mojibake_repaired(text: Column | str) -> Column:
    """Text whose Latin-1 bytes are UTF-8 read as such, where a tell-tale character asks for it; of a text that does not
    decode, only the quotation marks, apostrophes and ellipses."""
    text = F.col(text) if isinstance(text, str) else text
    tell = F.contains(text, F.lit("\\u00")) | F.contains(text, F.lit("â")) | F.contains(text, F.lit("ð"))
    narrow = ~F.rlike(text, F.lit(r"[^\x{00}-\x{FF}]"))
    raw = F.encode(F.when(tell & narrow, text), "ISO-8859-1")
    whole = F.coalesce(F.try_validate_utf8(F.decode(F.when(F.is_valid_utf8(raw), raw), "UTF-8")), text)
    for broken, mark in BROKEN_MARKS:
        whole = F.replace(whole, F.lit(broken), F.lit(mark))
    return whole


def words(text: Column) -> Column:
    """Lower-cased words: letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def lexical_diversity(ws: Column) -> Column:
    """Distinct words over words."""
    return F.size(F.array_distinct(ws)).cast("double") / F.size(ws)


def longest_run(ws: Column, stride: int) -> Column:
    """Longest run of i with w[i] = w[i + stride]."""
    n = F.size(ws)
    same = F.when(n > stride, F.transform(F.slice(ws, F.lit(1), F.greatest(n - stride, F.lit(0))), lambda w, i: w == F.get(ws, i + stride)))
    folded = F.aggregate(
        F.coalesce(same, F.array().cast("array<boolean>")),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, s: F.struct(F.when(s, a["now"] + 1).otherwise(0).alias("now"), F.when(s, F.greatest(a["most"], a["now"] + 1)).otherwise(a["most"]).alias("most")),
        lambda a: a["most"],
    )
    return folded


def phrase_repetition(ws: Column) -> Column:
    """Most repeats in a row of a word or of a pair of words."""

    def most(bound: Column) -> Column:
        one, two = longest_run(bound, 1), longest_run(bound, 2)
        pairs = F.when(F.size(bound) >= 4, 1 + F.floor(two / 2)).otherwise(0)
        return F.when(F.size(bound) < 2, 0).otherwise(F.greatest(F.when(one > 0, one + 1).otherwise(0), pairs)).cast("int")

    return evaluated_once(ws, most)


def sentence_repetition(text: Column) -> Column:
    """Longest run of one word, whatever its case, within a sentence."""
    sentences = F.split(F.lower(text), r"[.!?]+")
    tokens = F.transform(sentences, lambda s: F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))
    runs = F.transform(tokens, lambda ws: F.when(F.size(ws) > 0, longest_run(ws, 1) + 1).otherwise(0))
    return F.array_max(runs)


def third_person_ratio(ws: Column, pronouns: tuple[str, ...] = PRONOUNS_TEXT) -> Column:
    """Share of words that are third-person pronouns."""
    return F.size(F.filter(ws, lambda w: w.isin(*pronouns))).cast("double") / F.size(ws)


def narrative_marks(text: Column) -> Column:
    """Matches of all narrative patterns."""
    total = F.lit(0)
    for pattern in NARRATIVE_PATTERNS:
        total = total + F.regexp_count(F.lower(text), F.lit("(?U)" + pattern))
    return total


def story_phrases(text: Column) -> Column:
    """How many story phrases occur."""
    total = F.lit(0)
    for phrase in STORY_PHRASES:
        total = total + F.contains(F.lower(text), F.lit(phrase)).cast("int")
    return total


def occurrences(text: Column, mark: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def energy(text: Column) -> Column:
    """Length, with a premium for !, ?, ellipses and characters outside ASCII."""
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.length(text) + 5 * occurrences(text, "!") + 5 * occurrences(text, "?") + 3 * occurrences(text, "...") + 5 * wide


def is_question(text: Column) -> Column:
    """A question mark, or a question word first."""
    first = F.get(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), F.lit(0))
    return F.contains(text, F.lit("?")) | F.coalesce(first.isin(*QUESTION_WORDS), F.lit(False))


def is_english(text: Column, language: Column | None = None) -> Column:
    """False without words or with a local word; true for up to three words with a safe one; else by language."""
    known = F.lit(True) if language is None else F.coalesce(language == "en", F.lit(True))
    ws = words(F.coalesce(text, F.lit("")))
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    return (
        F.when(F.size(ws) == 0, False)
        .when(F.arrays_overlap(ws, listed(LOCAL_WORDS)), False)
        .when((F.size(ws) <= 3) & F.arrays_overlap(ws, listed(SAFE_WORDS)), True)
        .otherwise(known)
    )


def spaced(text: Column) -> Column:
    """Unix line ends, single blanks, at most one blank line, no blank before and one after a mark. A text so spaced stays
    as it is, also with a blank more between two letters."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = replaced(
        text, (r"[ \t]{2,}|\t", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"(?U)\s+([,.;:!?])", "$1"), (r"(?U)([,.;:!?])(?=\S)", "$1 ")
    )
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def phrases_repaired(text: Column) -> Column:
    """Known glued phrases written out; one look tells the texts that have none."""
    low = text  # the letters beside ASCII that (?iU) takes for ASCII ones are replaced
    for other, letter in zip("\u017f\u0131\u0130\u212a", "siik"):
        low = F.replace(low, F.lit(other), F.lit(letter))
    low = F.lower(low)
    some = evaluated_once(low, lambda x: functools.reduce(operator.or_, [F.contains(x, F.lit(p)) for p in PHRASE_PARTS]))
    return F.when(some, replaced(text, *[("(?iU)" + p, by) for p, by in PHRASE_RULES])).otherwise(text)


def mostly_upper(text: Column) -> Column:
    """At least 12 letters of which 72 % are their own upper case."""
    counts = F.struct(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).alias("letters"), F.length(F.regexp_replace(text, r"[^\p{L}]+|\p{Ll}+", "")).alias("upper"))
    return evaluated_once(counts, lambda n: (n["letters"] >= 12) & (n["upper"] / n["letters"] >= 0.72))


def file_name(text: Column) -> Column:
    """Without characters that file names may not hold."""
    return F.regexp_replace(text, r'[\\/*?:"<>|]', "")


def quality_log(text: Column) -> Column:
    """Quality ladder of text logs: diversity, repetition, third_person, marks, score, reason (null: passed)."""

    def ladder(ws: Column) -> Column:
        n = F.size(ws)
        long, narrative = n >= 10, n >= 50
        return F.struct(
            n.alias("n_words"),
            F.when(long, lexical_diversity(ws)).otherwise(0.0).alias("diversity"),
            F.when(long, phrase_repetition(ws)).otherwise(0).alias("repetition"),
            F.when(narrative, third_person_ratio(ws)).otherwise(0.0).alias("third_person"),
            F.when(narrative, narrative_marks(text)).otherwise(0).alias("marks"),
        )

    def judged(m: Column) -> Column:
        told = F.greatest(F.lit(0.0), 1 - m["third_person"] / 0.3) * F.greatest(F.lit(0.0), 1 - m["marks"] / 3)
        score = (
            F.when(m["diversity"] > 0, 0.5 * F.least(F.lit(1.0), m["diversity"] / 0.4)).otherwise(0.0)
            + 0.3 * F.greatest(F.lit(0.0), 1 - m["repetition"] / 5)
            + 0.2 * told
        )
        reason = (
            F.when(m["n_words"] == 0, "insufficient_words")
            .when((m["n_words"] >= 10) & (m["diversity"] < 0.4), "low_lexical_diversity")
            .when(m["repetition"] > 5, "excessive_phrase_repetition")
            .when(m["third_person"] > 0.3, "high_third_person_ratio")
            .when(m["marks"] > 3, "narrative_detected")
            .when(score < 0.5, "low_quality_score")
        )
        fields = [m[k].alias(k) for k in ("n_words", "diversity", "repetition", "third_person", "marks")]
        return F.struct(*fields, F.least(F.lit(1.0), score).alias("score"), reason.alias("reason"))

    return evaluated_once(evaluated_once(words(text), ladder), judged)


def quality_export(text: Column) -> Column:
    """Quality ladder of JSON exports: n_words, diversity, repetition, third_person, marks, score, reason (null: passed).

    The score is a product: each of diversity, repetition and narration takes its part away.
    """
    whole = F.coalesce(text, F.lit(""))

    def measured(ws: Column) -> Column:
        n = F.size(ws)
        loops = evaluated_once(sentence_repetition(whole), lambda r: F.when(r >= 2, r).otherwise(0))
        return F.struct(
            n.alias("n_words"),
            F.when(n >= 10, lexical_diversity(ws)).otherwise(0.0).alias("diversity"),
            F.when(n >= 10, loops).otherwise(0).alias("repetition"),
            F.when(n >= 50, third_person_ratio(ws, PRONOUNS_EXPORT)).otherwise(0.0).alias("third_person"),
            F.when(n >= 50, story_phrases(whole)).otherwise(0).alias("marks"),
        )

    def judged(m: Column) -> Column:
        up_to = lambda k, most: F.least(m[k] / most, F.lit(1.0))
        varied = F.when(m["diversity"] > 0, 0.6 + 0.4 * up_to("diversity", 0.4)).otherwise(1.0)
        fresh = F.when(m["repetition"] > 2, 1 - 0.3 * up_to("repetition", 5)).otherwise(1.0)
        told = F.when(m["third_person"] > 0.1, 0.15 * up_to("third_person", 0.3)).otherwise(0.0) + F.when(m["marks"] > 0, 0.15 * up_to("marks", 3)).otherwise(0.0)
        score = varied * fresh * (1 - told)
        reason = (
            F.when(F.length(F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")) < 2, "too_short")
            .when(F.length(whole) > 2000, "too_long")
            .when(m["n_words"] < 1, "insufficient_words")
            .when((m["n_words"] >= 10) & (m["diversity"] < 0.4), "low_lexical_diversity")
            .when(m["repetition"] > 5, "excessive_repetition")
            .when(m["third_person"] > 0.3, "high_third_person")
            .when(m["marks"] > 3, "narrative_detected")
            .when(score < 0.5, "low_quality_score")
        )
        return F.struct(*[m[k].alias(k) for k in ("n_words", "diversity", "repetition", "third_person", "marks")], score.alias("score"), reason.alias("reason"))

    return evaluated_once(evaluated_once(words(whole), measured), judged)
