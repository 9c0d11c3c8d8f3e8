"""Personal data spans: exact base patterns, and candidates accepted by boosted trees. DataFrame functions only.

Base kinds are matched as fixed patterns with checks. High-recall generators propose further, overlapping spans
(obfuscated and spelled-out addresses, national phone numbers, other card forms, whole and shortened IPv6 addresses,
values of secrets); boosted trees over format and the context on both sides score them, a threshold calibrated for
precision on held-out examples selects, and the best of overlapping spans stays. The trees are fitted on examples that the module writes itself (TRAIN of them, from a fixed seed), through the
same feature columns that score documents.
Everything is one narrow projection: no shuffle, and texts without a kind's trigger cost one scan for it.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.trees import Path, boost, condition

KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
# The base patterns as the contract gives them, bounded so that a scan stays linear in the text: a match may begin
# only where a run begins or the last match ended, and a chain of digits is matched only if its length can pass.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRIGGER = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
# Generators: kind, trigger, pattern.
GENERATORS = (
    ("email", r"(?i)[\[(]\x20?at\x20?[\])]|\x20dot\x20|[\[(]\x20?dot\x20?[\])]",
     r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,4}+"),
    ("phone", r"[0-9][)\x20.-]\x20?[0-9]{3}",
     r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])"),
    ("card", r"[0-9]{4}[\x20.-]?[0-9]{4}",
     r"(?<![0-9.])(?<![0-9][\x20-])(?:[0-9]{4}(?:\.[0-9]{4}){3}|[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|[0-9]{13})(?![\x20.-]?[0-9])"),
    ("ip", r"(?i)[0-9a-f]:[0-9a-f]{1,4}:", r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:.])"),
    ("ip", r"(?i)[0-9a-f]::[0-9a-f]", r"(?i)(?<![0-9a-z:._])(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}(?![0-9a-z:_])"),
    ("secret", r"(?i)(?:token|secret|passwor|(?:api|access|private)[_\x20-]?key)[\x22']?\x20?[:=]|AKIA[0-9A-Z]|gh[pousr]_|\bsk-|xox[abp]-",
     r"(?i)(?<=(?:token|secret|password|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key)[\x22']{0,1}\x20{0,2}[:=]\x20{0,2}[\x22']{0,1})[A-Za-z0-9+/_=.-]{8,}+"
     r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abp]-[A-Za-z0-9-]{10,}+)"),
)
_FEW = r"(?:[^\p{L}\p{N}]+\p{L}+){0,4}[^\p{L}\p{N}]*"  # up to four words between a cue and the span
CUES = {
    "phone_cue": r"(?i)(?:\btel|phone|\bcall|\bfax|mobile|\bcell|telefon|portable|\bring|\bdial|\btext|reach|anruf|llam)\p{L}*" + _FEW + "$",
    "card_cue": r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta)[^0-9]{0,12}$",
    "mail_cue": r"(?i)(?:mail|contact|write|reach|correo|courriel)\p{L}*" + _FEW + "$",
    "code_cue": r"(?i)(?:isbn|order|ref|\bno|\bid|sku|version|page|serial|tracking|invoice|part|lot|item)\p{L}*[^\p{L}\p{N}]{0,3}$",
}
AFTER = {
    "phone_after": r"(?i)^[^\p{L}\p{N}]{0,3}(?:\p{L}+[^\p{L}\p{N}]+){0,3}(?:phone|mobile|\bcell|\btel|\bfax|\bext|\bcall|voicemail|whatsapp)",
    "count_after": r"(?i)^[^\p{L}\p{N}]{0,2}(?:units|pages|items|copies|pieces|euros?|dollars|km|kg|people|times|points|stock|boxes)",
}
ENDING = r"(?i)(?:\.|dot\W{0,2}\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|ch|at|nl)$"
BEFORE, BEYOND = 48, 32  # code points of context
TRAIN, TREES, DEPTH, SEED, PRECISION = 4800, 16, 3, 2, 0.98
FEATURES = ("kind", "chars", "digits", "letters", "marks", "luhn", "brackets", "dots", "joined_at", "ending", "doubled", "area", *CUES, *AFTER)
_BLOCK, _PART = 256, 4096  # spans folded at once; code points of a piece of text


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, zero: Column, step, kind: str) -> Column:
    """The states after each item, from zero on: an array of kind. Blocks keep the copying small."""
    none = F.array().cast(f"array<{kind}>")

    def after(acc: Column, x: Column) -> Column:
        return _let(step(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))

    def folded(items: Column) -> Column:
        def block(acc: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(acc["at"].alias("at"), none.alias("out")), after)
            return _let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / _BLOCK).cast("int"))
        start = F.struct(zero.cast(kind).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(blocks, start, block, lambda a: F.flatten(a["out"]))

    return _let(items, folded)


def _starts(gaps: Column, sizes: Column) -> Column:
    """Running starts: sum of gaps up to and with each, and sizes before it."""
    steps = F.zip_with(gaps, sizes, lambda g, n: g + n)
    return F.zip_with(_scan(steps, F.lit(0), lambda at, x: at + x, "int"), sizes, lambda end, n: end - n)


SPAN = "array<struct<start:int,end:int,m:string>>"


def matches(text: Column, pattern: str, trigger: str) -> Column:
    """Leftmost non-overlapping matches in code points: an array of start, end (exclusive) and m, the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))

    def spans(m: Column) -> Column:
        sizes = F.transform(m, lambda x: F.length(x))
        starts = _starts(F.slice(gaps, F.lit(1), F.size(m)), sizes)
        return F.zip_with(starts, m, lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), x.alias("m")))

    none = F.array().cast(SPAN)
    some = _let(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))
    return F.when(F.rlike(text, F.lit(trigger)), some).otherwise(none)


def _parts(text: Column) -> Column:
    """text in parts of _PART code points: places in it are found without counting from its start."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _PART).cast("int")), lambda i: F.substring(text, i * _PART + 1, F.lit(_PART)))


def _between(parts: Column, a: Column, b: Column) -> Column:
    """Code points a to b of the text that parts hold."""
    i, j = F.floor(a / _PART).cast("int"), F.floor(b / _PART).cast("int")
    head = F.substring(F.get(parts, i), a % _PART + 1, F.when(i == j, b - a).otherwise(_PART))
    return F.when(i == j, head).otherwise(F.concat(head, F.array_join(F.slice(parts, i + 2, j - i - 1), ""), F.substring(F.get(parts, j), F.lit(1), b % _PART)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        v = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        return F.when(i % 2 == 1, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda a, i: a + value(i))
    return total % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        whole = F.transform(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(whole, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a base kind that pass its check."""
    return F.filter(matches(text, BASE[kind], TRIGGER[kind]), lambda s: _passes(kind, s["m"]))


def _features(kind: Column, m: Column, before: Column, after: Column) -> list[Column]:
    digits = _digits(m)
    told = lambda x, p: F.rlike(x, F.lit(p)).cast("double")
    out = [
        kind.cast("double").alias("kind"),
        F.length(m).cast("double").alias("chars"),
        F.length(digits).cast("double").alias("digits"),
        F.length(F.regexp_replace(m, "[^\\p{L}]", "")).cast("double").alias("letters"),
        F.length(F.regexp_replace(m, "[\\p{L}\\p{N}]", "")).cast("double").alias("marks"),
        F.when(F.length(digits) > 1, luhn(digits)).otherwise(False).cast("double").alias("luhn"),
        F.length(F.regexp_replace(m, "[^\\[\\](){}]", "")).cast("double").alias("brackets"),
        F.length(F.regexp_replace(m, "[^.]", "")).cast("double").alias("dots"),
        told(m, "(?i)\\x20at\\x20").alias("joined_at"),
        told(m, ENDING).alias("ending"),
        told(m, "::").alias("doubled"),
        told(m, r"^(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}$").alias("area"),
    ]
    return out + [told(before, p).alias(k) for k, p in CUES.items()] + [told(after, p).alias(k) for k, p in AFTER.items()]


def candidates(text: Column) -> Column:
    """Spans that the generators propose, with their features."""

    def named(kind: str, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(EVERY.index(kind)).alias("kind"), s["m"].alias("m")))

    def one(whole: Column, s: Column) -> Column:
        before = _between(whole["parts"], F.greatest(s["start"] - BEFORE, F.lit(0)), s["start"])
        after = _between(whole["parts"], s["end"], F.least(s["end"] + BEYOND, whole["size"]))
        beside = F.struct(before.alias("before"), after.alias("after"))
        return _let(beside, lambda b: F.struct(s["start"].alias("start"), s["end"].alias("end"), *_features(s["kind"], s["m"], b["before"], b["after"])))

    def featured(found: Column) -> Column:
        """The found spans with features; the text is cut into parts, and measured, only where there are some."""
        whole = F.when(F.size(found) > 0, F.struct(_parts(text).alias("parts"), F.length(text).alias("size")))
        return _let(whole, lambda w: F.transform(found, lambda s: one(w, s)))

    return _let(F.concat(*[named(kind, matches(text, pattern, trigger)) for kind, trigger, pattern in GENERATORS]), featured)


Model = tuple[float, list[tuple[Path, float]], float]


def score(model: Model, of) -> Column:
    """Margin of the boosted trees; of gives a feature's column. Terms are added in pairs, so that the sum stays flat."""
    terms = [F.lit(model[0]), *[F.when(condition(path, of), value).otherwise(0.0) for path, value in model[1]]]
    while len(terms) > 1:
        terms = [sum(terms[i + 1 : i + 2], terms[i]) for i in range(0, len(terms), 2)]
    return terms[0]


def examples(number: int = TRAIN, seed: int = SEED) -> list[tuple[str, int]]:
    """Texts with one proposed span each, and whether it is personal data."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randint(3, 9)))

    def carded(lengths: tuple[int, ...], sep: str, good: bool) -> str:
        body = r.choice("3456") + digits(sum(lengths) - 2)
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        check = (-total) % 10
        body += str(check if good else (check + r.randint(1, 9)) % 10)
        cut = [sum(lengths[:i]) for i in range(len(lengths) + 1)]
        return sep.join(body[a:b] for a, b in zip(cut, cut[1:]))

    some = lambda n: " ".join(word() for _ in range(n))
    near = lambda cues: f"{r.choice(cues)} {some(r.randint(0, 3))}".strip() + r.choice([" ", ": "])
    out = []
    for _ in range(number):
        good, form = r.random() < 0.5, r.randrange(8)
        cue, tail = "", ""
        if form == 0:
            if good:
                at, dot = r.choice([(" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), (" at ", " dot "), (" at ", " dot ")])
                m = f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"
            else:
                m = r.choice([f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot {word()}", f"{word()} at {word()} dot {word()} dot {word()}"])
            cue = near(["mail", "contact", "write to", "reach me"]) if good and r.random() < 0.6 else r.choice(["", "arrived ", "we met ", "the dot "])
        elif form in (1, 2, 3):
            sep = r.choice(" .-")
            m = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", f"0{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", f"0{digits(2)}{sep}{digits(4)}{sep}{digits(4)}"])
            asked = ["tel", "phone", "call me at", "call", "fax", "mobile", "ring", "telefon", "reach us on", "text"]
            if good and r.random() < 0.8:
                cue = near(asked)
            elif good:
                cue, tail = some(2) + " ", r.choice([" by phone", " on her mobile", " (cell)", " is my phone", " ext 12"])
            else:
                m = r.choice([m, f"{digits(r.randint(2, 5))}{sep}{digits(r.randint(3, 4))}{sep}{digits(r.randint(3, 4))}"])
                cue = r.choice(["order ", "ref ", "part no ", "isbn ", "lot ", "item ", some(5) + " ", some(6) + " "])
                tail = r.choice(["", "", " units", " pages", " items", " in stock"])
        elif form == 4:
            lengths, sep = r.choice([((4, 4, 4, 4), "."), ((4, 6, 5), " "), ((4, 6, 5), "-"), ((15,), ""), ((13,), "")])
            m = carded(lengths, sep, good)
            cue = r.choice(["card ", "visa: ", "amex ", ""]) if good and len(lengths) > 1 else "card " if good else r.choice(["order ", "serial ", "tracking ", ""])
        elif form == 5:
            m = ":".join("".join(r.choice("0123456789abcdef") for _ in range(4 if good else r.randint(1, 2))) for _ in range(8))
            cue = r.choice(["address ", "host ", ""])
        elif form == 6:
            part = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
            if good:
                m = r.choice(["2001", "fe80", "2a02", "fd00", "2606"]) + "".join(f":{part(r.randint(1, 4))}" for _ in range(r.randint(0, 3))) + "::" + ":".join(part(r.randint(1, 4)) for _ in range(r.randint(1, 3)))
            else:
                m = r.choice([f"{''.join(r.choice('abcdef') for _ in range(r.randint(1, 4)))}::{''.join(r.choice('abcdef') for _ in range(r.randint(1, 4)))}", f"{r.randint(1, 99)}::{r.randint(1, 99)}", f"{r.randint(0, 23)}:{r.randint(10, 59)}::{r.randint(10, 59)}", f"{r.randint(1, 99)}::{r.randint(1, 99)}:{r.randint(1, 99)}"])
            cue = r.choice(["address ", "host ", ""]) if good else r.choice(["", "see ", "verse ", "at ", "from "])
        else:
            key = r.choice(["token", "secret", "password", "api_key", "api key", "access_key", "private-key"])
            mixed = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randint(16, 44)))
            m = r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), mixed, "ghp_" + mixed * 2]) if good else r.choice([word() + word(), f"{word()}_{word()}", f"{word()}-{word()}", f"{word()}.{word()}"])
            m = m if len(m) >= 8 else m + "required"
            quote = r.choice(["", '"', "'"])
            cue, tail = f"{key}{r.choice([' = ', '=', ': '])}{quote}", quote
        out.append((f"{word()} {word()} {cue}{m}{tail} {word()}.", int(good)))
    return out


def fit(spark: SparkSession, number: int = TRAIN, seed: int = SEED) -> Model:
    """Boosted trees and the margin at which precision on the held-out fifth of the examples reaches PRECISION."""
    import numpy as np

    rows = [(i, t, y) for i, (t, y) in enumerate(examples(number, seed))]
    texts = spark.createDataFrame(rows, "i int, t string, y int")
    got = texts.select("i", "y", F.explode(candidates(F.col("t"))).alias("c")).select("i", "y", "c.*").collect()
    got.sort(key=lambda r: (r["i"], r["kind"]))
    x, y = np.array([[r[k] for k in FEATURES] for r in got]), np.array([r["y"] for r in got], np.float64)
    held = np.array([r["i"] % 5 == 0 for r in got])
    start, trees = boost(x[~held], y[~held], list(FEATURES), TREES, DEPTH, 0.4, 24, seed)
    leaves = [leaf for tree in trees for leaf in tree]
    from loomline.llm.trees import holds

    margin = np.full(held.sum(), start)
    for path, value in leaves:
        margin[holds(x[held], list(FEATURES), path)] += value
    order = np.argsort(-margin, kind="stable")
    precision = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1)
    good = np.flatnonzero(precision >= PRECISION)
    cut = float(margin[order][good[-1]]) if len(good) else float("inf")
    return start, leaves, max(cut - 1e-9, 0.0)  # the columns add in another order


def _spans(text: Column, model: Model) -> dict[str, Column]:
    return {k: base_spans(text, k) for k in KINDS} | {"proposed": candidates(text)}


_ONE = "struct<start:int,end:int,kind:int,rank:double>"
_SWEEP = f"struct<wait:{_ONE},busy:int,done:{_ONE}>"


def _best(base: Column, good: Column) -> Column:
    """The candidates that stay, as kind, start, end: a sweep by start. A candidate waits until nothing more can
    overlap it; it goes if it overlaps a base span, or a candidate with a better rank while it waits."""
    own = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(None).cast("double").alias("rank")))
    others = F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["rank"].alias("rank")))
    never = F.lit(None).cast(_ONE)

    def step(at: Column, s: Column) -> Column:
        wait, is_base = at["wait"], s["rank"].isNull()
        over = F.coalesce(s["start"] < wait["end"], F.lit(False))
        late = ~is_base & (s["start"] < at["busy"])  # within a base span
        worse = ~is_base & over & (s["rank"] >= wait["rank"])
        new = F.when(is_base, never).when(late | worse, wait).otherwise(s)
        busy = F.when(is_base, F.greatest(at["busy"], s["end"])).otherwise(at["busy"])
        return F.struct(new.alias("wait"), busy.alias("busy"), F.when(~over & ~late, wait).alias("done")).cast(_SWEEP)

    zero = F.struct(never.alias("wait"), F.lit(0).alias("busy"), never.alias("done"))
    swept = _scan(F.array_sort(F.concat(own, others)), zero, step, _SWEEP)

    def ended(states: Column) -> Column:
        out = F.concat(F.transform(states, lambda t: t["done"]), F.array(F.element_at(states, -1)["wait"]))
        return F.transform(F.filter(out, lambda s: s.isNotNull()), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return _let(swept, ended)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, columns in keep, base (array of kind, start, end) and all (base and accepted candidates) of every row.

    Both arrays are ordered by kind as in EVERY, then start; kind is its place in EVERY. Candidates that overlap a
    base span, or a better candidate in the sweep by start, go.
    """
    model = model or fit(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col), *[F.col(k) for k in keep], *[c.alias(f"_{k}") for k, c in _spans(text, model).items()])

    def marked(kind: str) -> Column:
        place = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(F.col(f"_{kind}"), lambda s: F.struct(place, s["start"].alias("start"), s["end"].alias("end")))

    base = F.concat(*[marked(k) for k in KINDS])
    scored = F.transform(
        F.col("_proposed"),
        lambda c: F.struct((-score(model, lambda k: c[k])).alias("rank"), c["kind"].cast("int").alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
    )
    good = F.filter(scored, lambda c: -c["rank"] >= model[2])
    with_base = found.withColumn("base", base).withColumn("_good", good)
    every = F.when(F.size("_good") == 0, F.col("base")).otherwise(F.array_sort(F.concat(F.col("base"), _best(F.col("base"), F.col("_good")))))
    return with_base.select(F.col(id_col), *[F.col(k) for k in keep], "base", every.alias("all"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS])


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in EVERY])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (of these kinds), secrets (spans of
    secrets' values, joined likewise) and n_found (all of them) for every row.

    Null and empty texts have no spans. Rows with a null or repeated id are treated one by one. Other columns are
    ignored; an empty table gives an empty result.
    """
    got = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model=model)
    secret = lambda s: s["kind"] == EVERY.index("secret")
    return got.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.filter("all", lambda s: ~secret(s))).alias("spans"),
        joined(F.filter("all", secret)).alias("secrets"),
        F.size("all").cast("long").alias("n_found"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; null texts stay null.

    Columns may have any names: they travel in one column while spans are looked for.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(own.alias("own"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("long").alias("id"))
    got = spans(held, "id", "text", model, ("own", "text"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in EVERY])
    ordered = F.array_sort(F.transform(F.col("all"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col("text")

    def built(x: Column) -> Column:
        ends, parts = x["ends"], x["parts"]  # ends: the greatest end of the spans up to each
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        pieces = F.transform(x["ordered"], lambda s, i: F.when(s["start"] >= before(i), F.concat(_between(parts, before(i), s["start"]), F.get(names, s["kind"]))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), _between(parts, F.element_at(ends, -1), F.length(text)))

    ends = _scan(ordered, F.lit(0), lambda at, s: F.greatest(at, s["end"]), "int")
    built = _let(F.struct(ordered.alias("ordered"), ends.alias("ends"), _parts(text).alias("parts")), built)
    new = F.when(F.size("all") == 0, text).otherwise(built)
    return got.select(*[(new if c == text_col else F.col("own").getField(c)).alias(c) for c in docs.columns])
