"""Personal data by weak supervision, in DataFrame expressions only.

Base spans come from four fixed patterns with checks and always stay.  Further
candidates (obfuscated mail addresses, national phone numbers, social security numbers, bank accounts and
names) are voted on by regex, gazetteer and context labelers.  Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is; the
posteriors train a logistic span classifier, whose weights become one
expression over the candidates of a row.  Nothing is shuffled but vote counts.

Patterns are written with possessive and anchored forms of equal language, so
that very long texts take linear time and no deep recursion.  Null and empty texts
have no spans.  Repeated rows give equal results; empty tables give empty
results; all columns pass through, and those named like an appended one are replaced."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipsift.llm.common import weighted_sample
from dipsift.operators.lineage import materialise

KINDS = ("email", "ip", "card", "phone")
MORE = ("email_obfuscated", "phone_national", "ssn", "iban", "name")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # A run of local characters can only match from its start, or from where the last match ended in it.
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Maximal runs; those of less than 12 digits would be dropped anyway.
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": PATTERNS["card"], "phone": r"\+[0-9]"}
# Common given names and titles.
NAMES = ("Anna", "Ana", "Antonio", "Carlos", "Carmen", "Charles", "Claire", "David", "Elena", "Elizabeth", "Emma", "Hans", "Isabel", "James",
         "Jean", "Jennifer", "John", "José", "Juan", "Julia", "Karl", "Laura", "Linda", "Louis", "Luis", "Marie", "Maria", "María", "Mary",
         "Michael", "Nicolas", "Patricia", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sophie", "Stefan", "Susan", "Thomas", "William", "Wolfgang")
TITLES = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur")
# Words that speak for or against personal data when they stand before it.
FOR_WORDS = ("phone", "tel", "telephone", "call", "mobile", "fax", "mail", "email", "contact", "reach", "ssn", "social", "iban", "account", "name",
             "signed", "dear", "telefon", "anruf", "konto", "nombre", "llamar", "correo", "cuenta", "nom", "appeler", "courriel", "compte")
AGAINST_WORDS = ("order", "invoice", "version", "isbn", "issn", "page", "figure", "section", "build", "model", "part", "article", "chapter", "total", "port")
CANDIDATE = "|".join((
    rf"(?<!{_LOCAL}){_LOCAL}{{2,64}}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{{2,63}}+(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z]{{2,24}}+)++",
    r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    rf"(?<![A-Za-z])(?:(?:{'|'.join(TITLES)})\.?\x20)?(?:{'|'.join(NAMES)})\x20[A-Z][a-z]{{2,30}}+",
))
BLOCK = 512  # hits of a text that are gathered in one array; changes the cost alone
LABELERS = ("regex", "gazetteer", "context", "counter_context", "shape", "edges")
FEATURES = tuple(f"is_{k}" for k in MORE) + LABELERS + ("log_length", "digit_share", "upper_share", "blank_share")


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def blocks(items: Column) -> Column:
    """The items of an array in arrays of up to ``BLOCK``, at least one of them."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / BLOCK), F.lit(0)).cast("int")),
                                            lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK))))


def gathered(items: Column, start: Column, step) -> Column:
    """What ``step(state, item)`` gives for the items in order: it returns the next state, whether to keep, and what.

    An array that grows is copied at every item, so arrays grow within blocks, and the blocks are put together."""
    def one(state, item):
        after, keep, what = step(state, item)
        return after, F.struct(keep.alias("keep"), what.alias("item"))

    def within(state, item):
        after, got = one(state["at"], item)
        return F.struct(after.alias("at"), F.array_append(state["found"], got).alias("found"))

    def whole(some, none):
        def across(state, block):
            return F.aggregate(block, F.struct(state["at"].alias("at"), none.alias("found")), within,
                               lambda s: F.struct(s["at"].alias("at"), F.array_append(state["found"], s["found"]).alias("found")))
        first = F.struct(start.alias("at"), F.slice(F.array(none), 1, 0).alias("found"))
        return F.aggregate(blocks(some), first, across, lambda s: F.flatten(s["found"]))
    # ``none`` is an empty array of the results' type.
    found = let(items, lambda some: let(F.transform(F.slice(some, 1, 0), lambda item: one(start, item)[1]), lambda none: whole(some, none)))
    return F.transform(F.filter(found, lambda x: x["keep"]), lambda x: x["item"])


def spans_of(text: Column, pattern: str, guard: Column, value, keep=lambda hit: F.lit(True), left: int = 0) -> Column:
    """Array of ``value(hit, start, end, before, after)`` for each match with ``keep(hit)``.

    Pieces between matches and the matches alternate, so their lengths add up to the places.
    ``before``: up to ``left`` characters in front, carried along from piece to piece; ``after``: the next character, if any."""
    def pairs_of(gaps, hits):
        return F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.size(gaps)).alias("next_gap"), F.slice(hits, 2, F.size(hits)).alias("next_hit"))

    def step(state, pair):
        hit = pair["hit"]
        begin = state["place"] + F.length(pair["gap"])
        end = begin + F.coalesce(F.length(hit), F.lit(0))
        before = F.right(F.concat(state["tail"], pair["gap"]), F.lit(left)) if left else F.lit("")
        tail = F.right(F.concat(before, F.coalesce(hit, F.lit(""))), F.lit(left)) if left else F.lit("")
        after = F.left(F.concat(F.coalesce(pair["next_gap"], F.lit("")), F.coalesce(pair["next_hit"], F.lit(""))), F.lit(1))
        return F.struct(end.alias("place"), tail.alias("tail")), hit.isNotNull() & keep(hit), value(hit, begin, end, before, after)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(F.split(text, pattern, -1), lambda gaps: let(hits, lambda x: gathered(
        pairs_of(gaps, x), F.struct(F.lit(0).alias("place"), F.lit("").alias("tail")), step)))
    none = F.transform(F.slice(F.array(F.lit(0)), 1, 0), lambda k: value(F.lit(""), k, k, F.lit(""), F.lit("")))
    return F.when(guard, found).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", ""))


def _ok(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(_digits(hit).between(12, 19), F.call_function("luhn_check", F.regexp_replace(hit, "[^0-9]", ""))).otherwise(False)
    if kind == "phone":
        return _digits(hit).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, rank, end): code points, end exclusive, rank in ``KINDS``."""
    parts = []
    for rank, kind in enumerate(KINDS):
        guard = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GUARDS[kind])
        parts.append(spans_of(text, PATTERNS[kind], F.coalesce(guard, F.lit(False)), lambda hit, start, end, before, after, r=rank: F.struct(
            start.alias("start"), F.lit(r).alias("rank"), end.alias("end")), keep=lambda hit, k=kind: _ok(k, hit)))
    return F.array_sort(F.concat(*parts))


def _kind(hit: Column) -> Column:
    return (F.when(hit.rlike(r"[\[(]\x20?at\x20?[\])]"), 0).when(hit.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 2)
            .when(hit.rlike("^[A-Z]{2}[0-9]{2}"), 3).when(hit.rlike(r"^[(0-9]"), 1).otherwise(4))


def _word_in(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(rf"(?i)(?<![\p{{L}}])(?:{'|'.join(words)})(?![\p{{L}}])")


def candidates(text: Column) -> Column:
    """Array of candidate structs: place, kind, votes of the labelers (-1, 0, 1) and shape features."""
    def value(hit, start, end, before, after):
        kind = _kind(hit)
        digits = F.regexp_replace(hit, "[^0-9]", "")
        length = F.greatest(F.length(hit), F.lit(1))
        votes = {
            "regex": F.when(kind == 2, F.when(hit.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), 1).otherwise(-1))
                     .when(kind == 1, F.when(digits.rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1)).when(kind == 4, 0).otherwise(1),
            "gazetteer": F.when(_word_in(hit, NAMES + TITLES) | hit.rlike("(?i)(?:gmail|yahoo|outlook|example)"), 1).otherwise(0),
            "context": F.when(_word_in(before, FOR_WORDS), 1).otherwise(0),
            "counter_context": F.when(_word_in(before, AGAINST_WORDS), -1).otherwise(0),
            "shape": F.when(digits.rlike(r"^([0-9])\1+$|0123456|1234567"), -1).otherwise(0),
            "edges": F.when(after.rlike(r"[\p{L}0-9_=/#]"), -1).otherwise(1),
        }
        shape = {"log_length": F.log(length.cast("double")), "digit_share": F.length(digits) / length,
                 "upper_share": F.length(F.regexp_replace(hit, r"[^\p{Lu}]", "")) / length,
                 "blank_share": F.length(F.regexp_replace(hit, r"[^\x20]", "")) / length}
        return F.struct(start.alias("start"), (kind + len(KINDS)).cast("int").alias("rank"), end.alias("end"),
                        *[votes[x].cast("int").alias(x) for x in LABELERS],
                        *[shape[x].cast("double").alias(x) for x in FEATURES if x in shape])
    return spans_of(text, CANDIDATE, F.coalesce(text.rlike(CANDIDATE), F.lit(False)), value, left=40)


@dataclass
class SpanModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -1.0
    reliability: dict[str, float] = field(default_factory=dict)


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50, strength: float = 20.0) -> tuple[list[float], dict[str, float]]:
    """Expectation-maximisation for two classes and independent labelers.

    ``counts`` has each vote pattern once (at most 3 ** labelers rows, however large the
    corpus).  Gives the posterior of each pattern and, for each labeler, how often a
    vote of it is right.  ``strength`` votes of the assumed table keep rare labelers from turning over."""
    votes = (-1, 0, 1)
    prior = 0.5
    first = {(v, y): (0.6 if v == (1 if y else -1) else 0.1 if v == (-1 if y else 1) else 0.3) for v in votes for y in (0, 1)}
    table = [dict(first) for _ in LABELERS]
    posterior = [0.5] * len(counts)
    total = sum(n for _, n in counts)
    for _ in range(rounds):
        for k, (pattern, _) in enumerate(counts):
            log = [math.log(1 - prior), math.log(prior)]
            for j, v in enumerate(pattern):
                for y in (0, 1):
                    log[y] += math.log(table[j][v, y])
            posterior[k] = 1 / (1 + math.exp(max(-60.0, min(60.0, log[0] - log[1]))))
        mass = [sum(n * (p if y else 1 - p) for (_, n), p in zip(counts, posterior)) for y in (0, 1)]
        prior = (mass[1] + strength / 2) / (total + strength)
        for j in range(len(LABELERS)):
            for y in (0, 1):
                for v in votes:
                    got = sum(n * (p if y else 1 - p) for (x, n), p in zip(counts, posterior) if x[j] == v)
                    table[j][v, y] = (got + strength * first[v, y]) / (mass[y] + strength)
    right = {}
    for j, name in enumerate(LABELERS):
        good = sum(n * p for (x, n), p in zip(counts, posterior) if x[j] == 1) + sum(n * (1 - p) for (x, n), p in zip(counts, posterior) if x[j] == -1)
        right[name] = good / max(1, sum(n for x, n in counts if x[j]))
    return posterior, right


def fit(docs: DataFrame, text: str = "text", per_kind: int = 20_000) -> SpanModel:
    """Learn from the candidates of all rows; the classifier is fitted on at most about
    ``per_kind`` candidates of each kind (a bounded sample; the bound is this parameter), alike ones as
    one row with a weight."""
    found = docs.select(F.explode(candidates(F.col(text))).alias("c")).select("c.*")
    found = materialise(found, "candidates")
    counts = [(tuple(r[x] for x in LABELERS), r["n"]) for r in found.groupBy(*LABELERS).agg(F.count(F.lit(1)).alias("n")).orderBy(*LABELERS).collect()]
    if not counts:
        return SpanModel()
    posterior, right = estimate(counts)
    label = F.lit(0.0)
    for (pattern, _), p in zip(counts, posterior):
        label = F.when(F.concat_ws(",", *LABELERS) == ",".join(map(str, pattern)), F.lit(p)).otherwise(label)
    rows = weighted_sample(found, [c for c in found.columns if c not in ("start", "end", "rank")], "rank", per_kind, 3)
    rows = rows.withColumnRenamed("weight", "times").withColumn("p", label)
    for k, kind in enumerate(MORE):
        rows = rows.withColumn(f"is_{kind}", (F.col("rank") == k + len(KINDS)).cast("double"))
    soft = rows.select(*FEATURES, F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("p") * F.col("times")).alias("weight")),
                                                    F.struct(F.lit(0.0).alias("label"), ((1 - F.col("p")) * F.col("times")).alias("weight")))).alias("y"))
    soft = soft.select(*FEATURES, "y.label", "y.weight").where("weight > 1e-6")
    if soft.agg(F.countDistinct("label")).first()[0] < 2:
        only = soft.first()
        return SpanModel({}, 1.0 if only and only["label"] == 1.0 else -1.0, right)
    model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=50).fit(
        VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(soft))
    return SpanModel(dict(zip(FEATURES, map(float, model.coefficients))), float(model.intercept), right)


def added_spans(text: Column, base: Column, model: SpanModel) -> Column:
    """Candidates that the classifier accepts and that overlap no base span."""
    def logit(c):
        total = F.lit(model.bias)
        for name, weight in model.weights.items():
            value = (c["rank"] == len(KINDS) + MORE.index(name[3:])).cast("double") if name.startswith("is_") else c[name].cast("double")
            total = total + F.lit(weight) * value
        return total
    kept = F.transform(F.filter(candidates(text), lambda c: logit(c) >= 0),
                       lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end")))
    return let(kept, lambda some: F.when((F.size(some) == 0) | (F.size(base) == 0), some).otherwise(apart(some, base)))


def apart(some: Column, base: Column) -> Column:
    """The spans of ``some`` that overlap none of ``base``: one pass by start against the farthest end so
    far, one from the right against the nearest start."""
    def forward(far, s):
        own = s["rank"] < len(KINDS)
        return F.when(own, F.greatest(far, s["end"])).otherwise(far), own | (far <= s["start"]), s

    def backward(near, s):
        own = s["rank"] < len(KINDS)
        return F.when(own, s["start"]).otherwise(near), ~own & (near >= s["end"]), s
    # Of spans with one start, those of the base come first, by their rank.
    left = gathered(F.array_sort(F.concat(base, some)), F.lit(0), forward)
    return F.reverse(gathered(F.reverse(left), F.lit(2 ** 31 - 1), backward))


def find(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """Append ``base`` and ``spans``: sorted arrays of (start, rank, end)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("base", "spans")]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*rest, base_spans(whole).alias("base"))
    return rows.select(*rest, "base", F.array_sort(F.concat("base", added_spans(whole, F.col("base"), model))).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    rank = (KINDS + MORE).index(kind)
    # One parameter: Spark passes a second one the position, also where it has a default.
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS + MORE])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS + MORE])
    nothing = F.slice(F.array(F.lit("")), 1, 0)

    def across(state, block):
        # A block's own stretch of the text, so that no span makes the whole text be walked through.
        end = F.greatest(state["at"], F.array_max(F.transform(block, lambda s: s["end"])))

        def within(piece):
            def step(inner, s):
                skip = s["start"] < inner["at"]
                part = F.when(skip, F.lit("")).otherwise(F.concat(
                    F.substring(piece, inner["at"] - state["at"] + 1, s["start"] - inner["at"]), F.element_at(names, s["rank"] + 1)))
                return F.struct(F.greatest(inner["at"], s["end"]).alias("at"), F.array_append(inner["parts"], part).alias("parts"))
            return F.aggregate(block, F.struct(state["at"].alias("at"), nothing.alias("parts")), step, lambda s: F.array_join(s["parts"], ""))
        part = let(F.substring(text, state["at"] + 1, end - state["at"]), within)
        return F.struct(end.alias("at"), F.array_append(state["parts"], part).alias("parts"))
    whole = F.aggregate(blocks(spans), F.struct(F.lit(0).alias("at"), nothing.alias("parts")), across,
                        lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
