"""Personal data by weak supervision, in DataFrame functions only.

Candidates are matches of four base patterns and of four loose ones (spelt-out addresses, numbers
without a country code, other separators). Five labelers vote +1, 0 or -1 on each: the pattern's own
validator, a gazetteer of cue words before the span, a gazetteer of words that speak against it, the
characters at its edges, and its shape. Expectation-maximisation over the counts of vote patterns
(a table of at most ``4 * 3**5 * 4`` rows, whatever the input) estimates each labeler's reliability per
class; a logistic span classifier is then fitted to the posteriors. A base match that passes its
validator always stays; another candidate is added where the classifier's probability exceeds
``threshold`` and it overlaps no base span.

Everything happens inside a row: documents are never shuffled. Offsets count code points.

Defined results: a null text is empty; a null ``doc_id`` stays null; repeated rows are scored one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Runs are taken possessively and may begin only where a run or the search does,
#: which finds the same matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|@| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold before a pattern is tried; every match of the pattern holds it.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]", "phone": r"[0-9]"}
LOOSE_NEEDS = NEEDS | {"email": r"(?:\(at\)|\[at\]|@| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{2}"}
CUES = {
    "email": r"(?:e-?mail|mailto|contact|write to|correo|courriel|schreib)\W*(?:\w+\W+)?$",
    "ip": r"(?:\bip|host|server|address|adresse|addr|client|peer)\W*(?:\w+\W+)?$",
    "card": r"(?:card|visa|mastercard|amex|karte|tarjeta|carte|credit)\W*(?:\w+\W+)?$",
    "phone": r"(?:phone|tel|call|mobile|fax|telefon|telefono|fono|cell)\W*(?:\w+\W+)?$",
}
AGAINST = r"(?:version|release|isbn|issn|doi|order|invoice|build|serial|section|chapter|figure|table|page)\W*(?:\w+\W+)?$"
SHAPES = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us)$",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}$|:",
    "card": r"^(?:[0-9]{4}[\x20._/-]?){3}[0-9]{1,7}$",
    "phone": r"[\x20().-]",
}
LABELERS = ("validator", "cue", "against", "edge", "shape")
REACH = 32
BLOCK = 128
THRESHOLD = 0.5
_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
_CAND = "array<struct<start:int,kind:int,end:int,base:boolean,votes:array<int>,size:int>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(parts: Column) -> Column:
    """struct(at: their length, tail: their last ``REACH`` characters, spans: of those that have a hit) of parts."""

    def step(acc, x):
        start, lead = acc["at"] + F.length(x["gap"]), F.right(F.concat(acc["tail"], x["gap"]), F.lit(REACH))
        hit = F.coalesce(x["hit"], F.lit(""))
        end = start + F.length(hit)
        after = F.left(F.concat(F.coalesce(x["gap_after"], F.lit("")), F.coalesce(x["hit_after"], F.lit(""))), F.lit(1))
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), lead.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), F.right(F.concat(lead, hit), F.lit(REACH)).alias("tail"), F.when(x["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(_SPAN).alias("spans")), step)


def matches(text: Column, pattern: str) -> Column:
    """start, end, value of every match, the ``REACH`` characters before it and the one after: split() and
    regexp_extract_all() find the same matches in turn.

    Appending copies an array, so offsets run within blocks of ``BLOCK`` matches, and the blocks' own
    offsets over the blocks: a text of many matches costs little more than in proportion to them."""
    two = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    rest = lambda x: F.slice(x, F.lit(2), F.size(x))
    parts = lambda x: F.arrays_zip(x["gap"].alias("gap"), x["hit"].alias("hit"), rest(x["gap"]).alias("gap_after"), rest(x["hit"]).alias("hit_after"))

    def joined(blocks):
        none = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<at:int,tail:string>>").alias("starts"))
        starts = F.aggregate(blocks, none, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), x["tail"].alias("tail"), F.concat(acc["starts"], F.array(F.struct(acc["at"].alias("at"), acc["tail"].alias("tail")))).alias("starts")), lambda acc: acc["starts"])

        def moved(x, by):
            return F.transform(x["spans"], lambda s: F.struct((s["start"] + by["at"]).alias("start"), (s["end"] + by["at"]).alias("end"), s["value"].alias("value"), F.when(F.length(s["before"]) < REACH, F.right(F.concat(by["tail"], s["before"]), F.lit(REACH))).otherwise(s["before"]).alias("before"), s["after"].alias("after")))

        return F.flatten(F.zip_with(blocks, starts, moved))

    def spans(parts):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: _running(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(parts) <= BLOCK, _running(parts)["spans"]).otherwise(_bound(blocks, joined))

    return _bound(two, lambda x: _bound(parts(x), spans))


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def step(acc, i):
        d = digits.substr(i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)
    return F.length(digits).between(14, 19) & (total % 10 == 0)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _labelled(kind: str, spans: Column, strict: bool) -> Column:
    """Candidates of one kind with their votes."""

    def one(x):
        value = x["value"]
        before, edge, after = F.lower(x["before"]), F.right(x["before"], F.lit(1)), x["after"]
        open_left = (x["start"] == 0) | ~edge.rlike(r"[\p{L}0-9_]")
        votes = F.array(
            F.when(valid(kind, value), 1).otherwise(-1) if strict else F.lit(0),
            F.when(before.rlike(CUES[kind]), 1).otherwise(0),
            F.when(before.rlike(AGAINST), -1).otherwise(0),
            F.when(open_left & ~after.rlike(r"[\p{L}0-9_]"), 1).otherwise(-1),
            F.when(value.rlike(SHAPES[kind]), 1).otherwise(-1),
        )
        size = F.least(F.floor(F.length(value) / 8), F.lit(3)).cast("int")
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), (valid(kind, value) if strict else F.lit(False)).alias("base"), votes.alias("votes"), size.alias("size"))

    return F.transform(spans, one)


def candidates(text: Column) -> Column:
    """All candidates of a text in order: base patterns, and loose ones clear of passing base spans."""
    none = F.array().cast(_CAND)
    strict = [F.when(text.rlike(NEEDS[k]), _labelled(k, matches(text, BASE[k]), True)).otherwise(none) for k in KINDS]
    loose = [F.when(text.rlike(LOOSE_NEEDS[k]), _labelled(k, matches(text, LOOSE[k]), False)).otherwise(none) for k in KINDS]
    return F.struct(F.concat(*strict).alias("strict"), F.concat(*loose).alias("loose"))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, strict, loose (arrays of candidates)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(text).alias("c"))
    out = out.select("doc_id", F.col("c.strict").alias("strict"), F.col("c.loose").alias("loose"))
    clear = F.filter("loose", lambda x: ~F.exists("strict", lambda b: b["base"] & (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.withColumn("loose", F.when(F.size("loose") > 0, clear).otherwise(F.col("loose")))


def fit(spans: DataFrame, rounds: int = 25) -> list[float]:
    """Weights of the span classifier: votes counted per pattern, reliabilities by EM, logistic fit to the posteriors."""
    rows = (
        spans.filter((F.size("strict") > 0) | (F.size("loose") > 0))
        .select(F.explode(F.concat("strict", "loose")).alias("x"))
        .groupBy(F.col("x.kind").alias("kind"), F.col("x.votes").alias("votes"), F.col("x.size").alias("size"))
        .count()
        .orderBy("kind", "votes", "size")
        .collect()
    )  # at most 4 * 3**5 * 4 rows
    cases = [(r["kind"], tuple(r["votes"]), r["size"], r["count"]) for r in rows]
    if not cases:
        return [0.0] * _width()
    posterior = reliabilities(cases, rounds)[0]
    return logistic([(features(k, v, s), n, p) for (k, v, s, n), p in zip(cases, posterior, strict=True)])


def reliabilities(cases, rounds: int = 25):
    """Dawid-Skene over (kind, votes, size, count): posterior of each case, and P(vote | class) of each labeler."""
    posterior = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for _, v, _, _ in cases]
    table: dict = {}
    for _ in range(rounds):
        mass, prior = {}, {}
        for (kind, votes, _, n), p in zip(cases, posterior, strict=True):
            for y, w in ((1, p * n), (0, (1 - p) * n)):
                prior[kind, y] = prior.get((kind, y), 1.0) + w
                for j, vote in enumerate(votes):
                    mass[j, vote, y] = mass.get((j, vote, y), 0.0) + w
        for j in range(len(LABELERS)):
            for y in (0, 1):
                total = sum(mass.get((j, v, y), 0.0) for v in (-1, 0, 1)) + 1.5
                for v in (-1, 0, 1):
                    table[j, v, y] = (mass.get((j, v, y), 0.0) + 0.5) / total
        for i, (kind, votes, _, _) in enumerate(cases):
            score = math.log(prior[kind, 1] / prior[kind, 0]) + sum(math.log(table[j, v, 1] / table[j, v, 0]) for j, v in enumerate(votes))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
    return posterior, table


def _width() -> int:
    return len(KINDS) + 3 * len(LABELERS) + 4


def features(kind: int, votes, size: int) -> list[int]:
    """Positions of the features that are on."""
    return [kind, *(len(KINDS) + 3 * j + v + 1 for j, v in enumerate(votes)), len(KINDS) + 3 * len(LABELERS) + size]


def logistic(cases, steps: int = 120, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Gradient descent on soft labels; cases: (features on, weight, probability)."""
    w, total = [0.0] * _width(), sum(n for _, n, _ in cases)
    for _ in range(steps):
        grad = [ridge * x for x in w]
        for on, n, p in cases:
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in on))))) - p) * n / total
            for i in on:
                grad[i] += miss
        w = [x - rate * g for x, g in zip(w, grad, strict=True)]
    return w


def probability(weights: list[float], x: Column) -> Column:
    """The classifier as an expression over a candidate."""
    table = F.array(*[F.lit(float(v)) for v in weights])
    at = [x["kind"], *(F.lit(len(KINDS) + 3 * j + 1) + x["votes"][j] for j in range(len(LABELERS))), F.lit(len(KINDS) + 3 * len(LABELERS)) + x["size"]]
    score = reduce(lambda a, b: a + b, [F.element_at(table, i + 1) for i in at])
    return 1 / (1 + F.exp(-score))


def label(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and added (arrays of candidates), for every row."""
    spans = found(docs)
    weights = fit(spans)
    return spans.select("doc_id", F.filter("strict", lambda x: x["base"]).alias("base"), F.filter("loose", lambda x: probability(weights, x) > threshold).alias("added"))


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each base span of the text replaced by its kind in angle brackets."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def hide(acc, x):
        new = F.concat(acc["out"], text.substr(acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.lit("<"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), F.lit(">"))
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), new.alias("out")))

    spans = F.array_sort(F.filter(candidates(text)["strict"], lambda x: x["base"]))
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), hide, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return docs.withColumn("text", F.when(F.col("text").isNull(), None).otherwise(done))
