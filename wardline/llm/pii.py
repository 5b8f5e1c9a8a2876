"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from the four base patterns and two looser ones. Five labelers
vote on each (rule, gazetteer, context, form, edges; 1, 0 or -1). Expectation
maximisation over the counts of vote patterns, of which there is a fixed number,
estimates how reliable each labeler is and how likely each pattern is a real span.
These probabilities are the soft labels of a logistic span classifier over features
of form and surroundings. Base spans that pass their checks always stay; other
candidates join if the classifier says so and they overlap no accepted span.

The patterns match what the plain ones match: possessive repetitions never need to
back off here, and a start inside a run is only tried where the last match ended, so
that long runs cost linear time.

Defined cases: a null or empty text has no spans; rows equal in id and text are
searched once and each get the result; positions are code points, the end exclusive;
an empty table fits the starting model and returns no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_key, unused

KINDS = ("email", "ip", "card", "phone", "number", "credential")
BASE = KINDS[:4]
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "credential": r"AKIA[0-9A-Z]{16}|\b(?i:password|passwd|token|secret|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9_/+-]{8,}\"?",
}
#: A text without this cannot match.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
CONTEXT_CHARS = 40
#: Fixed word lists of the gazetteer and context labelers.
DOMAINS = "com org net edu gov io de fr es uk eu info"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 63 64 65 66 81 82 84 86 90 91"
NEAR = {
    "email": "mail|write|contact|reach",
    "ip": "ip|host|server|address|login|client",
    "card": "card|visa|credit|payment|paid",
    "phone": "phone|call|tel|mobile|fax|dial",
    "number": "phone|call|tel|mobile|fax|dial",
    "credential": "key|login|access|auth|config",
}
AGAINST = "version|isbn|issn|invoice|order|section|chapter|page|figure|serial|example of"
VOTES = ("rule", "gazetteer", "context", "form", "edges")
ROUNDS, STEPS = 40, 300


def _matches(text: Column, kind: str) -> Column:
    """Array of (place, match, before, after) of one pattern; ``before`` reaches back to the last match."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind in NEEDS:
        found = F.when(text.contains(NEEDS[kind]), found)
    gaps = F.split(text, PATTERNS[kind])
    # the split runs only where something was found
    return F.when(
        F.size(found) > 0,
        F.transform(
            F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), F.slice(gaps, 2, F.size(found)).alias("h")),
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("place"), x["m"].alias("value"), F.length(x["g"]).alias("gap"),
                F.right(x["g"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(x["h"], F.lit(CONTEXT_CHARS)).alias("after"),
            ),
        ),
    )


def candidates(documents: DataFrame) -> DataFrame:
    """(key, kind, start, stop, value, before, after) of every match of every pattern."""
    text = F.col("text")
    rows = documents.filter("text is not null").select(text_key().alias("key"), F.explode(F.array(*[_matches(text, k) for k in KINDS])).alias("m"))
    rows = rows.filter("m is not null").select("key", F.explode("m").alias("m")).select("key", "m.*").dropDuplicates(["key", "kind", "place"])
    order = Window.partitionBy("key", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("value")).over(order)
    return rows.select("key", "kind", "place", "value", "before", "after", stop.alias("stop")).select(
        "key", "kind", (F.col("stop") - F.length("value")).alias("start"), "stop", "value", "before", "after"
    )


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits: every second digit from the right counts double, less 9 above 9."""
    rest = F.reverse(digits)
    place = lambda i: F.substr(rest, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + place(i) - F.when(place(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def base_check(kind: Column, value: Column) -> Column:
    digits = digits_of(value)
    n = F.length(digits)
    octets = F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", octets)
        .when(kind == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _sign(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def votes(spans: DataFrame) -> DataFrame:
    """``spans`` with ``base`` and a column for each labeler."""
    kind, value = F.col("kind"), F.col("value")
    digits, low = digits_of(value), F.lower(F.col("before"))
    listed = lambda words: [F.lit(w) for w in words.split()]
    ending = F.lower(F.regexp_extract(value, r"\.([A-Za-z0-9-]+)$", 1))
    code = F.array_contains(F.array(*listed(CALLING)), F.left(digits, F.lit(1))) | F.array_contains(F.array(*listed(CALLING)), F.left(digits, F.lit(2)))
    issuer = digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65|62)")
    gazetteer = (
        F.when(kind == "email", _sign(ending.isin(DOMAINS.split())))
        .when(kind == "ip", _sign(~value.rlike(r"^0*(?:0|10|127|255)\."), value.rlike(r"^0*(?:0|127|255)\.")))
        .when(kind == "card", _sign(issuer, ~issuer))
        .when(kind == "phone", _sign(code))
        .when(kind == "number", _sign(digits.rlike("^[2-9][0-9]{2}[2-9]"), digits.rlike("^[01]")))
        .otherwise(_sign(value.rlike("^AKIA|^(?i:password|passwd|secret|token|api_key)")))
    )
    near = F.lit(False)
    for k, words in NEAR.items():
        near = near | ((kind == k) & low.rlike(rf"\b(?:{words})\b"))
    form = (
        F.when(kind == "email", _sign(value.rlike("^[A-Za-z0-9]"), F.length(value) > 254))
        .when(kind == "ip", _sign(~value.rlike(r"(?:^|\.)0[0-9]"), value.rlike(r"(?:^|\.)0[0-9]")))
        .when(kind == "card", _sign(value.rlike(r"^[0-9]+$|^[0-9]{4}([ -])[0-9]{4,6}\1"), value.rlike("[ -].?[ -]")))
        .when(kind == "phone", _sign(value.rlike("[ ().-]"), value.rlike(r"[().-]{3,}")))
        .when(kind == "number", _sign(value.rlike(r"^\([0-9]{3}\)|^([0-9]{3})([.-])[0-9]{3}\2"), value.rlike(r"^[0-9]{3} [0-9]{3} ")))
        .otherwise(_sign(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), ~value.rlike("[0-9]")))
    )
    tight = F.col("before").rlike("[A-Za-z0-9]$") | F.col("after").rlike("^[A-Za-z0-9]")
    base = base_check(kind, value)
    return spans.withColumns({"base": base}).withColumns(
        {
            "rule": F.when(F.col("base"), 1).when(kind.isin("number", "credential"), 0).otherwise(-1),
            "gazetteer": gazetteer,
            "context": _sign(near, low.rlike(rf"\b(?:{AGAINST})\b")),
            "form": form,
            "edges": _sign(~tight, tight),
        }
    )


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict, dict]:
    """EM over (kind, votes, count): share of real spans per kind, and P(vote | real) per labeler.

    Returns the parameters and each pattern's probability to be a real span. A
    labeler starts out right four times out of five; counts of one smooth every estimate.
    """
    share = {k: 0.5 for k in KINDS}
    given = [{y: {v: (0.6 if v == (1 if y else -1) else 0.15 if v else 0.25) for v in (-1, 0, 1)} for y in (0, 1)} for _ in VOTES]
    real: dict = {}
    for _ in range(ROUNDS):
        for kind, vote, _n in patterns:
            logs = [math.log(share[kind] if y else 1 - share[kind]) + sum(math.log(given[i][y][v]) for i, v in enumerate(vote)) for y in (0, 1)]
            real[kind, vote] = 1 / (1 + math.exp(min(700.0, logs[0] - logs[1])))
        for kind in KINDS:
            own = [(real[k, v], n) for k, v, n in patterns if k == kind]
            share[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for i in range(len(VOTES)):
            for y in (0, 1):
                mass = {v: 2.0 if v == (1 if y else -1) else 1.0 for v in (-1, 0, 1)}
                for kind, vote, n in patterns:
                    mass[vote[i]] += n * (real[kind, vote] if y else 1 - real[kind, vote])
                given[i][y] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return {"share": share, "given": given}, real


def features() -> dict[str, Column]:
    """Indicators of a span's form and surroundings."""
    value, n = F.col("value"), F.length(digits_of(F.col("value")))
    out = {f"is_{k}": F.col("kind") == k for k in KINDS}
    out |= {
        "valid": F.col("base"),
        "long": F.length(value) > 16,
        "spaced": value.contains(" "),
        "bracketed": value.contains("("),
        "letters": value.rlike("[A-Za-z]"),
        "many_digits": n > 10,
        "digit_before": F.col("before").rlike("[0-9][ .-]?$"),
        "letter_before": F.col("before").rlike("[A-Za-z]$"),
        "word_after": F.col("after").rlike("^[ ,.;)]|^$"),
        "near": F.col("context") == 1,
        "against": F.col("context") == -1,
        "listed": F.col("gazetteer") == 1,
        "shaped": F.col("form") == 1,
        "odd": F.col("form") == -1,
    }
    return out


def fit_classifier(rows: list[tuple[tuple[bool, ...], float, int]], names: list[str]) -> dict[str, float]:
    """Logistic regression on distinct feature rows with soft labels and counts, by gradient steps."""
    weights, total = [0.0] * (len(names) + 1), max(1, sum(math.sqrt(n) for _, _, n in rows))
    for _ in range(STEPS):
        slope = [0.02 * w / total for w in weights]
        for flags, label, n in rows:
            z = weights[-1] + sum(w for w, f in zip(weights, flags) if f)
            gap = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label) * math.sqrt(n) / total
            for i, f in enumerate(flags):
                if f:
                    slope[i] += gap
            slope[-1] += gap
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return dict(zip([*names, "bias"], weights))


def personal_spans(documents: DataFrame) -> DataFrame:
    """(key, kind, start, stop, base, score): base spans, and others that the fitted classifier accepts.

    A span of another kind than the base ones is reported as ``phone`` or ``credential``.
    """
    known = votes(candidates(documents)).filter("base or kind not in ('email', 'card') or rule = -1")
    flags = features()
    known = known.withColumns({f"f_{n}": F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    known = cut_lineage(known.select("key", "kind", "start", "stop", "base", *VOTES, *[f"f_{n}" for n in flags]), "spans")
    # the number of distinct vote and feature rows is fixed by their definitions, however many spans there are
    table = known.groupBy("kind", *VOTES, *[f"f_{n}" for n in flags]).count().collect()
    seen: dict = {}
    for r in table:
        k = r["kind"], tuple(r[v] for v in VOTES)
        seen[k] = seen.get(k, 0) + r["count"]
    _, real = reliabilities([(k, v, n) for (k, v), n in sorted(seen.items())])
    names = list(flags)
    rows = [(tuple(r[f"f_{n}"] for n in names), real[r["kind"], tuple(r[v] for v in VOTES)], r["count"]) for r in table]
    weights = fit_classifier(sorted(rows), names)
    z = F.lit(weights["bias"])
    for n in names:
        z = z + F.when(F.col(f"f_{n}"), weights[n]).otherwise(0.0)
    scored = known.withColumn("score", 1 / (1 + F.exp(-z))).filter((F.col("score") >= 0.5) | F.col("base"))
    at = Window.partitionBy("key").orderBy("start", F.col("base").desc(), "kind", "stop")
    before, behind = at.rowsBetween(Window.unboundedPreceding, -1), at.rowsBetween(1, Window.unboundedFollowing)
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(behind)
    clear = (F.coalesce(F.max("stop").over(before), F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("stop")) >= F.col("stop"))
    kind = F.when(F.col("kind") == "number", "phone").otherwise(F.col("kind"))
    scored = scored.withColumn("clear", clear).filter("base or (clear and kind not in ('email', 'ip', 'card'))")
    return scored.select("key", kind.alias("kind"), "start", "stop", "base", "score")


def attach_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents' rows with ``found``: their spans as structs (start, order, kind, stop, base), sorted."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    found = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "kind", "stop", "base"))).alias("found"))
    empty = F.array().cast(found.schema["found"].dataType)
    (key,) = unused(documents, "key")
    rows = documents.drop("found").withColumn(key, text_key())
    return rows.join(found.withColumnRenamed("key", key), key, "left").drop(key).withColumn("found", F.coalesce("found", empty))


def redacted(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with each run of overlapping spans replaced by ``[KIND]`` of its first span."""
    order = Window.partitionBy("key").orderBy("start", "stop", "kind")
    edge = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("run", F.sum((F.coalesce(edge, F.lit(-1)) < F.col("start")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("kind", F.struct("start", "stop", "kind")).alias("kind"))
    key, own = unused(documents, "key", "runs")
    found = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind"))).alias(own))
    rows = documents.withColumn(key, text_key()).join(found.withColumnRenamed("key", key), key, "left")
    text, runs = F.col("text"), F.col(own)
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["stop"].cast("int")))
    parts = F.transform(
        runs, lambda r, i: F.concat(F.substr(text, F.get(begins, i) + 1, r["start"].cast("int") - F.get(begins, i)), F.lit("["), F.upper(r["kind"]), F.lit("]"))
    )
    tail = F.substr(text, F.get(begins, F.size(runs)) + 1)
    return rows.withColumn("text", F.when(runs.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail))).drop(key, own)
