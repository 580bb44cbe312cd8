"""Personal data (operator 10): weak-supervision aggregation, all in DataFrame functions.

1. Candidates. Four strict patterns give the base spans (leftmost, non-overlapping for each kind); looser
   patterns (spelled-out addresses, numbers without a plus sign, long digit groups, IPv6) give further ones.
   Places are prefix sums over the matches and the pieces of text that a split leaves between them.
2. Labelers vote on each candidate: format (regex), gazetteer (known endings, prefixes and ranges), context
   for and context against (words just before it); each says yes (1), no (-1) or nothing (0).
3. Expectation-maximisation over the counts of vote patterns (kinds x 3^4 rows at most, from all documents)
   estimates how reliable each labeler is for each kind, without labels.
4. A logistic span classifier is trained on the posteriors. Its features are, for each kind, the votes and what no
   labeler looks at: the span's length, the separators in it, and what stands before and after it. Candidates that it
   gives a half or more are added; base spans always stay.

Only counts of feature patterns reach the driver: kinds x 3^4 votes x 7 x 8 x 4 x 4 shapes at most, far fewer in practice.

Nulls: a null text is empty: no spans. Repeated rows and equal ids come back each; ties (spans of two kinds at
one place) all stay, in the kinds' order. Texts are searched whole, by patterns that take linear time on any run of
characters; placing and masking many spans works in runs of CHUNK. Columns of any other names do no harm. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("format", "gazetteer", "context_for", "context_against")
#: The contract's patterns. Possessive groups, and starts only where a run of characters starts or the last match ended,
#: match the same strings without trying every place of a long run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to be worth running.
NEEDS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[a-z0-9-]{2,63})+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[\x20-][0-9]{4,6}){2,3}(?![0-9-])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
LOOSE_NEEDS = {"email": r"(?i)[(\[{]at[)\]}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[\x20-][0-9]{4}", "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words just before a span that speak for a kind, and for something else.
FOR = {
    "email": r"e-?mail|mail|contact|write|send|reach|courriel|correo|kontakt",
    "ip": r"\bip\b|address|host|server|login|client|from|adresse",
    "card": r"card|visa|master|amex|credit|debit|payment|carte|karte|tarjeta",
    "phone": r"phone|tel|call|mobile|cell|fax|dial|whatsapp|anruf|llame|appel",
}
AGAINST = r"version|isbn|issn|order|invoice|ticket|serial|build|release|section|page|sha|hash|uuid|\bid\b|no\.|#|=|\$"
GAZETTEER = {
    "email": r"(?i)\.\x20?(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|eu|us|ca|ch|at|be|pl)$",
    "ip": r"^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|169\.254\.|[1-9][0-9]?\.|1[0-9][0-9]\.|2[01][0-9]\.|22[0-3]\.|[23][0-9A-Fa-f]{3}:|[fF][cdeCDE])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|62)",
    "phone": r"^\+?(?:1[\x20.(-]|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}[\x20).-]",
}
#: How many code points before a span count as its context.
BEFORE = 32
SPAN = "struct<kind:int,at:int,until:int,value:string,base:boolean>"
#: Long arrays are folded in runs of so many.
CHUNK = 64
#: What the classifier sees, by kind: a bias, votes, length, separators, what is before and after.
SIZES = (1, *[3] * len(LABELERS), 7, 8, 4, 4)
PLACES = tuple(sum(SIZES[:i]) for i in range(len(SIZES) + 1))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits in m pass the Luhn check."""
    each = F.transform(
        F.split(F.reverse(_digits(m)), ""),
        lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(c.try_cast("int"), F.lit(0)) + 1)).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often, or inside whatever function, the body uses it."""
    return F.transform(F.array(value), body)[0]


def _runs(a: Column, body) -> Column:
    """body(run, number) of each run of CHUNK elements of an array."""
    number = F.floor((F.size(a) - 1) / CHUNK).cast("int")
    numbers = F.when(F.size(a) > 0, F.sequence(F.lit(0), number)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda c: body(F.slice(a, c * CHUNK + 1, F.lit(CHUNK)), c))


def _sums_before(a: Column, first: Column) -> Column:
    """For each of an array of integers, first plus the sum of those before it."""
    start = F.struct(first.alias("t"), F.array().cast("array<int>").alias("o"))
    return F.aggregate(a, start, lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["o"], F.array(acc["t"])).alias("o")), lambda acc: acc["o"])


def _found(kind: str, text: Column, pattern: str, needs: str, base: bool) -> Column:
    """Spans of a pattern, in order."""

    def placed(z: Column) -> Column:
        steps = F.zip_with(z["m"], F.slice(z["gaps"], 1, F.size(z["m"])), lambda m, g: F.length(m) + g)
        return _let(steps, lambda st: _let(_sums_before(_runs(st, lambda run, _: F.aggregate(run, F.lit(0), lambda t, x: t + x)), F.lit(0)), lambda sums: _let(starts(st, sums), lambda at: spans(z, at))))

    def starts(steps: Column, sums: Column) -> Column:
        return F.flatten(_runs(steps, lambda run, c: _sums_before(run, F.get(sums, c))))

    def spans(z: Column, at: Column) -> Column:
        return F.transform(z["m"], lambda m, i: span(m, F.get(at, i) + F.get(z["gaps"], i)))

    def span(m: Column, at: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), at.alias("at"), (at + F.length(m)).alias("until"), m.alias("value"), F.lit(base).alias("base"))

    # a split leaves one piece more than there are matches: the text after the last
    split = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))
    found = F.when(text.rlike(needs), _let(split, placed)).otherwise(F.array()).cast(f"array<{SPAN}>")
    return F.filter(found, lambda s: _passes(kind, s["value"])) if base and kind != "email" else found


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs' kept columns and cands, all candidate spans with their features: the labelers' votes and their shape."""
    text = F.col("_text")
    df = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    for kind in KINDS:
        df = df.withColumn(f"_{kind}", _found(kind, text, BASE[kind], NEEDS[kind], True))
        df = df.withColumn(f"_{kind}2", _found(kind, text, LOOSE[kind], LOOSE_NEEDS[kind], False))

    def apart(k: str) -> Column:
        return _let(F.col(f"_{k}"), lambda base: F.filter(F.col(f"_{k}2"), lambda s: ~F.exists(base, lambda b: (b["at"] < s["until"]) & (s["at"] < b["until"]))))

    loose = [apart(k) for k in KINDS]
    df = df.withColumn("_all", F.concat(*[c for i, k in enumerate(KINDS) for c in (F.col(f"_{k}"), loose[i])]))

    def beside(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}0-9]"), 2).otherwise(3)

    def window(run: Column) -> Column:
        """The run's text, cut out once, and where it begins."""
        low = F.greatest(F.array_min(F.transform(run, lambda s: s["at"])) - BEFORE, F.lit(0))
        high = F.array_max(F.transform(run, lambda s: s["until"])) + 1
        return F.struct(low.alias("low"), F.substr(text, low + 1, high - low).alias("text"))

    def judged(s: Column, part: Column) -> Column:
        value, size = s["value"], s["until"] - s["at"]
        lead = F.least(s["at"], F.lit(BEFORE))
        around = F.substr(part["text"], s["at"] - lead - part["low"] + 1, lead + size + 1)
        before, after = F.lower(F.substr(around, F.lit(1), lead)), F.substr(around, lead + size + 1, F.lit(1))
        by = lambda table: F.array(*[before.rlike(table[k]) for k in KINDS])[s["kind"]]
        known = F.array(*[value.rlike(GAZETTEER[k]) for k in KINDS])[s["kind"]]
        digits = F.length(_digits(value))
        shape = F.when(s["base"], 1).when((s["kind"] == 2) & ~(digits.between(13, 19) & luhn(value)), -1).when((s["kind"] == 0) | (s["kind"] == 1), 1).otherwise(0)
        votes = [shape, F.when(known, 1).otherwise(-1), F.when(by(FOR), 1).otherwise(0), F.when(before.rlike(AGAINST), -1).otherwise(0)]
        length = F.least(F.floor(F.log2(size.cast("double"))), F.lit(6)).cast("int")
        parts = F.when(value.contains("."), 1).otherwise(0) + F.when(value.contains("-"), 2).otherwise(0) + F.when(value.rlike(r"[\x20()]"), 4).otherwise(0)
        features = F.array(*[(v + 1).cast("int") for v in votes], length, parts, beside(F.right(before, F.lit(1))), beside(after))
        return F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["until"].alias("until"), s["base"].alias("base"), features.alias("features"))

    cands = F.flatten(_runs(F.col("_all"), lambda run, _: _let(window(run), lambda part: F.transform(run, lambda s: judged(s, part)))))
    return df.select(*keep, cands.alias("cands"))


def em(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior that a candidate with each (kind, votes) is personal data: two-class model, one per kind.

    Labelers vote independently given the class; the start says that a labeler is right four times in five.
    Add-one counts keep every probability inside (0, 1).
    """
    post: dict[tuple[int, ...], float] = {}
    for kind in {p[0] for p in patterns}:
        own = {p: n for p, n in patterns.items() if p[0] == kind}
        prior = 0.5
        rate = {(j, c, v): (0.6 if v == (1 if c else -1) else 0.3 if v == 0 else 0.1) for j in range(len(LABELERS)) for c in (0, 1) for v in (-1, 0, 1)}
        for _ in range(rounds):
            for p in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j, 1, v] / rate[j, 0, v]) for j, v in enumerate(p[1:]))
                post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            mass = {c: sum(n * (post[p] if c else 1 - post[p]) for p, n in own.items()) for c in (0, 1)}
            prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
            # a pull of ten votes towards the start keeps the classes from trading places
            for j, c, v in product(range(len(LABELERS)), (0, 1), (-1, 0, 1)):
                said = sum(n * (post[p] if c else 1 - post[p]) for p, n in own.items() if p[1 + j] == v)
                start = 0.6 if v == (1 if c else -1) else 0.3 if v == 0 else 0.1
                rate[j, c, v] = (said + 10 * start) / (mass[c] + 10)
    return post


Pattern = tuple[int, ...]


def votes_of(pattern: Pattern) -> Pattern:
    """The (kind, votes) of a (kind, features) pattern."""
    return (pattern[0], *(f - 1 for f in pattern[1 : 1 + len(LABELERS)]))


def _places(kind: int, features: Pattern) -> list[int]:
    """Where a pattern's features have their weights."""
    return [kind * PLACES[-1] + p + f for p, f in zip(PLACES, (0, *features), strict=False)]


def classifier(patterns: dict[Pattern, int], post: dict[Pattern, float], rounds: int = 30, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method on the features of each kind, fitted to the posteriors of their votes."""
    w = np.zeros(len(KINDS) * PLACES[-1])
    for kind in range(len(KINDS)):
        own = sorted(p for p in patterns if p[0] == kind)
        if not own:
            continue
        x = np.zeros((len(own), PLACES[-1]))
        for i, p in enumerate(own):
            x[i, _places(0, p[1:])] = 1
        n, y = np.array([float(patterns[p]) for p in own]), np.array([post[votes_of(p)] for p in own])
        v = np.zeros(PLACES[-1])
        for _ in range(rounds):
            guess = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
            hess = (x * (n * guess * (1 - guess))[:, None]).T @ x + ridge * np.eye(len(v))
            step = np.linalg.solve(hess, x.T @ (n * (y - guess)) - ridge * v)
            v = v + step / max(1.0, float(np.abs(step).max()) / 2)
        w[kind * PLACES[-1] : (kind + 1) * PLACES[-1]] = v
    return w.tolist()


def learn(found: DataFrame) -> list[float]:
    """The span classifier's weights, from the cands of all documents."""
    pattern = F.transform("cands", lambda s: F.concat_ws(",", s["kind"].cast("string"), s["features"].cast("array<string>")))
    counts = found.select(F.explode(pattern).alias("p")).groupBy("p").count().collect()  # bounded by the kinds' features
    patterns = {tuple(int(x) for x in r.p.split(",")): r["count"] for r in counts}
    votes: Counter = Counter()
    for p, n in patterns.items():
        votes[votes_of(p)] += n
    return classifier(patterns, em(votes))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["until"].alias("until"))))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["at"].cast("string"), s["until"].cast("string"))))


def accepted(found: DataFrame, weights: list[float]) -> DataFrame:
    """found with spans: base spans and candidates that the classifier gives a half or more."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    first = F.array(*[F.lit(p + 1) for p in PLACES[1:-1]])  # the bias has no feature; element_at counts from 1

    def score(s: Column) -> Column:
        base = s["kind"] * PLACES[-1]
        seen = F.zip_with(s["features"], first, lambda f, p: F.element_at(w, base + p + f))
        return F.aggregate(seen, F.element_at(w, base + 1), lambda a, x: a + x)

    return found.withColumn("spans", F.filter("cands", lambda s: s["base"] | (score(s) >= 0)))


def detect(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Each row's carried columns (doc_id), counts of base spans by kind, base and spans as arrays and as strings."""
    keep = carry or ["doc_id"]
    found = cut(candidates(docs, keep))
    out = accepted(found, learn(found)).withColumn("base", F.filter("cands", lambda s: s["base"]))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(*keep, *counts, _listed(F.col("base")).alias("base_list"), _listed(F.col("spans")).alias("span_list"), "spans")


def mask(docs: DataFrame) -> DataFrame:
    """docs with every found span in text replaced by its kind in angle brackets, and n_chars (if there) to match.

    Spans that overlap are replaced together, by the kind of the first.
    """
    weights = learn(candidates(docs, []))
    row = docs.select(F.struct("*").alias("_row"), "text")
    found = accepted(candidates(row, ["_row"]), weights).select("_row", "spans", F.col("_row.text").cast("string").alias("text"))
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["until"].alias("until"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<at:int,until:int,kind:int>>").alias("out"))

    def union(acc: Column, s: Column) -> Column:
        last = F.element_at(acc["out"], -1)
        wider = F.struct(last["at"].alias("at"), F.greatest(last["until"], s["until"]).alias("until"), last["kind"].alias("kind"))
        held = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(wider))
        out = F.when(s["at"] < acc["end"], held).otherwise(F.concat(acc["out"], F.array(s)))
        return F.struct(F.greatest(acc["end"], s["until"]).alias("end"), out.alias("out"))

    found = found.withColumn("_u", F.when(F.size("spans") > 0, F.aggregate(ordered, start, union, lambda acc: acc["out"])))
    text, spans, size = F.col("text"), F.col("_u"), F.length("text")

    def part(run: Column, c: Column) -> Column:
        """The kinds of a run of spans and what follows each; the run's text is cut out once."""
        low = run[0]["at"]
        high = F.coalesce(F.get(spans, (c + 1) * CHUNK)["at"], size)
        whole = F.array(F.substr(text, low + 1, high - low))
        until = lambda i: F.coalesce(F.get(run, i + 1)["at"], high)
        return F.transform(whole, lambda t: F.array_join(F.transform(run, lambda s, i: F.concat(F.get(kinds, s["kind"]), F.substr(t, s["until"] - low + 1, until(i) - s["until"]))), ""))[0]

    masked = F.concat(F.substr(text, F.lit(1), spans[0]["at"]), F.array_join(_runs(spans, part), ""))
    found = found.withColumn("_t", F.when(spans.isNotNull(), masked))
    rest = [F.col("_row")[c].alias(c) for c in docs.columns]
    change = {"text": F.coalesce("_t", "text")}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(F.col("_t").isNotNull(), F.length("_t").cast("long")).otherwise(F.col("_row.n_chars"))
    return found.select(*[change[c].alias(c) if c in change else r for c, r in zip(docs.columns, rest, strict=True)])
