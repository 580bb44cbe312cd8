"""Toxicity (operator 7): noisy-channel deobfuscation, then a score of the restored text.

Writers disguise words by look-alike characters, spacing, separators and repeated letters. Each suspicious
token (or run of three single characters and more) is a lattice: every character stands for itself, for letters that
it imitates, or for nothing (a separator, a repeat); a space in a run may also end a word. An exact Viterbi search
(the state is the last two letters) under a character trigram model, learned from the training texts, restores the
words, whatever the length. Plain tokens pass unchanged.

Terms (restored words, and opening five letters of longer ones) get the lower confidence bound of their
log-odds between toxic and other documents; a logistic model over a text's strongest terms gives the score.
Learning uses every labelled document outside the held-out fold, and its whole text: terms and trigrams are counted by
Spark, the bounds are taken there, and each Newton round of the logistic model sums its terms over all rows where they are.
The driver gets the distinct trigrams, the terms that speak for toxicity and a row of sums a task. Scoring covers all rows
and whole texts. Each distinct token is judged once per worker (bounded cache).

Nulls: a null text is empty and scores as a text without terms. Null labels are not learned; with no labels
of one class the score is 0 everywhere. An id with both labels counts as toxic. Repeated rows and equal ids come back
each; of restorations that tie the first found in the order of the lattice's letters stays. Very long texts are scored
whole; a very long token takes time in proportion to its length. Columns of any other names do no harm. An empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, held_out, tidy
from quarry.sources.tables import compact, discard

#: What a character may imitate.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
}
COST = {"same": 0.0, "look": 1.0, "repeat": 1.0, "gap": 0.7, "break": 0.7, "wild": 2.5}
GAPS = set(".-_*~'`^ ")
WORD = re.compile(r"[^\W\d_]+")
PLAIN = re.compile(r"[^\W\d_]+")
EDGES = ".,;:!?\"'()[]{}<>%&$*#«»¿¡…-"
SPACED = re.compile(r"(?<!\S)\S(?: {1,3}\S){2,}(?!\S)")
SPACES = re.compile(" +")
TRIPLE = re.compile(r"(.)\1\1")
PREFIX = 5


class CharModel:
    """Trigram log-probabilities over letters, with backing-off to smaller contexts by fixed weights."""

    def __init__(self, words: dict[str, int] | None = None, trigrams: Iterable[tuple[str, str, int]] = ()) -> None:
        """From words with their counts, or from counts of (two letters, the next one); shorter contexts are sums of these."""
        tri: dict[str, Counter] = defaultdict(Counter)
        spelled = ((f"^^{w}$", n) for w, n in (words or {}).items())
        for context, x, n in [*((s[i - 2 : i], s[i], n) for s, n in spelled for i in range(2, len(s))), *trigrams]:
            for k in (0, 1, 2):
                tri[context[2 - k :]][x] += n
        letters = max(2, len(tri[""]))
        self.floor = math.log(1e-4 / letters)
        sums = {c: sum(v.values()) for c, v in tri.items()}
        self.table = {
            c: {x: math.log(0.7 * n / sums[c] + (0.25 * tri[c[1:]][x] / sums[c[1:]] if c else 0) + 0.05 * tri[""][x] / sums[""]) for x, n in v.items()} for c, v in tri.items()
        }

    def step(self, context: str, x: str) -> float:
        for k in range(3):
            found = self.table.get(context[k:])
            if found is not None and x in found:
                return found[x] - 1.5 * k
        return self.floor

    def letters(self, token: str, i: int) -> tuple[list[tuple[str, float]], float | None]:
        """What the i-th character may stand for, with costs; and the cost of its standing for nothing, if it may."""
        ch = token[i]
        options = [(x, COST["look"]) for x in LOOKS.get(ch, "")]
        if ch.isalpha():
            options.append((ch, COST["same"]))
        skip = COST["gap"] if ch in GAPS else COST["repeat"] if i and token[i - 1] == ch else None
        if ch == "*":
            options += [(v, COST["wild"]) for v in "aeiou"]
        if not options and skip is None:
            skip = COST["wild"]
        return options, skip

    def best(self, token: str) -> tuple[float, str]:
        """The likeliest words behind a token, and their score."""
        paths: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        step = self.step
        for i, ch in enumerate(token):
            grown: dict[str, tuple[float, tuple | None]] = {}
            options, skip = self.letters(token, i)
            for state, (score, out) in paths.items():
                for x, cost in options:
                    new, key = score + step(state, x) - cost, state[1] + x
                    if key not in grown or new > grown[key][0]:
                        grown[key] = (new, (out, x))
                if skip is not None and (state not in grown or score - skip > grown[state][0]):
                    grown[state] = (score - skip, out)
                if ch == " " and state != "^^":
                    new = score + step(state, "$") - COST["break"]
                    if "^^" not in grown or new > grown["^^"][0]:
                        grown["^^"] = (new, (out, " "))
            paths = grown
        score, out = max(((score + step(state, "$"), out) for state, (score, out) in paths.items()), key=lambda x: x[0])
        found = []
        while out is not None:
            out, x = out
            found.append(x)
        return score, "".join(reversed(found))

    def restore(self, token: str) -> str:
        return self.best(token)[1]


def suspicious(core: str) -> bool:
    """Whether a token without its outer punctuation may be a disguise: letters mixed with others, or a letter three times."""
    if PLAIN.fullmatch(core):
        return TRIPLE.search(core) is not None or any(c in LOOKS for c in core)
    return sum(c.isalpha() for c in core) * 2 >= len(core) or any(c.isalpha() for c in core) and all(c.isalpha() or c in LOOKS or c in GAPS for c in core)


def terms(word: str) -> list[str]:
    return [word, word[:PREFIX] + "*"] if len(word) > PREFIX else [word]


class Model:
    def __init__(self, chars: CharModel | None, weights: dict[str, float], w: list[float], cache_words: int = 1_000_000) -> None:
        self.chars, self.weights, self.w, self.cache_words = chars, weights, w, cache_words
        self.cache: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {"chars": self.chars, "weights": self.weights, "w": self.w, "cache_words": self.cache_words}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def words_of(self, token: str) -> list[str]:
        """The restored word(s) of a white-space token."""
        core = token.strip(EDGES)
        if len(token) > len(core) and token[: len(token) - len(token.lstrip("$!(@"))] and core[:1].isalpha():
            core = token.rstrip(EDGES)  # an opening look-alike belongs to the word
        if suspicious(core) and self.chars is not None:
            return [self.chars.restore(core), *WORD.findall(core)]
        return WORD.findall(core)

    def weight(self, token: str) -> float:
        """The strongest evidence in a token, 0 if none."""
        got = [self.weights[t] for w in self.words_of(token) for t in terms(w) if t in self.weights]
        return max(got, default=0.0)

    def features(self, text: str) -> list[float]:
        text = text.lower()
        tokens = set(text.split())
        cache = self.cache
        if len(cache) > self.cache_words:
            cache.clear()
        for t in tokens:
            if t not in cache:
                cache[t] = self.weight(t)
        found = [x for t in tokens if (x := cache[t])]
        if self.chars is not None:
            for run in SPACED.findall(text):
                words = self.chars.restore(SPACES.sub(" ", run)).split()
                found += [self.weights[t] for w in words for t in terms(w) if t in self.weights]
        found.sort(reverse=True)
        top = found[:1] + found[1:2] + [0.0, 0.0]
        return [1.0, top[0], top[1], math.log1p(sum(found)), math.log1p(len(found)), math.log1p(len(tokens))]

    def score(self, text: str) -> float:
        if not self.w:
            return 0.0
        z = sum(a * b for a, b in zip(self.w, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(data: DataFrame, features: int, ridge: float = 1.0, rounds: int = 25, close: float = 1e-9) -> list[float]:
    """Logistic regression by Newton's method on all rows (x, toxic): each task sums up its rows' gradients and Hessians."""
    w = np.zeros(features)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(features + features * features)
            for b in batches:
                x, y = b.column(0).flatten().to_numpy().reshape(-1, features), b.column(1).to_numpy().astype(float)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                sums += np.concatenate([x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["sums"])

        parts = data.select("x", "toxic").mapInArrow(run, "sums array<double>").toArrow().column(0).to_pylist()
        sums = np.array([math.fsum(v) for v in zip(*parts, strict=True)])
        grad, hess = sums[:features] + ridge * w, sums[features:].reshape(features, features) + ridge * np.eye(features)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < close * (1 + np.abs(w).max()):
            break
    return w.tolist()


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of every document with a label, outside the held-out fold; joined by size as Spark knows it."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out("doc_id"))
    first = F.min("text").alias("text")  # of rows with equal ids
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").filter(~held_out("doc_id"))
    return texts.join(marks, "doc_id").groupBy("doc_id", "toxic").agg(first).select("text", "toxic")


def vocabulary(rows: DataFrame, least_docs: int) -> DataFrame:
    """(t, bad, good): in how many toxic and other texts each word and opening of a longer word (with *) stands, if in least_docs."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    with_prefix = F.array_distinct(F.concat(words, F.transform(F.filter(words, lambda w: F.length(w) > PREFIX), lambda w: F.concat(F.substring(w, 1, PREFIX), F.lit("*")))))
    seen = rows.select("toxic", F.explode(with_prefix).alias("t")).filter("t <> ''").groupBy("t").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    return seen.filter(F.col("bad") + F.col("good") >= least_docs)


def trigram_counts(counted: DataFrame) -> DataFrame:
    """(context, x, n) over the words of a vocabulary: as many rows as there are different trigrams."""
    places = counted.filter("not endswith(t, '*')").select(F.concat(F.lit("^^"), "t", F.lit("$")).alias("s"), (F.col("bad") + F.col("good")).alias("n"))
    each = places.select("s", "n", F.explode(F.sequence(F.lit(3), F.length("s"))).alias("i"))
    return each.groupBy(F.col("s").substr(F.col("i") - 2, F.lit(2)).alias("context"), F.col("s").substr(F.col("i"), F.lit(1)).alias("x")).agg(F.sum("n").alias("n"))


def lower_bound(n: dict[int, int]) -> Column:
    """Of a term's log-odds between n[1] toxic and n[0] other texts."""
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    return F.log(bad / (n[1] + 1)) - F.log(good / (n[0] + 1)) - 1.64 * F.sqrt(1 / bad + 1 / good)


def train(docs: DataFrame, labels: DataFrame, least_docs: int = 4, bound: float = 1.0) -> Model:
    """Learn from all labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    rows, folder = compact(labelled(docs, labels))
    try:
        n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if not n.get(0) or not n.get(1):
            return Model(None, {}, [])
        counted = cut(vocabulary(rows, least_docs))
        told = counted.select("t", lower_bound(n).alias("low")).filter(F.col("low") > bound).toArrow()
        spelled = trigram_counts(counted).toArrow()
        chars = CharModel(trigrams=zip(*(spelled.column(c).to_pylist() for c in ("context", "x", "n")), strict=True))
        model = Model(chars, dict(zip(told.column("t").to_pylist(), told.column("low").to_pylist(), strict=True)), [])
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([shared.value.features(x.as_py() or "") for x in b.column(0)], pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

        data = cut(rows.mapInArrow(tidy(run), "x array<double>, toxic int"))
        model.w = fit(data, len(model.features("")))
    finally:
        discard(spark, folder)
    return model


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id) of each row with score."""
    keep = carry or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the terms that speak for toxicity, and the trigrams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.score(x.as_py() or "") for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(got, pa.float64())], [*keep, "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(run), f"{schema}, score double")
