"""Language identification (operator 8): segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language. A word's probability is the sum
over all its segmentations into pieces (forward algorithm, vectorised over words and languages); a text's is
the product over its words. Probabilities come from expectation-maximisation with the forward-backward sums
over the words of a bounded sample: `sample_docs` documents of each language, chosen by hash among those
outside the held-out fold. Everything else covers all rows and whole texts.

Words are letter runs, lower-cased, whole whatever their length; sums are rescaled on the way, so long words
stay in range. Each distinct token is scored once per worker and kept in a bounded cache.

Nulls: a null or letterless text is `und` with score 0. A null lang is never learned; with no lang to learn
every text is `und`. Rows with a null id are in no held-out fold. Repeated rows and equal ids come back each; of
languages that tie the first by name is told. Very long texts and words are scored whole, in flat memory. Columns of any
other names do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash_sample, held_out, tidy, tokenizer_path

LETTERS = re.compile(r"[^\W\d_]+")
SLICE = 20_000
#: A lattice holds so many places of words at a time.
PLACES = 100_000
#: Sums are rescaled at each so many places. FLOOR to the power of this plus the longest piece must be a double.
RESCALE = 12
START = "▁"
FLOOR = 1e-9


def vocabulary(name: str = "piece_bpe_32k.model") -> dict[str, int]:
    """Pieces without the byte and control ones, and their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return {p: k for k, p in enumerate(dict.fromkeys(pieces))}


def stretches(token: str) -> list[str]:
    """The word forms to score in a white-space token."""
    return [START + w for w in LETTERS.findall(token)]


def prefixes(pieces: dict[str, int]) -> dict[str, int]:
    """A trie of the pieces: their ids, and -1 for beginnings that are none."""
    return dict.fromkeys((p[:k] for p in pieces for k in range(1, len(p))), -1) | pieces


class Lattice:
    """The pieces that occur in each of the words, by place; words in parts of like length."""

    def __init__(self, words: list[str], pieces: dict[str, int], trie: dict[str, int] | None = None) -> None:
        self.words, self.trie, self.unknown = words, trie or prefixes(pieces), len(pieces) + 1  # a letter outside the vocabulary
        self.longest = max(map(len, pieces), default=1)
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        self.parts: list[list[int]] = []
        places = PLACES
        for k in order:
            places += len(words[k]) + 1
            if places > PLACES:
                self.parts.append([])
                places = len(words[k]) + 1
            self.parts[-1].append(k)
        self.kept: list[tuple[np.ndarray, ...]] | None = None

    def _arcs(self, part: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(place, length, rows, ids) of the pieces in a part's words, which are in descending length."""
        get, longest, unknown = self.trie.get, self.longest, self.unknown
        group = [self.words[k] for k in part]
        active = len(group)
        for i in range(len(group[0])):
            while len(group[active - 1]) <= i:
                active -= 1
            rows: list[list[int]] = [[] for _ in range(longest + 1)]
            ids: list[list[int]] = [[] for _ in range(longest + 1)]
            for k in range(active):
                w = group[k]
                x = get(w[i])
                rows[1].append(k)
                ids[1].append(unknown if x is None or x < 0 else x)
                if x is None:
                    continue
                for j in range(i + 2, min(len(w), i + longest) + 1):
                    x = get(w[i:j])
                    if x is None:
                        break
                    if x >= 0:
                        rows[j - i].append(k)
                        ids[j - i].append(x)
            for length in range(1, longest + 1):
                if rows[length]:
                    yield i, length, np.array(rows[length], dtype=np.int32), np.array(ids[length], dtype=np.int32)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(self.words), p.shape[1]))
        ring = self.longest + 1
        for part in self.parts:
            n = np.array([len(self.words[k]) for k in part])
            alpha = np.zeros((ring, len(part), p.shape[1]))
            alpha[0] = 1
            scale = np.zeros(alpha.shape[1:])
            done = -1
            for i, length, rows, ids in self._arcs(part):
                if i != done:  # the place before is left: words that end here are summed up
                    self._leave(alpha, scale, n, out, part, done, i, ring)
                    done = i
                alpha[(i + length) % ring, rows] += alpha[i % ring, rows] * p[ids]
            self._leave(alpha, scale, n, out, part, done, int(n[0]), ring)
        return out

    @staticmethod
    def _leave(alpha: np.ndarray, scale: np.ndarray, n: np.ndarray, out: np.ndarray, part: list[int], done: int, i: int, ring: int) -> None:
        """Clear place i - 1, take the sums of the words of i letters and rescale the others now and then."""
        if done >= 0:
            alpha[done % ring] = 0
        alive = int(np.searchsorted(-n, -i, side="right"))  # words of i letters or more
        ends = int(np.searchsorted(-n, -i, side="left"))
        if ends < alive:
            out[part[ends:alive]] = np.log(alpha[i % ring, ends:alive]) + scale[ends:alive]
        if i and i % RESCALE == 0 and ends:
            by = alpha[i % ring, :ends].copy()
            alpha[:, :ends] /= by
            scale[:ends] += np.log(by)

    def _flat(self, part: list[int]) -> tuple[np.ndarray, ...]:
        """A part's arcs in one table: (place, length, from, to) of each run, then row, id, place and end of each arc."""
        found = list(self._arcs(part))
        sizes = np.array([len(x[2]) for x in found])
        stops = np.cumsum(sizes)
        at, length = (np.array([x[c] for x in found], dtype=np.int64) for c in range(2))
        runs = np.stack([at, length, stops - sizes, stops], axis=1)
        return runs, np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found]), np.repeat(at, sizes), np.repeat(at + length, sizes)

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in each language, over all segmentations; counts: words x languages."""
        if self.kept is None:
            self.kept = [self._flat(part) for part in self.parts]
        out = np.zeros_like(p)
        for part, (runs, rows, ids, at, to) in zip(self.parts, self.kept, strict=True):
            n = np.array([len(self.words[k]) for k in part])
            size = (int(n[0]) + 1, len(part), p.shape[1])
            alpha, beta, ends = np.zeros(size), np.zeros(size), (n, np.arange(len(part)))
            up, down = np.zeros(size), np.zeros(size)  # the logs that a place's sums have been divided by
            alpha[0], beta[ends] = 1, 1
            for i, length, a, b in runs.tolist():
                if length == 1 and i:  # first arcs of a place: its sums are complete
                    up[i] = up[i - 1]
                    if i % RESCALE == 0:
                        by = np.where(alpha[i] > 0, alpha[i], 1)
                        alpha[i : i + self.longest + 1] /= by
                        up[i] += np.log(by)
                alpha[i + length, rows[a:b]] += alpha[i, rows[a:b]] * p[ids[a:b]]
            up[-1] = up[-2]
            scale = np.zeros(size[1:])
            for i, length, a, b in runs[::-1].tolist():
                beta[i, rows[a:b]] += p[ids[a:b]] * beta[i + length, rows[a:b]]
                if length == 1:  # the last arcs of a place, going back
                    down[i] = scale
                    if i % RESCALE == 0:
                        by = np.where((beta[i] > 0) & (n > i)[:, None], beta[i], 1)
                        beta[i : i + self.longest + 1] /= by
                        down[i : i + self.longest + 1] += np.log(by)
                        scale += np.log(by)
            whole = np.log(alpha[ends]) + up[ends]
            for a in range(0, len(rows), PLACES):
                r, k = rows[a : a + PLACES], ids[a : a + PLACES]
                i, j = at[a : a + PLACES], to[a : a + PLACES]
                use = alpha[i, r] * p[k] * beta[j, r] * np.exp(up[i, r] + down[j, r] - whole[r]) * counts[np.array(part)[r]]
                for c in range(p.shape[1]):
                    out[:, c] += np.bincount(k, weights=use[:, c], minlength=len(p))
        return out


class Model:
    """Piece probabilities and a bounded cache of token scores, in two generations: a token met again moves to the newer."""

    def __init__(self, langs: list[str], p: np.ndarray, cache_words: int = 400_000) -> None:
        self.langs, self.p, self.cache_words = langs, p, cache_words
        self.pieces: dict[str, int] = {}
        self.trie: dict[str, int] = {}
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs)), dtype=np.float32)
        self.used = 0
        self.older: dict[str, int] = {}
        self.older_rows = self.rows[:0]

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "p": self.p, "cache_words": self.cache_words}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _room(self, n: int) -> None:
        if self.used + n > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(n, len(self.rows)), len(self.langs)), dtype=np.float32)])

    def _learn(self, new: list[str]) -> None:
        """Scores of tokens that are not in the cache, a slice at a time so that the lattices stay small."""
        if not self.pieces:
            self.pieces = vocabulary()
            self.trie = prefixes(self.pieces)
        back = [w for w in new if w in self.older]
        if back:
            self._room(len(back))
            self.rows[self.used : self.used + len(back)] = self.older_rows[[self.older[w] for w in back]]
            self.cache.update(zip(back, range(self.used, self.used + len(back)), strict=True))
            self.used += len(back)
            new = [w for w in new if w not in self.older]
        for i in range(0, len(new), SLICE):
            part = new[i : i + SLICE]
            forms = [stretches(t) for t in part]
            distinct = list(dict.fromkeys(f for own in forms for f in own))
            at = {f: k for k, f in enumerate(distinct)}
            logs = Lattice(distinct, self.pieces, self.trie).forward(self.p) if distinct else np.zeros((0, len(self.langs)))
            self._room(len(part))
            for k, own in enumerate(forms):
                self.cache[part[k]] = self.used + k
                if len(own) == 1:
                    self.rows[self.used + k] = logs[at[own[0]]]
                else:
                    self.rows[self.used + k] = logs[[at[f] for f in own]].sum(axis=0) if own else 0
            self.used += len(part)

    def predict_all(self, texts: Iterator[str | None]) -> list[tuple[str, float]]:
        """Texts in runs whose unseen tokens are learned together."""
        out: list[tuple[str, float]] = []
        run: list[list[str] | None] = []
        size = 0
        for t in texts:
            known = bool(self.langs and t and LETTERS.search(t))
            run.append(t.lower().split() if known else None)
            size += len(t or "")
            if size > 1_000_000:
                out += self._run(run)
                run, size = [], 0
        return out + self._run(run)

    def _run(self, run: list[list[str] | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text's tokens; None is a text without letters."""
        places = [None if own is None else list(map(self.cache.get, own)) for own in run]
        new = {w for own, at in zip(run, places, strict=True) if at is not None and None in at for w, i in zip(own, at, strict=True) if i is None}
        if len(self.cache) + 2 * len(new) > self.cache_words and self.cache:
            self.older, self.older_rows, self.cache = self.cache, self.rows[: self.used], {}
            self.rows, self.used = np.zeros((1024, len(self.langs)), dtype=np.float32), 0
            new = {w for own in run if own is not None for w in own}
            places = [None if own is None else [None] * len(own) for own in run]
        cache = self.cache
        if new:
            bare = {w.rstrip(".,") for w in new}
            self._learn([w for w in bare if w not in cache])
            for w in new:
                if w not in cache:
                    cache[w] = cache[w.rstrip(".,")]
        out = []
        for own, at in zip(run, places, strict=True):
            if at is None:
                out.append(("und", 0.0))
                continue
            if None in at:
                at = [cache[w] if i is None else i for w, i in zip(own, at, strict=True)]
            total = self.rows[at].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def train(docs: DataFrame, sample_docs: int = 400, rounds: int = 4, smooth: float = 0.02, cache_words: int = 400_000) -> Model:
    """Learn from text and lang of documents outside the held-out fold; sample_docs bounds the rows a language gives."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sample = hash_sample(rows, "lang", sample_docs, ["doc_id", "text"])
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w <> ''").groupBy("lang", "w").count()
    table = words.toArrow()  # bounded by the sample
    langs = sorted(set(table.column("lang").to_pylist()))
    if not langs:
        return Model([], np.zeros((0, 0)))
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    for lang, w, n in zip(*(table.column(c).to_pylist() for c in ("lang", "w", "count")), strict=True):
        for form in stretches(w.lower()):
            counts[form][langs.index(lang)] += n
    pieces = vocabulary()
    forms = sorted(counts)
    weights = np.stack([counts[f] for f in forms])
    lattice = Lattice(forms, pieces)
    size = len(pieces)
    p = np.full((size + 2, len(langs)), 1.0 / size)
    p[size], p[size + 1] = 0.0, FLOOR
    for _ in range(rounds):
        used = lattice.expected(p, weights)[:size] + smooth
        p[:size] = used / used.sum(axis=0)
    return Model(langs, p, cache_words)


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id) of each row with lang_pred and score."""
    keep = carry or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.predict_all(x.as_py() for x in b.column(b.num_columns - 1))
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5, cache_words: int = 400_000) -> DataFrame:
    """docs without those whose language can't be told: no letters, or no language with a posterior of `least`."""
    row = docs.select(F.struct("*").alias("_row"), "text")
    found = predict(row, train(docs, cache_words=cache_words), ["_row"]).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
