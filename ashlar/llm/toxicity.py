"""Toxicity (6): noisy-channel deobfuscation, then a score of the restored text.

A character language model is counted over all documents, whatever letters they use.  Words that look disguised (letters
among digits or signs, drawn-out or doubled letters, letters set apart by blanks or other signs) are lattices: a sign may
stand for itself, for the letters it is written for, or for nothing; a blank may end a word or stand for nothing.
Viterbi decoding takes the path that the channel and the language model like best.  Plain words are their own only path.
A logistic regression over restored words and their beginnings, by how far each exceeds what a clean text of that length
holds, scores the document.

Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2, at most ``TRAIN_ROWS`` of them, chosen by
hash of the id.  Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts get the score of a text without signs; a null doc_id is not held out; repeated
rows score alike; without labels of both classes every score is the share of toxic labels (0 if there are none);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

TRAIN_ROWS = 12_000
#: Three letters in a row that the model keeps, the most frequent ones; the rest are estimated from two letters and one.
GRAMS = 400_000
THRESHOLD = 0.3
#: Of the language model against the channel.
WEIGHT = 0.7
#: Letters that a sign is written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Costs of the channel.
WRITTEN, WILD, DRAWN, TWICE, MARK, OTHER, NARROW, WIDE = -0.7, -3.5, -0.8, -6.0, -0.7, -8.0, -1.5, -3.0
#: Signs that are decoded at a time; the best path so far is then settled.
SEGMENT = 4096
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„«»‘’"
_THRICE = re.compile(r"(.)\1\1")
_DOUBLED = re.compile(r"(.)\1.*(.)\2.*(.)\3")
_PARTS = re.compile(r"[^\W\d_]{3,}(?:[^\w@$!|+(€£*\s]+[^\W\d_]{3,})+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGN = r"[^\W_]|[@$!|+*€£(]"
_SPELLED = re.compile(rf"(?<![^\s\"'(\[«„“])(?:{_SIGN})(?:\s+(?:{_SIGN})){{2,}}(?=[\"'.,;:?…)\]»”“]*(?:\s|$))")


# ---------------------------------------------------------------- language model


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(a, b, c, n): counts of three letters in a row, lower case, over all documents; 0 is any other sign."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1, np.int64)  # the letters met so far, 0 first
        total = np.zeros(1, np.int64)
        place = np.zeros(0x110000, np.int64)

        def give() -> pa.RecordBatch:
            k = len(known)
            used = np.flatnonzero(total)
            a, b, c = (known[x] for x in (used // (k * k), used // k % k, used % k))
            return pa.record_batch({"a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32)), "c": pa.array(c.astype(np.int32)), "n": pa.array(total[used])})

        for batch in it:
            text = "\0\0".join(t for t in batch.column("text").to_pylist() if t).lower()
            points = np.frombuffer(f"\0\0{text}\0".encode("utf-32-le", "surrogatepass"), "<u4")
            points = np.where(_letters()[points], points, 0)
            met = np.flatnonzero(np.bincount(points, minlength=1))
            if len(new := np.setdiff1d(met, known)):
                if total.any() and len(known) + len(new) > 128:  # a table by place would be large
                    yield give()
                    known, total = np.zeros(1, np.int64), np.zeros(1, np.int64)
                    new = np.setdiff1d(met, known)
                wide = np.concatenate([known, new])
                k, m = len(known), len(wide)
                if m <= 128:
                    grown = np.zeros((m, m, m), np.int64)
                    grown[:k, :k, :k] = total.reshape(k, k, k)
                    known, total = wide, grown.ravel()
                    place[known] = np.arange(m)
            if len(known) > 1 and not len(np.setdiff1d(met, known)):
                k, at = len(known), place[points]
                total += np.bincount((at[:-2] * k + at[1:-1]) * k + at[2:], minlength=k**3)
            else:  # many letters: by value
                p = points.astype(np.int64)
                grams, n = np.unique((p[:-2] << 42) | (p[1:-1] << 21) | p[2:], return_counts=True)
                mask = (1 << 21) - 1
                yield pa.record_batch({"a": pa.array((grams >> 42).astype(np.int32)), "b": pa.array((grams >> 21 & mask).astype(np.int32)), "c": pa.array((grams & mask).astype(np.int32)), "n": pa.array(n.astype(np.int64))})
        if total.any():
            yield give()

    counted = docs.select("text").mapInArrow(run, "a int, b int, c int, n long").where("b != 0 or c != 0")
    # a word begins after any word
    counted = counted.withColumn("a", F.when(F.col("b") == 0, 0).otherwise(F.col("a")))
    return counted.groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


class Language:
    """log P(third sign | first two), interpolated with two signs and one; a blank is any sign that is no letter."""

    def __init__(self, three: dict[str, int], two: dict[str, int], one: dict[str, int], after_two: dict[str, int], after_one: dict[str, int]):
        self.three, self.two, self.one, self.after_two, self.after_one = three, two, one, after_two, after_one
        self.total, self.kinds = sum(one.values()), len(one) + 1
        self.cache: dict[str, float] = {}
        nexts = defaultdict(list)
        for k, n in two.items():
            if k[1] != " ":
                nexts[k[0]].append((-n, k[1]))
        #: The letters that follow a sign most often.
        self.nexts = {k: [c for _, c in sorted(v)[:32]] for k, v in nexts.items()}

    def __call__(self, gram: str) -> float:
        got = self.cache.get(gram)
        if got is None:
            one = (self.one.get(gram[2], 0) + 1) / (self.total + self.kinds)
            two = (self.two.get(gram[1:], 0) + 5 * one) / (self.after_one.get(gram[1], 0) + 5)
            got = math.log((self.three.get(gram, 0) + 3 * two) / (self.after_two.get(gram[:2], 0) + 3))
            if len(self.cache) > 1_000_000:
                self.cache.clear()
            self.cache[gram] = got
        return got

    def __getstate__(self):
        return self.three, self.two, self.one, self.after_two, self.after_one

    def __setstate__(self, state):
        self.__init__(*state)


def language(docs: DataFrame, grams: int = GRAMS) -> Language:
    """The model of all documents.  The driver gets the ``grams`` most frequent of each length."""
    counts = gram_counts(docs).cache()

    def top(by: list[str]) -> dict[str, int]:
        rows = counts.groupBy(*by).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), *by).limit(grams).collect()
        return {"".join(chr(r[c]) if r[c] else " " for c in by): r.n for r in rows}

    out = Language(top(["a", "b", "c"]), top(["b", "c"]), top(["c"]), top(["a", "b"]), top(["b"]))
    counts.unpersist()
    return out


def restore(span: str, model: Language, doubled: bool = False) -> str:
    """The likeliest words behind a disguised span: Viterbi over the lattice of its signs.

    A state is the last two signs of a path; a path is kept as a chain of its letters.  White space in the span may end
    a word: a single blank rather stands for nothing, a wider gap rather for a word's end.  doubled: the second of two
    equal letters may go as easily as that of a drawn-out one.
    """
    best: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    before, span = "", span.lower()
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"\s+|(\S)\1*", span)]
    settled: list[str] = []
    signs = 0
    for ch, n in runs:
        if ch.isspace():
            keep, drop = (NARROW, 0.0) if n == 1 else (0.0, WIDE)
            into = {}
            for state, (score, chain) in best.items():
                if state not in into or into[state][0] < score + drop:
                    into[state] = (score + drop, chain)
                if state[1] != " ":
                    s = score + keep + WEIGHT * model(state + " ")
                    if "  " not in into or into["  "][0] < s:
                        into["  "] = (s, (chain, " "))
            best = into
            continue
        letter, signs_for = ch.isalpha(), LEET.get(ch, "")
        easy = DRAWN if n > 2 or doubled else TWICE
        for k in range(n):
            if letter:
                options, drop = ((ch, 0.0),), (easy if k else None)
            elif ch == "*" and n <= 3:
                options, drop = None, -3.0
            else:
                options = tuple((x, WRITTEN) for x in signs_for)
                drop = easy if k and options else OTHER if ch.isalnum() or options else MARK
            into = {}
            for state, (score, chain) in best.items():
                last = state[1]
                for x, cost in options if options is not None else [(x, WILD) for x in model.nexts.get(last, ())]:
                    s = score + cost + WEIGHT * model(state + x)
                    to = last + x
                    if to not in into or into[to][0] < s:
                        into[to] = (s, (chain, x))
                if drop is not None and (state not in into or into[state][0] < score + drop):
                    into[state] = (score + drop, chain)
            best = into or best
            signs += 1
            if signs % SEGMENT == 0:
                state, (score, chain) = max(best.items(), key=lambda e: e[1][0])
                settled.append(_spelt(chain))
                best = {state: (score, None)}
    _, chain = max(((score + (WEIGHT * model(state + " ") if state[1] != " " else 0.0), chain) for state, (score, chain) in best.items()), key=lambda e: e[0])
    return "".join([*settled, _spelt(chain)]).strip()


def _spelt(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, x = chain
        out.append(x)
    return "".join(reversed(out))


def words_of(token: str, model: Language) -> tuple[str, ...]:
    """The words that a token may be read as: stripped, and restored if it looks disguised."""
    core = token.strip(_PUNCT).lower()
    if core.isalpha() and not _THRICE.search(core):
        if _DOUBLED.search(core):
            return core, restore(core, model, True)
        near = token.lower().strip("\"#%&'*,-./:;<=>?[\\]^_`{}~.")  # a sign at an edge may be a letter
        if near == core or len(near) > len(core) + 2 or near.rstrip("!|+") == core:
            return (core,)
        return core, restore(near, model)
    if not core or not any(map(str.isalpha, core)):
        return ()
    if _PARTS.fullmatch(core) and not _THRICE.search(core):  # words joined by other signs, or one that they part
        parts = _LETTERS.findall(core)
        return (*parts, "".join(parts)) if len(parts) == 2 else tuple(parts)
    return (restore(core, model),)


# ---------------------------------------------------------------- classifier


def features_of(words: tuple[str, ...]) -> tuple[str, ...]:
    """A word and its beginnings of 3 to 7 letters (marked, as they are no words)."""
    return tuple({x for w in words if len(w) > 2 for x in (w, *(w[:k] + "-" for k in range(3, min(8, len(w) + 1))))})


class Counts(dict):
    """Features of each token, kept up to a bound."""

    def __init__(self, model: Language, known: dict[str, int] | None = None):
        super().__init__()
        self.model, self.known = model, known

    def __missing__(self, token: str):
        if len(self) > 400_000:
            self.clear()
        got = features_of(words_of(token, self.model))
        if self.known is not None:
            got = tuple(self.known[x] for x in got if x in self.known)
        self[token] = got
        return got

    def of(self, text: str) -> tuple[int, Counter]:
        """(tokens, occurrences of each feature)."""
        tokens = text.split()
        out: Counter = Counter()
        for f in filter(None, map(self.__getitem__, tokens)):
            out.update(f)
        for m in _SPELLED.finditer(text):
            if sum(map(str.isalpha, m[0])) < 2:
                continue
            got = features_of(tuple(restore(m[0], self.model).split()))
            out.update(got if self.known is None else [self.known[x] for x in got if x in self.known])
        return len(tokens), out


class Classifier:
    def __init__(self, names: list[str], base: np.ndarray, weight: np.ndarray, bias: float):
        self.names, self.base, self.weight, self.bias = names, base, weight, bias

    def excess(self, n: np.ndarray, count: np.ndarray, f: np.ndarray) -> np.ndarray:
        """How far a count exceeds what a clean text of n words holds."""
        return np.maximum(0, np.log((count + 0.5) / (n * self.base[f] + 0.5)))

    def score(self, n: int, counts: Counter) -> float:
        z = self.bias
        if counts:
            f = np.fromiter(counts, np.int64, len(counts))
            z += float(self.excess(np.float64(n), np.fromiter(counts.values(), float, len(counts)), f) @ self.weight[f])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, model: Language, rows: int = TRAIN_ROWS) -> Classifier:
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # bounded by `rows`; dealt out so that no task has many of them
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").repartition(12, "doc_id")

    def tally(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Counts(model)
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
        docs, words = [0, 0], [0, 0]
        for b in it:
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                n, counts = cache.of(text or "")
                docs[toxic] += 1
                words[toxic] += n
                for f, c in counts.items():
                    s = seen[f]
                    s[toxic] += 1
                    if not toxic:
                        s[2] += c
        seen[""] = [docs[1], docs[0], words[0]]
        names = list(seen)
        got = np.array([seen[f] for f in names], np.int64)
        got[-1] = docs[0], docs[1], words[0]
        yield pa.record_batch({"f": pa.array(names), "clean": pa.array(got[:, 0]), "toxic": pa.array(got[:, 1]), "n": pa.array(got[:, 2])})

    tallied = picked.mapInArrow(tally, "f string, clean long, toxic long, n long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "n")))
    all_ = tallied.where("f = ''").first()
    if all_ is None or not all_.clean or not all_.toxic:
        share = all_.toxic / (all_.clean + all_.toxic) if all_ and all_.clean + all_.toxic else 0.0
        return Classifier([], np.zeros(0), np.zeros(0), math.log((share or 1e-12) / (1 - share or 1e-12)))
    p, q, both = F.col("toxic") / all_.toxic, F.col("clean") / all_.clean, (F.col("toxic") + F.col("clean")) / (all_.toxic + all_.clean)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / all_.toxic + 1 / all_.clean) + 1e-9)
    top = tallied.where("f != '' and toxic >= 4").withColumn("z", z).where("z > 4").orderBy(F.desc("z"), "f").collect()  # bounded by the texts of the sample
    names = [r.f for r in top]
    out = Classifier(names, np.array([r.n / max(all_.n, 1) for r in top]), np.zeros(len(top)), 0.0)
    known = {f: i for i, f in enumerate(names)}

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Counts(model, known)
        for b in it:
            rows = [cache.of(t or "") for t in b.column("text").to_pylist()]
            yield pa.record_batch({"toxic": b.column("toxic").cast(pa.int32()), "n": pa.array([n for n, _ in rows], pa.int64()), "f": pa.array([list(c) for _, c in rows], pa.list_(pa.int32())), "c": pa.array([list(c.values()) for _, c in rows], pa.list_(pa.int32()))})

    got = sorted(picked.mapInArrow(gather, "toxic int, n long, f array<int>, c array<int>").collect())
    y = np.array([r.toxic for r in got], float)
    row = np.repeat(np.arange(len(got)), [len(r.f) for r in got])
    col = np.array([x for r in got for x in r.f], np.int64)
    val = out.excess(np.array([r.n for r in got], float)[row], np.array([x for r in got for x in r.c], float), col)
    out.weight, out.bias = _regress(row, col, val, y, len(names))
    return out


def _regress(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, m: int, l2: float = 2.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps."""
    n = len(y)
    size = 0.25 * max(1.0, float(np.bincount(row, val**2, n).max(initial=1.0))) * n / 40 + l2
    w, bias = np.zeros(m), math.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    v, vb, seen = w.copy(), bias, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * v[col], n) + vb, -30, 30))) - y
        w1, b1 = v - (np.bincount(col, val * r[row], m) + l2 * v) / size, vb - r.sum() / (0.25 * n + 1) * 0.5
        after = (1 + math.sqrt(1 + 4 * seen * seen)) / 2
        v, vb = w1 + (seen - 1) / after * (w1 - w), b1
        w, bias, seen = w1, b1, after
    return w, float(bias)


def score(docs: DataFrame, model: Language, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted: one pass, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Counts(model, {f: i for i, f in enumerate(classifier.names)})
        for b in it:
            s = np.array([classifier.score(*cache.of(t or "")) for t in b.column("text").to_pylist()])
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))})

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = language(docs)
    return score(docs, model, fit(docs, table(spark, sf_dir, "labels"), model))
