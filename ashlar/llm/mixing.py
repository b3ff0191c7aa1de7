"""Mixing sources to target weights (7): soft membership.

A classifier fitted on rows of the labelled table gives each document a posterior over the domains (the values of
``domain``, lang by default).  A document of n tokens counts n * p(domain) tokens to each; tokens are the runs of letters,
digits and other signs into which byte-level tokenizers cut a text before they merge.  Rates of documents are fitted by
projected gradient least squares, accelerated, so that the expected tokens of each domain, sum(rate * n * p), meet its
target, with rates of at least ``lower`` (0 unless asked for; at 1 documents are only repeated).  A step needs the
domains' totals only, and a document's rate follows from its own posterior and the steps so far, so neither is anything
kept by document nor anything shuffled but totals.

Defined results: a null or empty text has no tokens and gets the posterior of an empty text; rows with a null domain are
not learnt from but are mixed like others; a target of a domain without labelled rows is an error; without labelled rows
there is one domain and every rate is its target over its total; repeated rows get equal rates; an empty table gives an
empty result; other columns are carried by ``mixed``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, fresh, groups_of, mix, prepare, row_key, sums, table
from .components import forget, stored

TRAIN_ROWS = 6_000
#: Labelled rows learnt of each domain beyond the sample, one at least; so every labelled domain is learnt.
LEAST = 20
GRAMS = 1024
#: Targets by default: totals to this power, scaled so that no domain loses tokens.
TEMPERATURE = 0.7
#: Steps at most; they end when totals are this close to their targets, by share, or the misfit falls by no more in a step.
STEPS, CLOSE, STILL = 60, 1e-3, 1e-4
#: Of each byte: 0 white space, 1 letter, 2 digit, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def tokens(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The number of tokens of each document."""
    kind = _CLASS[data]
    begins = kind > 0
    if len(data):
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        begins[1:] &= (kind[1:] != kind[:-1]) | cut[1:-1]
    return sums(begins, off)


def frequencies(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(square roots of the shares of hashed byte trigrams, number of tokens) of each document."""
    n = len(off) - 1
    counts = np.zeros((n, GRAMS), np.float32)
    if len(data) > 2:
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
        code = ((low[:-2] * np.uint32(65536) + low[1:-1] * np.uint32(256) + low[2:]) * np.uint32(2654435761)) >> np.uint32(22)
        doc = np.repeat(np.arange(n), np.diff(off))[: len(code)]
        inside = np.ones(len(data), bool)
        for k in (1, 2):  # a trigram lies in one document
            ends = off[1:] - k
            inside[ends[ends >= off[:-1]]] = False
        ok = inside[: len(code)]
        counts = np.bincount(doc[ok] * GRAMS + code[ok], minlength=n * GRAMS).reshape(n, GRAMS).astype(np.float32)
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)), tokens(data, off)


class Posterior:
    """Softmax regression."""

    def __init__(self, domains: list[str], weight: np.ndarray, bias: np.ndarray):
        self.domains, self.weight, self.bias = domains, weight, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weight + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _each(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = as_bytes(column)
    for lo, hi in groups_of(off, 1 << 19, 256):  # a row of counts is large, however short its text
        yield lo, hi, *frequencies(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


def fit_posterior(docs: DataFrame, labels: DataFrame, domain: str = "lang", rows: int = TRAIN_ROWS) -> Posterior:
    """Learns from a sample of the labelled rows, bounded but for ``LEAST`` of each domain."""
    labelled = labels.where("doc_id is not null").select("doc_id").distinct()
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = docs.select("doc_id", F.col(domain).cast("string").alias("domain")).where("domain is not null").join(labelled, "doc_id")
    # the row of the least hash in each part of a domain: an aggregate, so that a hot domain is not one task's
    least = known.withColumn("h", F.xxhash64("doc_id")).groupBy("domain", F.pmod("h", F.lit(LEAST)).alias("part")).agg(F.min(F.struct("h", "doc_id")).alias("m")).select("m.doc_id")
    chosen = chosen.union(least.select("doc_id")).distinct()
    picked = docs.select("doc_id", F.col(domain).cast("string").alias("domain"), "text").where("domain is not null").join(F.broadcast(chosen), "doc_id").select("domain", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi, x, _ in _each(b.column("text")):
                yield pa.record_batch({"domain": b.column("domain").slice(lo, hi - lo), "x": pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())})

    got = picked.mapInArrow(run, "domain string, x binary").toArrow()
    names, inverse = np.unique(np.array(got.column("domain").to_pylist(), dtype=object).astype(str), return_inverse=True)
    if not len(names):
        return Posterior([""], np.zeros((GRAMS, 1)), np.zeros(1))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f4").reshape(-1, GRAMS)
    hot = np.eye(len(names), dtype=np.float32)[inverse]
    out = Posterior([str(n) for n in names], np.zeros((GRAMS, len(names)), np.float32), np.zeros(len(names), np.float32))
    for _ in range(200):  # features have norm 1, so the curvature is at most 1/2
        r = out(x) - hot
        out.weight -= 4.0 * (x.T @ r / len(x) + 1e-5 * out.weight)
        out.bias -= 1.0 * r.mean(0)
    return out


Step = tuple[float, np.ndarray]  # how far along the last move, and the gradient by domain there


def rates(p: np.ndarray, history: list[Step], lower: float = 0.0) -> np.ndarray:
    """The rates of documents with posteriors p after the steps so far."""
    x = before = np.full(len(p), max(1.0, lower))
    for along, r in history:
        x, before = np.maximum(lower, x + along * (x - before) - p @ r), x
    return x


def fit_rates(docs: DataFrame, posterior: Posterior, targets: dict[str, float] | None = None, lower: float = 0.0) -> tuple[list[Step], np.ndarray, np.ndarray]:
    """(steps, targets, fitted totals).  targets: tokens wanted of each domain; by default TEMPERATURE sets them."""
    if unknown := sorted(set(targets or ()) - set(posterior.domains)):
        raise ValueError(f"targets of domains that are not learnt: {', '.join(unknown)}")

    def posteriors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, _, x, n in _each(b.column("text")):
                some = n > 0
                yield pa.record_batch({"n": pa.array(n[some].astype(np.int64)), "p": pa.array([r.astype("<f8").tobytes() for r in posterior(x[some])], pa.binary())})

    soft = stored(docs.select("text").mapInArrow(posteriors, "n long, p binary"), "posteriors")
    k = len(posterior.domains)

    def totals(history: list[Step]) -> np.ndarray:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for b in it:
                p = np.frombuffer(b"".join(b.column("p").to_pylist()), "<f8").reshape(-1, k)
                total += (rates(p, history, lower) * b.column("n").to_numpy()) @ p
            yield pa.record_batch({"k": pa.array(np.arange(k), pa.int32()), "t": pa.array(total)})

        got = {r.k: r.t for r in soft.mapInArrow(run, "k int, t double").groupBy("k").agg(F.sum("t").alias("t")).collect()}
        return np.array([got.get(i, 0.0) for i in range(k)])

    start = totals([])
    size = np.maximum(start / max(1.0, lower), 1e-9)
    if targets is None:
        aim = size**TEMPERATURE
        aim *= (size / aim).max()
    else:
        aim = np.array([float(targets.get(d, 0.0)) for d in posterior.domains])
    misfit = lambda t: float((np.square(t - aim) / size).sum())
    history: list[Step] = []
    now = before = start
    speed, still = 1.0, 0
    while len(history) < STEPS and still < 3 and np.abs(now - aim).max(initial=0) > CLOSE * aim.max(initial=0):
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        along = (speed - 1) / faster if history else 0.0
        # totals follow the rates linearly, so those at the point ahead need no pass of their own; weighted by 1 / size
        # the map from rates to totals is an average, so a full step cannot overshoot
        r = (now + along * (now - before) - aim) / size
        after = totals([*history, (along, r)])
        if misfit(after) > misfit(now) and along:  # it went too far: again from here, without a run-up
            speed = 1.0
            history.append((0.0, (now - aim) / size))
            after = totals(history)
        else:
            speed = faster
            history.append((along, r))
        still = still + 1 if misfit(after) > (1 - STILL) * misfit(now) else 0
        before, now = now, after
    forget(soft)
    return history, aim, now


def mixed(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, lower: float = 0.0, report: bool = False) -> DataFrame:
    """The documents, each as often as its rate says: the whole part, and once more with the rest's probability by
    hash of its id and text.  report: instead a row per document with n_tokens, domain, posterior, rate and copies."""
    posterior = fit_posterior(docs, labels, domain)
    history, _, _ = fit_rates(docs, posterior, targets, lower)
    names = docs.columns
    key = fresh(names, "_mixing_key")
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], row_key("doc_id", "text").alias(key))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi, x, n in _each(b.column("text")):
                p = posterior(x)
                x = rates(p, history, lower)
                luck = (mix(b.column(key).slice(lo, hi - lo).to_numpy().view(np.uint64)) >> np.uint64(11)) / 2.0**53
                copies = (np.floor(x) + (luck < x - np.floor(x))).astype(np.int64)
                part = b.slice(lo, hi - lo)
                if report:
                    yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(n.astype(np.int64)), "domain": pa.array([posterior.domains[i] for i in p.argmax(1)]), "posterior": pa.array(list(p.astype(float)), pa.list_(pa.float64())), "rate": pa.array(x), "copies": pa.array(copies)})
                else:
                    yield part.take(pa.array(np.repeat(np.arange(hi - lo), copies))).select(names)

    schema = "doc_id long, n_tokens long, domain string, posterior array<double>, rate double, copies long"
    return keyed.mapInArrow(run, schema if report else docs.schema)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), report=True)
