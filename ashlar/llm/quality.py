"""Quality rules (8): gradient-boosted trees over document statistics, after two hard base rules.

Defined results: a null or empty text has no words, so the base rule rejects it; repeated rows each get their own,
equal result; a null doc_id is kept as it is; an empty table gives an empty result; further columns are ignored
(``op8``) or carried along (``keep_good``).  With no labels, or labels of one class only, the trees are a constant
and only the base rules reject.  Texts are processed whole; memory follows the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import BASE, RangeHash, SPACE, as_bytes, groups_of, mix, prepare, sums, table, words

#: Features in the order of the model's columns, and the sign that P(low quality) must follow.
FEATURES = {"symbol_share": 1, "repeat_share": 1, "dup_line_share": 1, "upper_share": 1, "bang_share": 1, "digit_share": 0, "distinct_share": 0, "mean_word": 0, "log_words": 0, "words_per_line": 0, "stop_share": 0, "top_word_share": 1}
#: Labelled rows that the trees are fitted on at most; chosen by hash of the id, whatever the table's size.
TRAIN_ROWS = 20_000
#: P(low quality) above which a document goes.
REJECT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _BANG, _STOP = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_BANG[list(b"!?")] = _STOP[list(b".!?")] = True


def statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Exact counts of each document of a buffer."""
    n = len(off) - 1
    start, end, doc = words(data, off)
    hashed = RangeHash(data)
    word = hashed(start, end)
    by_doc = mix(doc.astype(np.uint64) * BASE)
    nw = np.bincount(doc, minlength=n)
    inside = ~SPACE[data]
    out = {"n_words": nw, "word_chars": sums(inside & ((data & 0xC0) != 0x80), off), "n_symbols": sums(_SYMBOL[data], off)}

    rep = np.zeros(len(start), bool)
    if len(start) > 2:
        same = doc[2:] == doc[:-2]
        h = mix(word[:-2] * np.uint64(3) + mix(word[1:-1] * np.uint64(5) + mix(word[2:] * np.uint64(7)))) + by_doc[:-2]
        at = np.flatnonzero(same)
        twice = at[_more_than_once(h[at])]
        for k in range(3):
            rep[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc[rep], minlength=n)

    # lines with a word: cut at \n and at the ends of documents
    nl = np.flatnonzero(data == 10)
    ls = np.union1d(nl + 1, off[:-1])
    ls = ls[ls < len(data)]
    le = np.empty_like(ls)
    if len(ls):
        le[:-1], le[-1] = ls[1:], len(data)
        # a line that ends in \n loses it; the last line of a document ends where the document does
        le = np.where(data[le - 1] == 10, le - 1, le)
    count = np.searchsorted(start, le, "left") - np.searchsorted(start, ls, "left")
    ls, le = ls[count > 0], le[count > 0]
    ld = np.searchsorted(off, ls, "right") - 1
    lh = hashed(ls, le) + mix(ld.astype(np.uint64) * BASE)
    lines = np.bincount(ld, minlength=n)
    _, firsts = np.unique(lh, return_index=True)
    out["n_dup_lines"] = lines - np.bincount(ld[firsts], minlength=n)

    key = word + by_doc
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[first], counts)
    w = np.maximum(nw, 1)
    chars = np.maximum(out["word_chars"], 1)
    out["x"] = np.stack([
        out["n_symbols"] / chars, out["n_repeat_words"] / w, out["n_dup_lines"] / np.maximum(lines, 1), sums(_UPPER[data], off) / chars, sums(_BANG[data], off) / w, sums(_DIGIT[data], off) / chars,
        np.bincount(doc[first], minlength=n) / np.sqrt(w), out["word_chars"] / w, np.log1p(nw), nw / np.maximum(lines, 1), sums(_STOP[data], off) / w, most / w,
    ], 1)
    return out


def _more_than_once(h: np.ndarray) -> np.ndarray:
    order = np.argsort(h)
    s = h[order]
    eq = np.zeros(len(h), bool)
    if len(h) > 1:
        same = s[1:] == s[:-1]
        eq[1:] |= same
        eq[:-1] |= same
    out = np.zeros(len(h), bool)
    out[order] = eq
    return out


def _batches(column: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    data, off = as_bytes(column)
    for a, b in groups_of(off, 1 << 20):
        yield a, b, statistics(data[off[a] : off[b]], off[a : b + 1] - off[a])


def _training(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi, s in _batches(b.column("text")):
                yield pa.record_batch({"q": b.column("_q").slice(lo, hi - lo).cast(pa.int32()), "x": pa.array(list(s["x"]), pa.list_(pa.float64()))})

    # the chosen ids are bounded by `rows`, so their broadcast is too
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_q")
    got = picked.mapInArrow(run, "q int, x array<double>").toArrow()
    order = sorted(zip(got.column("q").to_pylist(), got.column("x").to_pylist(), strict=True))
    return np.array([x for _, x in order], float).reshape(len(order), len(FEATURES)), np.array([1 - q for q, _ in order], float)


def model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> gbt.Forest:
    """Trees for P(quality = 0), fitted on a bounded sample of labelled rows."""
    x, y = _training(docs, labels, rows)
    return gbt.fit(x, y, list(FEATURES.values()))


def score(docs: DataFrame, forest: gbt.Forest, reject: float = REJECT) -> DataFrame:
    """A row per document: doc_id, the exact counts, base_failed, low_quality (a probability), kept.  One pass, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi, s in _batches(b.column("text")):
                bad = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
                p = forest.probability(s["x"])
                cols = {"doc_id": b.column("doc_id").slice(lo, hi - lo)}
                cols |= {k: pa.array(s[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                yield pa.record_batch(cols | {"base_failed": pa.array(bad), "kept": pa.array(~bad & (p <= reject)), "low_quality": pa.array(p)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, low_quality double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    forest = model(docs, labels)
    names = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi, s in _batches(b.column("text")):
                ok = (s["n_words"] >= 50) & (100 * s["n_repeat_words"] <= 50 * s["n_words"])
                ok &= forest.probability(s["x"]) <= REJECT
                yield b.slice(lo, hi - lo).filter(pa.array(ok))

    return docs.select(*names).mapInArrow(run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, model(docs, table(spark, sf_dir, "labels")))
