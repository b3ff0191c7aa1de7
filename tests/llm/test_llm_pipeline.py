"""The pipeline's stages, one after the other."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ashlar.llm import pii, similar


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == names
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert ids["near_dedup"] < ids["quality_rules"] and ids["near_dedup"] == ids["pii"] == ids["mixing"] == ids["packing"]
    assert not any(re.search(r"@mail\d+\.example\.com", r.text) for r in seen["pii"].collect())
    assert seen["mixing"].count() >= seen["pii"].count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, ties, columns with clashing names, and an empty table."""
    long = " ".join(f"w{i % 701}x{i % 1301}" for i in range(40_000))
    some = "a text of its own with words that differ one from another and more than fifty of them so that the base rule keeps it " * 1 + " ".join(f"n{i}" for i in range(60))
    rows = [(1, ""), (2, None), (None, some + " null id"), (3, long), (4, some), (4, some), (5, some + " tail"), (5, "other " + long[:9000]), (6, " \n\t"), (7, long), (None, None)]
    odd = spark.createDataFrame([(i, t, "en", "s", 1, "k", 2, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _pii_kinds string, _similar_key long, _mixing_key string")
    sf = "/root/testdata/sf0.001"
    for start in (odd, odd.limit(0)):
        docs, names = start, start.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{start is odd}")
            stage(spark, docs, sf).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "packing":
                assert docs.columns == names, name
            if start is odd and k == 0:
                assert {r.doc_id for r in docs.collect()} <= {None, 3, 4, 5, 7}
            if start is odd and k == 1:
                assert len({(r.doc_id, r.text) for r in docs.collect()}) == docs.count()
        assert (docs.count() > 0) == (start is odd)


def test_near_dedup_discards_by_fingerprints_and_pivots(monkeypatch):
    """In one bucket: unrelated texts go by their fingerprints alone, near ones are joined as without them, and repeats don't count."""
    rng = np.random.default_rng(4)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    groups = [text(n) for n in (7, 9, 40, 60, 90, 150, 300, 500)]
    texts = [w[: len(w) - k % (len(w) // 20 + 1)] + text(k % (len(w) // 20 + 1)) + w[:6] * (k % 3) for w in groups for k in range(12)] + [text(80) for _ in range(100)]
    made = [similar.sketch(" ".join(texts[i]).encode(), 5) for i in rng.permutation(len(texts))]
    packed = np.array([np.frombuffer(m[1], np.uint8) for m in made])
    value = np.stack([packed >> 4, packed & 15], 2).reshape(len(made), -1)
    prints = np.array([np.frombuffer(m[2], np.uint64) for m in made])
    verified, near = [], similar._near
    monkeypatch.setattr(similar, "_near", lambda v, at, x, least: (verified.append(similar.estimate(v[at], v[x])), near(v, at, x, least))[1])
    links = list(similar.spanning(value, 0.8, prints))
    some = np.concatenate(verified)
    verified.clear()
    every = list(similar.spanning(value, 0.8))
    assert len(links) > 60 and joined(range(len(made)), links) == joined(range(len(made)), every)
    assert some.min() > 0.3 and 4 * len(some) < len(np.concatenate(verified))
    line, words = " ".join(text(12)), " ".join(text(200))
    a, b = (np.frombuffer(similar.sketch(f"{words}\n{line}{f'{chr(10)}{line}' * k}".encode(), 5)[2], np.uint64) for k in (1, 30))
    assert (a == b).all()


def joined(nodes, links):
    """The groups, each as the set of its members, that links make."""
    at = {i: {i} for i in nodes}
    for a, b in links:
        at[a] |= at[b]
        for i in at[b]:
            at[i] = at[a]
    return at


def test_redrawn_plans_are_small(spark, monkeypatch):
    """The driver keeps a plan and its changes, so none has the large expression of a surrogate twice."""
    length = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    one = length(spark.createDataFrame([("a@b.com", 0)], "e string, attempt int").select(pii.surrogates(F.array("e"), lambda _: F.col("attempt"), "k")[0]))
    plans, store = [], pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, name: (plans.append(length(df)), store(df, name))[1])
    docs = spark.createDataFrame([(i, f"write to {c}@example.com or call +1 212 555 01{i:02}") for i, c in enumerate("abcdefghijklmnopqrst")], "doc_id long, text string")
    again = pii.redrawn(docs, "k").collect()
    assert again and max(plans) < 2 * one


def test_stages_decode_few_rows(spark, sf_dir):
    """Each stage has the JVM decode few rows of a table at a time, unless the session says how many."""
    docs, setting = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0), "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(setting)
    try:
        for start, then, stages in (("4096", "256", corpus_pipeline.STAGES), ("1000", "1000", corpus_pipeline.STAGES[:1])):
            for name, stage in stages:
                spark.conf.set(setting, start)
                stage(spark, docs, sf_dir)
                assert spark.conf.get(setting) == then, name
    finally:
        spark.conf.set(setting, before)


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
