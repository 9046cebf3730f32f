"""Quality rules and the additive model."""

import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from floodgrid.llm import quality_gam, quality_rules

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_match_plain_python(spark, odd, prose):
    rng = random.Random(1)
    repeated = [(1000 + i, " ".join(rng.choices("abcde", k=rng.randint(0, 60))), "s") for i in range(60)]
    for table in (odd, spark.createDataFrame(prose + repeated, "doc_id bigint, text string, source string")):
        counts = quality_rules.with_counts(table)
        assert counts.count() == table.count()
        for r in counts.collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == plain_counts(r.row.text), r.row.doc_id


def plain_estimate(patterns, k, rounds):
    """The same expectation-maximisation, written out."""
    theta = [0.8] + [0.999] * k + [0.3] * k
    for _ in range(rounds):
        sums = [0.0] * (2 + 4 * k)
        for v, n in patterns:
            odds = math.log(theta[0] / (1 - theta[0]))
            for r in range(k):
                a, b = theta[1 + r], theta[1 + k + r]
                odds += {1: math.log(a / (1 - b)), -1: math.log((1 - a) / b), 0: 0.0}[v[r]]
            q = n / (1 + math.exp(-odds))
            cells = [q, n]
            for r in range(k):
                cells += [q * (v[r] == 1), q * (v[r] != 0), (n - q) * (v[r] == -1), (n - q) * (v[r] != 0)]
            sums = [a + b for a, b in zip(sums, cells)]
        theta = [(sums[0] + 1) / (sums[1] + 2)]
        theta += [(sums[2 + 4 * r] + 1) / (sums[3 + 4 * r] + 2) for r in range(k)]
        theta += [(sums[4 + 4 * r] + 1) / (sums[5 + 4 * r] + 2) for r in range(k)]
    return theta


def test_estimation_matches_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = quality_rules.with_counts(docs)
    patterns = [(r.v, r.n) for r in counts.groupBy(quality_rules.votes().alias("v")).agg(F.count("*").alias("n")).collect()]
    expected = plain_estimate(patterns, len(quality_rules.RULES), quality_rules.ROUNDS)
    assert np.allclose(quality_rules.estimate(counts), expected, rtol=1e-6)


def test_verdicts_agree_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.judge(docs).where("n_words >= 50").select("row.doc_id", "base_failed", "kept").join(labels, "doc_id")
    seen = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert seen.get((1, False), 0) <= 0.02 * seen[(1, True)]
    assert seen.get((0, True), 0) <= 0.1 * seen[(0, False)]


def test_rules_on_odd_and_empty_tables(spark, odd):
    judged = quality_rules.judge(odd)
    assert judged.count() == odd.count()
    assert judged.select("row.*").columns == odd.columns
    assert judged.where("n_words = 0 AND kept").count() == 0
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_kept_rows_are_those_judged_good_and_no_text_is_written(spark, odd, prose_table, tmp_path, monkeypatch):
    rows = prose_table.withColumn("row", F.lit("r")).unionByName(spark.sql("SELECT -1L AS doc_id, CAST(NULL AS STRING) AS text, 'a' AS source, 'r' AS row"))
    written = []
    monkeypatch.setattr(quality_rules, "materialize", lambda df, real=quality_rules.materialize: written.append(df.schema.simpleString()) or real(df))
    for table in (odd, rows, rows.limit(0)):
        want = sorted(map(str, quality_rules.judge(table).where("kept").select("row.*").collect()))
        written.clear()
        for words in (1, quality_rules.PLACE_WORDS):
            monkeypatch.setattr(quality_rules, "PLACE_WORDS", words)
            kept = quality_rules.kept_rows(table)
            assert kept.columns == table.columns
            assert sorted(map(str, kept.collect())) == want
        assert written and not any("text" in schema for schema in written)


def test_model_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit(x, y)
    fresh = rng.normal(size=(1000, 4))
    truth = (fresh[:, 0] > 0) ^ (fresh[:, 1] > 0)
    assert ((model.score(fresh) > 0.5) == truth).mean() > 0.9
    assert (0, 1) in model.pairs
    # A score is the base and one entry of each table.
    row = fresh[:1]
    total = model.base + sum(t[np.searchsorted(e, row[0, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
    total += sum(
        t[np.searchsorted(model.pair_edges[i], row[0, i], side="right"), np.searchsorted(model.pair_edges[j], row[0, j], side="right")]
        for (i, j), t in zip(model.pairs, model.pair_tables)
    )
    assert math.isclose(model.score(row)[0], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = quality_gam.classify(known, labels, keep=["doc_id"]).select("row.doc_id", "score").join(labels, "doc_id").toPandas()
    held = scored[[zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]]
    assert len(held) > 500
    rank, good = held.score.rank(), held.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98
    assert ((held.score >= 0.3) == good).mean() > 0.97


def test_model_on_odd_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(5, 1), (7, 0), (8, None), (None, 1)], "doc_id bigint, quality int")
    scored = quality_gam.classify(odd, labels).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality_gam.classify(odd.limit(0), labels).count() == 0
    alone = quality_gam.classify(odd, labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}
