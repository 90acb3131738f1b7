"""Literal cases and independent restatements of single operators."""

import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfathom.functions import text as X
from inkfathom.operators import context, corpus, document, features, metrics, ngram
from inkfathom.sources import files
from inkfathom.streaming import limiter

VERDICT = "doc_id string, source_id string, sentence_index int, char_start int, char_end int, text string, probability double, n_words int, smoothed double, reliable boolean, model string, scored_at timestamp"


def verdicts(spark, rows):
    return spark.createDataFrame([("d", None, i, 10 * i, 10 * i + 9, "t", p, w, None, r, "m", None) for i, (p, w, r) in enumerate(rows)], VERDICT)


def test_canonical_and_flatten(spark):
    df = spark.createDataFrame([("“a”\r\n\r\n\r\n\r\nb — c…  d ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.canonical(F.col("t"))).collect()] == ['"a"\n\nb - c... d', "", None]
    assert df.select(X.flatten(F.lit(" a \n \n b "))).first()[0] == "a b"
    assert [r[0] for r in df.select(X.count_words(F.col("t"))).collect()] == [5, 0, None]


def test_surface_literals(spark):
    rows = [(1, "We came, we saw, and we won it all."), (2, "It was not just long but also dull today."), (3, "Too short here"), (4, None), (5, "")]
    r = {x.id: x for x in features.surface_features(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert r[1].tricolon == 1.0 and r[1].antithesis == 0.0 and r[1].n_words == 9.0
    assert r[2].antithesis == 1.0 and r[2].tricolon == 0.0
    assert all(r[i][c] is None for i in (3, 4, 5) for c in features.SURFACE)


def test_observer_features_against_numpy(spark):
    rng = np.random.default_rng(1)
    n = 40
    lp, rank = rng.normal(-3, 1, n), rng.integers(1, 500, n)
    rows = [("a", i, float(lp[i]), int(rank[i]), 2.0 + i % 3, -3.0, 1.5) for i in range(n)] + [("b", i, -1.0, 1, 1.0, -1.0, 1.0) for i in range(3)]
    t = spark.createDataFrame(rows, "k string, tok_idx int, logprob double, rank int, entropy double, mu double, sigma2 double")
    r = {x.k: x for x in features.observer_features(t, ["k"]).collect()}
    assert all(r["b"][c] is None for c in features.OBSERVER)
    a = r["a"]
    assert a.logprob_sd == pytest.approx(lp.std(ddof=1)) and a.logprob_iqr == pytest.approx(np.subtract(*np.percentile(lp, [75, 25])))
    assert a.surprisal_autocorr == pytest.approx(np.corrcoef(lp[:-1], lp[1:])[0, 1])
    assert a.lrr == pytest.approx(-lp.mean() / np.log(rank).mean()) and a.curvature == pytest.approx((lp.mean() + 3) / math.sqrt(1.5))


def test_constant_tokens_have_no_autocorrelation(spark):
    t = spark.createDataFrame([("a", i, -1.0, 1, None, None, None) for i in range(6)], "k string, tok_idx int, logprob double, rank int, entropy double, mu double, sigma2 double")
    assert features.observer_features(t, ["k"]).first().surprisal_autocorr is None


def plain_loo(x):
    out = []
    for i, v in enumerate(x):
        o = [y for j, y in enumerate(x) if j != i]
        m = median(o)
        scale = 1.4826 * median([abs(y - m) for y in o])
        if scale < 1e-9:
            scale = float(np.std(o, ddof=1))
        out.append((0.0 if abs(v - m) < 1e-9 else math.copysign(6, v - m)) if scale < 1e-9 else max(-6, min(6, (v - m) / scale)))
    return out


@pytest.mark.parametrize("x", [[5, 5, 5, 5, 5, 9], [1, 2, 3, 4, 5, 1e9], [1, 2, 3, 4, 5, -1e9], [3, 3, 3, 3, 3, 12], [random.Random(i).randint(0, 6) for i in range(30)]])
def test_leave_one_out(x):
    assert context.loo_z(np.array(x, float)) == pytest.approx(plain_loo([float(v) for v in x]))


def test_loo_needs_three_others():
    assert np.isnan(context.loo_z(np.array([1.0, 2.0, 3.0]))).all()


def test_context_is_null_under_five_sentences(spark):
    df = spark.createDataFrame([("d", i, 5) for i in range(4)], "doc_id string, sentence_index int, n_words int")
    assert all(r.len_z_in_doc is None and r.rel_position is None for r in context.context_features(df).collect())


def test_smoothing(spark):
    s = [r.smoothed for r in document.smoothed(verdicts(spark, [(0.02, 20, True), (0.02, 20, True), (0.95, 20, True), (0.02, 20, True), (0.02, 20, True)])).orderBy("sentence_index").collect()]
    assert 0.02 < s[2] < 0.95
    s = [r.smoothed for r in document.smoothed(verdicts(spark, [(0.05, 20, True), (0.99, 466, False), (0.05, 20, True)])).orderBy("sentence_index").collect()]
    assert s == pytest.approx([0.05, 0.99, 0.05])


def test_passages_break_at_unreliable(spark):
    v = verdicts(spark, [(0.9, 10, True), (0.9, 10, False), (0.9, 10, True), (0.1, 10, True), (0.8, 10, True)]).withColumn("smoothed", F.col("probability"))
    assert sorted((r.first_sentence, r.sentences) for r in document.passages(v).collect()) == [(0, 1), (2, 1), (4, 1)]


def test_verdict_of_nothing_measurable(spark):
    r = document.verdicts(verdicts(spark, [(0.9, 466, False)])).first()
    assert (r.machine_share, r.n_reliable_sentences, r.n_words) == (0.0, 0, 466)


def test_bootstrap_bounds(spark):
    rows = [(0.9, 20, True)] * 5 + [(0.05, 20, True)] * 5
    v = verdicts(spark, rows)
    r, share = document.bootstrap_share(v, 0.5).first(), document.verdicts(v, 0.5).first().machine_share
    assert r.low <= share <= r.high
    assert tuple(document.bootstrap_share(verdicts(spark, rows[:2]), 0.5).first())[1:] == (0.0, 1.0)


def test_contributions_sum_to_logit_and_null_gives_zero(spark):
    p = {"x": {"mean": 1.0, "scale": 2.0, "coef": 0.5}, "y": {"mean": 0.0, "scale": 1.0, "coef": -1.0}}
    df = spark.createDataFrame([(3.0, None), (1e9, 1.0)], "x double, y double")
    c = document.contributions(p)
    assert [tuple(r) for r in df.select(*c.values()).collect()] == [(0.5, 0.0), (2.5, -1.0)]


def test_gate_drops_zeros(spark):
    df = spark.createDataFrame([("d", 10.0, 0.0), ("d", 10.0, 4.0), ("d", 20.0, None)], "doc_id string, n_words double, first_person_rate double")
    assert document.gate_features(df, ("first_person_rate",)).first().first_person_rate == 4.0


def test_fitted_detector_separates(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(r.gauss(i % 2, 0.3), r.gauss(0, 1), i % 2) for i in range(200)], "x double, y double, label int")
    p, _ = document.fit_detector(df, ["x", "y"])
    assert p["x"]["coef"] > abs(p["y"]["coef"])


def test_auroc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1), (None, 1)], "p double, y int")
    assert metrics.auroc(df, "p", "y", []).first().auroc == 0.875
    assert metrics.auroc(df.where("y = 1"), "p", "y", []).first().auroc is None


def test_exact_upper_bound():
    assert metrics.cp_upper_value(0, 10) == pytest.approx(1 - 0.05 ** (1 / 10))
    assert metrics.cp_upper_value(10, 10) == 1.0 and metrics.cp_upper_value(0, 0) == 1.0


def test_bands_do_not_cross(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(min(1.0, max(0.0, r.gauss(0.3 + 0.4 * (i % 2), 0.1))), i % 2) for i in range(600)], "p double, y int")
    b = metrics.fit_bands(df, "p", "y").first()
    assert b.t_human <= b.t_machine


def test_ngram_fit_and_novelty(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the cat ran on the mat"), (3, "a dog sat"), (4, None)], "id int, text string")
    m = ngram.fit(docs, "id", min_count=1)
    assert m["meta"].first().n_documents == 4
    s = spark.createDataFrame([("same", "the cat sat on the mat"), ("odd", "zebra quark lamp violet"), ("two", "the cat")], "k string, text string")
    r = {x.k: x for x in ngram.corpus_features(s, ["k"], m).collect()}
    assert r["same"].corpus_surprisal_mean < r["odd"].corpus_surprisal_mean and r["odd"].novel_trigram_rate == 1.0
    assert r["two"].corpus_surprisal_mean is None


def test_limiter():
    hits, got = [], []
    for t in range(0, 70, 5):
        ok, hits = limiter.admit(hits, float(t))
        got.append(ok)
    assert got[:6] == [True] * 6 and got[6] is False and got[12] is True


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, 1_700_000_000 + 7 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, s bigint").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = limiter.rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("admitted").collect())) == sorted(map(tuple, limiter.rate_limit(df).collect()))


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "s", "é\nx", "human", "train", 2, "h", "{}")], files.DOCUMENT)
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j")).collect() == df.collect()
    (tmp_path / "a.json").write_text('[{"text": "one", "k": "v"}, {"text": " "}, {"text": "three"}]')
    assert [r.id for r in files.read_json_array(spark, str(tmp_path / "a.json"), "src").collect()] == ["src:0000", "src:0002"]
    pages = spark.createDataFrame([("<h3>T</h3><p>one two</p><p>three</p><h3>U</h3><p>x</p>",), (None,)], "html string")
    assert [tuple(r) for r in files.html_sections(pages, least=2, most=9).collect()] == [("T", "one two\n\nthree")]
    (tmp_path / "c.csv").write_text('text,score\n"a b\nc",3.5\n"d e f",none\n')
    assert [r.proficiency for r in files.read_csv_documents(spark, str(tmp_path / "c.csv"), "text", "score", 3).collect()] == [3.5, None]


def test_first_wins_and_budget(spark):
    df = spark.createDataFrame([("h", 2, "b"), ("h", 1, "a"), ("k", 1, "c")], "sha string, seq int, id string")
    assert sorted(r.id for r in corpus.first_by(df, ["sha"], ["seq"]).collect()) == ["a", "c"]
    c = spark.createDataFrame([(i, 4.0) for i in range(5)], "i int, cost double")
    assert [r.i for r in corpus.within_budget(c, [], ["i"], "cost", 9.0).orderBy("i").collect()] == [0, 1, 2]


def test_resampled_auroc_and_budget_cut(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(min(1.0, max(0.0, r.gauss(0.4 + 0.2 * (i % 2), 0.2))), i % 2) for i in range(400)], "p double, y int")
    x = metrics.auroc_resampled(df, "p", "y", 500).first()
    assert x.low <= x.auroc <= x.high and x.p_value < 0.05 < x.null95 < 0.6
    assert metrics.auroc_resampled(df.where("y = 1"), "p", "y").count() == 0
    c = metrics.budget_cut(df.where("y = 0"), "p", 0.1).first()
    assert c.k / c.n <= 0.1 and metrics.budget_cut(df.where("y = 0"), "p", 0.1, "below").first().k <= c.n * 0.1
    assert metrics.budget_cut(df.where("y = 5"), "p", 0.1).count() == 0
