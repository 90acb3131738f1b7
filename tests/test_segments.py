"""Segmentation, tiling, ranks and quantiles on literal cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfathom.operators import metrics, ngram, ranks, segments


def cut(text):
    return [text[a:b] for a, b in segments.sentence_spans(text)]


def test_guards():
    assert cut("Dr. Ito met Mr. J. K. Roe at 3.5 p.m. on Jan. 5. They left.") == ["Dr. Ito met Mr. J. K. Roe at 3.5 p.m. on Jan. 5.", "They left."]
    assert cut("Alder Inc. and Corp. of Ltd. are firms. Yes!") == ["Alder Inc. and Corp. of Ltd. are firms.", "Yes!"]
    assert cut('He said "Stop!" and ran. "Why?" Nobody knew...') == ['He said "Stop!" and ran.', '"Why?"', "Nobody knew..."]
    assert cut("See site.com now. it goes on.\nnext line. Then") == ["See site.com now. it goes on.", "next line.", "Then"]


def test_paragraphs_end_sentences():
    text = "  A title\n \n First one. Second\n\n\n"
    assert cut(text) == ["A title", "First one.", "Second"] and [text[a:b] for a, b in segments.paragraph_spans(text)] == ["A title", "First one. Second"]
    assert cut("") == cut(" \n\n ") == []


def test_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "One. Two words here now."), (2, None), (3, "")], "k int, text string").withColumn("sentence_index", F.lit("x"))
    assert [(r.k, r.sentence_index, r.text) for r in segments.sentences(df, ["k"]).orderBy("k", "sentence_index").collect()] == [(1, 0, "One."), (1, 1, "Two words here now.")]
    assert [r.text for r in segments.words(df, ["k"]).orderBy("word_index").collect()] == ["here", "now."]


def test_tiling():
    assert segments.tile("abcd", ["ab", "x", "bc", "cd"]) == [(0, 2), (2, 4)] and segments.tile("abc", ["a", "c"]) is None and segments.tile("", []) == []
    assert segments.tile("aaa", ["a", "aa", "a", "a"]) in ([(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 3)])


def test_ranks_and_quantiles(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), float(r.randint(0, 30)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, i int").repartition(5)
    got = {(x.g, x.i): x.n for x in ranks.row_numbers(df, [F.col("x"), F.col("i")], ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((x, i) for k, x, i in rows if k == g)
        assert [got[g, i] for _, i in own] == list(range(1, len(own) + 1))
        q = ranks.quantiles(df, ["g"], "x", [0.1, 0.5, 0.95]).where(F.col("g").eqNullSafe(g)).orderBy("share").collect()
        assert [y.value for y in q] == pytest.approx(list(np.percentile([x for x, _ in own], [10, 50, 95])))
    assert ranks.quantiles(df.where("x > 99"), [], "x", [0.5]).count() == 0


def test_bounds_do_not_grow_with_counts():
    k, n = np.array([0, 3, 50, 5001, 6000]), np.array([10, 10, 1000, 20000, 12001])
    assert metrics.cp_upper_values(k, n)[:3] == pytest.approx([0.2588655509, 0.6066242161, 0.0628634035], abs=1e-9)
    near = metrics.cp_upper_values(np.array([5000, 5001]), np.array([20000, 20000]))
    assert 0 < near[1] - near[0] < 1e-4 and metrics.cp_upper_value(10**9, 10**10) == pytest.approx(0.100005, abs=1e-6)


def test_crossed_bands_collapse_to_the_machine_cut(spark):
    df = spark.createDataFrame([(i / 1000, i % 2) for i in range(1000)], "p double, y int")
    b = metrics.fit_bands(df.where("p < 0.2 AND y = 0").unionAll(df.where("p > 0.8 AND y = 1")), "p", "y").first()
    assert b.t_human == b.t_machine and b.observed_fpr <= 0.05 and b.n_human == 100
    none = metrics.fit_bands(spark.createDataFrame([(0.5, 0), (0.5, 1)], "p double, y int"), "p", "y").first()
    assert (none.t_machine, none.t_human) == (1.0, 0.0)


def test_packed_keys_round_trip_and_refusal(spark, monkeypatch):
    m = ngram.fit(spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the cat ran")], "k int, text string"), "k", min_count=1)
    back = ngram.unpacked(ngram.packed_keys(m), m)
    assert back.exceptAll(m["bi"]).count() == m["bi"].exceptAll(back).count() == 0
    monkeypatch.setattr(ngram, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        ngram.packed_keys(m)
