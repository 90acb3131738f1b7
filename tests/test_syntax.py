"""Structural features on literal parses."""

import math

import pytest

from inkfathom.operators import syntax

SCHEMA = "doc_id string, sentence_index int, i int, head int, pos string, is_stop boolean, is_punct boolean"


def parse(spark):
    rows = [("d", 0, 0, 1, "DET", True, False), ("d", 0, 1, 2, "NOUN", False, False), ("d", 0, 2, 2, "VERB", False, False), ("d", 0, 3, 2, "PUNCT", False, True), ("d", 0, 4, 2, "ADV", False, False)]
    rows += [("d", 1, 0, 1, "X", False, False), ("d", 1, 1, 0, "X", False, False)]  # a cycle
    rows += [("d", 2, i, min(i + 1, 39), "N", False, False) for i in range(40)]  # a chain
    return spark.createDataFrame(rows, SCHEMA)


def test_depths(spark):
    got = {(r.sentence_index, r.i): r.depth for r in syntax.token_depths(parse(spark)).collect()}
    assert [got[0, i] for i in range(5)] == [2, 1, 0, 1, 1] and got[1, 0] is None and got[2, 0] == 39 and got[2, 39] == 0


def test_structure(spark):
    r = {x.sentence_index: x for x in syntax.structure(parse(spark)).collect()}
    # Depths 2, 1, 0, 1: the deviation is that of a sample; the root has three children, punctuation among them.
    assert (r[0].tree_depth_max, r[0].tree_depth_mean, r[0].branching_factor) == (2, 1.0, 2.0) and r[0].tree_depth_sd == pytest.approx(math.sqrt(2 / 3))
    assert r[0].content_function_ratio == 3.0 and r[0].pos_trigram_entropy == 1.0 and r[0].stopword_ratio == pytest.approx(1 / 4)
    assert 1 not in r and r[2].tree_depth_max == 39  # a cycle, and too short


def test_context_of_structure(spark):
    rows = [("d", i, float(d), 1.0 + i % 2) for i, d in enumerate([3, 4, 3, 4, 3, 20])] + [("e", i, 2.0, 1.0) for i in range(4)]
    got = {(r.doc_id, r.sentence_index): r for r in syntax.context(spark.createDataFrame(rows, "doc_id string, sentence_index int, tree_depth_max double, pos_trigram_surprisal double")).collect()}
    assert got["d", 5].tree_depth_z_in_doc == 6.0 and abs(got["d", 0].tree_depth_z_in_doc) < 2 and got["d", 2].local_depth_burstiness > 0
    assert all(got["e", i].tree_depth_z_in_doc is None and got["e", i].local_depth_burstiness is None for i in range(4))


def test_tag_surprisal(spark):
    seen = [("d", k, i, 0, p, False, False) for k in range(40) for i, p in enumerate(["PRON", "VERB", "NOUN"])]
    m = syntax.tag_model(spark.createDataFrame(seen, SCHEMA))
    new = [("x", 0, i, 0, p, False, False) for i, p in enumerate(["PRON", "VERB", "NOUN"])] + [("x", 1, i, 0, p, False, False) for i, p in enumerate(["NOUN", "ZZ", "PRON"])]
    r = {x.sentence_index: x.pos_trigram_surprisal for x in syntax.tag_surprisal(spark.createDataFrame(new, SCHEMA), m).collect()}
    assert 0 <= r[0] < r[1] and math.isfinite(r[1])
