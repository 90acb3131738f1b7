"""Pair and group operators against brute force on small random corpora."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from inkfathom.llm import components, crosssplit, graydup
from inkfathom.llm.textform import fold_python


def shingles(t, k=3):
    w = regex.findall(r"[\p{L}\p{M}\p{Nd}]+", fold_python(t).lower())
    return set(zip(*(w[i:] for i in range(k)), strict=False))


def similar(texts, least=0.5, k=3):
    s = {i: shingles(t, k) for i, t in texts.items() if t is not None}
    return {tuple(sorted((a, b))) for a, b in combinations(s, 2) if s[a] and s[b] and len(s[a] & s[b]) >= least * len(s[a] | s[b])}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    texts = {}
    for i in range(60):
        base = r.choices(words, k=r.randint(4, 80))
        for j in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = r.choice(words)
            texts[f"d{i:02}_{j}"] = " ".join(w)
    texts |= {"copy1": "a b c d", "copy2": "A, b c D!", "copy3": "a b c d", "short": "a b", "empty": "", "null": None, "long": " ".join(r.choices(words, k=20_000))}
    return texts


def frame(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in texts.items()] + [("copy1", "a b c d  "), (None, "a b c d")], "id string, text string")
    return df.withColumn("role", F.when(F.xxhash64("id") % 2 == 0, " Train").otherwise("ablation")).withColumn("source_id", F.lit("s")).withColumn("cls", F.lit(0)).withColumn("n", F.lit("x"))


def test_near_duplicates(spark, corpus):
    got = list(map(tuple, graydup.near_duplicate_pairs(frame(spark, corpus)).collect()))
    assert len(got) == len(set(got)) and set(got) == similar(corpus)


def test_near_duplicates_in_tiles(spark, corpus, monkeypatch):
    monkeypatch.setattr(graydup, "TILE", 4)
    assert set(map(tuple, graydup.near_duplicate_pairs(frame(spark, corpus)).collect())) == similar(corpus)


def test_near_duplicate_classes(spark, corpus):
    r = {x.id: x for x in graydup.near_duplicate_classes(frame(spark, corpus), "id", k=3, least=0.5).collect()}
    assert r["copy1"].copies == 3 and r["null"].class_id is None and r["short"].links == 0 and len(r) == len(corpus)


def test_gray_index_stores_sets_only_of_likely_pairs(spark, monkeypatch):
    words = random.Random(8)
    texts = [" ".join(f"w{words.randint(0, 10**6)}" for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([(f"k{i:02}", t) for i, t in enumerate([*texts, texts[0] + " more", texts[1]])], "id string, text string")
    stored, cut = [], graydup.cut_lineage
    for module in (graydup, graydup.shingles):
        monkeypatch.setattr(module, "cut_lineage", lambda x: [stored.append(got := cut(x)), got][1])
    assert set(map(tuple, graydup.near_duplicate_pairs(df).collect())) == {("k00", "k60"), ("k01", "k61")}
    assert sum(x.count() for x in stored if "sh" in x.columns) == 2  # of 61 classes


def test_unrelated_classes_of_one_node_are_no_candidates():
    rng = np.random.default_rng(4)
    n = 600
    table = pa.table({"node": np.zeros(n, np.int64), "cls": np.arange(n), **{f"f{w}": rng.integers(-(2**63), 2**63, n, dtype=np.int64) for w in range(4)}, **{c: np.zeros(n, np.int32) for c in ("block", "i", "j")}})
    found = list(graydup._search(graydup.max_distance(0.5))(iter(table.to_batches())))
    assert sum(b.num_rows for b in found) < n  # of 179,700 pairs


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.int64).view(np.uint64)
    words = np.repeat(base, 12, axis=0)
    for row in words:
        for b in rng.integers(0, 128, rng.integers(0, 9)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    i, j = graydup.GrayIndex(words).pairs(14)
    d = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)
    assert {tuple(sorted(p)) for p in zip(i, j, strict=True)} == {(a, b) for a, b in zip(*np.nonzero(d <= 14), strict=True) if a < b}


def test_gray_rank_orders_the_code():
    n = np.arange(256, dtype=np.uint64)
    code = np.stack([np.zeros(256, np.uint64), n ^ (n >> np.uint64(1))], 1)
    assert (graydup.gray_rank(code)[:, 1] == n).all()


def test_cross_split(spark, corpus):
    df = frame(spark, corpus)
    role = {r.id: r.role.strip().lower() for r in df.where("id IS NOT NULL").collect()}
    want = {p for p in similar(corpus) if {role[p[0]], role[p[1]]} == {"train", "ablation"}}
    got = list(map(tuple, crosssplit.cross_split_pairs(df).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    rep = crosssplit.cross_split_report(df).first()
    held = {x for p in want for x in p if role[x] == "ablation"}
    assert (rep.role, rep.overlapping, rep.essays) == ("ablation", len(held), sum(v == "ablation" for v in role.values()))


def test_cross_split_stores_a_set_once(spark, monkeypatch):
    words = random.Random(9)
    texts = [" ".join(f"w{words.randint(0, 10**6)}" for _ in range(40)) for _ in range(60)]
    rows = [(f"k{i:02}", t, "train", "s") for i, t in enumerate(texts)] + [("k60", texts[0] + " more", "ablation", "s"), ("k61", texts[1], "ablation", "s")]
    df = spark.createDataFrame(rows, "id string, text string, role string, source_id string")
    stored, cut = [], crosssplit.cut_lineage
    for module in (crosssplit, crosssplit.shingles):
        monkeypatch.setattr(module, "cut_lineage", lambda x: [stored.append(got := cut(x)), got][1])
    monkeypatch.setattr(crosssplit, "MEETINGS", 1, raising=False)  # lists are met in blocks
    assert set(map(tuple, crosssplit.cross_split_pairs(df).collect())) == {("k00", "k60"), ("k01", "k61")}
    assert sum(x.where("sh IS NOT NULL").count() for x in stored if "sh" in x.columns) == 61 + 2  # classes, and those of the pair


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id string, text string, role string, source_id string, meta string")
    assert graydup.near_duplicate_pairs(empty).count() == 0 and crosssplit.cross_split_pairs(empty).count() == 0 and components.essay_groups(empty).count() == 0


def test_components_against_union_find(spark):
    r = random.Random(6)
    edges = [(f"n{r.randint(0, 120):03}", f"n{r.randint(0, 120):03}") for _ in range(70)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("solo", "solo"), (None, "x"), ("n001", None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_essay_groups_and_splits(spark):
    rows = [("a", "s1", '{"author": " Kim "}'), ("b", None, '{"author": "kim"}'), ("c", "s0", '{"base_doc_id": "b"}'), ("d", None, None), ("e", None, '{"base_doc_id": "d"}'), ("f", None, '{"base_doc_id": "missing"}'), ("a", "s1", "{")]
    df = spark.createDataFrame(rows, "id string, source_id string, meta string")
    assert {r.id: r.group_id for r in components.essay_groups(df).collect()} == {"a": "s0", "b": "s0", "c": "s0", "d": "d", "e": "d", "f": "f"}
    many = spark.createDataFrame([(f"e{i:04}", f"s{i % 3 if i < 600 else i // 4}", None) for i in range(3000)], "id string, source_id string, meta string")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    s = components.essay_splits(many, targets)
    assert s.count() == 3000 and s.select("group_id", "split_name").distinct().count() == s.select("group_id").distinct().count()
    share = {r.split_name: r["count"] / 3000 for r in s.groupBy("split_name").count().collect()}
    assert abs(share["train"] - 0.8) < 0.05 and abs(share["test"] - 0.1) < 0.04
    assert components.essay_splits(many, targets.where("share > 1")).count() == 0
