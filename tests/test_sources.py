"""Paged sources, retries, document files, models and their artifacts, settled budgets."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfathom.operators import corpus, document, models, ngram, probes
from inkfathom.sources import documents, paged
from inkfathom.streaming import limiter


def test_paged_rows_and_posts(spark, tmp_path):
    long = " ".join(["word"] * 120)
    for p in range(4):
        rows = [{"k": p * 10 + i, "text": f"{long} {i % 2 if p < 2 else p}", "flag": ["Yes", "No", "Maybe"][i % 3]} for i in range(3)]
        (tmp_path / f"{p}.json").write_text(json.dumps(rows))
    options = {"fetch": "inkfathom.sources.paged:json_page", "path": str(tmp_path), "pages": "6"}
    got = paged.flagged_rows(spark, options, "k bigint, text string, flag string", "text", "flag")
    assert sorted(r.k for r in got.collect()) == [0, 1, 20, 30]  # each text once, flags Yes and No, missing pages are empty
    assert [r.k for r in paged.flagged_rows(spark, options, "k bigint, text string, flag string", "text", "flag", target=2).collect()] == [0, 1]
    assert spark.read.format("paged_rows").schema("k bigint").options(**options, stride="3").load().count() == 6
    (tmp_path / "0.json").write_text(json.dumps([{"id": "a", "date": "2022-11-30T10:00", "html": f"<h1>no</h1><p>{long} &amp; <b>more</b></p><p>{long}</p>"}, {"id": "b", "date": "2022-12-01", "html": f"<p>{long} {long}</p>"}, {"id": "c", "date": "2020-01-01", "html": None}]))
    r = paged.posts_before(spark, options | {"pages": "1"}).collect()
    assert [x.id for x in r] == ["a"] and "& more\n\nword" in r[0].text and r[0].n_words == 242


def test_pages_of_a_folder_of_parquet_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    sizes = (7, 0, 1, 23, 9)
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    for i, (a, n) in enumerate(zip(starts, sizes)):  # pages go over files and row groups, an empty file included
        pq.write_table(pa.table({"k": pa.array(range(a, a + n), pa.int64()), "other": pa.array(["x"] * n, pa.string())}), folder / f"part-{i}.parquet", row_group_size=5)
    (folder / "_SUCCESS").write_text("")
    for path in (str(folder), f"file://{folder}"):
        options = {"fetch": "inkfathom.sources.paged:parquet_page", "path": path, "pages": "7", "page_size": "6", "columns": "k"}
        assert [[r["k"] for r in paged.parquet_page(options, p)] for p in range(8)] == [list(range(p * 6, min(40, p * 6 + 6))) for p in range(8)]
    paged.register(spark)
    assert sorted(r.k for r in spark.read.format("paged_rows").schema("k bigint").options(**options).load().collect()) == list(range(40))
    single = options | {"path": str(folder / "part-3.parquet")}
    assert [r["k"] for r in paged.parquet_page(single, 3)] == list(range(26, 31))


def test_unknown_format_raises(spark):
    with pytest.raises(Exception, match="(?i)data.?source|find"):
        spark.read.format("no_such_rows").load()


def test_retry_waits_longer_each_time():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("late")
        return "page"

    assert paged.with_retry(call, sleep=waits.append) == "page" and waits == [2, 4, 6]
    with pytest.raises(OSError):
        paged.with_retry(lambda: (_ for _ in ()).throw(OSError("gone")), sleep=waits.append)
    assert waits[3:] == [2, 4, 6, 8]


def test_document_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:r><w:t>First</w:t><w:tab/><w:t>line</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:p><w:r><w:instrText>PAGE</w:instrText><w:t>Second</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.txt").write_text("plain", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.problem) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("First\tline\nSecond", None), "b.txt": ("plain", None), "c.pdf": (None, "pdf is not read"), "d.docx": (None, "BadZipFile")}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + 0.3)))).astype(int)
    return spark.createDataFrame([(f"d{i}", f"g{i % 12}", float(a), float(b), int(c), float(i % 30)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "doc_id string, source string, a double, b double, label int, log_sentences double").cache()


def test_fits_reach_the_minimum(labelled):
    pdf = labelled.toPandas()
    for (fitted, intercept), penalty in ((models.fit_gate(labelled, ["a", "b"], "label"), 1 / 400), (models.fit_probe(labelled, ["a", "b"], "label"), 1e-3)):
        z = np.stack([np.clip((pdf[n] - p["mean"]) / p["scale"], -5, 5) for n, p in fitted.items()], 1)
        w = np.array([intercept, *(p["coef"] for p in fitted.values())])
        assert models.gradient_norm(z, pdf["label"].to_numpy(), w, penalty) < 1e-6


def test_platt_knots(spark, labelled):
    x = document.out_of_fold(labelled, ["a", "b"], "source")
    knots = models.platt_knots(x, "probability", "label", "source")
    assert len(knots) == 201 and all(0 < p < 1 for p in knots) and knots == sorted(knots)
    out = x.select("probability", models.interpolate(F.col("probability"), knots).alias("c")).collect()
    grid = np.linspace(0, 1, 201)
    assert [r.c for r in out] == pytest.approx([float(np.interp(r.probability, grid, knots)) for r in out])
    assert models.platt_knots(x.where("source < 'g2'"), "probability", "label", "source") is None  # three groups
    assert models.platt_knots(x.where("label = 1"), "probability", "label", "source") is None
    same = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "p double").select(models.interpolate(F.col("p"), knots).alias("c")).collect()
    assert same[0].c == knots[0] and same[1].c == knots[-1] and same[2].c is None


def test_unfitted_models(spark):
    x = spark.createDataFrame([(0.7,)], "max_p double").select(models.gate_probability(None).alias("g"), models.document_probability(None).alias("d")).first()
    assert (x.g, x.d) == (1.0, 0.7)


def test_artifacts_round_trip(spark, labelled, tmp_path):
    fitted, intercept = models.fit_gate(labelled, ["a", "b"], "label")
    models.save_model(spark, str(tmp_path / "m"), fitted, intercept, threshold=0.2, knots=[0.0, 1.0])
    assert models.load_model(spark, str(tmp_path / "m")) == (fitted, intercept, {"threshold": 0.2, "knots": [0.0, 1.0]})
    m = ngram.fit(spark.createDataFrame([(1, "the cat's hat sat on the mat"), (2, "the cat ran")], "k int, text string"), "k", min_count=1)
    models.save_ngrams(m, str(tmp_path / "n"))
    back = models.load_ngrams(spark, str(tmp_path / "n"))
    for k in ("uni", "bi", "tri", "meta"):
        assert back[k].select(*m[k].columns).exceptAll(m[k]).count() == m[k].exceptAll(back[k].select(*m[k].columns)).count() == 0


def test_protocols(labelled):
    gen = F.when(F.col("label") == 1, F.concat(F.lit("m"), (F.col("log_sentences") % 3).cast("int")))
    loo = {r.left_out: r for r in models.leave_one_out(labelled, ["a", "b"], "label", gen).collect()}
    assert set(loo) == {"m0", "m1", "m2"} and all(0.6 < r.auroc < 1 for r in loo.values())
    c = {r.control.split("_")[0] + "_" + r.control.split("_")[-1]: r.auroc for r in models.control_battery(labelled, ["a", "b"], "label", "log_sentences").collect()}
    assert c["all_all"] > 0.75 and abs(c["shuffled_features"] - 0.5) < 0.15 and abs(c["length_only"] - 0.5) < 0.15 and len(c) == 6
    a = models.arm(labelled, ["a", "b"], "label", "doc_id").collect()
    assert all(r.probability == pytest.approx(1 / (1 + math.exp(-(r.a_term + r.b_term + r.intercept)))) for r in a) and 0.02 < sum(r.flagged for r in a) / 400 < 0.6


def test_probes(spark, labelled):
    p = probes.permutation_p(labelled, "a", "b", "doc_id", 200).first()
    assert p.p_value > 0.01 and abs(p.rho) < 0.2
    assert probes.permutation_p(labelled.withColumn("c", F.col("a") * 2), "a", "c", "doc_id", 200).first().p_value == pytest.approx(1 / 201)
    r2 = {r.feature: r.r2 for r in probes.collinearity(labelled.withColumn("c", F.col("a") + F.col("b")).withColumn("one", F.lit(1.0)), ["a", "log_sentences", "one"]).collect()}
    assert r2["a"] < 0.1 and r2["one"] is None
    m = probes.mcnemar(spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 5, "x boolean, y boolean"), F.col("x"), F.col("y")).first()
    assert (m.b, m.c, m.p_value) == (8, 2, pytest.approx(0.109375))
    with pytest.raises(ValueError):
        corpus.add_new_columns(labelled, {"a": F.lit(1)})


def test_settled_budget(spark):
    rows = [(i, f"2024-01-0{1 + i // 6} 10:00:0{i % 6}", 3000.0, 1000.0, o) for i, o in enumerate(["ok", "failed_after", "ok", "ok", "ok", "ok", "failed_before", "ok", "ok"])]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, est double, actual double, outcome string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r.spent_before, r.admitted) for r in limiter.settled_budget(df).orderBy("event_id").collect()]
    assert got == [(0, True), (1000, True), (4000, True), (5000, False), (5000, False), (5000, False), (0, True), (0, True), (1000, True)]
