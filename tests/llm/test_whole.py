"""Cases that cuts in the operators would lose."""

import random
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex

from inkfathom.llm import components, leakage, personal, sentences, textform, truncation


# --- look folding
def test_arabic_ligatures_equal_unicodedata(spark):
    many = textform.tables()[1]
    texts = [f"x{c}y {c}" for c in many if c >= "ﭐ"] + ["ﺍﻟﺴﻼﻡ", "السلام"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r.folded for r in sorted(textform.fold_text(df, "id").collect())]
    assert len(texts) > 400 and got == [unicodedata.normalize("NFKC", t) for t in texts] == [textform.fold_python(t) for t in texts]
    assert (len(texts) - 2, len(texts) - 1) in {tuple(r) for r in textform.same_look_pairs(df).collect()}


def test_every_table_entry_in_both_forms(spark):
    one, many, looks = textform.tables()
    pairs = [(f"x{c}y", f"x{to}y") for m in (one, many) for c, to in m.items() if not unicodedata.combining(to[0])] + [(f"x{c}y", f"x{to}y") for c, to in looks.items()]
    pairs += [(f"m{base}\u0302me", "m\u00eame") for base in ("\u0435", "e")]  # Cyrillic letter with an accent of its own
    df = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], "id int, text string")
    got = {r.id: r.folded for r in textform.fold_text(df, "id").collect()}
    assert len(pairs) > 1300
    assert [p for i, p in enumerate(pairs) if got[2 * i] != got[2 * i + 1] or textform.fold_python(p[0]) != got[2 * i]] == []


# --- personal information
def spans_of(text):
    return {(text[a:b], k) for a, b, k in personal.entities(text, personal.trained())}


def test_names_of_any_length_and_script():
    for text, name in [
        ("Last week Anna Maria van der Berg came by with her dog.", "Anna Maria van der Berg"), ("We met Juan Carlos de la Cruz Ortega at the fair.", "Juan Carlos de la Cruz Ortega"), ("The committee chair is Maria Lopez.", "Maria Lopez"),
        ("Меня зовут Ольга Петрова и я пишу вам.", "Ольга Петрова"), ("大家好，我叫王小明。", "王小明"), ("私は佐藤花子です。", "佐藤花子"), ("اسمي أحمد حداد.", "أحمد حداد"), ("मेरा नाम राम कुमार है।", "राम कुमार"),
    ]:
        assert (name, "name") in spans_of(text), text


def test_places_streets_and_nouns_are_no_names():
    for text in ["Beside Port Wendil, our coach slept.", "We walked down Copper Lane to the Harwin Mill Academy.", "Die Verkäuferin brachte den alten Koffer der Gemeinde im Garten.", "I was in U.S. schools on Monday.", "我高兴地在白天看书。", "Follow @kalvor3 there."]:
        assert not spans_of(text), text


def test_spans_do_not_depend_on_other_rows(spark):
    texts = ["We met Tolka Bresan at the fair.", "Kind regards,\nMaria Lopez"]
    many = [(i, texts[i % 2]) for i in range(300)] + [(900 + i, f"the tolka and the bresan, number {i}, and maria lopez") for i in range(300)]
    few, all_ = (spark.createDataFrame(rows, "doc_id bigint, text string") for rows in (many[:2], many))
    of = lambda df: {tuple(r) for r in personal.personal_spans(df).where("doc_id < 2").collect()}
    assert of(few) == of(all_) and len(of(few)) == 2


def test_towns_end_at_the_sentence():
    assert ("230 Quarry Rd, Vesper Mills", "address") in spans_of("Come by 230 Quarry Rd, Vesper Mills. I was there.")
    assert ("ул. Ленина, д. 5, кв. 12", "address") in spans_of("Живу: ул. Ленина, д. 5, кв. 12.")


def test_training_lines_are_not_taken_from_the_documents():
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    texts = pq.read_table(path, columns=["text"])["text"].to_pylist()
    runs = lambda t: {tuple(w[i : i + 6]) for w in [regex.findall(r"[\p{L}\p{M}']+", t.lower())] for i in range(len(w) - 5)}
    assert not set().union(*(runs(t) for t in texts if t)) & set().union(*(runs(t) for t, _ in personal.labelled_lines(4000)))
    whole = "\n".join(t for t in texts if t)
    assert not [p for f in personal._FRAMES for p in regex.split(r"\{[A-Z]\}", f.replace("\\n", "\n")) if len(p) >= 8 and p in whole]


# Frames that share no phrase with those of training.
HELD_OUT = """Somebody said that {N} had won.|Have you seen {N} lately?|{N} opened the door.|The prize went to {N} this year.|Photo: {N}|Thanks go out to {N}, our host.|Editor {N} read it twice.|For tickets, ring {P}.|Any news goes to {E} first.|Our landline is {P} and it rings.|{A} is where I grew up.|Leave the box at {A} before noon.
The permit bears {I}.|He gave his identity number as {I}.|Ayer vi a {N}.|Hier soir, {N} chantait.|Neulich kam {N} vorbei.|Send flowers to {N}, {A}.""".replace("\n", "|").split("|")


def test_held_out_frames():
    found = gold = both = 0
    for text, spans in personal.labelled_lines(800, 99, HELD_OUT):
        mine, true = set(personal.entities(text, personal.trained())), set(spans)
        found, gold, both = found + len(mine), gold + len(true), both + len(mine & true)
    assert gold > 500 and both >= 0.85 * gold and both >= 0.97 * found, (both / gold, both / found)


# --- sentences
def test_months_weekdays_and_companies():
    cut = lambda t, lang: [t[a:b] for a, b in sentences.sentence_spans(t, lang)]
    assert cut("On Jan. 5 we left. On Mon. Jan. 6 we met the Alder Inc. Corp. of Ltd. firms. It was Jan. Then came rain.", "en") == ["On Jan. 5 we left.", "On Mon. Jan. 6 we met the Alder Inc. Corp. of Ltd. firms.", "It was Jan.", "Then came rain."]
    assert cut("Le 3 janv. 2020 il neigeait. Fin.", "fr") == ["Le 3 janv. 2020 il neigeait.", "Fin."] and cut("Am Okt. 3 war es kalt. Gut.", "de") == ["Am Okt. 3 war es kalt.", "Gut."]


# --- truncation
def test_copies_and_marks_are_no_closing_lines(spark):
    body = "The lamp was out. We knew it was late. "
    cut = [body + "We went home.\n\nAfter the concert my brother and I walked along the river"] * 3
    marked = [body + f"It was day {i}.\n\nRead more" for i in range(4)]
    closed = [body + f"It rained on day {i}.\n\nWritten at the long table by the river" for i in range(4)]
    long = "Before the exam my sister and I sat for hours by the river"
    starts = [body + f"It was noon {i}.\n\n{long}" for i in range(4)] + [body + f"It was night {i}.\n\n{long} and talked." for i in range(5)]
    texts = cut + marked + closed + starts
    df = spark.createDataFrame([(f"e{i:02}", "s", t, None) for i, t in enumerate(texts)], "id string, source_id string, text string, n_words int")
    got = sorted(r.id for r in truncation.truncated_essays(df).collect())
    assert got == [f"e{i:02}" for i in [*range(7), *range(11, 15)]]


def test_repeated_delivery_changes_nothing(spark):
    body = "The lamp was out. We knew it was late. "
    texts = [body + "We went home.\n\nAfter the exam my brother and I went to the", body + "It rained.\n\nWritten at the long table by the river", body + "So we sang...", body + "And then the riv...", body + "We left."]
    texts += [body + f"It rained on day {i}.\n\nWritten at the long table by the river" for i in range(3)] + [body + f"So we sang... Nobody knew about day {i}. We sang a lot." for i in range(3)]
    once, often = (spark.createDataFrame([(f"e{i:02}-{k}", "s", t, None) for i, t in enumerate(texts) for k in range(n)], "id string, source_id string, text string, n_words int") for n in (1, 40))
    of = lambda df: {r.id.split("-")[0] for r in truncation.truncated_essays(df).collect()}
    assert of(once) == of(often) == {"e00", "e03"}


def test_a_source_has_its_own_limit(spark):
    words = "one two six ten red sky low sun dry oak ".split()
    small = [(f"s{i}", "small", (" ".join(words[(i + k) % 10] for k in range(30)))[:100], None) for i in range(8)]
    small += [("s9", "small", ("Then we all went home and " + "slept " * 20)[:99] + ".", None)]
    large = [(f"l{i}", "large", "We sat. " * (i % 25 + 4) + "All was well" + "l" * (i % 7) + ".", None) for i in range(400)]
    df = spark.createDataFrame(small + large, "id string, source_id string, text string, n_words int")
    assert {r.id for r in truncation.truncated_essays(df).collect()} == {f"s{i}" for i in (*range(8), 9)}
    assert ("small", "chars", 100) in {(r.source_id, r.encoding, r.length) for r in truncation.storage_limits(df).collect()}


# --- leaks
def test_runs_longer_than_24_words_with_more_changes():
    item = [f"w{i}" for i in range(70)]
    index = leakage.ItemIndex.build([(77, " ".join(item))] + [(i, " ".join(f"v{i}x{k}" for k in range(60))) for i in range(20)])
    for start in range(0, 24):
        for length, places in ((32, (8, 12, 16, 20)), (40, (8, 14, 18, 22, 26)), (32, (0, 10, 20, 31)), (24, (3, 11, 19))):
            run = item[start : start + length]
            text = " ".join(["pre"] * 9 + ["changed" if i in places else w for i, w in enumerate(run)] + ["post"] * 9)
            assert leakage.leaks_of([text], index) == [(0, index.ids.index(77))], (start, length)
            text = " ".join(["pre"] * 9 + ["changed" if i in places or i % 5 == 4 else w for i, w in enumerate(run)] + ["post"] * 9)
            assert leakage.leaks_of([text], index) == []


def test_wand_finds_all_blocks_above_the_threshold():
    r = random.Random(4)
    items = [(i, " ".join(r.choices([f"w{k}" for k in range(12)], k=40))) for i in range(60)]
    index = leakage.ItemIndex.build(items)
    terms = np.array([[r.randrange(len(index.terms) + 1) for _ in range(leakage.TERMS)] for _ in range(300)])
    least = np.array([r.uniform(1, 12) for _ in range(300)], np.float32)
    q, k = index.pivots(terms, least)
    want = set()
    for i, row in enumerate(terms):
        total = {}
        for t in row:
            for x in range(index.first[t], index.first[t + 1]):
                total[int(index.block[x])] = total.get(int(index.block[x]), 0.0) + float(index.blockmax[x])
        want |= {(i, b) for b, x in total.items() if x >= least[i] + 1e-3}
    got = set(zip(q.tolist(), k.tolist(), strict=True))
    assert want <= got and len(got) <= len(want) + 5


def test_items_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_ITEM_BYTES", 300)
    items = [(i, " ".join(f"a{i}b{k}" for k in range(30))) for i in range(7)]
    docs = spark.createDataFrame([(i, "so " + t + " it ends") for i, t in items] + [(99, None), (98, "")], "doc_id bigint, text string")
    got = leakage.leaked_items(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(7)]


# --- splits
def test_essays_without_verdicts_get_a_split(spark):
    essays = spark.createDataFrame([("a", "s", None), ("b", "s", None), ("c", "t", None)], "id string, source_id string, meta string")
    verdicts = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("gone", 0)], "doc_id string, sentence_index int")
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, share double")
    got = sorted(components.verdict_splits(essays, verdicts, targets).collect(), key=str)
    assert list(map(tuple, got)) == [("a", 0, "train"), ("a", 1, "train"), ("b", None, "train"), ("c", None, "train")]
