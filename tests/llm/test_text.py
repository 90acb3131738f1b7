"""Text operators: folding, sentences, truncation, tokenizer, personal information, leakage."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfathom.llm import bpe, leakage, personal, sentences, textform, truncation

EXTRA = "id string, text string, look string, cls bigint"


def rows(spark, *texts):
    """Rows with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(f"k{i}", t, "x", 1) for i, t in enumerate(texts)], EXTRA)


def pairs(df):
    return sorted(map(tuple, df.collect()))


# --- look folding
def test_same_look_pairs(spark):
    df = rows(spark, "A naïve ﬁle", "Ａ naı̈ve file".replace("ı̈", "ï"), "А naïve f​ile", "a naïve file", "A naïve file!", None, "", "​", "A naïve ﬁle")
    got = pairs(textform.same_look_pairs(df))
    assert got == [("k0", "k1"), ("k0", "k2"), ("k1", "k2"), ("k1", "k8"), ("k2", "k8"), ("k6", "k7")]


def test_same_look_keeps_case_lines_and_superscripts(spark):
    assert not pairs(textform.same_look_pairs(rows(spark, "x2 a", "x² a", "X2 a", "x2\na", "x2  a")))
    assert not pairs(textform.same_look_pairs(rows(spark)))


def test_repeated_ids_are_one_row(spark):
    df = spark.createDataFrame([("a", "hi​ there"), ("a", "hi​ there  "), ("b", "hi there"), (None, "hi there")], "id string, text string")
    assert pairs(textform.same_look_pairs(df)) == [("a", "b")]


def test_fold_agrees_with_python(spark):
    texts = ["Ｍａｒｔｅｎ ﬃ ｶﾞﾗｽ ⼤ а е о", "👩‍🔬 x​y", "é z", "x" * 100_000, "ό ό"]
    got = {r.id: r.folded for r in textform.fold_text(rows(spark, *texts), "id").collect()}
    assert [got[f"k{i}"] for i in range(len(texts))] == [textform.fold_python(t) for t in texts]
    assert got["k0"] == "Marten ffi ガラス 大 a e o" and "‍" in got["k1"]


# --- sentences
CASES = [
    ("en", "I met Mrs. Lane and Prof. Dell at 8.30 p.m. Then it cost $3.50, i.e. No. 5. “Why?” she asked.", ["I met Mrs. Lane and Prof. Dell at 8.30 p.m.", "Then it cost $3.50, i.e. No. 5.", "“Why?” she asked."]),
    ("en", "A Heading\n \nK. P. Reed wrote... and left.\nNo stop here\n\n~ M. ~", ["A Heading", "K. P. Reed wrote... and left.", "No stop here", "~ M. ~"]),
    ("de", "Am 3. Mai kam Nr. 5 um 18.30 Uhr, d. h. spät. „Komm mit!“, rief er. Gut.", ["Am 3. Mai kam Nr. 5 um 18.30 Uhr, d. h. spät.", "„Komm mit!“, rief er.", "Gut."]),
    ("es", "EE. UU. queda lejos, p. ej. aquí. «¿Vienes?», preguntó. ¡Sí!", ["EE. UU. queda lejos, p. ej. aquí.", "«¿Vienes?», preguntó.", "¡Sí!"]),
    ("fr", "« Tu viens ? » demandait-il. Oui, env. dix min. avant.", ["« Tu viens ? » demandait-il.", "Oui, env. dix min. avant."]),
    ("zh", "“你怕不怕？”教练问我。同桌说：“不怕。”我等了很久……最后来了！", ["“你怕不怕？”教练问我。", "同桌说：“不怕。”", "我等了很久……最后来了！"]),
    ("ja", "「怖くない？」と兄は聞いた。母は「いらない。」と言った。", ["「怖くない？」と兄は聞いた。", "母は「いらない。」と言った。"]),
    ("th", "เราเดิน 44 กิโลเมตรแล้ว ฉันพบเรือ ทำไมไป? แม่แปล", ["เราเดิน 44 กิโลเมตรแล้ว", "ฉันพบเรือ", "ทำไมไป?", "แม่แปล"]),
    ("hi", "डॉ. साहब बोले। “तुम आओगे?” नर्स ने पूछा।", ["डॉ. साहब बोले।", "“तुम आओगे?” नर्स ने पूछा।"]),
    ("ru", "В 2019 г. дядя, т. е. он, пришёл. «Ты идёшь?» — спросил он.", ["В 2019 г. дядя, т. е. он, пришёл.", "«Ты идёшь?» — спросил он."]),
    ("ar", "قال د. الحي نعم. «هل ستأتي؟» سأل جدتي.", ["قال د. الحي نعم.", "«هل ستأتي؟» سأل جدتي."]),
]


@pytest.mark.parametrize("lang, text, want", CASES)
def test_sentences(lang, text, want):
    assert [text[a:b] for a, b in sentences.sentence_spans(text, lang)] == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab A.!?\n\"”“«» ​́é。？1了と", max_size=80))
def test_spans_are_ordered_and_lose_nothing(text):
    spans = sentences.sentence_spans(text, "en")
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)
    kept = "".join(text[a:b] for a, b in spans)
    assert sum(c.isalnum() for c in kept) == sum(c.isalnum() for c in text)


def test_sentences_of_odd_rows(spark):
    df = spark.createDataFrame([("a", "One. Two.", '{"lang": "en"}'), ("a", "One. Two. ", '{"lang": "en"}'), ("b", None, None), ("c", " \n ", "{"), ("d", "x", None), (None, "No id.", None)], "id string, text string, meta string")
    assert pairs(sentences.sentences_found(df)) == [("a", 0, 4), ("a", 5, 9), ("d", 0, 1)]


# --- truncation
def essays(spark, texts):
    return spark.createDataFrame([(f"e{i}", "s", t, n) for i, (t, n) in enumerate(texts)], "id string, source_id string, text string, n_words int")


def test_truncation_kinds(spark):
    whole = "The lamp was out. We knew it was late."
    texts = [(whole, 9), (whole + " Then the ba", 11), (whole + " We saw the re [...]", 14), (whole, 40), (whole + "\n\nWord count: 21", 11), (whole + "\n\n— R. T.", 9), (None, 3), ("", None), (whole + " I met Mrs.", 12), (whole + ' He said, "Go."', None), (whole + "\n\nThe end", None)]
    assert sorted(r.id for r in truncation.truncated_essays(essays(spark, texts)).collect()) == ["e1", "e2", "e3", "e8"]
    r = truncation.truncation_by_source(essays(spark, texts)).first()
    assert (r.essays, r.cut) == (10, 4)


def test_storage_limits_are_found(spark):
    r = random.Random(3)
    long = lambda: " ".join(r.choice(["lamp", "river", "was", "table", "ever"]) for _ in range(200)) + "."
    texts = [(long()[:300].ljust(300, "x"), None) for _ in range(30)] + [(long()[: r.randint(400, 900)].rsplit(" ", 1)[0] + ".", None) for _ in range(200)]
    got = {(x.encoding, x.length) for x in truncation.storage_limits(essays(spark, texts)).collect()}
    assert ("chars", 300) in got
    assert truncation.truncated_essays(essays(spark, texts)).count() == 30


def test_lengths():
    assert truncation.lengths('a&"\né😀') == (6, 10, 7, 15, 19, 1 + 1 + 2 + 2 + 6 + 12, 1 + 1 + 2 + 2 + 2 + 4, 7, 11)


# --- tokenizer
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("abc the'sdreING 019\n\t.,-"), st.characters(blacklist_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_encoding_equals_public_encoder(text):
    from tokenizers import Tokenizer

    t = test_encoding_equals_public_encoder.__dict__.setdefault("t", Tokenizer.from_file(f"{bpe.VOCABULARIES}/byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert bpe.encoder("byte_bpe_50k").encode(text) == t.encode(text, add_special_tokens=False).ids


def test_encoding_rows(spark):
    df = spark.createDataFrame([(1, "hello <|endoftext|>"), (2, ""), (3, None), (4, "a" * 50_000)], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df).collect()}
    e = bpe.encoder("byte_bpe_50k")
    assert got[2] == [] and got[3] == [] and b"".join(e.bytes[i] for i in got[4]) == b"a" * 50_000
    assert b"".join(e.bytes[i] for i in got[1]) == b"hello <|endoftext|>" and 50256 not in got[1]


# --- personal information
def test_held_out_accuracy():
    weights = personal.trained()
    hit = wrong = missed = 0
    for text, spans in personal.labelled_lines(600, seed=77):
        got, want = set(personal.decode(personal.candidates(text), weights)), set(spans)
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.93


def test_viterbi_is_the_best_of_all_subsets():
    from itertools import combinations

    r = random.Random(5)
    for _ in range(60):
        cands = [(a, a + r.randint(1, 4), "name", [f"f{i}"]) for i, a in enumerate(r.choices(range(12), k=7))]
        w = {f"f{i}": r.uniform(-1, 2) for i in range(7)}
        best = max(sum(w[c[3][0]] for c in s) for k in range(8) for s in combinations(cands, k) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(s, 2)))
        starts = {(a, b): max(w[f[0]] for x, y, _, f in cands if (x, y) == (a, b)) for a, b, _, _ in cands}
        assert sum(starts[a, b] for a, b, _ in personal.decode(cands, w)) == pytest.approx(best)


def test_redaction(spark):
    text = "My name is Tolka Bresan and I am applying. Call me: (415) 555-0190\nWe walked down Quarry Lane until the lamps went out.\nMail to: tolka.b @ post.example"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no one here")], "doc_id bigint, text string").withColumn("found", F.lit("x"))
    got = {r.doc_id: (r.text, r.found) for r in personal.redacted(df).collect()}
    assert got[1][0] == "My name is [NAME] and I am applying. Call me: [PHONE]\nWe walked down Quarry Lane until the lamps went out.\nMail to: [EMAIL]"
    assert got[2] == (None, 0) and got[3] == ("", 0) and got[4] == ("no one here", 0)
    assert personal.personal_spans(df.where("doc_id > 1")).count() == 0


def test_offsets_survive_invisible_characters():
    text = "Call me: (415) 5​55-0190"
    (a, b, kind), = personal.entities(text, personal.trained())
    assert kind == "phone" and text[a:b] == "(415) 5​55-0190"


# --- leakage
def plain_edit_leak(doc, item, length=24):
    """Whether some window of the item is within three edits of some part of the document; textbook Sellers."""
    for i in range(len(item) - length + 1):
        w = item[i : i + length]
        prev = [0] * (len(doc) + 1)
        for x in w:
            cur = [prev[0] + 1]
            for j, y in enumerate(doc):
                cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1))
            prev = cur
        if min(prev) <= length // 8:
            return True
    return False


def test_leaks_against_plain_alignment(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=40))) for i in range(12)]
    docs = []
    for i in range(120):
        w = r.choices(vocabulary, k=r.randint(0, 40))
        if i % 2:
            part = r.choice(items)[1].split()[r.randint(0, 14) :][: r.randint(20, 30)]
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(part))
                part[k : k + 1] = r.choice([[], [r.choice(vocabulary)], [part[k], r.choice(vocabulary)]])
            w += part + r.choices(vocabulary, k=5)
        docs.append((i, " ".join(w).upper() if i % 3 else ", ".join(w)))
    docs += [(900, None), (901, ""), (902, items[0][1])]
    got = set(map(tuple, leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (98, "too short"), (99, None)], "item_id bigint, text string")).collect()))
    want = {(d, i) for d, t in docs if t for i, x in items if plain_edit_leak(leakage.words(t), leakage.words(x))}
    assert got == want and (902, 0) in got


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert leakage.leaked_items(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
