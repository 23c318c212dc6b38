import random

from tunelore.llm.subjects import document_subjects, features, fit, labelled_sentences, plain, repair, sentences, told

DOCS = "doc_id bigint, text string, subject string, about int"
EXAMPLES = "example_id bigint, text string, lang string, subject string"


def test_layouts():
    assert plain("﻿<p>One &amp; two.</p><p>Three​ four.</p>").split("\n") == ["", "One & two.", "", "Three four.", ""]
    assert sentences('{"id": "a-1", "notes": ["First one here.", "Second one here."], "n": [1]}') == ["First one here.", "Second one here."]
    assert sentences("- An item, cf. no. 12.\n- Another item [12].\n") == ["An item, cf. no. 12.", "Another item  ."]
    assert sentences("[12:10] It ended – quite a game. Then it rained (as at sea).") == ["It ended", "Then it rained  ."]
    assert repair("solfÃ¨ge") == "solfège" and repair("Ãrbol é") == "Ãrbol é"
    assert sentences(None) == sentences(" \n ") == sentences("C#4 Ab3 1/8 2.0") == []


def texts(rng, subject, n):
    words = {"sea": "ship sailor harbour anchor wave tide mast captain".split(), "farm": "cow barn tractor field harvest plough sheep farmer".split(), "law": "court judge clause appeal verdict lawyer contract statute".split()}[subject]
    return " ".join(f"The {rng.choice(words)} met a {rng.choice(words)} near the {rng.choice(words)}." for _ in range(n))


def labelled(seed=1, n=40):
    rng = random.Random(seed)
    rows = [(len(range(i * 3)) + j, texts(rng, s, 3), "en", s) for i in range(n) for j, s in enumerate(("sea", "farm", "law"))]
    return [r if i % 30 else (*r[:3], "law") for i, r in enumerate(rows)]


def test_held_out_accuracy():
    rows = labelled()
    known = [(features(w), r[0], r[3]) for r in rows for _, w in told(r[1])]
    model, measures = fit(*map(list, zip(*known)))
    assert model.subjects == ["farm", "law", "sea"]
    assert measures["accuracy"] > 0.98 and measures["left_out"] >= 2
    rng = random.Random(5)
    for j, s in enumerate(("farm", "law", "sea")):
        scores = model.scores([w for _, w in told(texts(rng, s, 50))])
        assert (scores.argmax(1) == j).mean() > 0.95
    assert model.scores([["Zzz", "qqq", "xxx"]]).max() < model.thresholds.min()
    assert model.scores([]).shape == (0, 3)


def test_quarter_of_the_sentences(spark):
    rng = random.Random(7)
    sea, farm, law = (lambda n, s=s: texts(rng, s, n) for s in ("sea", "farm", "law"))
    docs = [
        (1, sea(3) + " " + farm(1), None, None), (2, sea(4) + " " + farm(1), None, None), (3, law(1), None, None), (4, None, "x", 1), (5, "", None, None), (6, "!!! ...", None, None), (7, "Nothing of that kind. Nothing else either.", None, None),
        (8, (sea(1) + " ") * 3000, None, None), (8, (sea(1) + " ") * 3000, None, None),
    ]
    df, ex = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labelled(), EXAMPLES)
    subjects = spark.createDataFrame([("sea", ""), ("farm", ""), ("law", "")], "subject string, about string")
    got = {(r["doc_id"], r["subject"]) for r in document_subjects(df, ex, subjects).collect()}
    assert got == {(1, "sea"), (1, "farm"), (2, "sea"), (3, "law"), (8, "sea")}
    assert document_subjects(df.limit(0), ex, subjects).count() == 0
    assert document_subjects(df, ex.limit(0), subjects).count() == 0


def test_subjects_without_examples_and_bound(spark):
    rng = random.Random(8)
    rows = [r for r in labelled() if r[3] != "law"] + [(9000, None, "en", "law"), (9001, "!!", "en", "law"), (9002, texts(rng, "law", 2), "en", "cooking")]
    ex = spark.createDataFrame(rows, EXAMPLES)
    subjects = spark.createDataFrame([("sea", ""), ("farm", ""), ("law", ""), (None, "")], "subject string, about string")
    df = spark.createDataFrame([(1, texts(rng, "sea", 3), None, None), (2, texts(rng, "law", 3), None, None), (None, texts(rng, "farm", 2), None, None)], DOCS)
    assert {(r["doc_id"], r["subject"]) for r in document_subjects(df, ex, subjects).collect()} == {(1, "sea"), (None, "farm")}
    one = spark.createDataFrame([("sea", "")], "subject string, about string")
    assert {r["doc_id"] for r in document_subjects(df, ex, one).collect()} >= {1}
    long = spark.createDataFrame([(1, texts(rng, "sea", 500), "en", "sea"), (2, texts(rng, "farm", 20), "en", "farm")], EXAMPLES)
    some = labelled_sentences(long, subjects, 100).collect()
    assert len(some) == 100 and {r["example_id"] for r in some} == {1, 2}
