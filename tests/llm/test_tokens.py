import base64
import random

import pytest

from tunelore.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
SCHEMA = "doc_id bigint, text string, ids string, n_tokens int"
TEXTS = [None, "", " ", "<|endoftext|> is text", "naïve 日本語 🎶 ​", "a" * 50_000, "don't\r\n\tstop", "퟿\x00\x7f", "½ Ⅷ ﬁ", "word " * 20_000]


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.BYTE_BPE.replace(".json", ".tiktoken"), "rb"))}
    import sys

    sys.path.append("/opt/py313/lib/python3.13/site-packages")
    import public_tokenizers as p

    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_another_library_and_decode(spark, other):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_spans(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é日🎶 \n") for _ in range(rng.randint(0, 30))) for _ in range(50)]
    library = tokens.load(tokens.BYTE_BPE)
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        assert [tuple(x) for x in tokens.character_spans(tokens.BYTE_BPE, e.ids).tolist()] == e.offsets
        spans = tokens.byte_spans(tokens.BYTE_BPE, e.ids).tolist()
        assert [t.encode()[a:b] for a, b in spans] == [tokens.token_bytes(tokens.BYTE_BPE)[i] for i in e.ids]
    got = tokens.spans(spark.createDataFrame([(1, "日本 x", "", 0), (2, None, "", 0)], SCHEMA)).collect()
    assert {r["doc_id"]: len(r["starts"]) == len(r["ids"]) == len(r["ends"]) for r in got} == {1: True, 2: True}


def test_split_characters_and_empty(spark):
    ids = tokens.load(tokens.BYTE_BPE).encode("𝄞", add_special_tokens=False).ids
    assert len(ids) > 1 and tokens.decode_ids(tokens.BYTE_BPE, ids) == "𝄞"
    assert "�" in tokens.decode_ids(tokens.BYTE_BPE, ids[:1])
    assert tokens.encode(spark.createDataFrame([], SCHEMA)).count() == 0
    assert len(tokens.byte_of_character()) == 256 == len(set(tokens.byte_of_character().values()))


def test_rows_without_key_stay_apart(spark):
    rows = [(None, "one two", "x", 1), (None, "three", "x", 1), (None, "three", "x", 1), (None, None, "x", 1), (5, "four", "x", 1), (5, "four", "x", 1), (6, "four", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in tokens.decode(tokens.encode(df)).collect())
    assert got == [(0, ""), (0, "one two"), (0, "three"), (5, "four"), (6, "four")]
    assert tokens.encode(df.limit(0)).count() == 0


def test_texts_of_single_keys_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, f"text {i}", "x", 1) for i in range(20)], SCHEMA)
    plan = tokens.encode(df.filter("doc_id is not null"))._jdf.queryExecution().executedPlan().toString()
    single = plan.split("Union")[1].split("MapInArrow")[0]
    assert "BroadcastHashJoin" in single
