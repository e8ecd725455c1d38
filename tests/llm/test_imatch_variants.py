"""I-Match fingerprints and spelling variants against plain versions, and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from axonloom.llm import imatch, variants

SCHEMA = "doc_id bigint, text string, fingerprint string, word string"


def prose(rnd, n, words):
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    common, rare = ["the", "of", "and", "in"], [f"word{i}" for i in range(4000)]
    texts = [prose(rnd, rnd.choice([1, 8, 40, 300]), common + rare) for _ in range(300)]
    texts += [texts[3]] * 40 + [texts[2].replace(" ", " , "), None, "", "!!!", "!?!"]
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def test_fingerprints_follow_the_text(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, docs).collect()}
    assert set(got) == set(texts)
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t or "", got[i]) == got[i]
    assert got[340] == got[2]  # the same terms
    assert got[343] != got[344] and got[341] == got[342]


def test_next_rows(spark, docs):
    for bucket_rows in (7, 1_000):
        got = {r.doc_id: (r.next_id, r.next_text) for r in imatch.with_next(docs, bucket_rows).collect()}
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        ids = sorted(texts, reverse=True)
        assert got == {i: (j, texts[j]) for i, j in zip(ids, ids[1:] + ids[:1])}
    one = docs.limit(1)
    assert [(r.doc_id, r.next_id) for r in imatch.with_next(one).collect()] == [(0, 0)]
    odd = spark.createDataFrame([(None, "b", "", ""), (None, "a", "", ""), (5, "c", "", ""), (5, "c", "", ""), (2**63 - 2, "d", "", ""), (-(2**63), "e", "", "")], SCHEMA)
    got = imatch.with_next(odd, 1).collect()
    assert len(got) == 6 and sorted(r.text for r in got) == sorted(r.next_text for r in got)
    assert {(r.doc_id, r.next_id) for r in got if r.doc_id is not None} == {(2**63 - 2, 5), (5, 5), (5, -(2**63)), (-(2**63), None)}
    assert imatch.edited(odd).count() == 6 and imatch.edited(docs.where("false")).count() == 0


def test_edits_stay_alike_and_strangers_do_not(docs):
    rows = [r for r in imatch.edited(docs.where("doc_id < 300")).collect() if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.97 * len(rows)
    assert sum(r.near_next for r in rows) / len(rows) < 0.02 and sum(r.near_edited for r in rows) / len(rows) > 0.4


def test_likeness(spark):
    a, b = "0401aaaaaa,0402bbbbbb,0502bbbbbb", "0502bbbbbb,0603cccccc"
    rows = spark.createDataFrame([(a, a), (a, b), (a, "~0"), ("~0", "~1"), (b, "0101dddddd")], "a string, b string")
    got = [r[0] for r in rows.select(imatch.likeness(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, pytest.approx(2 / 3), 0.0, 0.0, 0.0]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(seed, count, letters="abcé"):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9))) for _ in range(count)})


@pytest.mark.parametrize("block", [4_000, 25])  # small: groups are dealt over several blocks
def test_near_words_equal_brute_force(spark, block):
    words = some_words(1, 400) + ["aaaaaaa", "aaaaaa", "aaaaaaaa", "zzzzzz", "ÿaaaaaa"]
    df = spark.createDataFrame([(w, i + 5) for i, w in enumerate(dict.fromkeys(words))], "word string, n bigint")
    got = [(r.word, r.near) for r in variants.near_words(df, block).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_index_states_follow_both_directions():
    words = ["banana", "bananas", "cabana"]
    index = variants.Index(words)
    import numpy as np

    for order in ((0, "r"), (1, "l"), (2, "m")):
        state = np.array([[0], [0], [index.n]])
        pattern = index.encoded("bana").tolist()
        steps = {"r": [(c, False) for c in pattern], "l": [(c, True) for c in pattern[::-1]], "m": [(pattern[1], True), (pattern[2], False), (pattern[0], True), (pattern[3], False)]}[order[1]]
        for c, left in steps:
            state = index.extended(state, np.array([c]), left)
        assert state[2][0] == 3
        rows = index.sides[0].sa[state[0][0] : state[0][0] + 3]
        assert sorted(index.words_at(np.stack([np.arange(state[0][0], state[0][0] + 3)] * 3)).tolist()) == [0, 1, 2] and len(set(rows.tolist())) == 3


def test_forms_and_roots(spark):
    rows = [("lettersss", 5), ("letterss", 30), ("letters", 200), ("lettars", 40), ("lettera", 40), ("lettert", 9), ("houses", 7)]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in variants.grouped(spark.createDataFrame(rows, "word string, n bigint")).collect()}
    assert got["lettersss"] == ("letterss", "letters", 1, 30) and got["letterss"] == ("letters", "letters", 2, 200)
    assert got["lettars"] == ("letters", "letters", 1, 200) and got["lettert"] == ("letters", "letters", 2, 200)
    assert got["letters"] == (None, "letters", 4, None) and got["houses"] == (None, "houses", 0, None)
    assert variants.grouped(spark.createDataFrame([], "word string, n bigint")).collect() == []


def test_ties_go_to_the_smallest_word(spark):
    rows = [("bbbbbbx", 50), ("bbbbbba", 50), ("bbbbbbc", 5)]
    got = {r.word: r.form for r in variants.grouped(spark.createDataFrame(rows, "word string, n bigint")).collect()}
    assert got == {"bbbbbbx": None, "bbbbbba": None, "bbbbbbc": "bbbbbba"}


def test_vocabulary_of_odd_rows(spark):
    long = "wörtlich Wörtlich " * 80_000
    docs = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (3, long, "", ""), (None, "wörtlich", "", ""), (4, "short zürich-Zürich1zürich zürich ZÜRICH zürich", "", ""), (4, "zürich", "", "")], SCHEMA)
    got = {r.word: r.n for r in variants.vocabulary(docs).collect()}
    assert got == {"wörtlich": 160_001, "zürich": 6}  # only A-Z is lowered, so the one with a capital umlaut is another word
    assert variants.vocabulary(docs.where("false")).collect() == []
