"""Periodic runs against every period tried at every place, and odd rows."""

import random

import numpy as np
import pytest

from axonloom.llm import periodic, suffixes


def every_run(words, shortest):
    """All runs by trying each period at each place; of equal stretches the smallest period."""
    found, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, 2 * q) and (i, j - i + q) not in seen:
                seen.add((i, j - i + q))
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        n, letters = rnd.randint(0, 60), rnd.choice([1, 2, 3, 5])
        words = [chr(97 + rnd.randrange(letters)) for _ in range(n)]
        if n and rnd.random() < 0.5:
            a, p = rnd.randrange(n), rnd.randint(1, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        yield words


@pytest.mark.parametrize("shortest", [2, 12])
def test_runs_equal_brute_force(shortest):
    words = list(some_texts(3, 250))
    bounds, start, length, period, collapsed = periodic._found([" ".join(w).encode() for w in words], shortest)
    for t, w in enumerate(words):
        at = slice(bounds[t], bounds[t + 1])
        got = list(zip(start[at].tolist(), length[at].tolist(), period[at].tolist()))
        assert got == every_run(w, shortest)
        assert collapsed[t].decode() == plain_collapse(w, got)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 200):
        x = np.concatenate([rng.integers(1, 4, n - 1), [0]])
        sa, isa = suffixes.suffix_array(x)
        assert sa.tolist() == sorted(range(n), key=lambda i: x[i:].tolist()) and (isa[sa] == np.arange(n)).all()
        lcp = suffixes.lcp_array(x, sa)
        for j in range(1, n):
            a, b = x[sa[j - 1] :].tolist(), x[sa[j] :].tolist()
            assert lcp[j] == next(k for k in range(n) if a[k : k + 1] != b[k : k + 1])


def test_long_texts_and_powers():
    for text, want in ((b"a " * 50_000, (0, 50_000, 1)), (b"a b c " * 20_000, (0, 60_000, 3)), (b"x y " + b"a a b " * 9_000 + b"z", None)):
        bounds, start, length, period, _ = periodic._found([text], 12)
        if want:
            assert (bounds[-1], start[0], length[0], period[0]) == (1, *want)
        else:
            assert (start[0], length[0], period[0]) == (2, 27_000, 3)


def test_odd_rows(spark):
    again = "one two three " * 5
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", "c"), (4, again, "d"), (4, again, "d"), (None, again, "e"), (5, "word", "f"), (6, "eins zwei " * 12, "g"), (7, "x\0y " * 12, "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.runs(docs).collect()), key=repr)
    run, kept = [(0, 15, 3)], "one two three"
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, run, kept), (4, run, kept), (None, run, kept), (5, [], "word"), (6, [(0, 12, 1)], "eins zwei"), (7, [(0, 12, 1)], "x\0y")]
    assert got == sorted(want, key=repr)
    texts = {r.doc_id: r for r in periodic.without_repeats(docs).collect()}
    assert texts[4].text == kept and texts[3].text == " \n\t " and texts[1].text is None and texts[5].runs == "f"
    assert periodic.runs(docs.where("false")).collect() == []


def test_planted_texts_repeat(spark):
    from zlib import crc32

    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(60)] + [(i, t) for i, t in zip(range(60, 90), ["", None, "one"] * 10)] + [(None, "x")], "doc_id bigint, text string")
    for r in periodic.planted(docs).collect():
        text = " ".join(words) if r.doc_id is not None and r.doc_id < 60 else ["", None, "one"][(r.doc_id or 0) % 3] if r.doc_id is not None else "x"
        h = crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        w = (text or "").split()
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        assert r.text == text
