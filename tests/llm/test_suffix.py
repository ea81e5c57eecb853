import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import suffix


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=14), max_size=6))
def test_suffix_array_is_the_sorted_order(strings):
    text = [0]
    for s in strings:
        text += [*s, 0]
    tail = lambda i: text[i : text.index(0, i)]
    got = suffix.suffix_array(text)
    assert sorted(got) == [i for i, c in enumerate(text) if c]
    assert [tail(i) for i in got] == sorted(tail(i) for i in got)


def brute(rows, length=50):
    """What the contract says, window by window."""
    key = lambda d: suffix.LAST_ID if d is None else d
    least = {}
    for d, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            least[w] = min(least.get(w, suffix.LAST_ID), key(d))
    out = []
    for d, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < key(d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(n) for n in (9, 12, 30, 200)]
    rows = []
    for d in range(60):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, len(s) // 2)
            parts += [s[cut : len(s) - rng.randint(0, len(s) // 3)], text(rng.randint(0, 5))]
        whole = " ".join(parts)
        if rng.random() < 0.4 and whole:
            at = rng.randrange(len(whole))
            whole = whole[:at] + "Q" + whole[at + 1 :]
        rows.append((rng.randint(0, 1000), whole))
    rows += [(rng.randint(0, 1000), rows[3][1]) for _ in range(5)]
    rows += [(1, "a" * 300), (2, "a" * 120 + "b" * 70), (7, "ab" * 90), (9, "b" + "ab" * 40), (3, ""), (4, None), (None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (6, "x" * 49)]
    return rows


def test_removed_bytes_match_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        df = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, block string").repartition(3)
        got = sorted((tuple(r) for r in suffix.remove_repeats(df).collect()), key=str)
        want = brute(rows)
        assert got == want
        assert sum(r[2] for r in want) > 1000


def test_hot_anchors_are_divided(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 4000)
    monkeypatch.setattr(suffix, "HOT_BLOCKS", 3)
    monkeypatch.setattr(suffix, "HOT_SEGMENTS", 10)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrase = "the one and only common phrase of all"  # shorter than a window, in every document
    rows = [(d, noise(rng.randrange(60)) + phrase + noise(rng.randrange(60))) for d in range(300)]
    for d in range(0, 300, 7):  # and some longer matches around it, to each side
        i, text = rows[d]
        at = text.index(phrase)
        a, b = rng.randrange(30), rng.randrange(30)
        rows[(d * 5 + 1) % 300] = (rng.randrange(400), noise(20) + text[max(0, at - a) : at + len(phrase) + b] + noise(20))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in suffix.remove_repeats(df).collect()), key=str)
    want = brute(rows)
    assert got == want and sum(r[2] for r in want) > 500


def test_division_keeps_every_window():
    rng = np.random.default_rng(9)
    buf = rng.integers(97, 105, 3000).astype(np.uint8)
    h, place, first, windows, doc = suffix.segments(buf, np.array([0, 1000, 3000]))
    left, right = place - first, first + windows + 49 - place - suffix.K
    hot = rng.random(len(h)) < 0.7
    made = suffix.divided(buf, h, place, first, left, right, doc, hot, 50)
    starts = lambda place, first, right: sorted(s for p, f, r in zip(place, first, right, strict=True) for s in range(f, p + suffix.K + r - 49))
    assert starts(made[1], made[2], made[4]) == starts(place, first, right)
    assert ((made[1] - made[2]) == made[3]).all() and (made[4] >= 0).all()


def test_no_rows(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
