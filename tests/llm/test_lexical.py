"""Block-max search against plain loops."""

import math
import random
import re
from collections import Counter

import pytest

from knotwork.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        hits = []
        for i, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t in words(text) if b[t])
            if score > 0:
                hits.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def made(seed, n):
    """Documents of few common and many rare words in mixed case, with marks and other scripts."""
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)] + ["straße", "ÉTÉ", "naïve", "数字", "\x80x", "a_b", "x-y", "3.14", "İ"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    marks = [" ", ", ", "\n", "_", "\x00", "{", "/"]
    docs = []
    for i in range(n):
        docs.append((i, "".join(w.swapcase() * (rng.random() < 0.3) or w for w in sum(([w, rng.choice(marks)] for w in rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 30, 300]))), []))))
    return docs


@pytest.mark.parametrize(("rows", "first", "second", "group"), [(256, 4, 64, 256), (3, 1, 4, 5), (1, 2, 3, 1)])
def test_search_against_brute_force(spark, monkeypatch, rows, first, second, group):
    for name, value in {"BLOCK_ROWS": rows, "FIRST": first, "SECOND": second, "QUERY_GROUP": group, "SLICE": 64}.items():
        monkeypatch.setattr(lexical, name, value)
    docs = made(1, 150)
    docs += [(500, None), (501, ""), (502, " ,;\n"), (7, docs[9][1]), (None, docs[9][1]), (503, "w1 " * 3000), (504, "q" * 5000), *[(600 + i, docs[20][1]) for i in range(40)]]
    items = [(i, " ".join(w for w in words(t)[:25])) for i, t in docs[:60:5]] + [(90, "W1 w1 W1 w399"), (91, None), (92, "nothing known"), (93, ""), (9, "straße été"), (9, "W2"), (None, "w3"), (94, "q" * 5000), (95, docs[20][1])]
    random.Random(3).shuffle(docs)
    d = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(4)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in lexical.ranked(d, q).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute(docs, items)


def test_blocks_below_the_bound_are_not_scored(spark, monkeypatch):
    """A query of rare terms reads the blocks that hold them, and the bound is never below a score."""
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 5)
    seen = []
    inner = lexical.scored_blocks

    def counting(tiles, *args):
        seen.append(tiles.count())
        return inner(tiles, *args)

    monkeypatch.setattr(lexical, "scored_blocks", counting)
    monkeypatch.setattr(lexical, "FIRST", 2)
    monkeypatch.setattr(lexical, "SECOND", 8)
    docs = [(i, f"common words here {'rare rare rare' if i < 30 else ''} n{i}") for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = lexical.ranked(d, spark.createDataFrame([(1, "rare common")], "item_id int, text string"), 20).collect()
    assert sorted(r.doc_id for r in got) == list(range(20))
    assert sum(seen) < 12 < 80


def test_long_texts_are_cut_between_terms(monkeypatch):
    import numpy as np

    from knotwork.llm.common import utf8
    import pyarrow as pa

    texts = ["ab cd " * 50, "x" * 500, None, "", "é ü " * 40 + "end"]
    whole = lexical.terms(*utf8(pa.array(texts)))
    monkeypatch.setattr(lexical, "SLICE", 16)
    assert all(np.array_equal(a, b) for a, b in zip(whole, lexical.terms(*utf8(pa.array(texts))), strict=True))
    assert np.bincount(whole[2], minlength=5).tolist() == [len(words(t)) for t in texts]


def test_two_terms_with_one_first_hash():
    import numpy as np

    h1, h2 = np.array([5, 5, 7, 5]), np.array([1, 2, 3, 1])
    d1, d2, codes = lexical.coded(h1, h2)
    assert len(d1) == 3 and codes[0] == codes[3] != codes[1]
    assert lexical.places_in(d1, d2, np.array([5, 5, 5, 7, 9]), np.array([1, 2, 3, 3, 1])).tolist() == [codes[0], codes[1], -1, codes[2], -1]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(docs.select("doc_id", lexical.F.lit(None).cast("string").alias("text")), items).count() == 0
