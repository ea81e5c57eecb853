"""The corpus pipeline's stages by row."""

import random
import re
from collections import Counter
from pathlib import Path

import corpus_pipeline as pipeline
import pytest
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string"


def words(start, n=60):
    return " ".join(f"w{start + k}" for k in range(n))


def labelled(spark, path: Path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def unlabelled(spark, tmp_path_factory):
    return labelled(spark, tmp_path_factory.mktemp("none"), [])


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_rows_that_share_an_id_or_have_none_are_documents_each(spark, unlabelled):
    rows = [(1, words(0), "en"), (1, words(100), "en"), (None, words(200), "en"), (None, words(300), "de"), (2, words(400), "en")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(((r[0], r[1]) for r in rows), key=repr)
    for stage in (pipeline.remove_copies, pipeline.remove_near_copies):
        assert texts(stage(spark, docs, unlabelled)) == want, stage.__name__
    assert set(texts(pipeline.mix(spark, docs, unlabelled))) == set(want)


def test_of_equal_texts_one_row_stays(spark, unlabelled):
    rows = [(3, "a b", "en"), (3, "a b", "en"), (3, "ab", "en"), (3, " ab", "en"), (None, "a  b", "en"), (None, "c", "en"), (None, "c", "de"), (4, None, "en"), (5, "", "en")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = pipeline.remove_copies(spark, docs, unlabelled).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(None, "a  b", "en"), (None, "c", "de"), (4, None, "en")], key=repr)


def test_a_near_copy_does_not_stay_with_its_namesake(spark, unlabelled):
    edited = words(0)[:-2] + "x"
    rows = [(1, words(0), "en"), (5, edited, "en"), (5, words(500), "en"), (None, edited + " y", "en"), (None, words(800), "en")]
    found = pipeline.remove_near_copies(spark, spark.createDataFrame(rows, SCHEMA), unlabelled)
    assert texts(found) == sorted([(1, words(0)), (5, words(500)), (None, words(800))], key=repr)


def test_a_toxic_row_goes_though_its_namesake_is_clean(spark, tmp_path):
    clean = [(i, f"{words(i % 7 * 50, 20)}. {words(i % 11 * 40, 20)}.", "en") for i in range(400)]
    rows = [(i, "You zorg. " + t if i % 4 == 0 else t, lang) for i, t, lang in clean]
    folder = labelled(spark, tmp_path, [(i, 1, int(i % 4 == 0)) for i in range(400)])
    extra = [(1, "You zorg. " + words(3), "en"), (None, "You zorg. " + words(5), "en"), (None, words(8), "en")]
    found = texts(pipeline.remove_toxic(spark, spark.createDataFrame(rows + extra, SCHEMA), folder))
    assert found == sorted([(i, t) for i, t, _ in rows + extra if "zorg" not in t], key=repr)


def test_empty_table_and_odd_columns(spark, unlabelled, tmp_path):
    odd = "doc_id long, text string, lang string, row string, score double, uid long, `a b` string, len long"
    none = spark.createDataFrame([], odd)
    for name, stage in pipeline.STAGES[:-1]:
        made = stage(spark, none, unlabelled)
        assert made.count() == 0 and made.columns == none.columns, name
    assert pipeline.pack(spark, none, unlabelled).count() == 0
    rows = [(1, words(0), "en", "r", 0.5, 7, "x", 3), (None, None, None, None, None, None, None, None), (2, "", "en", "r", 1.0, 7, "y", 3)]
    for name, stage in pipeline.STAGES[:-1]:
        made = stage(spark, spark.createDataFrame(rows, odd), unlabelled)
        left = [r for r in rows if name != "exact dedup" or r[0] != None]  # noqa: E711 the null id is the largest
        assert sorted(map(tuple, made.collect()), key=repr) == sorted(left, key=repr), name


def plain_words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def brute_near(rows):
    """One row of each group of near copies, by comparing all pairs."""
    sets = []
    for _, text, _ in rows:
        w = plain_words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [min((r for r, g in zip(rows, group, strict=True) if g == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in set(group)]


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{k}" for k in range(400)], k=rng.randrange(30, 90))) + "." for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(1000 + i, base[i].replace(" ", "  ", 3)) for i in range(0, 40, 2)]  # exact copies, longer ones
    rows += [(2000 + i, base[i] + f" extra{i}") for i in range(1, 40, 3)]  # near copies
    rows += [(3000 + i, "You zorg of a text. " + " ".join(rng.choices([f"w{k}" for k in range(400)], k=40)) + ".") for i in range(60)]
    rows += [(5, base[60] + " and more of another kind entirely " * 6), (None, " ".join(f"n{k}" for k in range(50))), (None, " ".join(f"m{k}" for k in range(50))), (4000, ""), (4001, None)]
    rng.shuffle(rows)
    rows = [(i, t, "en") for i, t in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, tmp_path, [(i, 1, int(i >= 3000)) for i, _, _ in rows if i is not None and i != 5 and i < 4000])
    clean = [r for r in rows if "zorg" not in (r[1] or "")]
    owners = {}
    for r in clean:
        body = "".join(plain_words(r[1]))
        owners[body] = min([owners.get(body, r), r], key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
    kept = brute_near(sorted(owners.values(), key=repr))
    stages = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, str(tmp_path)), "test") if name != "packing" else stage(spark, docs, str(tmp_path))
        stages[name] = docs
    assert texts(stages["toxicity"]) == sorted(((i, t) for i, t, _ in clean), key=repr)
    assert texts(stages["exact dedup"]) == sorted(((i, t) for i, t, _ in owners.values()), key=repr)
    assert texts(stages["n-gram Jaccard join"]) == sorted(((i, t) for i, t, _ in kept), key=repr)
    assert set(texts(stages["mixing to target weights"])) == {(i, t) for i, t, _ in kept}
    library = Tokenizer.from_file(pipeline.tokenizer("word_bpe_49k.json"))
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in texts(stages["mixing to target weights"]))
    got = Counter()
    for r in stages["packing"].collect():
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == Counter({(i, n): n * times for (i, n), times in want.items()})
    run = pipeline.run(spark, str(tmp_path))
    assert run.columns == stages["packing"].columns and run.agg({"length": "sum"}).first() == stages["packing"].agg({"length": "sum"}).first()
