"""Dedup, similarity, toxicity, mixing and quotes against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from knotwork.llm import exact_dedup, jaccard, mixing, quotes, toxicity
from knotwork.llm.components import components

SPACE = "".join(map(chr, [32, *range(9, 14)]))


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, " \n", "a b", "ab", "a  b", "A b", "é", "é", "x" * 50_000, "x" * 50_000 + " ", " ", "ab\x1f"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), "k", 1) for _ in range(300)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, kept string, len int").repartition(5)).collect()
    groups = {}
    for i, t, *_ in rows:
        body = (t or "").translate(dict.fromkeys(map(ord, SPACE)))
        groups.setdefault(body, []).append((-len(t or ""), i is None, i or 0, i))
    want = []
    for body, own in groups.items():
        points, _, _, keep = min(own)
        want += [(x[3], keep, len(own), x[3] == keep and x[0] == points, hashlib.sha256(body.encode()).hexdigest()) for x in own]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_holds_each_string_once():
    rng = random.Random(2)
    trie, want = exact_dedup.PatriciaTrie(), {}
    for i in range(2000):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randrange(8)))
        trie.insert(s, 1, i)
        want.setdefault(s, []).append(i)
    assert {s: (o[1], o[2]) for s, o in trie.terminals()} == {s: (min(v), len(v)) for s, v in want.items()}


def test_spilled_subtrees_change_nothing(monkeypatch):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(60)))) for i in range(900)] + [(7, None), (5, "b" * 5000)]
    batches = [pa.record_batch([pa.array([i for i, _ in rows[k : k + 90]], pa.int64()), pa.array([t for _, t in rows[k : k + 90]], pa.string())], names=["doc_id", "text"]) for k in range(0, len(rows), 90)]
    held = []
    real = exact_dedup.PatriciaTrie.spilled

    def watched(trie):
        held.append(sum(1 for _ in trie.terminals()))
        return real(trie)

    monkeypatch.setattr(exact_dedup.PatriciaTrie, "spilled", watched)

    def owners(most):
        monkeypatch.setattr(exact_dedup, "TRIE_BYTES", most)
        sent = pa.Table.from_batches(list(exact_dedup._local(iter(batches)))).sort_by([("len", "ascending"), ("hash", "ascending")])
        found = pa.Table.from_batches(list(exact_dedup._merge(iter(sent.to_batches(max_chunksize=100))))).to_pylist()
        return sent.num_rows, sorted(map(str, found))

    few, whole = owners(1 << 30)
    assert not held
    more, spilled = owners(20_000)
    assert spilled == whole and more > few and held and min(held) > 1
    assert len(whole) == len({(t or "").replace(" ", "") for _, t in rows})


def near_copies(rng, n_groups=12, n_words=120):
    rows, next_id = [], 0
    passage = " ".join(f"p{k}" for k in range(60))
    for _ in range(n_groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(n_words)] = f"e{rng.randrange(10**6)}"
            rows.append((next_id, " ".join(own) + (" " + passage if rng.random() < 0.3 else "")))
            next_id += 1
    rows += [(next_id, ""), (next_id + 1, None), (next_id + 2, "one two"), (next_id + 3, "one\ttwo"), (next_id + 4, "a b c d e"), (next_id + 5, "a b c d e a b c d e")]
    rng.shuffle(rows)
    return rows


def brute_similar(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in "".join(" " if c in SPACE else c for c in (t or "")).split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: [j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (min(seen), len(links[i]), len(sets[i]))
    return out


@pytest.mark.parametrize(("small", "block"), [(4096, 4096), (4, 3)])
def test_similar_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(random.Random(small))
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, path string, n int").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links, r.set_size) for r in jaccard.similar(frame).collect()}
    assert got == brute_similar(rows)


def test_similar_reaches_its_recall_where_all_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 1)
    monkeypatch.setattr(jaccard, "STALL", 2.0)
    rows = []
    for g in range(400):  # pairs of 90 runs of words, 80 of them shared
        text = [f"g{g}w{i}" for i in range(94)]
        rows.append((2 * g, " ".join(text)))
        text[10 + g % 20] = text[50 + g % 30] = f"e{g}"
        rows.append((2 * g + 1, " ".join(text)))
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).agg({"n_links": "sum"}).first()[0]
    assert jaccard.RECALL * 800 <= got <= 800


def test_similar_moves_no_tokens_to_split_buckets(spark):
    """Two levels of splitting against a plain loop, with sets that stay where they are."""
    rng = np.random.default_rng(9)
    u = np.uint64
    sets = {int(k) + (int(k) % 3 << 33): np.unique(rng.integers(0, 60, 40)).astype(np.uint32) for k in range(70_000, 70_120)}
    first = np.array([3, -5, 8], np.int64)
    frame = spark.createDataFrame([(k, first.tolist(), bytearray(v.tobytes())) for k, v in sets.items()], "uid long, paths array<long>, tokens binary")

    def below(own, path):
        at = np.array([path], np.int64).view(u)
        return jaccard.next_path(own[jaccard.chosen(own, at, jaccard.limits(np.array([len(own)]), 0.8))], at).view(np.int64).tolist()

    one = {(p, k, int(f)) for k, own in sets.items() for f in first[:2] for p in below(own, f)}
    asked = [k for k in sets if k % 2]
    large = spark.createDataFrame([(int(f), k, 60) for k in asked for f in first[:2]], "path long, uid long, size long")
    got = jaccard.split_further(large, frame, [], 0.8)
    assert {tuple(r) for r in got.collect()} == {(p, k, f, 60) for p, k, f in one if k % 2}
    assert not [line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line and "tokens" in line]
    second = [(p, k, 7) for p, k, f in one if k % 2 and f == 3]
    deeper = jaccard.split_further(spark.createDataFrame(second, "path long, uid long, size long"), frame, [np.array([3], np.int64)], 0.8)
    assert {tuple(r) for r in deeper.collect()} == {(q, k, p, 7) for p, k, _ in second for q in below(sets[k], p)}

    few = spark.createDataFrame([(k,) for k in asked[:9]] + [(0,), (32_768,)], "uid long")
    wide = frame.unionByName(spark.createDataFrame([(k, [], bytearray()) for k in (0, 1, 32_768, 32_769)], frame.schema))
    near = jaccard.among(wide, few)
    assert sorted(r.uid for r in near.collect()) == sorted([*asked[:9], 0, 32_768])
    assert not [line for line in near._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line and "tokens" in line]


def test_similar_of_nothing(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = jaccard.similar(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.class_id, r.n_links) for r in one] == [(None, None, 1)] * 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_toxicity_finds_sentences_and_holds_out(spark):
    rng = random.Random(4)
    clean = [f"c{k}" for k in range(200)]
    docs, labels = [], []
    for i in range(600):
        lines = [" ".join(rng.choices(clean, k=8)) + "." for _ in range(4)]
        bad = i % 5 == 0
        if bad:
            lines[2] = "You Zorg, " + lines[2]
        docs.append((i, " ".join(lines), "en", "src"))
        labels.append((i, int(bad) if i % 7 else None))
    docs += [(1000, "", "en", "s"), (1001, None, "en", "s"), (0, docs[0][1], "en", "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.score(d, model).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id >= 1000:
            assert r.score == 0 and r.offending == []
        else:
            assert (r.score >= toxicity.THRESHOLD) == (r.doc_id % 5 == 0)
            if r.doc_id % 5 == 0:
                raw = docs[r.doc_id][1].encode()
                assert [b"zorg" in raw[o.start : o.end].lower() for o in r.offending] == [True]
    held = spark.range(200).selectExpr("id", "id AS doc_id")
    held = held.select("id", toxicity.held_out(held.doc_id)).collect()
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in held)
    none = toxicity.score(d, toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int")))
    assert none.agg({"score": "max"}).first()[0] < 0.01


def test_toxicity_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    scored = toxicity.score(d, toxicity.train(d, labels)).join(labels, "doc_id").where(toxicity.held_out(labels["doc_id"])).collect()
    right = np.mean([(r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in scored])
    assert len(scored) > 500 and right > 0.97


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["good", "fine", "well"] if i % 3 else ["bad", "poor", "ill"], k=rng.randrange(5, 60))), "x") for i in range(400)]
    docs += [(900, "", "x"), (901, None, "x")]
    labels = [(i, 1 if i % 3 else 0) for i in range(0, 400, 2)] + [(1, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, rate string").repartition(3)
    rows = mixing.mixed(d, spark.createDataFrame(labels, "doc_id long, quality int"), [0.5, 0.5]).collect()
    total = np.sum([np.array(r.posterior) * r.n_tokens * r.rate for r in rows], axis=0)
    assert abs(total[0] / total.sum() - 0.5) < 1e-3 and all(r.rate >= 0 for r in rows)
    assert {r.doc_id: r.rate for r in rows if r.doc_id >= 900} == {900: 1.0, 901: 1.0}
    down = mixing.mixed(d, spark.createDataFrame(labels, "doc_id long, quality int"), [0.9, 0.1], budget=2000.0).collect()
    total = np.sum([np.array(r.posterior) * r.n_tokens * r.rate for r in down], axis=0)
    assert abs(total[0] - 1800) < 5 and abs(total[1] - 200) < 5 and all(r.rate >= 0 for r in down)


def test_mixing_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert mixing.mixed(d, none, [0.5, 0.5]).first().rate == 1.0
    assert mixing.mixed(d.limit(0), none, [0.5, 0.5]).count() == 0


def test_quotes_link_and_leave_no_quotes(spark):
    rows = [
        (1, 0, "user", "Where is the  Key?\nI lost it."),
        (1, 1, "assistant", "Under the mat."),
        (1, 2, "user", "> where is the key?\n> I lost it.\nI found it."),
        (1, 3, "assistant", ">> I lost it.\n> Under the mat.\nGood."),
        (1, 4, "user", "> never said\nWhat?"),
        (1, 5, "user", "> Good.\n> > x\nyes"),
        (2, 0, None, None),
        (2, None, "user", "x"),
        (None, 3, "user", "> x"),
        (1, 1, "assistant", "Under the mat."),
    ]
    got = quotes.link_quotes(spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, hash int"))
    by = {(r.conv_id, r.turn, r.body): r for r in got.collect()}
    assert got.count() == len(rows)
    assert by[1, 2, "I found it."].parent_turn == 0 and by[1, 2, "I found it."].n_linked == 1
    assert by[1, 3, "Good."].parent_turn == 1 and by[1, 3, "Good."].n_linked == 2
    assert by[1, 4, "What?"].parent_turn == 3 and by[1, 4, "What?"].n_passages == 1
    assert by[1, 5, "yes"].parent_turn == 3 and by[1, 5, "yes"].n_passages == 2
    assert by[1, 1, "Under the mat."].parent_turn == 0
    assert by[2, 0, ""].role == "user" and by[2, None, "x"].parent_turn == -1
    assert by[None, 3, ""].parent_turn == -1
    assert all(not line.startswith(">") for r in by.values() for line in r.body.split("\n"))


def test_quotes_of_several_lines_out_of_longer_messages(spark):
    long = "Dear all,\nthe bus leaves at nine.\nBring water.\n\nLunch is at noon\nin the old mill.\n\nYours,\nAda"
    rows = [
        (1, 0, "user", long),
        (1, 1, "user", "Bring water.\nLunch is at noon"),
        (1, 2, "user", "Yours,\nEve"),
        (1, 3, "user", "> the bus leaves at nine.\n> Bring water.\nFine."),  # two lines of many
        (1, 4, "user", "> Lunch is at noon in\n> the old mill.\nOn foot?"),  # a paragraph, wrapped anew
        (1, 5, "user", "> the bus leaves at nine.\nFirst part\nof mine.\n> Yours,\nSecond part\nof mine."),
        (1, 6, "user", "> First part of\n> mine.\nA."),  # one block of an interleaved reply
        (1, 7, "user", "> Dear all,\n> [...]\n> Bring water.\n> Lunch is at noon\nB."),  # most lines, not in one piece
        (1, 8, "user", "> Dear all,\n> who\nC."),  # half of the lines
        (1, 9, "user", "> of mine.\n> Second part\n> of mine.\nD."),
        (1, 10, "user", "> Fine.\n\n> On foot?\nE."),
        (1, 10, "user", "> Fine.\n\n> On foot?\nE."),
        (None, 0, "user", "a\nb\nc"), (None, 1, "user", "x"), (None, 2, "user", "> b\n> c\ny"),
    ]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = sorted(((r.conv_id, r.turn, r.parent_turn, r.n_passages, r.n_linked) for r in got.collect()), key=repr)
    want = [(1, 0, -1, 0, 0), (1, 1, 0, 0, 0), (1, 2, 1, 0, 0), (1, 3, 0, 1, 1), (1, 4, 0, 1, 1), (1, 5, 2, 2, 2), (1, 6, 5, 1, 1), (1, 7, 0, 1, 1), (1, 8, 7, 1, 0), (1, 9, 5, 1, 1), (1, 10, 4, 2, 2), (1, 10, 4, 2, 2), (None, 0, -1, 0, 0), (None, 1, 0, 0, 0), (None, 2, 0, 1, 1)]
    assert out == sorted(want, key=repr)


def quoted_brute(rows):
    """Per message what the operator's description says, pair by pair: (conv_id, turn, parent_turn, n_passages, n_linked, body)."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).strip(" ")
    mark = re.compile(r"(?:\s*>)+", re.ASCII)

    def parsed(text):
        runs = []
        for line in (text or "").split("\n"):
            found = mark.match(line)
            level = found.group().count(">") if found else 0
            if level:
                line = re.sub(r"^ ", "", line[found.end() :])
            if runs and runs[-1][0] == level:
                runs[-1][1].append(line)
            else:
                runs.append((level, [line]))
        runs = [(n, "\n".join(x)) for n, x in runs]
        free = [x for n, x in runs if not n]
        return "\n".join(free).strip(" "), free, [(n, x) for n, x in runs if n]

    lines = lambda t: [x for x in map(norm, t.split("\n")) if x]
    made = [(c, t, *parsed(x)) for c, t, _, x in rows]
    out = []
    for c, t, body, _, passages in made:
        lengths = {len(lines(x)) for d, *_, p in made if d == c for _, x in p}
        earlier = [m for m in made if m[0] == c and t is not None and m[1] is not None and m[1] < t and m[2]]
        links = []
        for level, text in passages:
            hits = []
            for _, s, other, free, _ in earlier:
                own = lines(other)
                parts = {norm(x) for r in free for x in [r, *re.split(r"\n[\x20\x09-\x0D]*\n", r)]} - {""} | set(own)
                parts |= {" ".join(own[i : i + k]) for k in lengths if k > 1 for i in range(len(own) - k + 1)}
                if norm(text) == norm(other):
                    hits.append((1, s))
                if norm(text) in parts:
                    hits.append((0, s))
            if not hits and len(lines(text)) > 1:
                asked = set(lines(text))
                held = {}
                for _, s, other, *_ in earlier:
                    held.setdefault(s, set()).update(lines(other))
                best = max(((len(asked & x), s) for s, x in held.items()), default=(0, 0))
                hits += [(0, best[1])] if best[0] * 2 > len(asked) else []
            if hits:
                links.append((-level, *max(hits)))
        before = [s for d, s, *_ in made if d == c and s is not None and t is not None and s < t]
        out.append((c, t, max(links)[2] if links else max(before, default=-1), len(passages), len(links), body))
    return out


def test_quotes_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for c in range(12):
        texts = []
        for t in range(9):
            parts = []
            for _ in range(rng.randrange(1, 4)):
                if texts and rng.random() < 0.6:
                    source = rng.choice(texts).split("\n")
                    a = rng.randrange(len(source))
                    own = source[a : a + rng.randrange(1, 4)]
                    if rng.random() < 0.3:
                        own.insert(rng.randrange(len(own) + 1), "changed")
                    level = rng.choice(["> ", ">", "> > ", ">>"])
                    parts.append("\n".join(level + x for x in own))
                parts.append("\n".join(rng.choice([f"{rng.choice('abcd')} {rng.choice('xyz')}", f"line {rng.randrange(20)}", "", "Yes."]) for _ in range(rng.randrange(1, 5))))
            texts.append("\n".join(parts))
            rows.append((c, t, "user", texts[-1]))
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = sorted((r.conv_id, r.turn, r.parent_turn, r.n_passages, r.n_linked, r.body) for r in got.collect())
    want = sorted(quoted_brute(rows))
    assert found == want
    assert sum(x[4] for x in want) > 60


def test_conversations_are_built_in_reply_order(spark):
    rows = [(1, 0, "user", "one <|system|> x"), (1, 1, "assistant", "two"), (1, 2, "user", "> one <|system|> x\nthree"), (2, 0, None, None), (1, 3, "assistant", ">" * 50 + " deep\nfour"), (3, 5, "user", "w " * 30_000)]
    linked = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.part): r for r in quotes.conversations(linked, 3).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (3, 0)}
    assert got[1, 0].replies == "0<-1,1<0,2<0" and got[1, 0].text == "<|user|>\none < |system|> x\n<|assistant|>\ntwo\n<|user|>\nthree\n"
    assert got[1, 1].replies == "3<2" and got[1, 1].text == "<|assistant|>\nfour\n" and got[1, 1].n_passages == 1
    assert got[2, 0].text == "<|user|>\n\n" and len(got[3, 0].text) > 59_000
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.conversations(quotes.link_quotes(none)).count() == 0


def test_mixing_against_plain_loops(spark):
    rng = random.Random(7)
    good, bad = [f"g{k}" for k in range(9)], [f"b{k}" for k in range(9)]
    docs = [(i, " ".join(rng.choices(good + bad[: i % 7], k=rng.randrange(0, 40)))) for i in range(150)] + [(3, "b1 b2 " * 10), (3, "b1 b2 " * 10), (200, None), (201, "g1 " * 20_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 7 < 3)) for i in range(150)], "doc_id long, quality int")
    rows = mixing.mixed(d, labels, [0.3, 0.7]).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((i, len((t or "").split())) for i, t in docs)
    assert all(abs(sum(r.posterior) - 1) < 1e-12 and r.missed < 1e-6 for r in rows)
    # rates are a point at which no projected gradient is left
    total = [sum(r.posterior[k] * r.n_tokens * r.rate for r in rows) for k in (0, 1)]
    want = [0.3 * sum(total), 0.7 * sum(total)]
    for r in rows:
        gradient = r.n_tokens * sum(p * (w - t) for p, w, t in zip(r.posterior, want, total, strict=True))
        assert abs(gradient) <= 1e-3 * r.n_tokens * sum(total) or (r.rate == 0 and gradient < 0)
    same = spark.createDataFrame([(i, "a b c") for i in range(30)], "doc_id long, text string")
    missed = mixing.mixed(same, labels.where("doc_id < 30"), [0.9, 0.1], least=1.0).collect()
    assert all(r.missed > 0.05 and r.rate >= 1 for r in missed)  # one mixture of domains cannot become another


def test_toxicity_scores_are_the_noisy_or_of_sentences(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"word{k}" for k in range(30)] + ["Zorg", "né", "x1"]
    weights = rng.normal(size=toxicity.BUCKETS) * 2

    def z(sentence):
        own = sorted(set(re.findall(r"[^ ,]+", sentence)))
        features = set()
        for w in own:
            s = toxicity.sentences(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
            features |= set(s.bucket.tolist())
        return sum(weights[b] for b in features) - 3.0

    texts = []
    for _ in range(40):
        lines = [" ".join(rng.choice(vocabulary, rng.integers(1, 7))) for _ in range(rng.integers(1, 5))]
        texts.append("".join(x + rng.choice([". ", "! ", "?\n", "\n"]) for x in lines))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (98, "word1 " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(frame, (weights, -3.0)).collect()}
    for i, t in enumerate(texts):
        clean = 1.0
        for sentence in filter(None, (x.strip() for x in re.split(r"[.!?\n]+", t))):
            clean *= 1 - 1 / (1 + np.exp(-z(sentence)))
        assert abs(got[i] - (1 - clean)) < 1e-4, i
    assert got[99] == 0 and abs(got[98] - 1 / (1 + np.exp(-z("word1")))) < 1e-4


def test_quotes_of_long_messages_and_of_common_lines(spark):
    """Runs of many lengths out of one long message, and lines that all messages of a conversation hold."""
    lines = [f"line {i} of it" for i in range(20_000)]
    rows = [(1, 0, "user", "\n".join(lines))]
    rows += [(1, k + 1, "user", "\n".join(f"> {x}" for x in lines[k * 499 : k * 499 + 2 + k * k]) + f"\nreply {k}") for k in range(12)]
    for k in range(400):
        rows.append((2, k, "user", f"thanks\nok {k % 7}" if k % 2 else f"> thanks\n> not there {k % 5}\n> ok {k % 7}\nme too {k}"))
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[1, k + 1].n_linked == 1 and got[1, k + 1].parent_turn == 0 for k in range(12))
    for k in range(0, 400, 2):
        earlier = [j for j in range(1, k, 2) if j % 7 == k % 7]  # the last one that thanks and says the same
        assert (got[2, k].n_linked, got[2, k].parent_turn) == ((1, earlier[-1]) if earlier else (0, k - 1))
