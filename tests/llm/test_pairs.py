"""Operators on pairs and passages against brute force."""

import random

import pytest

from clinmill.llm import decontam, ngram_join, substring

from .conftest import words


def grams(t, n=5):
    w = t.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def corpus():
    r = random.Random(3)
    texts = [" ".join(words(r.randint(30, 120), k)) for k in range(60)]
    for k in range(60):  # near copies of several strengths, chains among them
        w = texts[k % 25].split()
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts + [texts[0], texts[0], texts[61], "two words", "two words", "two other", ""]


def brute(texts):
    sets = [grams(t) for t in texts]
    distinct = {}
    for k, t in enumerate(texts):
        distinct.setdefault(t, k + 1)
    heads = sorted(distinct.values())
    links, up = {h: 0 for h in heads}, {h: h for h in heads}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in heads:
        for b in heads:
            x, y = sets[a - 1], sets[b - 1]
            if a < b and x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {k + 1: (find(distinct[t]), distinct[t], links[distinct[t]]) for k, t in enumerate(texts)}


def test_jaccard_classes(make_docs):
    texts = corpus()
    want = brute(texts)
    for side in (256, 8):  # one block a component, and components cut into blocks
        got = {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in ngram_join.jaccard_classes(make_docs(texts), side=side).collect()}
        assert got == want
    assert sum(v[2] > 0 for v in want.values()) > 30


def test_jaccard_edges(edge, make_docs):
    got = ngram_join.jaccard_classes(edge).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1, 9))
    by = {r["doc_id"]: r for r in got}
    assert by[2]["class_id"] == 1 and by[5]["class_id"] == 4 and by[5]["n_copies"] == 2
    assert ngram_join.jaccard_classes(edge.limit(0)).count() == 0
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"]) == [(False, k) for k in (1, 3, 4, 6, 7, 8)]
    assert kept.where("doc_id is null").count() == 1


def test_bands_reach_the_recall():
    b, r = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 128


def test_large_near_copy_group(make_docs):
    base = words(200, 5)
    texts = []
    for k in range(400):
        w = list(base)
        w[k % 200] = f"q{k}"
        texts.append(" ".join(w))
    got = ngram_join.jaccard_classes(make_docs(texts), side=64).collect()
    assert {r["class_id"] for r in got} == {1}
    assert {r["n_links"] for r in got} == {399}


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_contaminated(spark, make_docs):
    items = [" ".join(words(40, 100 + k)) for k in range(5)]
    r = random.Random(2)

    def changed(t, every):
        w = t.split()
        return " ".join(x if k % every else f"s{r.randrange(999)}" for k, x in enumerate(w, 1))

    texts = [
        " ".join(words(100, 1)),
        " ".join(words(50, 2)) + " " + items[0].upper().replace(" ", ", ") + " " + " ".join(words(50, 3)),
        " ".join(words(300, 4)) + "\n" + changed(items[1], 8),
        " ".join(items[2].split()[:10]) + " " + " ".join(words(60, 6)),  # too little
        items[3] + " x " + items[4],
        items[0],
        items[0],
    ]
    got = {(x["doc_id"], x["item_id"]): x for x in decontam.contaminated(make_docs(texts), bench(spark, items)).collect()}
    assert set(got) == {(2, 0), (3, 1), (5, 3), (5, 4), (6, 0), (7, 0)}
    assert got[2, 0]["n_equal"] == 40 and got[2, 0]["doc_at"] == 50
    assert 30 <= got[3, 1]["n_equal"] < 40
    left = decontam.drop_contaminated(make_docs(texts), bench(spark, items))
    assert sorted(x["doc_id"] for x in left.collect()) == [1, 4]
    assert left.columns == make_docs(texts).columns


def test_contaminated_long_items(spark, make_docs):
    """An item of 3,000 tokens: copied whole, with every tenth token changed over a long stretch, half of it, and too little."""
    long, short = words(3000, 300), words(40, 301)
    other = [words(700, 400 + k) for k in range(4)]
    worn = [f"s{k}" if 500 < k < 2500 and k % 10 == 0 else w for k, w in enumerate(long)]
    texts = [other[0] + long + other[1], other[2] + worn, long[700:2300] + other[3], other[1] + long[:1400] + other[2], short + other[0] + short, other[3]]
    got = {(x["doc_id"], x["item_id"]): x for x in decontam.contaminated(make_docs([" ".join(t) for t in texts]), bench(spark, [" ".join(long), " ".join(short)])).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (5, 1)}
    assert [got[1, 0][c] for c in ("n_equal", "item_from", "item_to", "n_item", "doc_at")] == [3000, 0, 3000, 3000, 700]
    assert got[2, 0]["n_equal"] == sum(a == b for a, b in zip(long, worn, strict=True)) and got[2, 0]["doc_at"] == 700
    assert (got[3, 0]["n_equal"], got[3, 0]["item_from"], got[3, 0]["doc_at"]) == (1600, 700, 0)
    assert got[5, 1]["n_equal"] == 40 and got[5, 1]["doc_at"] == 0


def test_contaminated_edges(spark, edge):
    b = bench(spark, ["plain words only here", None, "", " ".join(words(30, 8))])
    assert decontam.contaminated(edge, b).count() == 0
    assert decontam.contaminated(edge, b.limit(0)).count() == 0
    assert decontam.contaminated(edge.limit(0), b).count() == 0
    assert decontam.drop_contaminated(edge, b).count() == edge.count()


def test_seeds_survive_a_substitution():
    """Every single substitution in a passage of 24 tokens leaves a hit of some mask."""
    import numpy as np

    h = np.arange(1, 25).astype(np.uint64)
    row = np.zeros(24, np.int64)
    base = set(decontam.seeds(h, row)[0].tolist())
    for k in range(24):
        g = h.copy()
        g[k] = 999
        assert base & set(decontam.seeds(g, row)[0].tolist())


def test_repeated_passages(make_docs):
    passage = " ".join(words(60, 50))
    texts = [" ".join(words(150, k)) for k in range(12)]
    texts[2] = texts[2] + " " + passage
    texts[7] = passage + " " + texts[7]
    texts[9] = texts[9][:200] + " " + passage + " " + texts[9][200:]
    texts.append(texts[4])
    docs = make_docs(texts)
    got = substring.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == {3, 8, 10, 5, 13}
    for r in got:
        cut = texts[r["doc_id"] - 1][r["c_from"] : r["c_to"]]
        assert sum(cut in t for t in texts) >= 2 and len(cut) >= 150
        assert r["first_doc"] in (3, 5)
    clean = {r["doc_id"]: r["text"] for r in substring.without_repeats(docs).collect()}
    assert clean[3] == texts[2] and len(clean[13]) < 50 and len(clean[8]) < len(texts[7]) - 150


def test_repeated_passages_with_a_chunk_in_every_row(make_docs, monkeypatch):
    """A header that all rows hold and a tail that a third holds: nothing is lost, whether a digest is hot or not."""
    head, tail = " ".join(words(50, 70)), " ".join(words(45, 71))
    texts = [f"{head}\n{' '.join(words(40, 500 + k))}" + (f"\n{tail}" if k % 3 == 0 else "") for k in range(240)]
    docs = make_docs(texts)
    want = None
    for hot in (1, 5_000):
        monkeypatch.setattr(substring, "HOT", hot)
        got = sorted(map(tuple, substring.repeated_passages(docs).collect()))
        assert want is None or got == want
        want = got
    for k, t in enumerate(texts, 1):
        spans = [(r[1], r[2]) for r in got if r[0] == k]
        assert sum(b - a for a, b in spans) >= 0.75 * (len(head) + (len(tail) if k % 3 == 1 else 0)), k
        assert all(r[4] in (1, 4) for r in got if r[0] == k)
        assert any(a <= 40 for a, _ in spans)


def test_ids_keep_their_type(spark, make_docs):
    texts = [" ".join(words(60, k)) for k in range(6)]
    texts += [texts[0], texts[1] + " one more", "x y"]
    docs = make_docs(texts).withColumn("doc_id", __import__("pyspark").sql.functions.expr("concat('d', doc_id)"))
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.jaccard_classes(docs).collect()}
    assert got["d7"] == "d1" and got["d8"] == "d2" and got["d3"] == "d3" and len(got) == 9
    assert ngram_join.keep_one(docs).count() == 7
    items = spark.createDataFrame([("a", texts[2])], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()] == [("d3", "a")]
    assert decontam.drop_contaminated(docs, items).count() == 8
    assert {r["doc_id"] for r in substring.repeated_passages(docs).collect()} == {"d1", "d2", "d7", "d8"}


def test_keep_one_of_rows_that_share_an_id(make_docs):
    import hashlib

    texts = ["first text of the id", "second text of the id"]
    docs = make_docs(texts[:1]).unionByName(make_docs(texts[1:])).repartition(3)
    got = ngram_join.keep_one(docs).collect()
    assert [r["text"] for r in got] == [min(texts, key=lambda t: hashlib.md5(t.encode()).digest())]
    assert ngram_join.keep_one(docs).columns == docs.columns


def test_long_chains_settle(spark):
    from clinmill.operators.graph import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(700) if k != 350], "src long, dst long")
    got = {r["id"]: r["comp"] for r in components(edges).collect()}
    assert got == {k: 0 if k <= 350 else 351 for k in range(701)}


def test_contaminated_against_brute_force(spark, make_docs):
    """Items of 20 to 5,000 words, planted whole, in part, worn, or not at all, against all diagonals."""
    import numpy as np

    r = random.Random(21)
    items = [words(n, 900 + n) for n in (20, 25, 33, 48, 70, 150, 400, 1100, 2500, 5000)]
    texts, planted = [], []
    for k in range(60):
        it = items[k % len(items)]
        share = r.choice([1.0, 0.8, 0.6, 0.3])
        n = max(1, int(share * len(it)))
        a = r.randrange(len(it) - n + 1)
        every = r.choice([0, 0, 20, 9])
        part = [f"s{x}" if every and x % every == every - 1 else w for x, w in enumerate(it[a : a + n])]
        texts.append(words(r.randint(0, 300), 3000 + k) + part + words(r.randint(0, 300), 4000 + k))
    docs = make_docs([" ".join(t) for t in texts])
    found = {(x["doc_id"], x["item_id"]): x["n_equal"] for x in decontam.contaminated(docs, bench(spark, [" ".join(i) for i in items])).collect()}
    code: dict = {}
    num = lambda t: np.array([code.setdefault(w, len(code)) for w in t])
    want = {}
    for d, t in enumerate(texts, 1):
        for i, it in enumerate(items):
            x, y = num(t), num(it)
            best = max((decontam.overlap(x, y, s)[0] for s in np.unique(np.subtract.outer(np.flatnonzero(np.isin(x, y)), np.arange(len(y)))[np.equal.outer(x[np.isin(x, y)], y)]).tolist()), default=0)
            if best >= min(16, max(13, len(it))) and best >= 0.5 * len(it):
                want[d, i] = best
    assert len(want) > 30 and set(found) <= set(want)
    assert len(found) >= 0.97 * len(want)
    assert all(found[k] == want[k] for k in found)


@pytest.mark.parametrize("every, least", [(4, 0.9), (5, 0.9), (6, 0.95), (8, 0.97)])
def test_recall_by_share_of_changed_words(spark, make_docs, every, least):
    """Items of 40 to 120 words with a word in `every` changed, at a fixed step and at random; all are to be found whose
    best overlap by definition (all diagonals) reaches the thresholds."""
    import numpy as np

    r = random.Random(every)
    items = [words(r.randint(40, 120), 5000 + k) for k in range(150)]
    texts, want = [], set()
    for k, it in enumerate(items):
        at = range(r.randrange(every), len(it), every) if k % 2 else r.sample(range(len(it)), len(it) // every)
        worn = [f"x{x}" if x in set(at) else w for x, w in enumerate(it)]
        texts.append(words(20, 6000 + k) + worn + words(15, 7000 + k))
        code: dict = {}
        num = lambda t, code=code: np.array([code.setdefault(w, len(code)) for w in t])
        if decontam.overlap(num(texts[-1]), num(it), 20)[0] >= max(16, 0.5 * len(it)):
            want.add((k + 1, k))
    found = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(make_docs([" ".join(t) for t in texts]), bench(spark, [" ".join(i) for i in items])).collect()}
    print("changed every", every, "found", len(found & want), "of", len(want))
    assert len(want) > (60 if every == 4 else 100) and len(found & want) >= least * len(want)
    assert all(d == i + 1 for d, i in found)


def test_all_texts_of_an_item_are_looked_for(spark, make_docs):
    a, b = " ".join(words(40, 1)), " ".join(words(30, 2))
    items = spark.createDataFrame([(5, a), (5, b), (5, b), (6, None), (6, b)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["n_item"] for x in decontam.contaminated(make_docs([f"so {a} on", f"so {b} on", "nothing"]), items).collect()}
    assert got == {(1, 5): 40, (2, 5): 30, (2, 6): 30}


def test_cuts_resist_insertions():
    import numpy as np

    t = " ".join(words(800, 9)).encode()
    a = np.frombuffer(t, np.uint8)
    b = np.frombuffer(b"inserted words " + t, np.uint8)
    ca, cb = substring.cuts(a, np.array([0, len(a)])), substring.cuts(b, np.array([0, len(b)]))
    assert len(set(ca[1:].tolist()) & {x - 15 for x in cb.tolist()}) >= len(ca) - 3
    assert np.diff(np.append(ca, len(a))).max() <= substring.LONGEST


def test_repeated_passages_edges(edge):
    got = substring.repeated_passages(edge).collect()
    assert got == []
    assert substring.repeated_passages(edge.limit(0)).count() == 0
    assert substring.without_repeats(edge).count() == edge.count()
    same = edge.where("doc_id = 7").unionByName(edge.where("doc_id = 7").selectExpr("99L doc_id", "text", "lang", "source", "n_chars", "spans", "bands", "digest"))
    assert {r["doc_id"] for r in substring.repeated_passages(same).collect()} == {7, 99}


def test_rows_that_share_an_id_are_one_document(make_docs):
    import hashlib

    a, b, c = (" ".join(words(90, k)) for k in (70, 71, 72))
    one = lambda *rows: [x for k, t in rows for x in [make_docs([t], first=k)]]

    def report(*rows):
        df = one(*rows)
        out = df[0]
        for d in df[1:]:
            out = out.unionByName(d)
        return out, sorted(map(tuple, substring.repeated_passages(out).collect()))

    _, plain = report((1, a), (2, a))
    _, twice = report((1, a), (2, a), (2, a), (2, a))
    assert plain and twice == plain
    _, alone = report((2, a), (2, a))
    assert alone == []
    # of different texts under one id that of the smallest digest counts, and only its row is cut
    low, high = sorted((b, c), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    docs, got = report((1, a + " " + low), (2, low), (2, high), (3, high))
    assert {r[0] for r in got} == {1, 2}
    kept = sorted((r["doc_id"], r["text"]) for r in substring.without_repeats(docs).collect())
    assert [x for x in kept if x[0] != 2] == [(1, a + " " + low), (3, high)]
    assert (2, high) in kept and len([t for d, t in kept if d == 2 and t != high][0]) < len(low) / 3


def test_recall_against_all_windows_of_fifty_words(make_docs):
    """Documents that share a passage of 50 words and more with another, shifted, found by comparing all windows."""
    r = random.Random(33)
    shared = [words(r.randint(52, 120), 500 + k) for k in range(25)]
    texts = []
    for k in range(150):
        t = words(r.randint(20, 200), 700 + k)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            at = r.randrange(len(t) + 1)
            t[at:at] = r.choice(shared)
        texts.append(t)
    seen: dict = {}
    for d, t in enumerate(texts, 1):
        for k in range(len(t) - 49):
            seen.setdefault(tuple(t[k : k + 50]), set()).add(d)
    want = {d for s in seen.values() if len(s) > 1 for d in s}
    got = {x["doc_id"] for x in substring.repeated_passages(make_docs([" ".join(t) for t in texts])).collect()}
    assert len(want) > 60 and got <= want
    assert len(got) >= 0.9 * len(want)


def test_bitmap_has_all_seeds(spark):
    import numpy as np

    r = np.random.default_rng(0)
    keys = r.integers(-(1 << 62), 1 << 62, 500) * 2 + 1
    bits = decontam._filter_bits(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert len(decontam._in_bits(bits, keys.astype(np.int64).view(np.uint64))) == 500
    other = r.integers(0, 1 << 63, 200_000).astype(np.uint64)
    assert len(decontam._in_bits(bits, other)) < 20
