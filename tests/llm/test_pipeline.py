import corpus_pipeline

from clinmill.llm import common


def test_pipeline_edges(spark, tmp_path, edge):
    d = str(tmp_path)
    edge.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d)
    assert {"doc_id", "text", "lang", "source", "n_chars", "copy"} <= set(out.columns)
    out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]


def planted(spark, d):
    """Documents with toxic texts, exact and near copies, benchmark passages and personal data; the rest is clean."""
    from .conftest import words

    body = lambda k, n=70: words(n, 10_000 + k)
    texts, kind = [], []

    def add(what, t):
        texts.append(t)
        kind.append(what)

    for k in range(240):
        add("clean", " ".join(body(k)))
    for k in range(60):
        w = body(300 + k)
        w[30:30] = ["you", "stupid", "clown", "pathetic"][: 2 + k % 3]
        add("toxic", " ".join(w))
    for k in range(10):
        add("copy", texts[k])
        w = texts[20 + k].split()
        w[35] = "other"
        add("near", " ".join(w))
    item = words(40, 77)
    for k in range(6):
        add("leak", " ".join([*body(400 + k), *item, *body(500 + k)]))
    for k in range(8):
        add("private", " ".join([*body(600 + k), f"write to jim.{k}9@mail.example.com or 10.0.0.{k}", *body(700 + k)]))
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(x == "toxic")) for k, x in enumerate(kind, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item)), (1, " ".join(words(30, 78)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return texts, kind


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's rows against what was planted, and run() against the stages applied one by one."""
    import re

    d = str(tmp_path)
    texts, kind = planted(spark, d)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    left = [k for k, x in enumerate(kind, 1) if x != "toxic"]
    docs = common.stored(stage["toxicity"](spark, docs, d))
    assert ids(docs) == left and docs.columns == cols
    sets = {k: {tuple(w[i : i + 5]) for w in [texts[k - 1].split()] for i in range(len(w) - 4)} for k in left}
    first = [k for k in left if not any(j < k and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k]) for j in left)]
    docs = common.stored(stage["near_duplicates"](spark, docs, d))
    assert ids(docs) == first and len(first) == len(left) - 20 and docs.columns == cols
    clean = [k for k in first if kind[k - 1] != "leak"]
    docs = common.stored(stage["decontamination"](spark, docs, d))
    assert ids(docs) == clean and docs.columns == cols
    docs = common.stored(stage["personal_data"](spark, docs, d))
    assert ids(docs) == clean and docs.columns == cols
    for r in docs.collect():
        t = texts[r["doc_id"] - 1]
        if kind[r["doc_id"] - 1] == "private":
            assert r["text"] == re.sub(r"10\.0\.0\.\d", "[IP]", re.sub(r"\S+@\S+", "[EMAIL]", t)) and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == t
    out = [tuple(r) for r in stage["mixing"](spark, docs, d).select("doc_id", "source", "copy", "text").collect()]
    assert {x[0] for x in out} <= set(clean) and abs(len(out) - len(clean)) < 5 * len(clean) ** 0.5
    assert sorted(out) == sorted(tuple(r) for r in corpus_pipeline.run(spark, d).select("doc_id", "source", "copy", "text").collect())


def test_word_hashes_match_split():
    import numpy as np

    texts = ["a bb  ccc\tbb", "", "é bb", " x", "y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, row, s, e = common.words(data, offs)
    got = [(int(r), data[a:b].tobytes().decode()) for r, a, b in zip(row, s, e)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in t.split()]
    assert h[1] == h[3] == h[5] and len(set(h.tolist())) == 6


def test_word_hashes_over_blocks(monkeypatch):
    import numpy as np

    texts = ["word " * 50 + "x" * 300, "tail words here", "z" * 90]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t) for t in texts)])
    whole = common.words(data, offs)
    monkeypatch.setattr(common, "BLOCK", 64)
    for a, b in zip(whole, common.words(data, offs), strict=True):
        assert (a == b).all()
