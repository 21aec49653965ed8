"""SentencePiece encoding and decoding against the library, on texts, vocabularies of its pieces and random ids."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinmill.llm import tokens

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load(MODEL)


@pytest.fixture(scope="module")
def codec(vocabulary):
    return tokens.Codec(vocabulary)


def strange(r, pieces):
    kind = r.randrange(5)
    if kind == 0:
        return "".join(r.choice(pieces).replace("▁", " ") for _ in range(r.randint(0, 12)))
    if kind == 1:
        return "".join(r.choice("ab ▁ \n\té漢\U0001f600\x00<>s/'.,") for _ in range(r.randint(0, 40)))
    if kind == 2:
        return " " * r.randint(0, 70) + r.choice(["", "a", "the", "---" * r.randint(0, 20)]) + " " * r.randint(0, 40)
    if kind == 3:
        return "".join(r.choice("aeiourstln") for _ in range(r.randint(0, 60)))
    return "".join(chr(r.choice([r.randint(0, 0x2FFF), r.randint(32, 126), r.randint(0xE000, 0x1FFFF)])) for _ in range(r.randint(0, 30)))


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_same_ids_and_texts_as_the_library(codec, library, vocabulary):
    r, pieces = random.Random(7), sorted(vocabulary.ids)
    texts = ["", " ", "\x00", "▁", "<s> </s> <0x0A> <unk>", "�", "ﬁ①", *(strange(r, pieces) for _ in range(6000))]
    for text in texts:
        want = library.encode(text, add_bos=True, add_eos=True)
        got = codec.encode(text)
        assert ids_of(got) == want, text
        assert codec.decode(got) == library.decode(want), text


def test_ids_that_no_text_gives_decode_alike(codec, library):
    r = random.Random(11)
    for _ in range(6000):
        ids = [r.choice([r.randrange(32000), r.randrange(300), r.randint(3, 258)]) for _ in range(r.randint(0, 9))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_pairs_stand_together_as_merging_says(codec, vocabulary):
    r, pieces = random.Random(5), sorted(vocabulary.built)
    short = [p for p in pieces if len(p) <= 4]
    for _ in range(20_000):
        a, b = r.choice(short), r.choice(short)
        assert codec.compatible(a, b) == (tokens.merged(vocabulary.score, a + b) == [a, b]), (a, b)


def test_small_vocabularies_against_the_definition():
    """Invented vocabularies, whose merges don't come in the order of their parts, with equal scores."""
    r = random.Random(3)
    for _ in range(60):
        pieces = set("abc▁")
        while len(pieces) < 14:
            pieces.add("".join(r.choice("abc▁") for _ in range(r.randint(2, 5))))
        score = {p: float(-r.randrange(8)) for p in pieces}
        v = tokens.Vocabulary({p: k for k, p in enumerate(sorted(pieces))}, score, [], sorted(pieces), frozenset(), 99, 98, 97)
        v.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        for p in pieces:
            made = []
            if tokens.merged(score, p, made) == [p]:
                v.built[p] = made[-1] if made else (p, "")
                s = [score[a + b] for a, b in made]
                if all(x > y for x, y in zip(s[:-1], s[1:], strict=True)) and len({score[q] for q in pieces}) == len(pieces):
                    v.steady.add(p)
        v.pattern = tokens.stretches(v, frozenset("abc▁"))
        codec = tokens.Codec(v)
        for _ in range(60):
            text = "".join(r.choice("abc ") for _ in range(r.randint(1, 14)))
            want = [v.ids[p] for p in tokens.merged(score, "▁" + text.replace(" ", "▁"))]
            assert ids_of(codec.encode(text, False, False)) == want, (text, score)


def test_report_on_edge_rows(edge, library):
    got = tokens.token_report(edge, MODEL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    key = lambda d, n, a, b: (d is None, d or 0, n, a, b)

    def of(d, text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        return key(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())

    assert sorted(key(*x) for x in got.collect()) == sorted(of(x.doc_id, x.text) for x in edge.collect())
    assert tokens.token_report(edge.limit(0), MODEL).count() == 0


def test_columns_of_ids_and_texts(make_docs, library):
    texts = ["one two  three", None, "", "漢字 \U0001f600"]
    df = tokens.decoded(tokens.encoded(make_docs(texts), MODEL, bos=False), MODEL)
    for x in df.collect():
        want = library.encode(x.text or "", add_eos=True)
        assert x.ids == want and x.decoded == library.decode(want) and x.spans == "x"
    odd = tokens.decoded(df.select(F.lit(None).cast("array<int>").alias("ids")).limit(1), MODEL).first()
    assert odd.decoded is None


def test_long_texts_without_spaces(codec, library):
    r = random.Random(2)
    for text in ("a" * 200_000, "".join(r.choice("abcdefghij") for _ in range(200_000)), " " * 200_000, "漢" * 200_000, "-" * 200_000, "\U0001f600" * 50_000):
        began = time.process_time()
        got = codec.encode(text)
        assert time.process_time() - began < 8
        assert ids_of(got) == library.encode(text, add_bos=True, add_eos=True)


def test_the_documents(spark, library):
    """Every row of the small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {x.doc_id: x for x in tokens.token_report(docs, MODEL).collect()}
    for x in docs.collect():
        ids = library.encode(x.text or "", add_bos=True, add_eos=True)
        assert got[x.doc_id].n_tokens == len(ids)
        assert got[x.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[x.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
