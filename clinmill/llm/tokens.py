"""SentencePiece BPE: exact encoding by a table of each prefix's last token, and decoding.

BPE merges the adjacent pair whose piece scores best, leftmost first. Three facts make this a table:

* What happens inside a stretch that no merge leaves is what happens to the stretch alone. So a token that ends a
  prefix is its last token exactly if it can be built alone and stands next to the last token of the prefix before
  it as it would in a text of these two.
* Each prefix therefore has one last token, found among the pieces that an automaton reports as ending there.
* Ids are read off backwards from the end of the text.

The time is in proportion to the text, whatever it holds. No piece goes on behind a word (where the vocabulary has
space symbols only at the beginning of pieces) or from one script into another, so such stretches are encoded apart
and those that a task has met are looked up.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_iter_udf

#: Fixed values of the model format: the symbol for a space, what an unknown id decodes to, the surface of a byte
#: that belongs to no character.
SPACE, UNKNOWN, BROKEN = "▁", " ⁇ ", "�"
#: Stretches (and pairs of pieces) kept in a task's table, and the longest that is kept.
KEPT, LONGEST = 600_000, 48
NEVER = float("inf")


@dataclass
class Vocabulary:
    """What a task needs of a model; its size is that of the vocabulary."""

    ids: dict[str, int]  # of the pieces of texts
    score: dict[str, float]
    byte: list[int]  # ids of the 256 byte pieces, or none
    shown: list[str]  # what each id decodes to, with the space symbol in it
    control: frozenset[int]
    unknown: int
    bos: int
    eos: int
    built: dict[str, tuple[str, str]] = field(default_factory=dict)  # last merge of each piece that can be built
    steady: set[str] = field(default_factory=set)  # pieces whose merges have falling scores
    by_word: bool = True
    pattern: str = ""  # of the stretches that no merge leaves


def load(path: str) -> Vocabulary:
    """Reads a model file on the driver.

    The model must be BPE that keeps white space and puts a space before the text (`add_dummy_prefix`), as its
    own normaliser shows on samples; ValueError otherwise."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("", "a", " a  b ", "ﬁ①Å\t\n", "a▁b\x00"):
        if sp.normalize(text) != (SPACE + text.replace(" ", SPACE) if text else ""):
            raise ValueError("the model's normaliser changes texts in a way that is not supported")
    n = sp.get_piece_size()
    byte = [i for i in range(n) if sp.is_byte(i)]
    control = frozenset(i for i in range(n) if sp.is_control(i))
    text = [i for i in range(n) if i not in control and not sp.is_byte(i) and not sp.is_unknown(i) and not sp.is_unused(i)]
    v = Vocabulary(
        ids={sp.id_to_piece(i): i for i in text}, score={sp.id_to_piece(i): sp.get_score(i) for i in text}, byte=sorted(byte, key=lambda i: int(sp.id_to_piece(i)[3:5], 16)),
        shown=["" if i in control else UNKNOWN if sp.is_unknown(i) else sp.id_to_piece(i) for i in range(n)], control=control, unknown=sp.unk_id(), bos=sp.bos_id(), eos=sp.eos_id(),
    )
    if any(c not in v.ids for p in v.ids for c in p):
        raise ValueError("pieces with characters that are no pieces are not supported")
    v.by_word = not any(SPACE in p.lstrip(SPACE) for p in v.ids)
    for piece in v.ids:
        made: list[tuple[str, str]] = []
        if merged(v.score, piece, made) == [piece]:
            v.built[piece] = made[-1] if made else (piece, "")
            scores = [v.score[a + b] for a, b in made]
            if all(a > b for a, b in zip(scores[:-1], scores[1:], strict=True)):
                v.steady.add(piece)
    v.pattern = stretches(v, frozenset(c for c in v.ids if len(c) == 1))
    return v


def merged(score: dict[str, float], text: str, made: list | None = None) -> list[str]:
    """Merges by the definition, best score first and leftmost among equals; for short texts. `made` gets the merges."""
    parts = list(text)
    while len(parts) > 1:
        at, best = -1, -NEVER
        for k in range(len(parts) - 1):
            s = score.get(parts[k] + parts[k + 1])
            if s is not None and s > best:
                at, best = k, s
        if at < 0:
            break
        if made is not None:
            made.append((parts[at], parts[at + 1]))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def stretches(v: Vocabulary, known: frozenset[str]) -> str:
    """A pattern of the stretches that no merge leaves.

    Characters are in one class if a chain of pieces joins them (in practice, a script); a stretch is a run of one
    class with the spaces before it, a character that no piece joins to another, or a run of unknown characters."""
    kin: dict[str, set[str]] = {}
    for p in v.built:
        chars = set(p) - ({SPACE} if v.by_word else set())
        if len(chars) + len(p) > 2:
            group = set(chars).union(*(kin.get(c, ()) for c in chars))
            for c in group:
                kin[c] = group
    groups = sorted({id(g): g for g in kin.values()}.values(), key=lambda g: (-len(g), min(g)))
    alone = known - set(kin) - ({SPACE} if v.by_word else set())
    of = lambda chars: "[" + re.escape("".join(sorted(chars))) + "]"
    before = f"{SPACE}*" if v.by_word else ""
    return "|".join([*(f"{before}{of(g)}+" for g in groups), *[f"{before}{of(alone)}"] * bool(alone), *[f"{SPACE}+"] * v.by_word, f"[^{of(known)[1:]}+"])


class Met(dict):
    """Stretches met so far and their packed ids; pieces stand for themselves."""

    def __init__(self, codec: Codec):
        super().__init__(codec.packed)
        self.codec = codec

    def __missing__(self, s: str) -> bytes:
        got = self.codec.stretch(s)
        if len(s) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
                self.update(self.codec.packed)
            self[s] = got
        return got


class Codec:
    """Encoding and decoding with tables that grow to a bound."""

    def __init__(self, v: Vocabulary):
        import ahocorasick

        self.v = v
        self.pieces = ahocorasick.Automaton()
        for p in v.built:
            self.pieces.add_word(p, p)
        self.pieces.make_automaton()
        self.known = frozenset(c for c in v.ids if len(c) == 1)
        self.words = re.compile(v.pattern)
        self.edges: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.packed = {p: np.array([v.ids[p]], "<u4").tobytes() for p in v.built}
        self.of = Met(self)
        self.plain = np.ones(len(v.shown) + 1, bool)
        self.plain[v.byte] = False

    def edge(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """What stands at an end of a piece while it is built, each with the (negated) score of the merge that takes it up."""
        key = piece, right
        if key not in self.edges:
            out, until, p = [], NEVER, piece
            while True:
                out.append((p, until))
                if len(p) == 1:
                    break
                until, p = -self.v.score[p], self.v.built[p][right]
            self.edges[key] = out[::-1]
        return self.edges[key]

    def compatible(self, a: str, b: str) -> bool:
        """Whether the text a + b is encoded as these two pieces.

        Both are built side by side in the order of scores; the pair is lost if at some time a merge of what stands
        left and right of the border comes before the next merge of either side. Of equal scores the leftmost is
        first: a merge within a, then that over the border, then one within b."""
        key = a, b
        if key not in self.fits:
            if len(self.fits) >= KEPT:
                self.fits.clear()
            self.fits[key] = self._beside(a, b) if a in self.v.steady and b in self.v.steady else merged(self.v.score, a + b) == [a, b]
        return self.fits[key]

    def _beside(self, a: str, b: str) -> bool:
        left, right, score = self.edge(a, True), self.edge(b, False), self.v.score
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            s = score.get(x + y)
            if s is not None and -s < x_until and -s <= y_until:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def run(self, s: str) -> bytes:
        """Packed ids of a stretch of known characters."""
        last: list[str | None] = [None] * (len(s) + 1)
        fits = self.fits
        for end, piece in self.pieces.iter(s):
            end += 1
            if last[end] is None:
                begin = end - len(piece)
                if begin:
                    before = last[begin]
                    fit = fits.get((before, piece))
                    if not (self.compatible(before, piece) if fit is None else fit):
                        continue
                last[end] = piece
        out, at, packed = [], len(s), self.packed
        while at:
            piece = last[at]
            out.append(packed[piece])
            at -= len(piece)
        return b"".join(out[::-1])

    def stretch(self, s: str) -> bytes:
        """Packed ids of a stretch that no merge leaves."""
        if s[0] in self.known:
            return self.run(s)
        if self.v.byte:
            return np.array([self.v.byte[b] for b in s.encode()], "<u4").tobytes()
        return np.array([self.v.unknown], "<u4").tobytes()  # neighbouring unknown characters are one

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = [np.array([self.v.bos] * bos, "<u4").tobytes()]
        if text:
            parts += map(self.of.__getitem__, self.words.findall(SPACE + text.replace(" ", SPACE)))
        parts.append(np.array([self.v.eos] * eos, "<u4").tobytes())
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: control ids show nothing, bytes join to characters, one space goes at the beginning."""
        x = np.frombuffer(ids, "<u4")
        if len(x) and int(x.max()) >= len(self.v.shown):
            raise ValueError("an id is not in the vocabulary")
        shown = self.v.shown
        if self.plain[x].all():
            text = "".join([shown[i] for i in x.tolist()])
        else:
            parts, held, value = [], bytearray(), {i: b for b, i in enumerate(self.v.byte)}
            for i in x.tolist():
                if i in value:
                    held.append(value[i])
                    continue
                if held:
                    parts.append(characters(bytes(held)))
                    held.clear()
                parts.append(shown[i])
            parts.append(characters(bytes(held)))
            text = "".join(parts)
        return text.removeprefix(SPACE).replace(SPACE, " ")


def characters(b: bytes) -> str:
    """UTF-8 with a sign for each byte that belongs to no character."""
    try:
        return b.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(b):
            size = 1 + (b[at] >= 0xC0) + (b[at] >= 0xE0) + (b[at] >= 0xF0)
            try:
                out.append(b[at : at + size].decode())
                at += size
            except UnicodeDecodeError:
                out.append(BROKEN)
                at += 1
        return "".join(out)


def _in_tasks(spark: SparkSession, path: str, step, schema: str, kind: pa.DataType):
    """An Arrow UDF of step(codec, value); the vocabulary's tables go to the tasks as a broadcast of their bounded size."""
    shared = spark.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value)
        for col in batches:
            parts = [pa.array([step(codec, x) for x in col.slice(i, 256).to_pylist()], kind) for i in range(0, len(col), 256)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return arrow_iter_udf(run, schema)


def encoded(df: DataFrame, path: str, text: str = "text", out: str = "ids", bos: bool = True, eos: bool = True) -> DataFrame:
    """df with a column `out`: the ids of `text` as array<int>.

    Null text counts as empty and gives the begin and end ids only. All other columns and repeated rows stay."""

    def step(codec: Codec, x: str | None):
        return array("i", codec.encode(x or "", bos, eos)).tolist()

    return df.withColumn(out, _in_tasks(df.sparkSession, path, step, "array<int>", pa.list_(pa.int32()))(F.col(text).cast("string")))


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a column `out`: the text of the array `ids`. Null ids give null, no ids an empty text; null entries are left out."""

    def step(codec: Codec, x: list | None):
        return None if x is None else codec.decode(np.array([i for i in x if i is not None], "<u4").tobytes())

    return df.withColumn(out, _in_tasks(df.sparkSession, path, step, "string", pa.string())(F.col(ids).cast("array<int>")))


def round_trip(spark: SparkSession, path: str, text: Column) -> Column:
    """struct<ids binary, decoded string>: packed little-endian ids with begin and end, and what they decode to."""
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    def step(codec: Codec, x: str | None):
        ids = codec.encode(x or "")
        return {"ids": ids, "decoded": codec.decode(ids)}

    return _in_tasks(spark, path, step, "ids binary, decoded string", kind)(text.cast("string"))


def token_report(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty; repeated rows give repeated rows; a null doc_id stays null; other columns are ignored."""
    out = docs.select("doc_id", round_trip(docs.sparkSession, path, F.col("text")).alias("__x"))
    return out.select("doc_id", (F.octet_length("__x.ids") / 4).cast("long").alias("n_tokens"), F.sha2("__x.ids", 256).alias("ids_sha256"), F.sha2(F.encode("__x.decoded", "UTF-8"), 256).alias("decoded_sha256"))
