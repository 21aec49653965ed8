"""Toxicity by Levenshtein automata intersected with a lexicon trie, with context-window scores."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, NOT_ALNUM, arrow_iter_udf, hash_words, ngrams, over_batches, slices, stored, utf8, words

#: Context: words before and after a hit, words that report speech, words that address a reader.
WINDOW = 8
#: Fixed lists in the corpus's four languages.
REPORTING = tuple(
    "said says wrote writes called quote quoted word term example meaning definition alleged "
    "sagte sagt schrieb nannte zitat wort begriff beispiel bedeutung "
    "disait dit écrit appelé citation mot terme exemple signifie "
    "dijo dice escribió llamó cita palabra término ejemplo significa".split()
)
ADDRESSING = tuple("you your youre yourself u du dich dir dein deine ihr euch tu toi ton ta vous votre tú te ti usted ustedes vosotros".split())
PREFIX_LENGTHS = (4, 5, 6, 7)
#: A learned threshold of the score from which a document counts as toxic (fixed by the contract).
TOXIC = 0.7
FEATURES = 6
#: Longer words become no terms of their own; they take part by their beginnings.
LONGEST_TERM = 64
#: Terms and stems of one automaton; a larger lexicon makes more automata, not larger ones.
PART = 24


def budget(term: str) -> int:
    """Edits allowed by length of the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


#: Edits of what is no term.
FAR = 99


def _part(entries: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(step, classes, accept, settled) of the automaton of a few (term, is a stem).

    Its states are the reachable sets of (trie node, edits so far), with the edits of the best stem that the
    word begins with: the trie run in step with the Levenshtein automata of its terms. State 1 is the start;
    no letter leads out of a settled one.
    """
    kids: list[dict[int, int]] = [{}]
    most, ends, heads = [0], [-1], [-1]
    for t, stem in entries:
        node, b = 0, budget(t)
        most[0] = max(most[0], b)
        for c in t.encode():
            if c not in kids[node]:
                kids[node][c] = len(kids)
                kids.append({})
                for x in (most, ends, heads):
                    x.append(-1)
            node = kids[node][c]
            most[node] = max(most[node], b)
        last = heads if stem else ends
        last[node] = max(last[node], b)
    letters = sorted({c for k in kids for c in k})
    classes = np.zeros(256, np.int64)
    classes[letters] = np.arange(1, len(letters) + 1)

    def key(best: int, s: dict[int, int]) -> tuple[int, tuple]:
        todo = list(s)
        while todo:  # a letter of the term that the word leaves out
            node = todo.pop()
            for kid in kids[node].values():
                e = s[node] + 1
                if e <= most[kid] and e < s.get(kid, FAR):
                    s[kid] = e
                    todo.append(kid)
        best = min([best, *(e for node, e in s.items() if e <= heads[node])])
        return best, tuple(sorted((node, e) for node, e in s.items() if e < best))

    start = key(FAR, {0: 0})
    index, queue = {(FAR, ()): 0, start: 1}, [start]
    rows = {0: [0] * (len(letters) + 1)}
    while queue:
        state = queue.pop()
        best, nodes = state
        follow = {c for node, _ in nodes for c in kids[node]}
        row = [0] * (len(letters) + 1)
        for k, c in enumerate([-1, *letters]):
            if k and c not in follow:
                row[k] = row[0]
                continue
            nxt: dict[int, int] = {}
            for node, e in nodes:
                if e + 1 <= most[node]:  # a letter that the term lacks
                    nxt[node] = min(e + 1, nxt.get(node, FAR))
                for letter, kid in kids[node].items():
                    d = e + (letter != c)
                    if d <= most[kid]:
                        nxt[kid] = min(d, nxt.get(kid, FAR))
            to = key(best, nxt)
            if to not in index:
                index[to] = len(index)
                queue.append(to)
            row[k] = index[to]
        rows[index[state]] = row
    accept = [min([best, *(e for node, e in nodes if e <= ends[node])]) for best, nodes in index]
    step = np.array([rows[k] for k in range(len(index))], np.int32)
    return step, classes, np.array(accept, np.int64), np.array([not nodes for _, nodes in index])


@dataclass
class Automaton:
    """Byte automata that accept words within each term's edit budget; stems accept, within theirs, any ending."""

    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def build(terms: list[str], stems: list[str]) -> Automaton:
        entries = sorted([(t, False) for t in terms] + [(t, True) for t in stems])
        return Automaton([_part(entries[k : k + PART]) for k in range(0, len(entries), PART)])

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Edits of the best term for each word data[start:end], or -1. All words step together."""
        edits = np.full(len(start), FAR, np.int64)
        for step, classes, accept, settled in self.parts:
            state = np.ones(len(start), np.int32)
            live = np.arange(len(start))
            cls, at = classes[FOLD], 0
            while len(live):
                live = live[start[live] + at < end[live]]
                state[live] = step[state[live], cls[data[start[live] + at]]]
                live = live[~settled[state[live]]]
                at += 1
            edits = np.minimum(edits, accept[state])
        return np.where(edits < FAR, edits, -1)


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    benign: list[str] = field(default_factory=list)
    alone: list[str] = field(default_factory=list)  # benign words that only one clean training text holds
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))
    auto: list[Automaton] = field(default_factory=list)  # of the terms, of the stems

    def __post_init__(self):
        # built once, where the model is made; tasks get the finished tables
        if not self.auto:
            self.auto = [Automaton.build(self.terms, []), Automaton.build([], self.stems)]


#: Kinds of hit: a term as it stands, a stem as it stands, a term with edits, a stem with edits.
TERM, STEM, NEAR_TERM, NEAR_STEM = range(4)


def _hits(model: Model):
    """f(data, offs, own) -> words per row and (row, kind, quoted, hostile, word number, start, end) of each hit.

    A word near a term or stem that clean training texts hold is benign and counts only when exact. own marks
    rows that are such texts themselves: a word that no other clean text holds is not benign there."""
    few = hash_words(" ".join(model.benign))
    alone = hash_words(" ".join(model.alone))
    report = np.array([hash_words(w)[0] for w in REPORTING])
    address = np.array([hash_words(w)[0] for w in ADDRESSING])

    def f(data: np.ndarray, offs: np.ndarray, own: np.ndarray | None = None):
        h, row, s, e = words(data, offs, NOT_ALNUM, FOLD)
        n = np.bincount(row, minlength=len(offs) - 1)
        z = np.empty(0, np.int64)
        if not len(h) or not (model.terms or model.stems):
            return n, z, z, z, z, z, z, z
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        term, stem = (a.run(data, s[first], e[first]) for a in model.auto)
        kind = np.select([term == 0, stem == 0, term > 0, stem > 0], [TERM, STEM, NEAR_TERM, NEAR_STEM], -1)
        per, benign = kind[back], np.isin(uniq, few)[back]
        if own is not None:
            benign &= ~(np.isin(uniq, alone)[back] & own[row])
        per[(per >= NEAR_TERM) & benign] = -1
        at = np.flatnonzero(per >= 0)
        if not len(at):
            return n, z, z, z, z, z, z, z
        reports, addresses = np.isin(h, report), np.isin(h, address)
        quoted, hostile = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k, i in enumerate(at.tolist()):
            lo, hi = max(0, i - WINDOW), min(len(h), i + WINDOW + 1)
            near = np.arange(lo, hi)[row[lo:hi] == row[i]]
            line = data[max(offs[row[i]], s[near[0]]) : s[i]].tobytes().rsplit(b"\n", 1)[-1]
            after = data[e[i] : e[near[-1]] + 2].tobytes().split(b"\n", 1)[0]
            inside = line.count(b'"') % 2 == 1 and b'"' in after
            inside |= line.rfind("“".encode()) > line.rfind("”".encode()) or line.rfind("«".encode()) > line.rfind("»".encode())
            quoted[k] = inside or bool(reports[near[near < i]].any())
            hostile[k] = bool(addresses[near].any()) or bool((per[near] >= 0).sum() > 1) or after[:1] == b"!"
        return n, row[at], per[at], quoted, hostile, at - np.searchsorted(row, row[at]), s[at], e[at]

    return f


def _features(n: np.ndarray, row, kind, quoted, hostile) -> np.ndarray:
    """Per row: log counts of plain hits of each kind, of quoted hits and of hostile hits."""
    m = len(n)
    count = lambda mask: np.log1p(np.bincount(row[mask], minlength=m)) if len(row) else np.zeros(m)
    plain = quoted == 0
    return np.stack([*(count((kind == k) & plain) for k in (TERM, STEM, NEAR_TERM, NEAR_STEM)), count(quoted == 1), count((hostile == 1) & plain)], 1)


def _scorer(model: Model):
    def run(batches):
        hits = _hits(model)
        w = np.array(model.weights)
        kind = pa.struct([("score", pa.float64()), ("n_hits", pa.int64()), ("n_quoted", pa.int64())])
        for col in batches:
            data, offs = utf8(col)
            parts = []
            for i, j in slices(offs):
                n, row, kinds, quoted, hostile, *_ = hits(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                z = np.clip(w[0] + _features(n, row, kinds, quoted, hostile) @ w[1:], -30, 30)
                parts.append((1 / (1 + np.exp(-z)), np.bincount(row, minlength=j - i), np.bincount(row, weights=quoted, minlength=j - i).astype(np.int64)))
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(3)]
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], fields=list(kind))

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most `most` labelled documents that are not held out, toxic ones first up to
    half, taken in hash order; stored, since the fit reads it three times. Of texts with the same label
    whose smallest 5-gram hash is the same (copies, most near copies) one stays: repetition is no evidence."""
    seen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    seen = seen.where(~held_out(F.col("doc_id"))).withColumn("__k", F.xxhash64("doc_id"))
    some = seen.where("toxic = 1").orderBy("__k", "doc_id").limit(most // 2).unionByName(seen.where("toxic = 0").orderBy("__k", "doc_id").limit(most - most // 2))
    some = F.broadcast(stored(some.drop("__k")))  # at most `most` ids and labels
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(some, "doc_id")
    keyed = over_batches(rows, lambda: _keyed, "doc_id string, text string, toxic int, key long")
    return stored(keyed.groupBy("toxic", "key").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select("text", "toxic"))


def _keyed(batch):
    data, offs = utf8(batch["text"])
    h, row, _, _ = words(data, offs)
    g, at = ngrams(h, row, 5)
    key = np.zeros(batch.num_rows, np.int64)  # texts of under five words: all their words
    some, begin = np.unique(row, return_index=True)
    if len(some):
        key[some] = np.bitwise_xor.reduceat(h, begin).view(np.int64)
    have, first = np.unique(row[at], return_index=True)
    if len(have):
        key[have] = np.minimum.reduceat(g, first).view(np.int64)
    yield {"doc_id": batch["doc_id"], "text": batch["text"], "toxic": batch["toxic"], "key": key}


def _terms(batch):
    """Distinct words and word beginnings of each text."""
    t, p, y = [], [], []
    for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        h, _, s, e = words(data, np.array([0, len(data)]), NOT_ALNUM, FOLD)
        _, first = np.unique(h, return_index=True)
        raw = FOLD[data].tobytes()
        own = [raw[a:b].decode() for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        own = [w for w in own if 3 <= len(w)]
        stems = {w[:k] for w in own for k in PREFIX_LENGTHS if len(w) > k}
        own = [w for w in own if len(w) <= LONGEST_TERM]
        t += own + list(stems)
        p += [0] * len(own) + [1] * len(stems)
        y += [toxic] * (len(own) + len(stems))
    yield {"term": t, "stem": p, "toxic": y}


def learn_lexicon(rows: DataFrame, least: int = 3) -> tuple[list[str], list[str]]:
    """(whole words, stems) that mark toxic texts, best first.

    A term counts if its G-squared against the base rate is beyond what the best of as many harmless
    terms would reach by chance, 2 ln(terms). A word beginning becomes a stem if clearly more
    toxic texts hold it than any one of its words. Counting runs in the cluster; the terms that pass, a
    part of the words of the training rows, come to the driver.
    """
    total = rows.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    pos, neg = float(total["p"] or 0), float(total["n"] - (total["p"] or 0))
    if not pos or not neg:
        return [], []
    rate = pos / (pos + neg)
    count = over_batches(rows, lambda: _terms, "term string, stem int, toxic int").groupBy("term", "stem").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    count = stored(count.where(F.col("a") + F.col("b") >= least))
    evidence = 2 * math.log(max(count.count(), 2))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    g2 = 2 * (a * F.log(a / ((a + b) * rate)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - rate)))).otherwise(F.lit(0.0)))
    good = count.where((F.col("a") >= least) & (a / pos > 20 * (b + 0.02) / neg)).withColumn("g2", g2).where(F.col("g2") >= evidence)
    found = good.orderBy(F.desc("g2"), F.length("term"), "term").toPandas()
    whole = found[found["stem"] == 0].set_index("term")["a"].to_dict()
    heads = found[found["stem"] == 1].set_index("term")["a"].to_dict()
    stems: list[str] = []
    for t, n in sorted(heads.items(), key=lambda x: (len(x[0]), x[0])):
        best = max((k for w, k in whole.items() if w.startswith(t)), default=0)
        if n >= 1.25 * best + 1 and not any(x.startswith(t) or t.startswith(x) for x in stems):
            # the longest beginning that as many texts hold says the same and matches less else
            stems.append(max((x for x, k in heads.items() if x.startswith(t) and k >= 0.98 * n), key=len))
    terms = [w for w in whole if not any(w.startswith(x) for x in stems)]
    return terms, stems


def _near_words(model: Model):
    """Distinct words of each clean text that are near a term or stem."""

    def make():
        hits = _hits(model)

        def f(batch):
            data, offs = utf8(batch["text"])
            _, row, kind, _, _, _, s, e = hits(data, offs)
            raw = FOLD[data]
            near = {(int(row[k]), raw[s[k] : e[k]].tobytes().decode()) for k in np.flatnonzero(kind >= NEAR_TERM)}
            yield {"word": [w for _, w in sorted(near)]}

        return f

    return make


def _train_features(model: Model):
    def make():
        hits = _hits(model)

        def f(batch):
            data, offs = utf8(batch["text"])
            n, row, kind, quoted, hostile, *_ = hits(data, offs, batch["toxic"].to_numpy(zero_copy_only=False) == 0)
            yield {"x": list(_features(n, row, kind, quoted, hostile)), "toxic": batch["toxic"]}

        return f

    return make


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> Model:
    """Lexicon, its harmless neighbours and a logistic score, from at most most_rows labelled rows.

    Words near a term that clean training texts use are benign: they count as hits only when exact. For the
    weights, a training text is no evidence for itself, so they meet near hits as often as other texts do.
    Without rows of both labels the score is constant (the base rate, 0.5 without rows)."""
    rows = training_rows(docs, labels, most_rows)
    terms, stems = learn_lexicon(rows)
    model = Model(terms, stems)
    near = over_batches(rows.where("toxic = 0"), _near_words(model), "word string").groupBy("word").agg(F.count("*").alias("n")).orderBy("word").collect()
    model.benign, model.alone = [r["word"] for r in near], [r["word"] for r in near if r["n"] == 1]
    data = over_batches(rows, _train_features(model), "x array<double>, toxic int").toPandas()
    model.weights = logistic(np.array(data["x"].tolist()).reshape(len(data), FEATURES), data["toxic"].to_numpy(float)).tolist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """L2 logistic regression by Newton steps; classes weigh alike, so scores don't depend on their mix."""
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    rate = y.mean()
    if rate in (0.0, 1.0):
        return np.concatenate(([math.copysign(3.0, rate - 0.5)], np.zeros(x.shape[1])))
    wt = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))
    a = np.hstack([np.ones((len(y), 1)), x])
    w = np.zeros(a.shape[1])
    reg = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (wt * (p - y)) + reg @ w
        hess = (a * (wt * p * (1 - p))[:, None]).T @ a + reg + 1e-9 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __tox (score, n_hits, n_quoted). Null text counts as empty; other columns stay."""
    score = arrow_iter_udf(_scorer(model), "score double, n_hits long, n_quoted long")
    return docs.withColumn("__tox", score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def toxicity_report(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_hits, n_quoted.

    Labels are learned from rows outside the held-out third only. Null and empty texts score as texts
    without hits; a null doc_id isn't held out and has no label; repeated rows give repeated rows; without labels
    the score is 0.5. Whole texts are read; in learning, a word of more than LONGEST_TERM letters gives its beginnings as
    stems and no term of its own. Other columns are ignored.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, most_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__tox.score").alias("score"), (F.col("__tox.score") >= TOXIC).cast("int").alias("predicted"), F.col("__tox.n_hits").alias("n_hits"), F.col("__tox.n_quoted").alias("n_quoted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> DataFrame:
    """The rows of docs that score under TOXIC."""
    return scored(docs, fit(docs, labels, most_rows)).where(F.col("__tox.score") < TOXIC).drop("__tox")

