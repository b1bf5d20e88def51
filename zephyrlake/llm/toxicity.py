"""Toxicity scores from a learned lexicon, misspelling-tolerant matching and context windows.

Lexicon. All words and word stems that are much commoner in toxic training texts than in others
(document frequencies over a bounded sample of labelled ids, one text of each). A stem, written with a final *,
stands for all words that begin with it, and is taken only where many words share it; words of five letters or more under it
stay, for their misspellings.

Matching. The lexicon is a trie; the Levenshtein automaton of each word is run over it. The product
of the two is determinised as texts need it: a state is the set of (trie node, edits so far),
a step is remembered by (state, character), and a word that has left every term's
neighbourhood stops at once. Terms of five to eight characters may be one edit away, longer ones
two; a term whose misspellings turn up in clean training texts has to be spelled right, and so
have stems.

Context. A hit inside quotation marks, in a line that begins with >, or shortly after a verb of
reporting is a quotation: it counts for less than abuse, and for more near a word of address (both are lists of the
configuration). The score is a logistic function of the text's evidence, fitted on the same sample.

What comes to the driver is bounded by the sample: terms that pass, counts by term, two numbers for each of its texts.

Defined results: null, empty and blank texts have no evidence and get the base score; repeated rows
and equal texts get equal scores; a very long text is scored whole; labels that are null, or that disagree for an id, are left out;
of documents with equal id the smallest text is learned from; with no
labelled rows, or none of one class, the lexicon is empty and every text gets the share of toxic
labels, (p + 1) / (n + 2); an empty table gets no scores. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.llm.common import Scratch, in_small_batches, read, releasing

#: Verbs of reporting and words of address, lower case.
REPORTING = frozenset(
    "said says wrote writes called calls quoted quote quotes replied shouted dit disait écrit sagte schrieb nannte dijo escribió llamó".split()
)
ADDRESS = frozenset("you your you're u du dich dein ihr tu toi vous votre tú usted ustedes vosotros".split())
QUOTES = frozenset("\"“”„«»‹›")
#: Lengths of stems.
STEMS = range(4, 11)
_EDGE = re.compile(r"^[^\w*@$]+|[^\w*@$]+$")


@dataclass(frozen=True)
class ToxicConfig:
    """sample: labelled ids that the lexicon and the score are fitted on, at most (about); reporting, address: words that tell the context."""

    sample: int = 20_000
    least_docs: int = 4
    least_ratio: float = 25.0
    window: int = 12
    quoted: float = 0.2
    threshold: float = 0.7
    reporting: frozenset[str] = REPORTING
    address: frozenset[str] = ADDRESS


#: Spellings that a matcher remembers, their letters at most, and states of its automaton: bounds of its memory.
SPELLINGS, REMEMBERED, STATES = 150_000, 64, 50_000


def word(raw: str) -> str:
    """Lower case, without marks around it."""
    low = raw.lower()
    return low if low[:1].isalnum() and low[-1:].isalnum() else _EDGE.sub("", low)


def allowed(term: str) -> int:
    n = len(term)
    return 0 if n < 5 or term.endswith("*") else 1 if n <= 8 else 2


class Matcher:
    """The lexicon's trie and the determinised product with Levenshtein automata.

    terms: weight by term; fuzzy: edits by term. find(word) gives (term, edits) of the best term or None.
    """

    def __init__(self, terms: dict[str, float], fuzzy: dict[str, int]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, int]]] = [[]]
        self.most = [0]  # edits that some term below allows
        for t in sorted(terms):
            at, k = 0, fuzzy.get(t, 0)
            self.most[0] = max(self.most[0], k)
            for c in t.rstrip("*"):
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.child[at][c]
                self.most[at] = max(self.most[at], k)
            self.ends[at].append((t, k))
        self.letters = {c for x in self.child for c in x}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.said: list[tuple[str, int] | None] = []
        self.stem: list[tuple[str, int] | None] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})
        self.seen: dict[str, tuple[str, int] | None] = {}

    def _state(self, best: dict[int, int]) -> int:
        """The state of these nodes with their edits, closed under leaving out a term's letter; -1 for none."""
        todo = list(best)
        while todo:
            n = todo.pop()
            e = best[n] + 1
            for m in self.child[n].values():
                if e <= self.most[m] and e < best.get(m, 99):
                    best[m] = e
                    todo.append(m)
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.states:
            ends = sorted((e, -self.terms[t], t) for n, e in key for t, k in self.ends[n] if e <= k)
            stems = [x for x in ends if x[2].endswith("*")]
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.said.append((ends[0][2], ends[0][0]) if ends else None)
            self.stem.append((stems[0][2], stems[0][0]) if stems else None)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        best: dict[int, int] = {}

        def put(n: int, e: int) -> None:
            if e <= self.most[n] and e < best.get(n, 99):
                best[n] = e

        for n, e in self.sets[state]:
            put(n, e + 1)  # a letter too many
            for d, m in self.child[n].items():
                put(m, e + (d != c))
        return self._state(best)

    def _find(self, w: str) -> tuple[str, int] | None:
        at, stem = self.start, None
        for c in w:
            steps = self.steps[at]
            c = c if c in self.letters else ""
            to = steps.get(c)
            if to is None:
                to = steps[c] = self._step(at, c)
            if to < 0:
                return stem
            at = to
            stem = stem or self.stem[at]
        return self.said[at] or stem

    def find(self, raw: str) -> tuple[str, int] | None:
        """Of a word as the text has it, remembered by its spelling."""
        hit = self.seen.get(raw, False)
        if hit is False:
            if len(self.seen) >= SPELLINGS:
                self.seen.clear()
            if len(self.sets) > STATES:  # forget the automaton, not the trie
                self.states, self.sets, self.said, self.stem, self.steps = {}, [], [], [], []
                self.start = self._state({0: 0})
            hit = self._find(word(raw)) if self.terms else None
            if len(raw) <= REMEMBERED:
                self.seen[raw] = hit
        return hit


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    fuzzy: dict[str, int] = field(default_factory=dict)
    weights: tuple[float, float] = (0.0, 0.0)
    config: ToxicConfig = ToxicConfig()


def hits(text: str | None, m: Matcher, cfg: ToxicConfig) -> list[tuple[str, int, float]]:
    """(term, edits, context weight) of each hit."""
    tokens = (text or "").split()
    find = m.find
    found = [(i, h) for i, t in enumerate(tokens) if (h := find(t)) is not None]
    if not found:
        return []
    inside, open_, out = set(), False, []
    if any(q in text for q in QUOTES):
        for i, t in enumerate(tokens):
            n = sum(c in QUOTES for c in t)
            if open_ or n:
                inside.add(i)
            open_ = open_ != bool(n % 2)
        if open_:
            inside = set()  # a mark without its partner tells nothing
    cited: set[int] = set()
    if ">" in text:
        at = 0
        for line in text.split("\n"):
            n = len(line.split())
            if line.lstrip().startswith(">"):
                cited.update(range(at, at + n))
            at += n
    for i, (term, edits) in found:
        near = [word(t) for t in tokens[max(0, i - cfg.window) : i + cfg.window + 1]]
        quoted = i in inside or i in cited or any(w in cfg.reporting for w in near[: min(i, cfg.window)][-4:])
        context = cfg.quoted if quoted else 1.25 if any(w in cfg.address for w in near) else 1.0
        out.append((term, edits, context))
    return out


def evidence(text: str | None, m: Matcher, cfg: ToxicConfig) -> float:
    return sum(m.terms[t] * c * (1.0, 0.85, 0.7)[e] for t, e, c in hits(text, m, cfg))


def training_rows(labels: DataFrame, id_col: str, label_col: str, keep: Column, cfg: ToxicConfig) -> DataFrame:
    """(id, y) of at most about cfg.sample rows, chosen by the id's hash: the bound is the parameter."""
    rows = labels.filter(keep & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("z")
    )
    rows = rows.filter("y = z").select("id", "y")
    share = min(1.0, cfg.sample / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64("id", F.lit(41)), F.lit(1_000_000)) < int(share * 1_000_000))


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document counts by term, some texts at a time."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def told() -> pd.DataFrame:
        terms = list(counts[0].keys() | counts[1].keys())
        made = pd.DataFrame({"term": terms, "pos": [counts[1][t] for t in terms], "neg": [counts[0][t] for t in terms]})
        counts.update({0: Counter(), 1: Counter()})
        return made

    for b in batches:
        for text, y in zip(b.text, b.y, strict=True):
            words = {w for t in set((text or "").split()) if (w := word(t))}
            counts[1 if y else 0].update(words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k})
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield told()
    yield told()


def choose_terms(rows: Iterable[tuple[str, int, int]], pos: int, neg: int, cfg: ToxicConfig) -> dict[str, float]:
    """Terms with weights from document counts; a stem only where no word of it makes up most of it."""
    score = {}
    for term, p, n in rows:
        ratio = (p / (pos + 1)) / ((n + 1) / (neg + 1))  # one clean text more than seen, so that few texts prove little
        if p >= cfg.least_docs and ratio >= cfg.least_ratio:
            score[term] = (p, min(1.0, math.log(ratio) / math.log(cfg.least_ratio * 8)))
    words: dict[str, int] = defaultdict(int)
    for t, (p, _) in score.items():
        if not t.endswith("*"):
            for k in STEMS:
                words[t[:k] + "*"] = max(words[t[:k] + "*"], p)
    stems = sorted((t for t, (p, _) in score.items() if t.endswith("*") and words[t] < 0.6 * p), key=len)
    taken: list[str] = []
    for t in stems:
        if not any(t.startswith(s[:-1]) for s in taken):
            taken.append(t)
    heads = tuple(s[:-1] for s in taken)
    plain = [t for t in score if not t.endswith("*") and (allowed(t) or not (heads and t.startswith(heads)))]
    return {t: score[t][1] for t in sorted([*taken, *plain])}


def _misspelt(model: Model):
    """(term, edits) of the misspellings in clean texts, each once for a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(model.terms, {t: allowed(t) for t in model.terms})
        for b in batches:
            rows = [x for text in b.text for x in {(t, e) for t, e, _ in hits(text, m, model.config) if e}]
            yield pd.DataFrame(rows, columns=["term", "edits"])

    return run


def _weighed(model: Model):
    """(y, evidence) of each text with any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(model.terms, model.fuzzy)
        for b in batches:
            rows = [(y, e) for text, y in zip(b.text, b.y, strict=True) if (e := evidence(text, m, model.config)) > 0]
            yield pd.DataFrame(rows, columns=["y", "evidence"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2e-5, rounds: int = 40) -> tuple[float, float]:
    """Intercept and slope by Newton steps; ridge on the slope, a share of the rows."""
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + np.array([1e-6, ridge]) * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag([1e-6, ridge])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(
    docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    cfg: ToxicConfig | None = None
) -> Model:
    """A model from the labelled rows that keep (a condition on labels) admits."""
    cfg = cfg or ToxicConfig()
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = training_rows(labels.select(F.col(id_col), F.col(label_col)), id_col, label_col, keep, cfg)
    # at most about cfg.sample rows of twelve bytes: small enough to send to every executor
    train = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(rows), "id")
    train = scratch.write(train.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y"), "train")
    pos, n = train.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    neg = n - pos
    base = (pos + 1) / (n + 2)
    prior = math.log(base / (1 - base))
    if not pos or not neg:
        return Model(weights=(prior, 0.0), config=cfg)
    counts = train.mapInPandas(
        releasing(_count_terms), "term string, pos long, neg long"
    ).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = F.col("pos") / (pos + 1) / ((F.col("neg") + 1) / (neg + 1))
    # terms of the sample that pass: choose_terms decides, this only spares the driver the others
    some = counts.filter((F.col("pos") >= cfg.least_docs) & (ratio >= 0.99 * cfg.least_ratio)).collect()
    model = Model(choose_terms(((r["term"], r["pos"], r["neg"]) for r in some), pos, neg, cfg), config=cfg)
    if not model.terms:
        return Model(weights=(prior, 0.0), config=cfg)
    clean = train.filter("y = 0").mapInPandas(releasing(_misspelt(model)), "term string, edits int")
    wrong = {(r["term"], r["edits"]): r["n"] for r in clean.groupBy("term", "edits").agg(F.count("*").alias("n")).collect()}
    for t in model.terms:
        most = 0
        while most < allowed(t) and wrong.get((t, most + 1), 0) <= 0.0005 * neg:
            most += 1
        model.fuzzy[t] = most
    told = train.mapInPandas(releasing(_weighed(model)), "y int, evidence double").toPandas().sort_values(["y", "evidence"])
    rest = [pos - int(told.y.sum()), neg - int((1 - told.y).sum())]
    x = np.concatenate([told.evidence.to_numpy(float), np.zeros(sum(rest))])
    y = np.concatenate([told.y.to_numpy(float), np.ones(rest[0]), np.zeros(rest[1])])
    model.weights = logistic(np.log1p(4 * x), y)
    scratch.drop("train")
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, evidence, terms (the terms found) of each row's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(model.terms, model.fuzzy)
        a, b_ = model.weights
        for b in batches:
            found = [hits(t, m, model.config) for t in b.text]
            e = np.array([sum(m.terms[t] * c * (1.0, 0.85, 0.7)[k] for t, k, c in f) for f in found], float)
            s = 1 / (1 + np.exp(-np.clip(a + b_ * np.log1p(4 * e), -30, 30)))
            yield pd.DataFrame({"id": b.id, "score": s, "evidence": e, "terms": [sorted({t for t, _, _ in f}) for f in found]})

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = docs.mapInPandas(releasing(run), f"id {docs.schema['id'].dataType.simpleString()}, score double, evidence double, terms array<string>")
    return made.withColumnRenamed("id", id_col)


def score_column(text: Column, model: Model) -> Column:
    """The score of a text column, for frames whose other columns should stay."""

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(model.terms, model.fuzzy)
        a, b = model.weights
        for texts in batches:
            e = np.array([evidence(t, m, model.config) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(a + b * np.log1p(4 * e), -30, 30))))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return releasing(scores)(batches)

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no training sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= model.config.threshold).cast("int").alias("predicted"))
