"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat verb, intent, target, negation, reporting verb, other). Small
transducers pass the symbols on and mark insults and threats that stand in their scope; composed, they read
a clause once in each direction. What they mark decides the kind of clause match, and a document's score
is a logistic function of its clause matches. Insult stems and weights are learned from labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import as_table

from .common import batches, held_out, text_or_empty, without
from .near_copies import shingles

THRESHOLD = 0.7
#: Labelled rows that are read to learn from, at most.
SAMPLE = 8000
MIN_STEM, MAX_STEM, MOST_STEMS = 4, 8, 2000

INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, OTHER = "ITWYNR."
_WORDS = {
    INSULT: "idiot idiots moron morons scum loser losers",
    THREAT: "kill hurt destroy shoot stab murder töten umbringen schlagen tuer frapper matar golpear",
    INTENT: "will gonna shall going i'll we'll werde werden vais allons voy vamos",
    TARGET: "you your you're u he she him her they them his their du dich dir ihr euch sie tu toi te vous "
            "il elle ils elles usted ustedes tú ti ellos",
    NEGATION: "not never no don't isn't aren't nicht kein keine nie pas jamais ne nunca jamás tampoco",
    REPORT: "said says say told wrote writes called calls quoted quotes claimed claims reported sagte sagt "
            "schrieb nannte dit écrit appelé dijo dice escribió llamó",
}
_LEXICON = {w: symbol for symbol, words in _WORDS.items() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE = re.compile(r"[^.!?;\n]+")


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (state, symbol), state 0 first; missing arcs lead to state 0 unchanged."""

    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (0, symbol))

    def run(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for s in symbols:
            state, made = self.step(state, s)
            out.append(made)
        return out


def scope(trigger: str, marked: str, mark: str, reach: int, alphabet: set[str]) -> Transducer:
    """Adds a mark to symbols of the kinds in `marked` up to `reach` words after a trigger."""
    arcs = {}
    for state in range(reach + 1):
        for s in alphabet:
            out = s + mark if state and s[0] in marked else s
            arcs[state, s] = (reach if s == trigger else max(0, state - 1), out)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer, alphabet: set[str]) -> Transducer:
    """One transducer that does the work of two, over the states that can be reached."""
    arcs, numbers, todo = {}, {(0, 0): 0}, [(0, 0)]
    while todo:
        here = todo.pop()
        for s in alphabet:
            a, middle = first.step(here[0], s)
            b, out = second.step(here[1], middle)
            if (a, b) not in numbers:
                numbers[a, b] = len(numbers)
                todo.append((a, b))
            arcs[numbers[here], s] = (numbers[a, b], out)
    return Transducer(arcs)


def _grammar() -> tuple[Transducer, Transducer]:
    """Forward: intent, negation, reporting and target before. Backward: target after."""
    alphabet = set("ITWYNR.")
    whole = None
    for trigger, marked, mark, reach in ((INTENT, THREAT, "!", 4), (NEGATION, INSULT + THREAT, "-", 4),
                                         (REPORT, INSULT + THREAT, '"', 12), (TARGET, INSULT, ">", 5)):
        grown = alphabet if whole is None else {o for _, o in whole.arcs.values()}
        next_one = scope(trigger, marked, mark, reach, grown | alphabet)
        whole = next_one if whole is None else compose(whole, next_one, alphabet)
    return whole, scope(TARGET, INSULT + THREAT, ">", 5, alphabet)


_FORWARD, _BACKWARD = _grammar()
KINDS = tuple(f"{k}_{how}" for k in ("insult", "aimed_insult", "threat") for how in ("asserted", "negated", "reported"))
#: Where learning starts from: intercept, then one weight for each kind.
PRIOR = np.array([-4.0, 5.0, 1.0, 1.0, 6.0, 1.0, 1.5, 6.0, 0.5, 1.0])


@dataclass(frozen=True)
class ToxicityModel:
    stems: tuple[tuple[str, bool], ...] = ()     # (stem, whole word only)
    weights: tuple[float, ...] = tuple(PRIOR)


class Reader:
    """Finds the clause matches of a text."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.by_head: dict[str, list[tuple[str, bool]]] = {}
        for w, symbol in _LEXICON.items():
            if symbol in (INSULT, THREAT):
                self.by_head.setdefault(w[:MIN_STEM], [])
        for stem, whole in model.stems:
            self.by_head.setdefault(stem[:MIN_STEM], []).append((stem, whole))

    def symbol(self, word: str) -> str:
        for stem, whole in self.by_head.get(word[:MIN_STEM], ()):
            if word == stem or not whole and word.startswith(stem):
                return INSULT
        return _LEXICON.get(word, OTHER)

    def matches(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of each clause match, in order; offsets of the clause."""
        low = text.lower()
        heads = self.by_head.keys()
        if heads.isdisjoint([w[:MIN_STEM] for w in _WORD.findall(low)]):
            return []
        if len(low) != len(text):  # a character whose lower case is longer: keep offsets true
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = []
        for clause in _CLAUSE.finditer(low):
            words = _WORD.findall(clause[0])
            if heads.isdisjoint([w[:MIN_STEM] for w in words]):
                continue
            symbols = [self.symbol(w) for w in words]
            if INSULT not in symbols and THREAT not in symbols:
                continue
            after = _BACKWARD.run(symbols[::-1])[::-1]
            for marked, later in zip(_FORWARD.run(symbols), after, strict=True):
                if marked[0] == THREAT and not ("!" in marked and ">" in later) or marked[0] not in INSULT + THREAT:
                    continue
                kind = "threat" if marked[0] == THREAT else "aimed_insult" if ">" in marked + later else "insult"
                how = "reported" if '"' in marked else "negated" if "-" in marked else "asserted"
                out.append((f"{kind}_{how}", clause.start(), clause.end()))
        return out

    def score(self, found: list[tuple[str, int, int]]) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.model.weights, _features(found)))))


def _features(found: list[tuple[str, int, int]]) -> list[float]:
    kinds = [k for k, _, _ in found]
    return [1.0] + [float(min(kinds.count(k), 3)) for k in KINDS]


#: Bands of a sketch that tells near copies among the labelled sample, and hashes of a band.
_BANDS, _PER_BAND = 8, 3


def _prefixes(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(copy_of, stem, toxic) of each labelled text, a stem once a text. Stems are word beginnings, and whole words with a
    space after them.
    """
    def rows() -> Iterator[tuple]:
        for batch in incoming:
            for name, text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {w for w in _WORD.findall(text.lower()) if len(w) >= MIN_STEM}
                stems = {w[:n] for w in words for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)}
                for stem in stems | {w + " " for w in words}:
                    yield name, stem, toxic
    yield from batches(pa.schema([("copy_of", pa.string()), ("stem", pa.string()), ("toxic", pa.int64())]), rows(), 1 << 16)


def _sketches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands of least hashes over five-word shingles: texts of 0.8 similarity share one of them almost surely,
    texts of 0.1 hardly ever. A text without words has none."""
    odd = np.random.default_rng(1).integers(1, 1 << 63, (_BANDS * _PER_BAND, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in incoming:
        out = []
        for v in batch.column(1):
            h = shingles(v.as_buffer().to_pybytes())
            least = ((h * odd) ^ ((h * odd) >> np.uint64(31))).min(axis=1).reshape(_BANDS, -1) if len(h) else np.zeros((0, 1), np.uint64)
            out.append([xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["digest", "bands"])


def _groups(sketched: list) -> list[tuple[str, str]]:
    """(digest, one digest of its group): texts that share a band, directly or over others. At most `sample` texts."""
    up = {r.digest: r.digest for r in sketched}

    def top(x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    first: dict[int, str] = {}
    for r in sorted(sketched):
        for b in r.bands:
            up[top(r.digest)] = top(first.setdefault(b, r.digest))
    return [(d, top(d)) for d in up]


def _training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most `sample` labelled texts outside the held-out third, chosen by a hash of the id."""
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return docs.select(docs["doc_id"], text_or_empty(docs["text"]).alias("text")).join(chosen, "doc_id")


def _least_support(spread: list[tuple[int, int, int]]) -> int:
    """Sightings a stem needs so that chance alone would hardly give one such stem.

    spread: (sightings of a stem, number of such stems, toxic sightings of them summed up).
    """
    rate = min(0.5, max(1e-3, sum(k for _, _, k in spread) / max(1, sum(n * m for n, m, _ in spread))))
    for least in range(4, 1000):
        if sum(m * rate ** n for n, m, _ in spread if n >= least) < 0.05:
            return least
    return 1000


def _choose_stems(rows: list[tuple[str, int, int]], least: int) -> list[tuple[str, bool]]:
    """Stems found in toxic texts far beyond chance, each as long as its support allows."""
    good = {s: k for s, k, n in rows if k >= least and k >= 0.95 * n}
    kept = []
    for s in sorted(good):
        longer = [t for t in good if len(t) > len(s) and t.startswith(s) and good[t] >= 0.95 * good[s]]
        shorter = any(s[:n] in good for n in range(MIN_STEM, len(s)) if good.get(s[:n], 0) > good[s] / 0.95)
        if not longer and not shorter:
            kept.append((good[s], s))
    kept.sort(key=lambda x: (-x[0], x[1]))
    return [(s.strip(), s.endswith(" ")) for _, s in kept[:MOST_STEMS]]


def _fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to the prior so that kinds never seen keep its weight."""
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)),
                               x.T @ (y - p) - pull * (w - PRIOR))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn stems and weights from labels (doc_id, toxic) of documents outside the held-out third.

    Labels, language, source and id never enter a score. At most `sample` labelled rows are used. Without
    labels of both kinds the fixed lexicon and the prior weights make the model.
    """
    rows = _training_rows(docs, labels, sample).select("text", "toxic")
    counts = rows.groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in counts}
    if not n.get(0) or not n.get(1):
        return ToxicityModel()
    # Copies and near copies of one text are one document; it is toxic only if all of them are.
    plain = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    texts = as_table(rows.groupBy(plain.alias("digest")).agg(F.first("text").alias("text"), F.min("toxic").alias("toxic")))
    sketched = texts.select("digest", "text").mapInArrow(_sketches, "digest string, bands array<bigint>").collect()
    group = rows.sparkSession.createDataFrame(_groups(sketched), "digest string, copy_of string")
    sightings = (texts.join(group, "digest").select("copy_of", "text", "toxic")
                 .mapInArrow(_prefixes, "copy_of string, stem string, toxic bigint")
                 .groupBy("copy_of", "stem").agg(F.min("toxic").alias("toxic")))
    stems = as_table(sightings.groupBy("stem").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
                     .where("n >= 4"))
    spread = stems.groupBy("n").agg(F.count("*").alias("m"), F.sum("k").alias("k")).collect()  # n <= sample
    least = _least_support([(r.n, r.m, r.k) for r in spread])
    best = (stems.where((F.col("k") >= least) & (F.col("k") >= 0.95 * F.col("n")))
            .orderBy(F.desc("k"), "stem").limit(10 * MOST_STEMS).collect())
    chosen = _choose_stems([(r.stem, r.k, r.n) for r in best], least)
    reader = Reader(ToxicityModel(tuple(chosen)))

    def seen(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            x = [_features(reader.matches(t.as_py()))[1:] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    told = rows.mapInArrow(seen, "x array<double>, toxic bigint").groupBy("x", "toxic").count().collect()
    x = np.array([[1.0, *r.x] for r in told for _ in range(r["count"])])
    y = np.array([r.toxic for r in told for _ in range(r["count"])], float)
    return ToxicityModel(tuple(chosen), tuple(float(v) for v in _fit_weights(x, y)))


def _scorer(model: ToxicityModel):
    @F.pandas_udf("score double, matches array<string>")
    def score(texts: pd.Series) -> pd.DataFrame:
        reader = Reader(model)
        found = [reader.matches(t) for t in texts]
        return pd.DataFrame({"score": [reader.score(f) for f in found],
                             "matches": [[f"{k}:{a}:{b}" for k, a, b in f] for f in found]})
    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Every input row with `out`: score (0 to 1) and matches (kind:start:end of the clauses that match).

    Whole texts are read. Null and empty texts match nothing and get the score of the intercept. A column
    called like `out` is replaced; other columns pass through, and only the text goes to Python.
    """
    scored: Column = _scorer(model)(text_or_empty(docs[f"`{text}`"]))
    return docs.select(*without(docs, out), scored.alias(out))
