"""Op 5: toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as classes: insult, threat, target (a person spoken to or of), negation, reported speech,
or other. Small weighted transducers, two that give out the weight of an insult or threat and three that
scale what is given out (more near a target, less after a negation or in reported speech), are composed into
one machine that reads a clause. Scores come from matched clauses: what they give out with these factors, and
how much of it was targeted, negated and reported, so that the logistic model over a text's clauses learns from labels
how far the factors, its prior, hold. The model makes a probability of them.

The insult lexicon is learnt from labelled rows that are not held out (about ``MAX_LABELLED`` at most,
drawn by a hash of doc_id): words, and stems of words, whose share among toxic texts departs from chance
by far; ``LEXICON`` entries at most, those that tell most by G squared, a bound on the model like that on its rows. A word has the weight of itself, else of its longest known stem. Lexicon and logistic model are
fitted on different halves of the rows, so that chance words don't count as evidence.

Texts are read whole. Null or empty texts: no clause matches; the score is that of such texts. Labels of
one kind only, or none: the fixed words alone, with a fixed logistic model. Null doc_ids: scored like others,
never learnt from. Of several labels of a doc_id the highest counts, of several texts one. Repeated rows each get
their row. Empty tables: no rows. Columns besides doc_id and text are not read (others are passed on).
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .quality import labelled

MAX_LABELLED = 8_000
THRESHOLD = 0.3
#: A stem is learnt when its likelihood ratio (G squared) is at least this, and it is this much commoner in toxic texts.
LEAST_G2, LEAST_RATIO = 20.0, 6.0
STEM = range(4, 9)
#: Of a lexicon: the most entries, by G squared.
LEXICON = 5_000

# Word classes of the grammar.
TARGETS = "you your yours you're u he she they him her them his their this these all everyone people tu vous te ton votre toi il elle ils du dich dir dein ihr euch er sie usted tus vosotros ustedes él ella ellos".split()
NEGATIONS = "not no never n't don't isn't aren't wasn't won't cannot can't neither nor without hardly ne pas jamais aucun sans nicht kein keine nie niemals ohne nunca jamás ningún sin".split()
REPORTS = "said says say saying told tells wrote writes claimed claims called calls quoted quote reported reports alleged accused according dit disait écrit selon sagte sagt schrieb laut dijo dice escribió según".split()
THREATS = "kill hurt destroy murder burn shoot stab beat die hang tuer töten umbringen mato matar quemar".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


class Machine(NamedTuple):
    """Transducer over word classes: next state by state and class, factor of each state, which influences act in it, classes whose weight it gives out."""

    moves: list[list[int]]
    factors: list[float]
    acting: list[frozenset[int]]
    gives: frozenset[int]


def giving(kind: int) -> Machine:
    """Gives out the weight of every word of ``kind``."""
    return Machine([[0] * 6], [1.0], [frozenset()], frozenset([kind]))


def after(cause: int, reach: int, factor: float) -> Machine:
    """For ``reach`` words after ``cause``, what is given out counts times ``factor``. States: words left."""
    moves = [[reach if c == cause else max(0, s - 1) for c in range(6)] for s in range(reach + 1)]
    return Machine(moves, [factor if s else 1.0 for s in range(reach + 1)], [frozenset([cause] if s else []) for s in range(reach + 1)], frozenset())


def compose(*machines: Machine) -> Machine:
    """All at once: a state for each combination, its factor the product of theirs."""
    states = list(itertools.product(*[range(len(m.factors)) for m in machines]))
    number = {s: i for i, s in enumerate(states)}
    moves = [[number[tuple(m.moves[x][c] for m, x in zip(machines, s, strict=True))] for c in range(6)] for s in states]
    factors = [float(np.prod([m.factors[x] for m, x in zip(machines, s, strict=True)])) for s in states]
    acting = [frozenset().union(*[m.acting[x] for m, x in zip(machines, s, strict=True)]) for s in states]
    return Machine(moves, factors, acting, frozenset().union(*[m.gives for m in machines]))


def settling(machine: Machine) -> int:
    """Words of no class after which a machine stays where it is, whatever state it was in: more of them change nothing."""
    at, steps = set(range(len(machine.factors))), 0
    while any(machine.moves[s][OTHER] != s for s in at) and steps < len(machine.factors):
        at, steps = {machine.moves[s][OTHER] for s in at}, steps + 1
    return steps


#: What scales a word's weight, and the words it reaches.
INFLUENCES = (after(TARGET, 4, 1.5), after(NEGATION, 3, 0.3), after(REPORT, 12, 0.5))
GRAMMAR = compose(giving(INSULT), giving(THREAT), *INFLUENCES)
FEATURES = 11


class Lexicon:
    def __init__(self, weights: dict[str, float]) -> None:
        """Stems end with *, words don't."""
        self.words = {w: x for w, x in weights.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in weights.items() if w.endswith("*")}
        self.fixed = {w: c for c, group in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in group}

    def read(self, word: str) -> tuple[int, float]:
        """Class and weight of a normalised word."""
        if (x := self.words.get(word)) is not None:
            return INSULT, x
        if (c := self.fixed.get(word)) is not None:
            return c, 2.0 if c == THREAT else 0.0
        for n in reversed(STEM):
            if len(word) >= n and (x := self.stems.get(word[:n])) is not None:
                return INSULT, x
        return OTHER, 0.0


def read_words(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Distinct words as written and normalised, the number of the word at each place, and words in each text. A line end is a word."""
    spaced = pc.replace_substring(texts, "\n", " \n ")
    cut = pc.split_pattern(spaced, " ")
    coded = cut.flatten().dictionary_encode()
    written = coded.dictionary
    normal = pc.utf8_trim(pc.utf8_lower(written), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„…\n\t\r")
    return written, normal, coded.indices.to_numpy(), np.diff(cut.offsets.to_numpy())


class Clause(NamedTuple):
    """What a clause gave out: insults and threats with the factors, and without them what was targeted, negated and reported."""

    insult: float
    threat: float
    targeted: float
    negated: float
    reported: float


def clauses(classes: np.ndarray, weights: np.ndarray, ends: np.ndarray, grammar: Machine = GRAMMAR, settled: int | None = None) -> list[Clause]:
    """The clauses of one text that give out anything. ``settled``: ``settling`` of the grammar, where it is known."""
    settled = settling(grammar) if settled is None else settled
    out, got, state, last = [], [0.0] * 5, 0, -1
    moves, factors, acting, gives = grammar
    places = np.flatnonzero((classes != OTHER) | ends)
    for i, c, w, end in zip(places.tolist(), classes[places].tolist(), weights[places].tolist(), ends[places].tolist(), strict=True):
        for _ in range(min(i - last - 1, settled)):  # other words in between
            state = moves[state][OTHER]
        if c in gives:
            got[0 if c == INSULT else 1] += w * factors[state]
            for k, influence in enumerate((TARGET, NEGATION, REPORT)):
                if influence in acting[state]:
                    got[2 + k] += w
        state, last = moves[state][c], i
        if end:
            if got[0] or got[1]:
                out.append(Clause(*got))
            state, got = 0, [0.0] * 5
    if got[0] or got[1]:
        out.append(Clause(*got))
    return out


def features(texts: pa.Array, lexicons: list[Lexicon], grammar: Machine = GRAMMAR) -> list[np.ndarray]:
    """For each lexicon a row of features for each text."""
    texts = texts.cast(pa.large_string())
    written, normal, at, counts = read_words(texts)
    ends = pc.match_substring_regex(written, r"[.!?;:]$|\n").to_numpy(zero_copy_only=False)[at]
    distinct = normal.dictionary_encode()
    to_normal = distinct.indices.to_numpy()
    words, starts, out, settled = common.values(distinct.dictionary), np.cumsum(counts) - counts, [], settling(grammar)
    for lexicon in lexicons:
        read = [lexicon.read(w) for w in words]
        kind = np.array([c for c, _ in read], np.int8)[to_normal][at]
        weight = np.array([x for _, x in read], np.float32)[to_normal][at]
        hit = (kind == INSULT) | (kind == THREAT)
        hits = np.add.reduceat(np.append(hit, False), starts) if len(starts) else np.zeros(0)
        found = np.zeros((len(texts), FEATURES))
        for i in np.flatnonzero(hits):
            a, b = starts[i], starts[i] + counts[i]
            got = clauses(kind[a:b], weight[a:b], ends[a:b], grammar, settled)
            own = sorted((c.insult + c.threat for c in got), reverse=True)
            thousands = 1 + counts[i] / 1000
            met = np.unique(to_normal[at[a:b]][kind[a:b] == INSULT])
            found[i] = [np.log1p(sum(own)), own[0], sum(own[1:2]), np.log1p(len(own)), np.log1p(10 * sum(own) / (20 + counts[i])), np.log1p(len(met)), np.log1p(sum(c.threat for c in got)), sum(own[:3]) / thousands, *[np.log1p(sum(x)) for x in list(zip(*got, strict=True))[2:]]]
        out.append(found)
    return out


def stems_of(text: str) -> set[str]:
    words = {w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", text.lower())}
    return words | {f"{w[:n]}*" for w in words for n in STEM if len(w) >= n}


def count_stems(rows: DataFrame) -> DataFrame:
    """(stem, half, toxic, clean): texts with it, of stems that toxic texts hold in the same or another half."""

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            found: Counter = Counter()
            for text in common.values(common.column(b, "text")):
                found.update(stems_of(text))
            yield pa.record_batch({"stem": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    seen = common.map_arrow(rows.where("label = 1").select("text"), toxic, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).where("n >= 3")
    # of the bounded sample's toxic texts only
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(r["stem"] for r in seen.collect()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in common.slices(batches):
            found: Counter = Counter()
            for text, half, label in zip(common.values(common.column(b, "text")), common.column(b, "half").to_pylist(), common.column(b, "label").to_pylist(), strict=True):
                found.update((s, half, label == 1) for s in stems_of(text) & known)
            yield pa.record_batch({"stem": pa.array([k[0] for k in found], pa.string()), "half": pa.array([k[1] for k in found], pa.int32()), "toxic": pa.array([n * k[2] for k, n in found.items()], pa.int64()), "clean": pa.array([n * (not k[2]) for k, n in found.items()], pa.int64())})

    return common.map_arrow(rows.select("text", "half", "label"), count, "stem string, half int, toxic long, clean long").groupBy("stem", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights (log ratios) of stems far commoner in toxic texts."""
    if not toxic or not clean:
        return {}
    names = list(counts)
    t, c = (np.array([counts[s][k] for s in names], float) for k in (0, 1))
    ratio = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))

    def part(seen: np.ndarray, total: float, share: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = np.where(seen > 0, seen * np.log(seen / total / share), 0.0)
            miss = np.where(total - seen > 0, (total - seen) * np.log((1 - seen / total) / (1 - share)), 0.0)
        return hit + miss

    share = np.clip((t + c) / (toxic + clean), 1e-12, 1 - 1e-12)
    g2 = 2 * (part(t, toxic, share) + part(c, clean, share))
    good = np.flatnonzero((g2 >= LEAST_G2) & (ratio >= LEAST_RATIO))
    good = good[np.argsort(-g2[good], kind="stable")[:LEXICON]]
    return {names[i]: float(np.log(ratio[i])) for i in good}


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights, the intercept first, by Newton's method."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [penalty] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, grammar: Machine = GRAMMAR) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and logistic weights."""
    rows = labelled(docs, labels, "toxic", bound).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int"))
    rows = common.written(rows.select("text", "half", "label"), "labelled-texts")
    totals = {(r["half"], r["label"] == 1): r["n"] for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = ([totals.get((h, k), 0) for h in (0, 1)] for k in (True, False))
    if not sum(toxic) or not sum(clean):
        return {}, np.array([-3.0, 1.0, *[0.0] * (FEATURES - 1)])
    by_half: list[dict[str, tuple[int, int]]] = [{}, {}]
    for r in count_stems(rows).collect():
        by_half[r["half"]][r["stem"]] = (r["toxic"], r["clean"])
    both = {s: tuple(a + b for a, b in zip(by_half[0].get(s, (0, 0)), by_half[1].get(s, (0, 0)), strict=True)) for s in by_half[0].keys() | by_half[1].keys()}
    halves = [choose(by_half[h], toxic[h], clean[h]) for h in (0, 1)]
    weights = choose(both, sum(toxic), sum(clean))
    if not all(halves):
        return weights, np.array([-3.0, 1.0, *[0.0] * (FEATURES - 1)])
    names = [f"x{k}" for k in range(FEATURES)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(h) for h in halves]
        for b in common.slices(batches):
            half = common.column(b, "half").to_numpy()
            zero, one = features(common.column(b, "text"), lexicons, grammar)
            x = np.where((half == 0)[:, None], one, zero)  # by what the other half taught
            yield pa.record_batch({"label": common.column(b, "label"), **{n: pa.array(x[:, k]) for k, n in enumerate(names)}})

    measured = common.map_arrow(rows, measure, "label double, " + ", ".join(f"{n} double" for n in names)).toPandas()
    return weights, fit_logistic(measured[names].to_numpy(), measured["label"].to_numpy())


@functools.lru_cache(maxsize=2)
def lexicon(entries: tuple[tuple[str, float], ...]) -> Lexicon:
    return Lexicon(dict(entries))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = MAX_LABELLED, grammar: Machine = GRAMMAR) -> DataFrame:
    """The columns of ``docs`` and score, predicted of every row (names of theirs that clash are replaced)."""
    weights, model = learn(docs, labels, bound, grammar)
    entries, coefficients = tuple(weights.items()), model.tolist()
    kept = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon(entries)
        for b in common.slices(batches):
            (x,) = features(pc.fill_null(common.column(b, "text"), ""), [known], grammar)
            p = 1 / (1 + np.exp(-(coefficients[0] + x @ np.array(coefficients[1:]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    common.ship(docs.sparkSession)
    schema = StructType([*[StructField(f.name, f.dataType) for f in kept.schema], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return kept.mapInArrow(run, schema)


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return score(docs.select("doc_id", "text"), labels).select("doc_id", common.held_out().alias("held_out"), "score", "predicted")
