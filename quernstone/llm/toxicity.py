"""Counterfactual-regularised toxicity classifier.

A logistic model over which words a text has, and which first letters (four to
seven) one, two or three of its different words share. First letters stand for
stems: inflected and compound forms of one word share them, and a form that no
labelled row has is still met. Features are chosen by the likelihood ratio of
their association with the label, against a limit that rises with the number
of features tried.

Terms that may be exchanged for each other are stated (``IDENTITY_TERMS``,
names of groups in four languages) and learned. Learned terms are content
words: in at least ``RARE`` of the labelled texts, and in LEAST_TEXTS, but in
no more than ``COMMON`` of them, so that articles, pronouns and the like stay
out; their association with the label is within chance; they are put together
where the words before and behind them are the same (cosine of the counts of
at least ``ALIKE``, over all words that are not rare). They are features
whether associated or not. Every mention in a labelled text is exchanged, a stated
term for each other one of its set, a learned one for one of its set that a
hash of the text picks; the loss adds ``FAIRNESS`` times the mean squared
difference that this makes to the score (log-odds), so that which of the
terms a text has moves the score little, and neutral mentions are not taken
for toxic.

Learning takes at most ``MAX_ROWS`` labelled rows, those with the least hashes
of doc_id, and one text for each, which are kept in the checkpoint folder;
their ids (a bounded number) are broadcast to find the texts. Features, their
lists for these rows, and exchanges (counted by what they change) come to the
driver, which fits the weights. Every whole text is scored.

Defined cases: null and empty texts have no features and get the score of the
intercept alone; null labels are not learned from, of several labels for a
document the highest counts, and of several texts under one doc_id the one
with the least hash; a null doc_id is never held out nor learned from; without
any usable label every score is 0; an empty table gives an empty result; very
long texts are one row of a task, their different words in memory; repeated
rows are scored alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import cut
from .language_id import held_out

MAX_ROWS = 40_000
RARE, COMMON, LEAST_TEXTS = 0.02, 0.1, 20
ALIKE = 0.9
FAIRNESS = 1.0
RIDGE = 1e-4
STEPS = 300
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")
# Names of groups that are exchanged for each other, set by set.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino", "arab"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "citoyens"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "bürger"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "ciudadanos"),
)


def features(text: str | None) -> set[str]:
    """Words, and ``k^letters`` for each k up to 3 if at least k different words go on after these letters."""
    words = set(_WORD.findall(text.lower())) if text else set()
    found = set(words)
    for n in PREFIXES:
        for letters, k in Counter(w[:n] for w in words if len(w) > n).items():
            found.update(f"{j}^{letters}" for j in range(1, min(k, 3) + 1))
    return found


def counterfactuals(words: set[str], identity: Sequence[Sequence[str]], learned: dict[str, Sequence[str]], draw: int) -> Iterator[tuple[str, str]]:
    """The exchanges (out, in) of the terms among the words: stated ones for each other one, learned ones for one that ``draw`` picks."""
    for names in identity:
        for name in sorted(words.intersection(names)):
            yield from ((name, other) for other in names if other != name)
    for name in sorted(words.intersection(learned)):
        others = [x for x in learned[name] if x != name]
        yield name, others[(draw + crc32(name.encode())) % len(others)]


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, intercept: float) -> None:
        self.weight, self.intercept = dict(zip(names, weights.tolist())), intercept
        self.letters = {f[2:] for f in names if "^" in f}

    def score(self, text: str | None) -> float:
        """The probability of the label: ``features`` of the text, but none that has no weight."""
        own = self.weight
        words = set(_WORD.findall(text.lower())) if text else set()
        found = [w for w in words if w in own]
        for n in PREFIXES:
            for letters, k in Counter(p for w in words if (p := w[:n]) in self.letters and len(w) > n).items():
                found += [f for j in range(1, min(k, 3) + 1) if (f := f"{j}^{letters}") in own]
        z = self.intercept + math.fsum(own[f] for f in found)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _training_rows(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int) -> DataFrame:
    """``text, toxic`` of at most ``max_rows`` labelled documents."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & learnable)
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = F.min_by("text", F.struct(F.xxhash64("text").alias("h"), "text")).alias("text")
    return cut(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(one).select("text", "toxic"))


def _counts(rows: DataFrame) -> DataFrame:
    """``feature, n, t``: in how many texts, and toxic texts, each feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            names = list(every)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([every[f] for f in names], pa.int64()), pa.array([toxic[f] for f in names], pa.int64())], ["feature", "n", "t"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                found = features(text.as_py())
                every.update(found)
                if label > 0:
                    toxic.update(found)
                if len(every) > 200_000:
                    yield counted()
                    every.clear()
                    toxic.clear()
        yield counted()

    return cut(rows.mapInArrow(run, "feature string, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))


def choose(rows: DataFrame, rare: float = RARE, common: float = COMMON) -> tuple[list[str], list[str], list[str]]:
    """Features whose association with the label is beyond what chance gives the best of so many, content words for which it is not, and the other words that are not rare."""
    n, t = rows.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    if not n or not t or t == n:
        return [], [], []
    counts = _counts(rows)
    rate = F.lit(t / n)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    gain = part(F.col("t"), rate) + part(F.col("n") - F.col("t"), 1 - rate)
    limit = math.log(max(1, counts.count())) + 3
    rated = counts.withColumn("gain", gain).withColumn("chosen", F.col("gain") > limit).withColumn("word", ~F.contains("feature", F.lit("^")) & (F.col("n") >= max(rare * n, LEAST_TEXTS)))
    kept = rated.where("chosen or word").select("feature", "chosen", "word", (F.col("n") <= common * n).alias("content")).orderBy(F.desc("gain"), "feature").collect()
    content = [r["feature"] for r in kept if r["word"] and r["content"] and not r["chosen"]]
    return [r["feature"] for r in kept if r["chosen"]], content, [r["feature"] for r in kept if r["word"] and (r["chosen"] or not r["content"])]


def exchangeable(rows: DataFrame, words: Sequence[str], others: Sequence[str] = (), alike: float = ALIKE) -> list[list[str]]:
    """Sets of the given words that the same ones, of them and of ``others``, come before and behind."""
    shared = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate([*words, *others])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs = shared.value, Counter()
        for batch in batches:
            for text in batch.column(0):
                at = [own.get(w, -1) for w in _WORD.findall((text.as_py() or "").lower())]
                pairs.update((a, b) for a, b in zip(at, at[1:]) if a >= 0 and b >= 0)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.int32()), pa.array(list(pairs.values()), pa.int64())], ["a", "b", "n"])

    met = rows.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where((F.col("a") < len(words)) | (F.col("b") < len(words))).toArrow()
    width = len(words) + len(others)
    table = np.zeros((len(words), 2 * width), np.float32)
    first, second, n = (met[c].to_numpy() for c in "abn")
    before, after = first < len(words), second < len(words)
    table[first[before], second[before]] = n[before]
    table[second[after], width + first[after]] = n[after]
    size = np.sqrt(np.square(table).sum(axis=1))
    table /= np.maximum(size, 1e-12)[:, None]
    free, sets = size > 0, []
    for i in range(len(words)):
        if free[i]:
            own = np.flatnonzero(free & (table @ table[i] >= alike))
            free[own] = False
            if len(own) > 1:
                sets.append([words[k] for k in own])
    return sets


def exchange(words: set[str], stems: Counter, out: str, into: str) -> tuple[set[str], set[str]]:
    """The features that a text of these words (and of them with these first letters) loses and gains when ``into`` takes the place of ``out``."""
    new = into not in words
    change = Counter(out[:n] for n in PREFIXES if len(out) > n)
    change = Counter({p: -k for p, k in change.items()})
    if new:
        change.update(into[:n] for n in PREFIXES if len(into) > n)
    gone, come = {out}, {into} if new else set()
    for letters, by in change.items():
        had = stems[letters]
        gone.update(f"{j}^{letters}" for j in range(had + by + 1, min(had, 3) + 1))
        come.update(f"{j}^{letters}" for j in range(had + 1, min(had + by, 3) + 1))
    return gone, come


def _encoded(rows: DataFrame, names: list[str], identity: Sequence[Sequence[str]], learned: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """``has, toxic`` of each row, and ``gone, come, n``: how many exchanges take these features away and bring those."""
    of = {w: own for own in learned for w in own}
    shared = rows.sparkSession.sparkContext.broadcast(({f: i for i, f in enumerate(names)}, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, groups), swaps = shared.value, Counter()
        for batch in batches:
            has = []
            for text in batch.column(0):
                found = features(text.as_py())
                words = {f for f in found if "^" not in f}
                has.append(sorted(own[f] for f in found if f in own))
                stems = Counter(w[:n] for w in words for n in PREFIXES if len(w) > n)
                for out, into in counterfactuals(words, identity, groups, crc32((text.as_py() or "").encode())):
                    sides = tuple(tuple(sorted(own[f] for f in side if f in own)) for side in exchange(words, stems, out, into))
                    if any(sides):
                        swaps[sides] += 1
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.list_(pa.int32())), batch.column(1), pa.nulls(len(has), pa.list_(pa.int32())), pa.nulls(len(has), pa.list_(pa.int32())), pa.nulls(len(has), pa.int64())], columns)
        k = len(swaps)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.int32()), pa.array([a for a, _ in swaps], pa.list_(pa.int32())), pa.array([b for _, b in swaps], pa.list_(pa.int32())), pa.array(list(swaps.values()), pa.int64())], columns)

    columns = ["has", "toxic", "gone", "come", "n"]
    both = cut(rows.mapInArrow(run, "has array<int>, toxic int, gone array<int>, come array<int>, n long"))
    return both.where("n is null").select("has", "toxic"), both.where("n is not null").groupBy("gone", "come").agg(F.sum("n").alias("n"))


def descend(has: list[list[int]], toxic: np.ndarray, swaps: list[tuple[list[int], list[int], int]], width: int, fairness: float) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient steps, each weight with a step size of its own."""
    label = (toxic > 0).astype(float)
    row = np.repeat(np.arange(len(has)), [len(x) for x in has])
    column = np.concatenate([*(np.array(x, np.int64) for x in has), np.zeros(0, np.int64)])
    # One row for each kind of exchange: +1 for what it takes away, -1 for what it brings.
    pair_row = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b, _ in swaps])
    pair_column = np.array([f for a, b, _ in swaps for f in (*a, *b)], np.int64)
    pair_sign = np.array([s for a, b, _ in swaps for s in (*(1.0 for _ in a), *(-1.0 for _ in b))])
    times = np.array([n for *_, n in swaps], float)
    times /= max(1.0, times.sum())

    weights, intercept = np.zeros(width), math.log((label.mean() + 1e-9) / (1 - label.mean() + 1e-9))
    speed = np.zeros(width + 1)  # running sum of squared gradients
    for _ in range(STEPS):
        z = intercept + np.bincount(row, weights[column], len(label))
        error = (1 / (1 + np.exp(-z)) - label) / len(label)
        gradient = np.bincount(column, error[row], width) + RIDGE * weights
        if len(swaps):
            apart = np.bincount(pair_row, pair_sign * weights[pair_column], len(swaps)) * times
            gradient += 2 * fairness * np.bincount(pair_column, pair_sign * apart[pair_row], width)
        whole = np.append(gradient, error.sum())
        speed += whole**2
        step = 0.5 * whole / (np.sqrt(speed) + 1e-12)
        weights, intercept = weights - step[:-1], intercept - step[-1]
    return weights, float(intercept)


def fit(rows: DataFrame, fairness: float = FAIRNESS, identity: Sequence[Sequence[str]] = IDENTITY_TERMS, rare: float = RARE, common: float = COMMON) -> Model:
    """A model from ``text, toxic`` rows, which must be few enough for the driver."""
    chosen, content, others = choose(rows, rare, common)
    learned = exchangeable(rows, content, others) if content else []
    terms = {w for own in (*identity, *learned) for w in own}
    names = chosen + sorted(terms - set(chosen))
    table, swaps = _encoded(rows, names, identity, learned)
    table = table.toArrow()
    if not table.num_rows:
        return Model([], np.zeros(0), -700.0)
    weights, intercept = descend(table["has"].to_pylist(), table["toxic"].to_numpy(), [tuple(r) for r in swaps.orderBy("gone", "come").collect()], len(names), fairness)
    return Model(names, weights, intercept)


def score(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """The columns ``keys`` and the ``score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(*keys, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*keys, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, max_rows: int = MAX_ROWS, **how) -> DataFrame:
    """One row per document: whether its fold was held out from learning, its score and the prediction."""
    out = held_out(F.col("doc_id"), parts, part)
    model = fit(_training_rows(docs, labels, ~out & F.col("doc_id").isNotNull(), max_rows), **how)
    folds = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    return score(folds, model, "doc_id", "held_out").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
