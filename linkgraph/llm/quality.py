"""A document classifier without labels: heuristic labellers, a model of their accuracies, and a linear scorer.

Two questions are asked of a document: is it junk, is it abusive.  For each, heuristics vote
yes, no or nothing; expectation-maximisation over the counts of vote patterns in the whole
corpus estimates how each labeller votes on either class; the posteriors label a bounded
sample, on which a linear scorer over hashed features is trained; that scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm import _text

#: Labelled documents from which the learned labeller takes its words, at most about.
LABELLED = 20_000
#: A word or word beginning is learned if so many abusive documents have it, to each so many others at most.
LEARN_ROWS, LEARN_OTHERS = 4, 0.02
#: Bytes of a word's beginnings.
BEGINNINGS = (4, 5, 6)
#: Documents that the scorer is trained on, at most about; all of a smaller corpus.
SAMPLE = 8_000
#: Passes over the sample; step size; weight decay.
EPOCHS, RATE, DECAY = 12, 0.3, 1e-5
#: A feature is used if it is in so many of the sample's documents, and its share differs between the classes by so many deviations.
LEAST_ROWS, LEAST_Z = 5, 4.0
THRESHOLD = 0.5

# Word lists of the labellers.
STOP_WORDS = "the of and to in is that for it as was with be by on not he his are this at from or have an they which you had we been has were their will would there what if can all her one about out up so into no die der und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son el que y los del las por con una su para lo como más pero sus al o este sí porque esta entre cuando muy sin sobre".split()
STRONG = "idiot moron scum stupid imbecile cretin bastard retard".split()
OTHERS = "loser pathetic worthless trash clown disgusting filthy vermin jerk fool dumb ugly garbage crap".split()

UPPER, LOWER, DIGIT, BEYOND, SYMBOL, BAR, SHOUT, SPACE = range(8)
_KIND = np.full(256, 8, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = UPPER, LOWER, DIGIT, BEYOND
for _c in "#$%&*+<=>@[\\]^_`{}~":
    _KIND[ord(_c)] = SYMBOL
_KIND[ord("|")], _KIND[ord("!")] = BAR, SHOUT
_KIND[[32, 9, 10, 11, 12, 13]] = SPACE

LABELLERS = {"junk": ("capitals", "symbols", "bars", "shouts", "function_words", "repetition", "runs"), "abuse": ("strong_words", "other_words", "rate", "learned", "learned_much")}


def _hashes(words: list[str]) -> np.ndarray:
    part = next(_text.slices(pa.array([" ".join(words)])))
    starts, ends, _ = part.words(_text.ALNUM)
    return np.unique(part.word_hashes(starts, ends, lower=True))


_STOP, _STRONG, _OTHERS = _hashes(STOP_WORDS), _hashes(STRONG), _hashes(OTHERS)


def _vote(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """1 for yes, 0 for no, 2 for neither."""
    return np.where(yes, 1, np.where(no, 0, 2)).astype(np.int8)


@dataclass
class View:
    """Statistics, words and votes of the documents of a slice."""

    votes: dict[str, np.ndarray]
    stats: np.ndarray
    words: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, part: _text.Slice, learned: np.ndarray) -> View:
        """learned: sorted features of the learned labeller."""
        kinds = _KIND[part.data]
        counts = np.stack([np.diff(np.concatenate(([0], np.cumsum(kinds == k)))[part.offsets]) for k in range(8)]).astype(float)
        starts, ends, first = part.words(_text.ALNUM)
        words = part.word_hashes(starts, ends, lower=True)
        n = np.diff(first)
        # A column for each kind of feature: the word, then its beginnings (of a short word, the word again).
        units = np.stack([words, *[part.word_hashes(starts, np.minimum(ends, starts + k), lower=True) for k in BEGINNINGS]], axis=1)
        units = (units >> _text.U64(32)).astype(np.uint32)
        known = np.isin(units, learned).any(axis=1) if len(learned) else np.zeros(len(words), bool)
        per_document = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[first])
        tally = lambda known: per_document(np.isin(words, known))
        again = np.zeros(len(words), dtype=bool)
        again[1:] = words[1:] == words[:-1]
        again[first[:-1][n > 0]] = False
        distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)])
        stop, strong, others = tally(_STOP), tally(_STRONG), tally(_OTHERS)
        letters = counts[UPPER] + counts[LOWER] + counts[BEYOND]
        solid = np.diff(part.offsets) - counts[SPACE]
        share = lambda a, b: a / np.maximum(b, 1)
        capitals, symbols, bars, shouts = share(counts[UPPER], counts[UPPER] + counts[LOWER]), share(counts[SYMBOL], solid), share(counts[BAR], solid), share(counts[SHOUT], solid)
        learned_words, runs = per_document(known), share(per_document(again), n)
        function, variety = share(stop, n), share(distinct, n)
        some = n > 0
        # Each sign of junk votes only for it; the votes against it are for texts that read like prose.
        never = np.zeros(len(n), dtype=bool)
        junk = [
            _vote((capitals > 0.5) & (letters >= 20), never),
            _vote(symbols > 0.08, never),
            _vote(bars > 0.04, never),
            _vote(shouts > 0.08, never),
            _vote((function < 0.02) & (n >= 30), (function > 0.1) & (symbols + bars + shouts < 0.02)),
            _vote((variety < 0.2) & (n >= 50) & (n <= 5000), (variety > 0.4) & (capitals < 0.2) & (symbols + bars + shouts < 0.02) & (runs < 0.05) & some),
            _vote((runs > 0.15) & (n >= 8), never),
        ]
        rate = share(strong + others, n)
        abuse = [_vote(strong >= 1, some), _vote(others >= 1, some), _vote((strong + others >= 2) & (rate > 0.001), (strong + others == 0) & some)]
        if len(learned):
            abuse += [_vote(learned_words >= 2, some & (learned_words == 0)), _vote(share(learned_words, n) > 0.005, some & (learned_words == 0))]
        else:
            abuse += [_vote(never, never)] * 2
        stats = np.stack([np.minimum(7, (8 * x).astype(int)) for x in (capitals, 4 * symbols, 8 * bars, 4 * shouts, 2 * function, variety, runs)], axis=1)
        return cls({"junk": np.stack(junk, axis=1), "abuse": np.stack(abuse, axis=1)}, stats, units, first)

    def features(self, d: int) -> np.ndarray:
        """Distinct features of document d, hashed to 32 bits: its words with their beginnings, and its statistics in steps."""
        words = np.unique(self.words[self.first[d] : self.first[d + 1]])
        if not len(words):
            return words
        steps = (_text.mix((self.stats[d] + 8 * np.arange(self.stats.shape[1]) + 1).astype(np.uint64)) >> _text.U64(32)).astype(np.uint32)
        return np.unique(np.concatenate((words, steps)))


def patterns(votes: np.ndarray) -> list[str]:
    return ["".join("01-"[x] for x in row) for row in votes]


@dataclass
class LabelModel:
    """share: of the yes class. votes: (labeller, class, vote) probabilities."""

    share: float
    votes: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, int], rounds: int = 100) -> LabelModel:
        """From the number of documents of each vote pattern, beginning with the share of yes among the votes cast."""
        seen = sorted(counts)
        weight = np.array([counts[x] for x in seen], float)
        cast = np.array([["01-".index(c) for c in x] for x in seen])
        one = np.eye(3)[cast]
        yes, no = (cast == 1).sum(1), (cast == 0).sum(1)
        post = np.where(yes, 0.5 + 0.45 * yes / np.maximum(1, yes + 0.25 * no), 0.02)
        for _ in range(rounds):
            both = np.stack((1 - post, post)) * weight
            votes = np.einsum("cn,nlv->lcv", both, one) + np.array([[2.0, 0.1, 0.5], [0.1, 2.0, 0.5]])
            votes /= votes.sum(2, keepdims=True)
            model = cls(float((both[1].sum() + 1) / (weight.sum() + 2)), votes)
            now = np.array([model.posterior(x) for x in seen])
            if np.abs(now - post).max() < 1e-6:
                break
            post = now
        return model

    def posterior(self, pattern: str) -> float:
        """Of yes; where nobody votes there is no evidence, and it is 0."""
        if set(pattern) == {"-"}:
            return 0.0
        odds = np.log(self.share / (1 - self.share)) + sum(np.log(self.votes[k, 1, v] / self.votes[k, 0, v]) for k, v in enumerate("01-".index(c) for c in pattern) if v < 2)
        return float(1 / (1 + np.exp(-odds)))


@dataclass
class Scorer:
    """A linear score of hashed features: keys in ascending order, the weight of each, and the bias."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0

    def fit(self, rows: list[np.ndarray], target: np.ndarray, seed: int = 11, batch: int = 64) -> Scorer:
        """Logistic regression by Adagrad over the features whose share differs between the classes by LEAST_Z deviations."""
        every = np.concatenate([*rows, np.zeros(0, np.uint32)])
        if not len(every) or not (target > 0.5).any():
            return self
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        keys, place = np.unique(every, return_inverse=True)
        yes, all_yes = np.bincount(place, target[owner]), target.sum()
        no, all_no = np.bincount(place, 1 - target[owner]), (1 - target).sum()
        share = (yes + no) / len(rows)
        z = (yes / all_yes - no / all_no) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / all_yes + 1 / all_no))
        chosen = np.flatnonzero((np.abs(z) >= LEAST_Z) & (yes + no >= LEAST_ROWS))
        at = np.full(len(keys), -1)
        at[chosen] = np.arange(len(chosen))
        self.keys, weights = keys[chosen], np.zeros(len(chosen))
        known = at[place] >= 0
        columns, starts = at[place][known], np.searchsorted(owner[known], np.arange(len(rows) + 1))
        rng, squares, bias_square = np.random.default_rng(seed), np.full(len(chosen), 1e-2), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for first in range(0, len(rows), batch):
                some = order[first : first + batch]
                held = [columns[starts[k] : starts[k + 1]] for k in some]
                mine, inner = np.concatenate(held), np.repeat(np.arange(len(some)), [len(x) for x in held])
                total = np.bincount(inner, weights[mine], len(some)) + self.bias
                error = (1 / (1 + np.exp(-total)) - target[some]) / len(some)
                g = np.bincount(mine, error[inner], len(chosen)) + DECAY * weights
                squares += g * g
                weights -= RATE * g / np.sqrt(squares)
                bias_square += error.sum() ** 2
                self.bias -= RATE * error.sum() / np.sqrt(bias_square)
        self.weights = weights
        return self

    def score(self, features: np.ndarray) -> float:
        """Of yes; a document without words has no evidence and scores 0."""
        if not len(features):
            return 0.0
        if not len(self.keys):
            return float(1 / (1 + np.exp(-self.bias)))
        place = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        return float(1 / (1 + np.exp(-(self.weights[place[self.keys[place] == features]].sum() + self.bias))))


def _slices(batches: Iterator[pa.RecordBatch], learned: np.ndarray) -> Iterator[tuple[pa.RecordBatch, View]]:
    for batch in batches:
        for part in _text.slices(batch.column(batch.num_columns - 1)):
            yield batch.slice(part.first, len(part)), View.of(part, learned)


def _count_votes(batches: Iterator[pa.RecordBatch], learned: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each pattern that a partition holds."""
    counts: dict[tuple[str, str], int] = {}
    for _, view in _slices(batches, learned):
        for task, votes in view.votes.items():
            for pattern in patterns(votes):
                counts[task, pattern] = counts.get((task, pattern), 0) + 1
    yield pa.RecordBatch.from_pydict({"task": pa.array([x[0] for x in counts], pa.string()), "pattern": pa.array([x[1] for x in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})


def _featurise(batches: Iterator[pa.RecordBatch], learned: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, view in _slices(batches, learned):
        rows = len(view.first) - 1
        votes = {task: pa.array(patterns(view.votes[task]), pa.string()) for task in LABELLERS}
        yield pa.RecordBatch.from_pydict(votes | {"features": pa.array([view.features(d) for d in range(rows)], pa.list_(pa.int64()))})


def learned_words(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = LABELLED, seed: int = 5) -> np.ndarray:
    """Features that abusive documents of a bounded sample of labelled rows have, and others hardly.

    The sample has about ``limit`` rows of labels, which are broadcast: a key and a number each.
    Only the number of documents of each feature leaves the executors.
    """
    total = labels.count()
    chosen = (labels.sample(limit / total, seed) if total > limit else labels).select(labels[id_col].alias("key"), labels[label_col].alias("label")).dropna().limit(2 * limit)
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).join(F.broadcast(chosen), "key").select(F.col("label").cast("int").alias("label"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint32)
        for batch, view in _slices(batches, none):
            marks = batch.column(0).to_numpy(zero_copy_only=False)
            for label in np.unique(marks):
                found = [view.features(d) for d in np.flatnonzero(marks == label)]
                features, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"feature": pa.array(features, pa.int64()), "yes": pa.array(n * (label == 1), pa.int64()), "no": pa.array(n * (label != 1), pa.int64())})

    counts = rows.mapInArrow(count, "feature long, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    chosen = counts.where((F.col("yes") >= LEARN_ROWS) & (F.col("no") <= LEARN_OTHERS * F.col("yes"))).select("feature").toArrow()
    return np.sort(chosen["feature"].to_numpy()).astype(np.uint32)


@dataclass(frozen=True)
class Classifier:
    """What documents are scored with."""

    learned: np.ndarray
    models: dict[str, LabelModel]
    scorers: dict[str, Scorer]
    threshold: float = THRESHOLD

    def scores(self, view: View) -> dict[str, np.ndarray]:
        features = [view.features(d) for d in range(len(view.first) - 1)]
        return {task: np.array([scorer.score(x) for x in features]) for task, scorer in self.scorers.items()}

    def kept(self, scores: dict[str, np.ndarray]) -> pa.Array:
        return pa.array(np.all([x < self.threshold for x in scores.values()], axis=0), pa.bool_())


def train(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 3) -> Classifier:
    """Label models from the votes on every document, and scorers from a sample of about ``sample``.

    labels: where given, one more labeller is learned from a bounded sample of them.  To the
    driver come its words, the vote patterns (some hundred at most) and the sample's features.
    """
    learned = learned_words(docs, labels, id_col, text_col) if labels is not None else np.zeros(0, np.uint32)
    texts = docs.select(docs[text_col].alias("text"))
    counts: dict[str, dict[str, int]] = {task: {} for task in LABELLERS}
    for x in texts.mapInArrow(lambda batches: _count_votes(batches, learned), "task string, pattern string, n long").groupBy("task", "pattern").agg(F.sum("n").alias("n")).collect():
        counts[x.task][x.pattern] = x.n
    models = {task: LabelModel.fit(found) for task, found in counts.items() if found}
    total = sum(counts["junk"].values())
    scorers = {task: Scorer() for task in LABELLERS}
    if total:
        chosen = texts.sample(sample / total, seed) if total > sample else texts
        rows = chosen.mapInArrow(lambda batches: _featurise(batches, learned), "junk string, abuse string, features array<long>").toArrow()
        features = [x.values.to_numpy().astype(np.uint32) for x in rows["features"]]
        for task, model in models.items():
            scorers[task].fit(features, np.array([model.posterior(x) for x in rows[task].to_pylist()]))
    return Classifier(learned, models, scorers)


def classify(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, junk double, abuse double, kept boolean of every document.

    The scores say how likely it is junk and abusive; a document is kept if neither reaches the
    threshold.  Null and empty texts score 0 and are kept; whole texts are scored; repeated
    rows stay; an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, view in _slices(batches, np.zeros(0, np.uint32)):
            scores = model.value.scores(view)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(scores[x], pa.float64()) for x in LABELLERS), model.value.kept(scores)], ["key", *LABELLERS, "kept"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, junk double, abuse double, kept boolean").withColumnRenamed("key", id_col)


def kept_documents(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch.column(place)):
                kept = model.value.kept(model.value.scores(View.of(part, np.zeros(0, np.uint32))))
                yield batch.slice(part.first, len(part)).filter(kept)

    return docs.mapInArrow(run, docs.schema)
