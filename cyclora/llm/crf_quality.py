"""Quality of documents from a linear-chain conditional random field over lines.

Each line is good or bad. Its features, and those of the lines around it, give
a score; neighbouring lines influence each other through a transition matrix.
Forward-backward gives each line's probability of being good, and the mean of
these, weighted by length, is the document's quality, calibrated to labels.

Labels are of documents. Lines of good documents are good; those of bad ones
start as bad and are labelled anew from the model's marginals after each round
of fitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.sources.shared import spread

from . import text_stats as S
from .common import table
from .labels import held_out, labelled_sample, one_each

#: Most labelled documents that the model is fitted on, with all their lines.
SAMPLE_ROWS = 3000
#: Rounds of fitting and labelling lines anew, and steps of each fit.
ROUNDS, STEPS = 3, 50
THRESHOLD = 0.7

OWN = ["bias", "symbols", "pipes", "shouts", "upper", "digits", "same_word", "few_words", "copy", "repeats", "short", "mixed"]


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and length in bytes of each line that has a word."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    if not lines:
        return np.zeros((0, 2 * len(OWN) - 1), np.float32), np.zeros(0)
    sizes = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    kinds = S.classes(b"".join(lines))
    counts = np.stack([np.add.reduceat((kinds == k).astype(np.int32), starts) for k in range(S.CLASSES)], 1)
    words = [x.split() for x in lines]
    n = np.array([len(w) for w in words])
    covered = S.repeated_words([w for x in words for w in x])
    first_word = np.concatenate([[0], np.cumsum(n)[:-1]])
    repeats = np.add.reduceat(covered.astype(np.int32), first_word) / n
    same = np.array([sum(map(bytes.__eq__, w, w[1:])) for w in words]) / np.maximum(n - 1, 1)
    few = np.array([1 - len(set(w)) / len(w) if len(w) > 4 else 0.0 for w in words])
    seen: set[bytes] = set()
    copies = np.array([x in seen or bool(seen.add(x)) for x in lines], float)
    letters = np.maximum(counts[:, S.UPPER] + counts[:, S.LOWER], 1)
    chars = np.maximum(sizes - counts[:, S.SPACE] - counts[:, S.REST], 1)
    ratio = lambda k: counts[:, k] / (n + counts[:, k])
    own = np.stack(
        [
            np.ones(len(lines)),
            ratio(S.SYMBOL),
            ratio(S.PIPE),
            ratio(S.BANG),
            counts[:, S.UPPER] / letters,
            counts[:, S.DIGIT] / chars,
            same,
            few,
            copies,
            repeats,
            np.exp(-n / 4.0),
            1 - letters / chars,
        ],
        1,
    )
    around = np.zeros_like(own)
    around[1:] += 0.5 * own[:-1]
    around[:-1] += 0.5 * own[1:]
    return np.hstack([own, around[:, 1:]]).astype(np.float32), sizes.astype(float)


class Chains:
    """Chains of lines, padded to one length, longest first."""

    def __init__(self, features: list[np.ndarray]) -> None:
        self.order = np.argsort([-len(x) for x in features], kind="stable")
        self.sizes = np.array([len(features[i]) for i in self.order])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.rows = np.concatenate([features[i] for i in self.order]) if len(features) else np.zeros((0, 1))
        longest = int(self.sizes.max(initial=0))
        #: Chains that have a line at each step, and their lines.
        self.at = [self.starts[: int((self.sizes > t).sum())] + t for t in range(longest)]

    def marginals(self, emission: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of good for each line, expected transitions, and the log of the partition function.

        ``emission`` is the score of good over bad, ``move`` the scores of transitions.
        """
        score = np.zeros((len(emission), 2))
        score[:, 1] = emission
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        for t, at in enumerate(self.at):
            ahead[at] = score[at]
            if t:
                before = ahead[at - 1]
                ahead[at] += np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1])
        for t in range(len(self.at) - 1, 0, -1):
            at = self.at[t]
            after = score[at] + back[at]
            back[at - 1] = np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1])
        both = ahead + back
        z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - z)
        moves = np.zeros((2, 2))
        for at in self.at[1:]:
            joint = ahead[at - 1][:, :, None] + move + (score[at] + back[at])[:, None, :] - z[at][:, None, None]
            moves += np.exp(joint).sum(0)
        return good, moves, float(z[self.starts[self.sizes > 0]].sum())


class Model:
    """Weights of features and transitions, and the calibration of documents' qualities."""

    def __init__(self, features: list[np.ndarray], sizes: list[np.ndarray], good: np.ndarray) -> None:
        self.weights, self.move = np.zeros(2 * len(OWN) - 1), np.zeros((2, 2))
        self.slope, self.offset = 1.0, 0.0
        some = [i for i, x in enumerate(features) if len(x)]
        if len({bool(good[i]) for i in some}) < 2:
            return
        chains = Chains([features[i] for i in some])
        docs = np.repeat(np.arange(len(some))[chains.order], chains.sizes)
        of_good = np.array([bool(good[i]) for i in some])[docs]
        lines = of_good.copy()
        for _ in range(ROUNDS):
            self._fit(chains, lines)
            p = chains.marginals(chains.rows @ self.weights, self.move)[0]
            worst = np.ones(len(some))
            np.minimum.at(worst, docs, p)
            lines = of_good | ((p > 0.5) & (p > worst[docs]))
        quality = self.qualities(features, sizes)
        self._calibrate(quality[some], np.array([bool(good[i]) for i in some]))

    def _fit(self, chains: Chains, lines: np.ndarray) -> None:
        """Penalised likelihood by Adam, from the weights that are there."""
        n = len(lines)
        seen = np.zeros((2, 2))
        for at in chains.at[1:]:
            np.add.at(seen, (lines[at - 1].astype(int), lines[at].astype(int)), 1)
        theta = np.concatenate([self.weights, self.move.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            p, moves, _ = chains.marginals(chains.rows @ theta[:-4], theta[-4:].reshape(2, 2))
            slope = np.concatenate([(p - lines) @ chains.rows, (moves - seen).ravel()]) / n + 1e-4 * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.move = theta[:-4], theta[-4:].reshape(2, 2)

    def _calibrate(self, quality: np.ndarray, good: np.ndarray) -> None:
        """Logistic regression of labels on the log-odds of quality."""
        x = _log_odds(quality)
        x = np.stack([x, np.ones_like(x)], 1)
        theta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2])
            theta -= np.linalg.solve(hessian, x.T @ (p - good) + 1e-2 * (theta - [1.0, 0.0]))
        self.slope, self.offset = max(float(theta[0]), 1e-3), float(theta[1])

    def qualities(self, features: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Mean probability of good over a document's lines, weighted by length; 0 without lines."""
        out = np.zeros(len(features))
        chains = Chains(features)
        good = chains.marginals(chains.rows @ self.weights, self.move)[0] if len(chains.rows) else np.zeros(0)
        for k, i in enumerate(chains.order):
            if chains.sizes[k]:
                out[i] = np.average(good[chains.starts[k] : chains.starts[k] + chains.sizes[k]], weights=sizes[i])
        return out

    def scores(self, features: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Calibrated quality; a text without a word has 0."""
        x = self.slope * _log_odds(self.qualities(features, sizes)) + self.offset
        return np.where([len(f) > 0 for f in features], 1 / (1 + np.exp(-np.clip(x, -30, 30))), 0.0)


def _log_odds(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on all lines of at most ``rows`` labelled documents that are not held out; good ones have ``quality`` 1.

    Of a repeated doc_id with different texts always the same one is taken,
    so two runs give one model. Null texts and those without a word have no
    lines and are passed over.
    """
    sample = labelled_sample(docs, labels, "quality", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(x.as_py() or b"") for x in batch.column(2)]
            lines = pa.array([f.tobytes() for f, _ in found], pa.binary())
            sizes = pa.array([z.tobytes() for _, z in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lines, sizes], names=["doc_id", "quality", "lines", "sizes"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    measured = sample.select("doc_id", "quality", F.col("text").cast("binary")).mapInArrow(
        run, f"doc_id {kind}, quality int, lines binary, sizes binary"
    )
    # a repeated doc_id counts once, so at most `rows` rows of numbers come to the driver
    got = one_each(measured).toPandas().sort_values("doc_id")
    width = 2 * len(OWN) - 1
    return Model(
        [np.frombuffer(x, np.float32).reshape(-1, width) for x in got["lines"]],
        [np.frombuffer(x) for x in got["sizes"]],
        got["quality"].to_numpy() == 1,
    )


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Quality of each row of ``docs`` (text), after the columns in ``keep``, as score and predicted.

    A null text counts as empty; a text without a word has score 0. A text of
    any length is one chain of all its lines. Only the text is looked at. Each row is scored alone, so repeated rows have equal
    scores; an empty table gives an empty table. A column of ``keep`` that is
    named score or predicted is replaced. A model that was fitted on rows of
    one label, or on none, gives every text with a word the same score.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias("__text"))
    rows = spread(rows)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [line_features(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)]
            scores = model.scores([f for f, _ in found], [z for _, z in found])
            made = [pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; nothing is learnt from the rows that are held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
