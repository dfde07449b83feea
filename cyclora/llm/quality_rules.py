"""Quality rules: an isolation forest over rule statistics, with a threshold from labelled rows.

Each document is described by the statistics that quality rules test. Trees of
random splits are grown on small subsamples; a document that few splits set
apart has short paths and is anomalous. The forest grows on one part of the
labelled good documents; the threshold comes from the other part and from the
labelled bad ones. All labelled documents that are not held out take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.operators.order import positions, running_sums
from cyclora.sources.shared import spread

from . import text_stats as S
from .common import table
from .labels import held_out, labelled, one_each

#: Trees, rows in the subsample of each, and most splits on a path.
TREES, SUBSAMPLE, DEPTH = 200, 256, 9
#: Least share of the labelled good documents to be kept, among those that pass the base rules.
KEEP_GOOD = 0.998
#: Good documents that a forest needs: with fewer only the base rules hold.
LEAST_GOOD = 20

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "shouts", "pipes", "not_letters", "upper", "digits", "repeats", "dup_lines"]


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base statistics and the forest's features of one text."""
    kinds = np.bincount(S.classes(text), minlength=S.CLASSES)
    words = text.split()  # of bytes: exactly U+0020 and U+0009..U+000D
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = int(S.repeated_words(words).sum())
    symbols = int(kinds[S.SYMBOL] + kinds[S.PIPE])
    chars = len(text) - int(kinds[S.SPACE] + kinds[S.REST])
    base = [n, chars, symbols, dup_lines, repeats]
    letters = int(kinds[S.UPPER] + kinds[S.LOWER])
    per_word = lambda k: float(kinds[k]) / (n + float(kinds[k])) if n else 0.0
    features = [
        per_word(S.SYMBOL),
        per_word(S.BANG),
        per_word(S.PIPE),
        1 - letters / max(chars, 1),
        float(kinds[S.UPPER]) / max(letters, 1),
        float(kinds[S.DIGIT]) / max(chars, 1),
        repeats / max(n, 1),
        dup_lines / max(len(lines), 1),
    ]
    return base, features


class Forest:
    """An isolation forest over features between 0 and 1; each tree is a heap of nodes in arrays.

    Splits are drawn over the whole side of a node's box, not only over the
    part where its rows are, so that a row where no fitted row is has a short
    path even along features that are constant among the fitted rows.
    ``drawn`` has the places in ``rows`` of each tree's subsample, where they
    are drawn already.
    """

    def __init__(
        self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7, drawn: np.ndarray | None = None
    ) -> None:
        drawn = draws(len(rows), trees, subsample, seed) if drawn is None else drawn
        rng = np.random.default_rng(seed)
        trees, self.size = drawn.shape
        self.depth = DEPTH
        nodes = 2 ** (self.depth + 1)
        self.feature = np.full((trees, nodes), -1, np.int16)
        self.split = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        box = np.array([[0.0, 1.0]] * rows.shape[1])
        for t in range(trees):
            self._grow(t, 1, 0, rows[drawn[t]], box, rng)

    def _grow(self, tree: int, node: int, depth: int, rows: np.ndarray, box: np.ndarray, rng: np.random.Generator) -> None:
        if depth == self.depth or len(rows) <= 1:
            self.path[tree, node] = depth + average_path(len(rows))
            return
        f = rng.integers(rows.shape[1])
        at = rng.uniform(*box[f])
        left = rows[:, f] <= at
        self.feature[tree, node], self.split[tree, node] = f, at
        lower, upper = box.copy(), box.copy()
        lower[f, 1] = upper[f, 0] = at
        self._grow(tree, 2 * node, depth + 1, rows[left], lower, rng)
        self._grow(tree, 2 * node + 1, depth + 1, rows[~left], upper, rng)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter a row's paths, the higher."""
        total, at = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = rows[at, f] > split[node]
                node = np.where(f >= 0, 2 * node + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(average_path(self.size), 1e-9))


def draws(n: int, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> np.ndarray:
    """The places, among ``n`` rows, of each tree's subsample; no row is twice in one tree."""
    rng = np.random.default_rng([seed, 1])
    return np.stack([rng.choice(n, min(subsample, n), replace=False) for _ in range(trees)])


def average_path(n: int) -> float:
    """Mean length of an unsuccessful search in a random tree over n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def base_failed(n_words: np.ndarray | Column, n_repeat_words: np.ndarray | Column) -> np.ndarray | Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


class Model:
    """A forest with its threshold; without a forest only the base rules hold."""

    def __init__(self, forest: Forest | None = None, threshold: float = 1.0) -> None:
        self.forest, self.threshold = forest, threshold

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.forest.scores(features) if self.forest else np.zeros(len(features))


def calibrated(good: np.ndarray, bad: np.ndarray, keep_good: float) -> float:
    """The threshold that keeps the given share of good scores and, at or above it, has the least sum of error rates.

    The errors are good scores above the threshold and bad ones at most as
    high. Thresholds between two neighbouring scores are equal in that; the
    middle of the two is taken. Without bad scores the given share decides.
    """
    least = float(np.quantile(good, keep_good))
    if not len(bad):
        return least
    every = np.unique(np.concatenate([[least], good[good > least], bad[bad > least]]))
    wrong = (good[None, :] > every[:, None]).mean(1) + (bad[None, :] <= every[:, None]).mean(1)
    at = int(wrong.argmin())
    return float((every[at] + every[at + 1]) / 2) if at + 1 < len(every) else float(every[at])


def threshold(counts: DataFrame, keep_good: float) -> float:
    """What ``calibrated`` finds, of a table of any size: each score once, with the numbers of good and bad rows that have it.

    Only a few sums and scores come to the driver. There must be a good row.
    """
    upto = running_sums(counts, ["score"], {"__good": "good", "__bad": "bad"}).select(
        "score", "good", "bad", (F.col("__good") + F.col("good")).alias("good_upto"), (F.col("__bad") + F.col("bad")).alias("bad_upto")
    )
    n_good, n_bad = upto.agg(F.sum("good"), F.sum("bad")).first()
    at = (n_good - 1) * keep_good
    low = math.floor(at)
    beside = [F.min(F.when(F.col("good_upto") > k, F.col("score"))) for k in (low, min(low + 1, n_good - 1))]
    least = float(np.quantile(upto.agg(*beside).first(), at - low))
    if not n_bad:
        return least
    wrong = (n_good - F.col("good_upto")) / F.lit(n_good) + F.col("bad_upto") / F.lit(n_bad)
    # errors fall and rise with the score; those at the least threshold are those at the last score up to it
    up_to_least, best = upto.agg(
        F.max(F.when(F.col("score") <= least, F.struct("score", wrong.alias("wrong")))),
        F.min(F.when(F.col("score") > least, F.struct(wrong.alias("wrong"), "score"))),
    ).first()
    chosen = best["score"] if best and best["wrong"] < up_to_least["wrong"] else least
    following = upto.agg(F.min(F.when(F.col("score") > chosen, F.col("score")))).first()[0]
    return chosen if following is None else (chosen + following) / 2


def _measured(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics(x.as_py() or b"") for x in text]
    base = np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE))
    return base, np.array([f for _, f in found]).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> Model:
    """Fit on all labelled documents that are not held out and pass the base rules; good ones have ``quality`` 1.

    Every other good one (in the order of a hash) is of those that the trees'
    subsamples are drawn from. The rest, and all bad ones, set the threshold.
    With fewer than ``LEAST_GOOD`` good ones there is no forest. Only the
    subsamples come to the driver, whose sizes are parameters.

    Of a repeated doc_id with different texts always the same one is taken,
    so two runs give one model. Null texts fail the base rules and have no
    part in it.
    """
    spark = docs.sparkSession
    # texts are measured where they are, so that only numbers are shuffled to their labels
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("text").cast("binary"))
    kinds = ", ".join([*(f"{c} bigint" for c in BASE), *(f"{c} double" for c in FEATURES)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, features = _measured(batch.column(1))
            columns = [*base.T, *features.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", *BASE, *FEATURES])

    measured = spread(texts).mapInArrow(measure, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {kinds}")
    passed = (
        one_each(measured)
        .where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .join(labelled(labels, "quality"), "doc_id")
        .select(F.xxhash64("doc_id").alias("__hash"), "doc_id", (F.col("quality") != 1).alias("bad"), *FEATURES)
    )
    ranked = positions(passed, ["bad", "__hash", "doc_id"], "__at")  # the good ones come first
    n = ranked.where(~F.col("bad")).count()
    if n < LEAST_GOOD:
        return Model()
    drawn = 2 * draws((n + 1) // 2)
    wanted = spark.createDataFrame(pa.table({"__at": np.unique(drawn)}))
    rows = ranked.join(F.broadcast(wanted), "__at").select("__at", *FEATURES).toPandas().sort_values("__at")
    forest = Forest(rows[FEATURES].to_numpy(), drawn=np.searchsorted(rows["__at"].to_numpy(), drawn))
    shared = spark.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = np.stack([x.to_numpy() for x in batch.columns[1:]], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(features))], names=["bad", "score"])

    rest = ranked.where(F.col("bad") | (F.col("__at") % 2 == 1)).select("bad", *FEATURES)
    scored = rest.mapInArrow(score, "bad boolean, score double")
    counts = scored.groupBy("score").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    return Model(forest, threshold(counts, keep_good))


def judge(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Statistics and verdict for each row of ``docs`` (text), after the columns in ``keep``.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, anomaly (the forest's score) and kept; a column of ``keep``
    with such a name is replaced. A null text counts as empty, and an empty
    one fails the base rules. A text of any length is judged whole. A score
    that ties with the threshold is kept. Each row is judged alone, so
    repeated rows have equal verdicts; an empty table gives an empty table.
    """
    added = {**dict.fromkeys(BASE, "bigint"), "base_failed": "boolean", "anomaly": "double", "kept": "boolean"}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep if c not in added], F.col("text").cast("binary").alias("__text"))
    rows = spread(rows)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            base, features = _measured(batch.column(batch.num_columns - 1))
            failed, scores = base_failed(base[:, 0], base[:, 4]), model.scores(features)
            made = [*base.T, failed, scores, ~failed & (scores <= model.threshold)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, made)], names=[*batch.schema.names[:-1], *added]
            )

    return rows.mapInArrow(run, ", ".join([*fields, *(f"{k} {t}" for k, t in added.items())]))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the rules, with all their columns."""
    renamed = docs.select([F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(docs.columns)] + [F.col("text")])
    marked = judge(renamed, fit(docs, labels), renamed.columns[:-1]).where("kept")
    return marked.select([F.col(f"__in{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
