"""Secret scans: base patterns, and a battery of randomness tests over other strings.

Strings without white space that could be keys are taken apart by the encoding
that their characters suggest. Each is tested for a uniform alphabet
(chi-squared), for runs above and below the middle of the alphabet, and for
serial correlation. What none of the three rejects is then held against
chance: the p-value that a string written by people (letters as often as in
prose, few changes between cases and digits) of the same alphabet and no
greater length would look as random, by Fisher's sum over the three and by how
often its neighbouring characters are of different classes, with false discoveries controlled over all candidates of similar length
(Benjamini-Hochberg by classes of length).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclora.sources.shared import spread

from .common import checkpoint, table

KINDS = ["assign", "access", "hex", "random"]
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_WORDS = re.compile(r"passw|secret|token|api", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: A string counts as random when none of the tests rejects that at this level.
REJECT = 0.001
#: Share of false discoveries allowed among the strings reported, in each class of length.
FALSE_SHARE = 0.01
#: p-values are told apart by a thousandth of a power of ten, lengths by powers of two.
STEPS = 1000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base matches: leftmost and non-overlapping within a kind, failing ones dropped."""
    found = []
    if _WORDS.search(text):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # runs are maximal, so a run of 16 or more is found whole
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def encoding(token: str) -> str | None:
    """The smallest alphabet that has all characters of a token, or none."""
    chars = set(token.rstrip("="))
    return next((name for name, letters in ENCODINGS.items() if chars <= set(letters)), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, letters: str) -> tuple[float, float, float]:
    """p-values of three tests that the token is drawn evenly and independently from ``letters``."""
    values = np.array([letters.index(c) for c in token.rstrip("=")])
    n, k = len(values), len(letters)
    counts = np.bincount(values, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    # Wilson and Hilferty's cube root makes chi-squared nearly normal
    df = k - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_chi = 0.5 * math.erfc(z / math.sqrt(2))
    high = values >= k / 2
    n1, n0 = int(high.sum()), int((~high).sum())
    if n1 and n0:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * n1 * n0 / n + 1
        var = (mean - 1) * (mean - 2) / max(n - 1, 1)
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    centred = values - values.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p_serial = _normal_tail((r + 1 / n) * math.sqrt(n))
    return p_chi, p_runs, p_serial


#: Strings that people write, as a null: letters come as often as in prose, and neighbouring characters are of different
#: classes (lower case, upper case, digits, others) with this probability.
_PROSE_CHANGE = 0.15
_PROSE = dict(
    zip("etaoinshrdlcumwfgypbvkjxqz", [127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1], strict=True)
)
#: Lengths at which the null is drawn (a string is held against the greatest that isn't longer), and strings drawn by each proposal.
_LENGTHS = [20, 22, 24, 26, 28, 30, 32, 36, 40, 44, 48, 56, 64]
_DRAWN, _MIXED = 2000, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def class_changes(token: str) -> float:
    """Logarithm of Chernoff's bound that neighbours in a string that people write are so often of different classes."""
    kinds = [_kind(c) for c in token.rstrip("=")]
    n = len(kinds) - 1
    q = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n if n else 0.0
    p = _PROSE_CHANGE
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def evidence(token: str, p: tuple[float, ...]) -> float:
    """Fisher's sum over the three tests, less for many changes of class: small for strings that look random."""
    return class_changes(token) - sum(math.log(max(x, 1e-300)) for x in p)


def _chain(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the first character, and of each after each, in strings of ``letters`` that people write."""
    kind = np.array([_kind(c) for c in letters])
    weight = np.array([float(_PROSE.get(c.lower(), 1)) for c in letters])
    share = np.array([weight[kind == x].sum() for x in kind])
    each = weight / share  # within its class
    n_other = len(set(kind)) - 1
    change = _PROSE_CHANGE if n_other else 0.0
    same = kind[:, None] == kind[None, :]
    after = np.where(same, 1 - change, change / max(n_other, 1)) * each[None, :]
    first = each * (kind < 2)
    return first / first.sum(), after


@lru_cache(maxsize=None)
def _prose_null(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of strings of length n that people write, in order, and the logarithm to base 10 of its lower tail.

    Strings are drawn from mixtures of the null with even characters and
    weighted back (importance sampling), so that tails far below one over the
    number of strings are known. Seeds are fixed: results don't hang on chance.
    """
    letters = ENCODINGS[name]
    k = len(letters)
    first, after = _chain(letters)
    rng = np.random.default_rng(n)
    drawn = []
    for mix in _MIXED:
        start, step = (1 - mix) * first + mix / k, ((1 - mix) * after + mix / k).cumsum(axis=1)
        x = np.empty((_DRAWN, n), dtype=np.int64)
        x[:, 0] = np.minimum((start.cumsum()[None, :] < rng.random((_DRAWN, 1))).sum(axis=1), k - 1)
        for i in range(1, n):
            x[:, i] = np.minimum((step[x[:, i - 1]] < rng.random((_DRAWN, 1))).sum(axis=1), k - 1)
        drawn.append(x)
    x = np.concatenate(drawn)
    with np.errstate(divide="ignore"):
        logs = [
            np.log((1 - m) * first + m / k)[x[:, 0]] + np.log((1 - m) * after + m / k)[x[:, :-1], x[:, 1:]].sum(axis=1) for m in _MIXED
        ]
    weights = np.exp(logs[0] - np.logaddexp.reduce(logs, axis=0) + math.log(len(_MIXED)))
    tokens = ["".join(letters[i] for i in row) for row in x]
    values = np.array([evidence(t, battery(t, letters)) for t in tokens])
    order = np.argsort(values, kind="stable")
    tail = np.minimum(np.cumsum(weights[order]) / len(x), 1.0)
    return values[order], np.log10(np.maximum(tail, 1e-300))


def written_by_hand(token: str, name: str, p: tuple[float, ...]) -> float:
    """Logarithm to base 10 of the p-value that a string people write looks at least as random (``p``: the three tests)."""
    n = len(token.rstrip("="))
    size = _LENGTHS[bisect_right(_LENGTHS, n) - 1] if n >= _LENGTHS[0] else _LENGTHS[0]
    values, tail = _prose_null(name, size)
    # the next greater value drawn, so that the tail is not understated
    at = int(np.searchsorted(values, evidence(token, p)))
    return float(tail[at]) if at < len(tail) else 0.0


def candidates(text: str, taken: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Strings outside the base spans: those that all tests take for random, and the length class of each one tried.

    The former are (start, end, class of length, step of the p-value).
    """
    found, tried = [], []
    starts = [a for a, _, _ in taken]
    reach = list(accumulate((b for _, b, _ in taken), max))  # where the spans so far end at most
    for m in _CANDIDATE.finditer(text):
        token = m[0]
        before = bisect_left(starts, m.end())
        if before and reach[before - 1] > m.start():
            continue
        size = len(token).bit_length()
        tried.append(size)
        if (name := encoding(token)) and min(p := battery(token, ENCODINGS[name])) >= REJECT:
            found.append((m.start(), m.end(), size, int(-written_by_hand(token, name, p) * STEPS)))
    return found, tried


def _spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    rows = spread(rows)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    pairs, numbers = pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())
    types = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string()}
    types |= {"__base": pairs, "__found": pairs, "__tried": numbers}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for cell in batch.column(batch.num_columns - 1):
                text = cell.as_py()
                base = base_spans(text)
                told = ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in base)
                found, tried = candidates(text, base)
                counts = [sum(x[2] == k for x in base) for k in range(3)]
                digest = hashlib.sha256(told.encode()).hexdigest()
                for column, value in zip(out, [*counts, digest, base, found, tried], strict=True):
                    column.append(value)
            made = [pa.array(v, t) for v, t in zip(out, types.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *types])

    made = ["n_assign bigint", "n_access bigint", "n_hex bigint", "base_sha256 string"]
    made += ["__base array<array<bigint>>", "__found array<array<bigint>>", "__tried array<bigint>"]
    return rows.mapInArrow(run, ", ".join([*fields, *made]))


def _limits(spans: DataFrame) -> dict[int, int]:
    """For each class of length, the least step that keeps false discoveries below their share (Benjamini-Hochberg)."""
    tried = spans.select(F.explode("__tried").alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("m"))
    steps = (
        spans.select(F.explode("__found").alias("x"))
        .select(F.col("x")[2].alias("size"), F.col("x")[3].alias("step"))
        .groupBy("size", "step")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    above = F.sum("n").over(Window.partitionBy("size").orderBy(F.desc("step")))
    passed = (
        steps.withColumn("k", above)
        .join(tried, "size")
        .where(F.pow(F.lit(10.0), -F.col("step") / STEPS) * F.col("m") <= FALSE_SHARE * F.col("k"))
    )
    # one row for each power of two that is the length of a string: a few dozen
    return {r["size"]: r["step"] for r in passed.groupBy("size").agg(F.min("step").alias("step")).collect()}


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Every span of every text: one row for each row of ``docs`` (text), after the columns in ``keep``.

    Adds n_assign, n_access, n_hex, base_sha256 (of the base spans), spans
    (base and random ones, as kind:start:end in code points) and n_random; a
    column of ``keep`` with such a name is replaced. A null text counts as
    empty and has no spans. Each row is scanned alone, so repeated rows have
    equal results (all of them count for the false-discovery control); an
    empty table gives an empty table.
    """
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
    keep = [c for c in keep if c not in added]
    spans = checkpoint(_spans(docs, keep))
    limits = _limits(spans)
    least = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else None
    passes = lambda x: x[3] >= F.element_at(least, x[2].cast("int")) if limits else F.lit(False)
    found = F.transform(F.filter("__found", passes), lambda x: F.array(x[0], F.lit(3).cast("long"), x[1]))
    base = F.transform("__base", lambda x: F.array(x[0], x[2], x[1]))
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x[1].cast("int") + 1)
    told = F.transform(F.array_sort(F.concat(base, found)), lambda x: F.concat_ws(":", kind(x), x[0], x[2]))
    return spans.select(
        *[F.col(f"`{c}`") for c in keep],
        *added[:4],
        F.array_join(told, ",").alias("spans"),
        F.size(found).cast("long").alias("n_random"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])
