"""Quality scores learned from preferences between documents.

Bradley and Terry: a document has a utility, a weighted sum of features of its text; that one document
is preferred to another has the log-odds of the difference of their utilities. The weights minimise
the logistic loss on feature differences of pairs (good, bad). A cut-off at the quantile of the
utilities that the share of bad labels names turns utilities into decisions.

Features count characters, words and lines of the whole text, so their values do not depend on its
language. The fit sees every labelled row that is not held out: pairs, sums and the quantile are made by
Spark, and the driver gets sums of a fixed size per partition.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut_lineage

#: Bad partners of each good row; pairs are dealt out in rounds, not crossed.
PARTNERS = 8
RIDGE = 1e-3
#: Score of the cut-off.
CUT_SCORE = 0.7

_UPPER = string.ascii_uppercase.encode()
_LETTERS = string.ascii_letters.encode()
_DIGITS = string.digits.encode()
_ENDS = b".,;:!?"
_SPACE = b" \t\n\r\x0b\x0c"
_OTHER = bytes(c for c in range(33, 127) if chr(c) not in string.ascii_letters + string.digits + ".,;:!?'\"()-")


def features(text: str | None) -> list[float]:
    """Shape of a text: character classes, word lengths, repetition, lines. All zero when it is empty."""
    raw = text.encode() if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    size = len(raw)

    def share(kind: bytes) -> float:
        return (size - len(raw.translate(None, kind))) / size

    upper, letters = share(_UPPER), share(_LETTERS)
    wide = sum(map(len, words)) / size - share(bytes(range(33, 127)))
    n = len(words)
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        np.log1p(n),
        min(size / n, 40.0),
        upper / max(letters + wide, 1e-3),
        letters + wide,
        share(_DIGITS),
        share(_ENDS),
        share(_OTHER),
        share(b"|"),
        share(b"!"),
        share(b"<>{}[]\\"),
        len(counts) / n,
        len(counts) / n**0.8,
        max(counts.values()) / n,
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
    ]


FEATURES = (
    "log words", "bytes a word", "upper case of letters", "letters", "digits", "stops", "other symbols", "bars",
    "exclamation marks", "brackets", "distinct words", "distinct words by length", "most frequent word",
    "short words", "log words a line", "repeated lines",
)


@dataclass(frozen=True)
class QualityModel:
    """Utility = weights . (clipped, standardised features); cut: utility of the cut-off."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def utilities(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -8, 8) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, CUT_SCORE at the cut-off."""
        shift = np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(self.utilities(rows) - self.cut + shift, -500, 500)))


def _loss_sums(differences: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the loss, summed over the pairs, and the number of pairs, as one row."""
    p = 1 / (1 + np.exp(np.clip(differences @ weights, -500, 500)))
    curve = (differences * (p * (1 - p))[:, None]).T @ differences
    return np.concatenate([-(differences * p[:, None]).sum(axis=0), curve.ravel(), [len(differences)]])


def _minimise(sums: Callable[[np.ndarray], np.ndarray], size: int, ridge: float = RIDGE, turns: int = 50) -> np.ndarray:
    """Newton's method; ``sums`` gives the ``_loss_sums`` of all pairs for some weights."""
    weights = np.zeros(size)
    for _ in range(turns):
        total = sums(weights)
        gradient = total[:size] / total[-1] + ridge * weights
        curve = total[size:-1].reshape(size, size) / total[-1]
        step = np.linalg.solve(curve + ridge * np.eye(size), gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit_preferences(differences: np.ndarray, ridge: float = RIDGE, turns: int = 50) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w . d)) + ridge |w|^2 / 2 over differences d (Newton)."""
    return _minimise(lambda weights: _loss_sums(differences, weights), differences.shape[1], ridge, turns)


def fit(good: np.ndarray, bad: np.ndarray, bad_share: float) -> QualityModel:
    """The model from feature rows of both labels; ``bad_share`` is the share of bad labels among all."""
    both = np.concatenate([good, bad])
    mean, spread = both.mean(axis=0), both.std(axis=0) + 1e-6
    scaled = [np.clip((rows - mean) / spread, -8, 8) for rows in (good, bad)]
    rounds = max(len(good), len(bad))
    at = np.arange(rounds)
    pairs = [scaled[0][at % len(good)] - scaled[1][(at + turn * 7919) % len(bad)] for turn in range(PARTNERS)]
    weights = fit_preferences(np.concatenate(pairs))
    utilities = np.concatenate([rows @ weights for rows in scaled])
    mass = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(utilities, kind="stable")
    above = int(np.searchsorted(np.cumsum(mass[order]), bad_share + 1e-9))
    above = min(max(above, 1), len(order) - 1)
    cut = (utilities[order[above - 1]] + utilities[order[above]]) / 2
    return QualityModel(mean, spread, weights, float(cut))


def held_out(key: str | Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves ``rest``; a null key is not held out."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(column.cast("string")) % modulus == rest, F.lit(False))


def _featured(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` and the features as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(len(keep))]
            arrays = [*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "features"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, text).mapInArrow(run, f"{schema}, features array<double>")


def _arrays(column: pa.Array) -> np.ndarray:
    """Feature rows of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _summed(rows: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of a row of numbers; the driver gets one row per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = sums(batch)
                total = found if total is None else total + found
        if total is not None:
            numbers = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tolist()])]
            yield pa.RecordBatch.from_arrays(numbers, names=["part", "sums"])

    parts = rows.mapInArrow(run, "part long, sums array<double>").collect()
    return np.sum([row["sums"] for row in sorted(parts, key=lambda row: row["part"])], axis=0)


def _numbered(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Rows (at, label, features), numbered from 0 within their label in the order of the partitions of
    written rows (label, features), and the number of rows of each label."""
    parts = rows.groupBy(F.spark_partition_id().alias("part"), "label").count().collect()
    begin: dict[tuple[int, int], int] = {}
    counts = {0: 0, 1: 0}
    for part, label, count in sorted(map(tuple, parts)):
        begin[part, label] = counts[label]
        counts[label] += count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = {label: begin.get((part, label), 0) for label in (0, 1)}
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.empty(len(labels), np.int64)
            for label in seen:
                own = np.flatnonzero(labels == label)
                at[own] = seen[label] + np.arange(own.size)
                seen[label] += own.size
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["at", "label", "features"])

    return rows.mapInArrow(run, "at long, label int, features array<double>"), counts


def _pairs(numbered: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Rows (good, bad): PARTNERS rounds of pairs, each round over all rows of the larger label."""
    rounds = max(counts.values())
    every = F.sequence(F.col("at"), F.lit(rounds - 1).cast("long"), F.lit(counts[1]).cast("long"))
    turns = F.sequence(F.lit(0), F.lit(PARTNERS - 1))
    good = (
        numbered.filter("label = 1")
        .select(F.col("features").alias("good"), F.explode(every).alias("pair"))
        .select("good", "pair", F.explode(turns).alias("turn"))
        .select("good", ((F.col("pair") + F.col("turn") * 7919) % counts[0]).alias("at"))
    )
    return good.join(numbered.filter("label = 0").select("at", F.col("features").alias("bad")), "at").select("good", "bad")


def _cut(rows: DataFrame, utilities: Callable[[np.ndarray], np.ndarray], counts: dict[int, int], bad_share: float) -> float:
    """The middle between the two utilities where the mass of the lower rows reaches ``bad_share``; labels
    weigh as their shares do. The rows are sorted by Spark; the driver gets counts per partition."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(utilities(_arrays(batch.column(1))))], names=["label", "utility"]
                )

    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.mapInArrow(scored, "label int, utility double").repartitionByRange(ranges, "utility", "label")
    ordered = cut_lineage(ordered.sortWithinPartitions("utility", "label"))
    part = F.spark_partition_id().alias("part")
    found = ordered.groupBy(part).agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).collect()
    mass = np.array([(1 - bad_share) / counts[1], bad_share / counts[0]])
    wanted = bad_share + 1e-9
    begin, seen, first, crossing = {}, np.zeros(2, np.int64), np.zeros(2, np.int64), None
    for number, *own in sorted(map(tuple, found)):
        begin[number] = int(seen.sum())
        if crossing is None and (seen + own) @ mass >= wanted:
            crossing, first = number, seen.copy()
        seen = seen + own
    total = int(seen.sum())
    above = total
    if crossing is not None:

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = first, int(first.sum())
            for batch in batches:
                good = np.cumsum(batch.column(0).to_numpy(zero_copy_only=False))
                bad = np.arange(1, len(good) + 1) - good
                over = np.flatnonzero((held[0] + good) * mass[0] + (held[1] + bad) * mass[1] >= wanted)
                if over.size:
                    yield pa.RecordBatch.from_arrays([pa.array([at + int(over[0])], pa.int64())], names=["at"])
                    return
                held, at = held + [int(good[-1]), int(bad[-1])], at + len(good)

        above = ordered.filter(F.spark_partition_id() == crossing).mapInArrow(reached, "at long").first()["at"]
    above = min(max(above, 1), total - 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = begin.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            own = batch.column(1).slice(max(0, above - 1 - at), max(0, min(batch.num_rows, above + 1 - at) - max(0, above - 1 - at)))
            yield pa.RecordBatch.from_arrays([own], names=["utility"])
            at += batch.num_rows

    sides = [row["utility"] for row in ordered.mapInArrow(placed, "utility double").collect()]
    return sum(sides) / 2


def fit_rows(rows: DataFrame, bad_share: float) -> QualityModel | None:
    """``fit`` for written rows (label, features) of any number; None without rows of both labels."""
    numbered, counts = _numbered(rows)
    if not counts[0] or not counts[1]:
        return None
    size = len(FEATURES)
    total = counts[0] + counts[1]
    mean = _summed(rows, lambda batch: _arrays(batch.column(1)).sum(axis=0)) / total
    spread = np.sqrt(_summed(rows, lambda batch: ((_arrays(batch.column(1)) - mean) ** 2).sum(axis=0)) / total) + 1e-6

    def scaled(found: np.ndarray) -> np.ndarray:
        return np.clip((found - mean) / spread, -8, 8)

    pairs = cut_lineage(_pairs(numbered, counts))

    def sums(weights: np.ndarray) -> np.ndarray:
        return _summed(
            pairs, lambda batch: _loss_sums(scaled(_arrays(batch.column(0))) - scaled(_arrays(batch.column(1))), weights)
        )

    weights = _minimise(sums, size)
    cut = _cut(rows, lambda found: scaled(found) @ weights, counts, bad_share)
    return QualityModel(mean, spread, weights, float(cut))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    modulus: int = 4,
    rest: int = 2,
) -> QualityModel | None:
    """The model of all labelled rows that are not held out; None without rows of both labels.

    Features are made before the join with the labels, so that no text is moved. A key with several rows
    of text gives one row; the rows are written once, in the order of the keys.
    """
    known = labels.select(key, label).filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key, modulus, rest))
    keyed = known.groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("label"))
    counts = {row[0]: row[1] for row in keyed.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    rows = docs.filter(F.col(key).isNotNull() & ~held_out(key, modulus, rest))
    rows = rows.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    found = (
        _featured(rows, ["__key"], "__text")
        .join(keyed, "__key")
        .groupBy("__key", "label")
        .agg(F.min("features").alias("features"))
        .orderBy("__key")
        .select("label", "features")
    )
    return fit_rows(cut_lineage(found), counts[0] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: QualityModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row, empty and null texts included; 0.5 where nothing could be learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None or not n:
                scores = np.full(n, 0.5)
            else:
                scores = model.scores(np.array([features(t.as_py()) for t in batch.column(1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores CUT_SCORE or more; all rows where nothing could be learned.

    Decided row by row, so repeated rows and rows without a key are judged like others.
    """
    model = learn(docs, labels, key, text)
    if model is None:
        return docs

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            rows = np.array([features(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(rows) >= CUT_SCORE))

    return docs.mapInArrow(judge, docs.schema)
