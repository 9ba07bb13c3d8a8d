"""Quality of texts by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.common import hash_unit, table, tidied

WORD_BUCKETS = 1 << 14
BINS = 24
#: Statistics of a text, each in BINS bins (see ``statistics``).
STATISTICS = ["words", "word_length", "distinct", "repeated", "upper", "digits", "marks", "pipes", "odd", "line_length", "longest", "shouts", "given_chars"]
FEATURES = WORD_BUCKETS + BINS * len(STATISTICS)
#: At most so many labelled rows are fitted; they are gathered as hashed counts in one task.
SAMPLE_ROWS = 6000


def _set(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8)).astype(np.int64)


UPPER, DIGITS, PIPES, SHOUTS = _set(bytes(range(65, 91))), _set(bytes(range(48, 58))), _set(b"|<>{}[]=_/\\"), _set(b"!?")
MARKS, ODD = _set(b".,;:'\"()-!?"), _set(b"#$%&*@^~+")


def _bin(x: float, low: float, high: float) -> int:
    return min(BINS - 1, max(0, int((x - low) / (high - low) * BINS)))


def statistics(raw: bytes, ids: np.ndarray, distinct: int, given_chars: int | None) -> list[int]:
    """The bin of each statistic. Shares are taken as logarithms, so that small ones stay apart."""
    n, size = len(ids), max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda which: math.log10(float(counts @ which) / size + 1e-4)
    again = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
    lines = raw.count(b"\n") + 1
    return [
        _bin(math.log10(n + 1), 0, 5), _bin(size / max(n, 1), 1, 16), _bin(distinct / max(n, 1), 0, 1.001), _bin(math.log10(again + 1e-3), -3, 0.001),
        _bin(share(UPPER), -4, 0), _bin(share(DIGITS), -4, 0), _bin(share(MARKS), -4, 0), _bin(share(PIPES), -4, 0), _bin(share(ODD), -4, 0),
        _bin(math.log10(size / lines + 1), 0, 5), _bin(math.log10(max(map(len, raw.split()), default=0) + 1), 0, 4), _bin(share(SHOUTS), -4, 0),
        _bin(math.log10(given_chars + 1), 0, 7) if given_chars is not None and given_chars >= 0 else BINS - 1,
    ]


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = bucket = zlib.crc32(word) % WORD_BUCKETS
        return bucket


def featurize(text: str | None, given_chars: int | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text: words by damped counts in a unit vector, statistics as indicators."""
    raw = (text or "").encode()
    ids = np.fromiter(map(buckets.__getitem__, raw.lower().split()), np.int64)
    found, counts = np.unique(ids, return_counts=True)
    values = np.log1p(counts)
    values /= max(np.sqrt(values @ values), 1e-9)
    bins = np.array(statistics(raw, ids, len(found), given_chars)) + WORD_BUCKETS + BINS * np.arange(len(STATISTICS))
    return np.concatenate([found, bins]).astype(np.int32), np.concatenate([values, np.full(len(bins), 0.5)]).astype(np.float32)


def machine_scores(bias: float, w: np.ndarray, v: np.ndarray, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """bias + w x + half of sum over factors of (sum v x)^2 - sum (v x)^2, for each run of features."""
    vx = v[index] * value[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    return bias + np.add.reduceat(w[index] * value, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, factors: int = 8, steps: int = 1500, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, minimised by AdaGrad in ``steps`` small batches, in a seeded order that is drawn anew after each pass."""
    draw = np.random.default_rng(seed)
    w, v = np.zeros(FEATURES), draw.normal(0, 0.05, (FEATURES, factors))
    gw, gv, gb = np.full(FEATURES, 1e-2), np.full((FEATURES, factors), 1e-2), 1e-2
    mean = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    bias = math.log(mean / (1 - mean))
    if len(set(labels.tolist())) < 2:
        return bias, w, v * 0
    batches = math.ceil(len(rows) / 64)
    for step in range(steps):
        k = step % batches * 64
        order = draw.permutation(len(rows)) if k == 0 else order
        part = [rows[i] for i in order[k : k + 64]]
        y = labels[order[k : k + 64]]
        index, value = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]).astype(np.float64)
        lengths = np.array([len(r[0]) for r in part])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        vx = v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        score = bias + np.add.reduceat(w[index] * value, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
        slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(part)
        each = np.repeat(slope, lengths) * value
        per_row = np.repeat(np.arange(len(part)), lengths)
        touched, back = np.unique(index, return_inverse=True)
        dw = np.bincount(back, each, len(touched)) + decay * w[touched]
        grad = each[:, None] * (sums[per_row] - vx)
        dv = np.stack([np.bincount(back, grad[:, f], len(touched)) for f in range(factors)], axis=1) + decay * v[touched]
        gw[touched] += dw**2
        gv[touched] += dv**2
        gb += slope.sum() ** 2
        w[touched] -= rate * dw / np.sqrt(gw[touched])
        v[touched] -= rate * dv / np.sqrt(gv[touched])
        bias -= rate * slope.sum() / math.sqrt(gb)
    return bias, w, v


def _columns(docs: DataFrame, id_col: str, text_col: str, chars_col: str | None) -> DataFrame:
    given = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), given.alias("__given"))


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str = "n_chars", sample_rows: int = SAMPLE_ROWS, seed: int = 3, **fit) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit the machine on at most ``sample_rows`` labelled rows, chosen by a seeded hash of the id.

    Null labels are left out; a document with several labels has the largest one. Without rows of both labels the
    machine is constant.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__lid")).agg(F.max(label_col).cast("int").alias("__y"))
    known = known.select("__lid", "__y", hash_unit(seed, F.col("__lid")).alias("__u")).orderBy("__u", "__lid").limit(sample_rows)
    texts = _columns(docs, id_col, text_col, chars_col)
    rows = texts.join(F.broadcast(known), F.col("__id") == F.col("__lid")).select("__u", "__y", "__text", "__given")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            made = [featurize(t.as_py(), g.as_py(), buckets) for t, g in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())], names=["u", "y", "i", "x"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)), key=lambda r: (r[0], r[2]))
        made = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for _, _, i, x in found]
        bias, w, v = fit_machine(made, np.array([r[1] for r in found], np.float64), **fit)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([w.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["bias", "w", "v"])

    # the sample is bounded, so that one task can fit it; the driver gets the machine alone
    got = rows.mapInArrow(lambda b: tidied(features(b)), "u double, y int, i binary, x binary").repartition(1).mapInArrow(fit_all, "bias double, w binary, v binary").first()
    if got is None:
        return fit_machine([], np.zeros(0), **fit)
    w = np.frombuffer(got.w, np.float64)
    return got.bias, w, np.frombuffer(got.v, np.float64).reshape(len(w), -1)


def score_quality(docs: DataFrame, machine: tuple[float, np.ndarray, np.ndarray], *, text_col: str = "text", chars_col: str = "n_chars", score_col: str = "score") -> DataFrame:
    """Add the score (0 to 1) of each row's whole text. A column of that name is replaced.

    Edge cases: null and empty texts are scored by their statistics; a null or negative number of characters has a
    bin of its own; very long texts are scored whole; equal texts with equal numbers of characters have equal
    scores; an empty table gives no rows; other columns, whatever their names, are passed on.
    """
    keep = [c for c in docs.columns if c != score_col]
    given = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    source = docs.select(*keep, F.col(text_col).alias("__t"), given.alias("__g"))
    bias, w, v = machine
    sent = docs.sparkSession.sparkContext.broadcast((bias, w.astype(np.float32), v.astype(np.float32)))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        bias, w, v = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [featurize(t.as_py(), g.as_py(), buckets) for t, g in zip(part.column("__t"), part.column("__g"), strict=True)]
                starts = np.concatenate([[0], np.cumsum([len(m[0]) for m in made])[:-1]]).astype(np.int64)
                raw = machine_scores(bias, w, v, np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), starts)
                score = 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score)], names=[*keep, score_col])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(lambda b: tidied(scores(b)), f"{schema}, `{score_col}` double")


def fold_of(column, folds: int):
    """crc32 of the id as text, modulo the folds; null ids are in no fold."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 3) != 1)
    machine = train_quality(docs, labels)
    scored = score_quality(docs, machine)
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
