"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and words of whole texts, computed for a batch at once.
Trees are fitted on histograms of quantile bins and kept flattened into five arrays;
scoring walks all documents down a tree level by level with numpy gathers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, frugal, read_table, stage
from .textvec import U64, slices, word_hashes, word_spans

#: Labelled rows that a fit uses at most: those of the smallest hashes of their ids.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 60, 4, 64, 0.15, 5, 1.0

FEATURES = [
    "log_bytes", "log_words", "bytes_per_word", "upper", "digit", "space", "newline", "non_ascii", "mark", "sentence_mark",
    "other_symbol", "symbol_run", "distinct_words", "same_as_before", "upper_words", "short_words", "long_words", "marked_words",
]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SPACE = _class(" \t\n\x0b\x0c\r")
_UPPER, _DIGIT, _NEWLINE, _MARK, _SENTENCE = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("\n"), _class("!?,;:'\"()-"), _class(".")
_SYMBOL = _class("#$%&*+/<=>@[\\]^_`{|}~")
_WIDE = np.arange(256) >= 128
_ANY = _UPPER | _DIGIT | _SENTENCE | _MARK | _SYMBOL


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n = np.diff(at)
    size = np.maximum(n, 1).astype(float)

    def share(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
        return (total[at[1:]] - total[at[:-1]]) / size

    starts, ends, edge = word_spans(raw, at, ~_SPACE)
    h = word_hashes(raw, starts, ends)
    words = np.diff(edge)
    many = np.maximum(words, 1).astype(float)
    doc = np.repeat(np.arange(len(n)), words)

    def share_of_words(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
        return (total[edge[1:]] - total[edge[:-1]]) / many

    keys = np.sort((doc.astype(U64) << U64(54)) | (h >> U64(10)))
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    distinct = np.bincount((keys[new] >> U64(54)).astype(np.int64), minlength=len(n))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    length = ends - starts
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw], dtype=np.int64)])
    marks = np.concatenate([[0], np.cumsum((_SYMBOL | _MARK)[raw], dtype=np.int64)])
    symbol = _SYMBOL[raw]
    run = np.zeros(len(raw), bool)
    run[1:] = symbol[1:] & symbol[:-1]
    columns = [
        np.log1p(n), np.log1p(words), n / many, share(_UPPER[raw]), share(_DIGIT[raw]), share(_SPACE[raw]), share(_NEWLINE[raw]), share(_WIDE[raw]), share(_MARK[raw]), share(_SENTENCE[raw]),
        share(symbol), share(run), distinct / many, share_of_words(again), share_of_words((upper[ends] - upper[starts]) * 2 > length), share_of_words(length <= 2), share_of_words(length >= 14), share_of_words(marks[ends] - marks[starts] > 0),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, x) of labelled texts (doc_id, y, text)."""
    for batch in batches:
        for lo, hi, raw, at in slices(batch.column(2)):
            rows = statistics(raw, at)
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), x], names=["doc_id", "y", "x"])


@dataclass
class Trees:
    """Flattened trees: node i splits ``feature[i]`` at ``cut[i]`` into ``left[i]`` (<=) and ``left[i] + 1``; a leaf has feature -1."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row."""
        total, row = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[node]
                inner = f >= 0
                right = x[row, np.maximum(f, 0)] > self.cut[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1 under logistic loss.

    Without rows of both labels there are no trees, and the score is the share of
    label 1 (one half without rows), kept within 1 % of 0 and 1.
    """
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, cut, left, value, roots = [], [], [], [], []
    if len(np.unique(y)) > 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        total = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            grad, hess = y - p, p * (1 - p)
            roots.append(len(feature))
            feature.append(-1), cut.append(0.0), left.append(-1), value.append(0.0)
            level = [(roots[-1], np.arange(len(y)))]
            for depth in range(DEPTH + 1):
                below = []
                for node, rows in level:
                    g, h = grad[rows], hess[rows]
                    value[node] = float(RATE * g.sum() / (h.sum() + RIDGE))
                    found = _split(binned[rows], g, h, [len(e) for e in edges]) if depth < DEPTH else None
                    if found is None:
                        total[rows] += value[node]
                        continue
                    j, b = found
                    feature[node], cut[node], left[node] = j, float(edges[j][b]), len(feature)
                    for part in (rows[binned[rows, j] <= b], rows[binned[rows, j] > b]):
                        below.append((len(feature), part))
                        feature.append(-1), cut.append(0.0), left.append(-1), value.append(0.0)
                level = below
    return Trees(base, np.array(roots, np.int64), np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(value))


def _split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[int]) -> tuple[int, int] | None:
    """(feature, last bin of the left side) of the greatest gain, or None."""
    best, found = 1e-6, None
    if len(g) < 2 * LEAST_ROWS:
        return None
    whole = g.sum() ** 2 / (h.sum() + RIDGE)
    for j, m in enumerate(cuts):
        if not m:
            continue
        sums = [np.cumsum(np.bincount(binned[:, j], weights=w, minlength=m + 1))[:m] for w in (g, h, np.ones(len(g)))]
        gl, hl, nl = sums
        gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - whole
        gain[(nl < LEAST_ROWS) | (len(g) - nl < LEAST_ROWS)] = 0
        if gain.max() > best:
            best, found = float(gain.max()), (j, int(gain.argmax()))
    return found


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = model.value
        for batch in batches:
            for lo, hi, raw, at in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(trees.score(statistics(raw, at)))], names=["doc_id", "score"])

    return frugal(run)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row.

    docs needs doc_id and text, labels doc_id and quality; other columns are not read.
    Null texts count as empty and are scored like empty ones.  Labels that are null, or
    of documents that are not there, are left out; of several labels of a document the
    largest counts.  A row with a null id is scored and not held out.
    """
    trees = fitted(docs, labels, train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(trees)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most ``train_rows`` labelled documents, those of the smallest hashes of their ids.

    Labels are counted first, and a cut on the hash leaves a few more than the bound, so a
    bounded table is all that is joined with the documents and all that reaches the driver.
    Rows with the same id count once, by the least statistics.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    known = known.withColumn("place", F.xxhash64("doc_id"))
    many = known.count()
    if many > 2 * train_rows:
        known = known.filter(F.col("place") < int(-(1 << 63) + 1.3 * train_rows / many * (1 << 64)))
    known = stage(known, "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known.select("doc_id", "y")), "doc_id").select("doc_id", "y", "text").mapInArrow(_features, "doc_id long, y int, x array<double>")
    sample = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select(F.xxhash64("doc_id").alias("place"), "doc_id", "r.x", "r.y").toPandas()
    dropped(known)
    sample = sample.sort_values(["place", "doc_id"]).head(train_rows)
    x = np.stack(sample["x"].to_list()) if len(sample) else np.zeros((0, len(FEATURES)))
    return fit(x, sample["y"].to_numpy(np.float64))


def _kept(model, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = model.value
        for batch in batches:
            for lo, hi, raw, at in slices(batch.column(column)):
                good = trees.score(statistics(raw, at)) >= THRESHOLD
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return frugal(run)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents (score below the threshold); all columns stay."""
    trees = fitted(docs, labels)
    return docs.mapInArrow(_kept(docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index("text")), docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
