"""Benchmark decontamination by winnowing.

Words of a text are hashed; the hash of every run of ``K`` words is a k-gram, and of
every ``WINDOW - K + 1`` consecutive k-grams the least (the leftmost of equals) is a
fingerprint.  A passage of ``WINDOW`` words has the same fingerprint wherever it
stands, so every shared passage of that length is met when fingerprints of documents
and of the benchmark are joined.  A hit is extended to the windows around it and
compared word by word; what is reported is exact.  Items of fewer words than a window
are one window; these have one k-gram of their own length.

The benchmark's windows go to the executors in blocks of ``BLOCK_WINDOWS`` at most: a
larger benchmark takes several passes over the documents, whose hits are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, read_table, stage
from .textvec import U64, runs, slices, window_hashes, word_hashes, word_spans

WINDOW = 8
K = 5
#: Windows of the benchmark that one pass holds in memory (about 200 bytes each).
BLOCK_WINDOWS = 1_000_000
#: Items that are collected at a time while blocks are made.
BLOCK_ITEMS = 20_000
#: A document with windows of so many items is contaminated.
MIN_ITEMS = 2
#: Column of a row's number where several passes are united.
ROW = "__row"

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


@dataclass
class Windows:
    """Distinct windows of one length with the items that have them."""

    length: int
    words: np.ndarray  # (windows, length) word hashes
    keys: np.ndarray  # the fingerprint of each window, sorted
    at: np.ndarray  # its place in the window
    item_from: np.ndarray  # items of window i: items[item_from[i]:item_from[i + 1]]
    items: np.ndarray


def fingerprints(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every run of ``length`` words: its fingerprint, and the place of that k-gram in the run."""
    k = min(K, length)
    grams = window_hashes(h, k)
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    best, place = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, length - k + 1):
        less = grams[j : j + n] < best
        best[less] = grams[j : j + n][less]
        place[less] = j
    return best, place


def _words_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, raw, at in slices(texts):
        starts, ends, edge = word_spans(raw, at, _IS_WORD)
        yield lo, hi, word_hashes(raw, starts, ends), edge


def index_windows(item_ids: list[int], texts: pa.Array) -> list[Windows]:
    """The windows of items, by length."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lo, hi, h, edge in _words_of(texts):
        for d in range(hi - lo):
            own = h[edge[d] : edge[d + 1]]
            if len(own):
                length = min(WINDOW, len(own))
                rows = np.lib.stride_tricks.sliding_window_view(own, length)
                found.setdefault(length, []).append((rows, np.full(len(rows), item_ids[lo + d], np.int64)))
    out = []
    for length, parts in sorted(found.items()):
        rows, items = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        words, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), items]), axis=1)
        item_from = np.searchsorted(pairs[0], np.arange(len(words) + 1))
        prints = [fingerprints(w, length) for w in words]
        keys, at = np.array([p[0][0] for p in prints], U64), np.array([p[1][0] for p in prints], np.int64)
        order = np.argsort(keys, kind="stable")
        count = np.diff(item_from)[order]
        out.append(Windows(length, words[order], keys[order], at[order], np.concatenate([[0], np.cumsum(count)]), pairs[1][runs(item_from[:-1][order], count)]))
    return out


def occurrences(h: np.ndarray, edge: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, window) of every window in the texts; ``edge``: words before each text."""
    length, none = windows.length, np.zeros(0, np.int64)
    prints, place = fingerprints(h, length)
    if not len(prints) or not len(windows.keys):
        return none, none
    # each distinct fingerprint of the texts is looked up once
    first = np.concatenate([[True], (prints[1:] != prints[:-1]) | (np.diff(place) != -1)])
    group = np.cumsum(first) - 1
    heads = prints[first]
    low = np.searchsorted(windows.keys, heads)
    low[low == len(windows.keys)] = 0
    met = (windows.keys[low] == heads)[group]
    start = np.flatnonzero(met)
    if not len(start):
        return none, none
    room = edge[np.searchsorted(edge, start, side="right")] - start
    start = start[room >= length]
    lo, hi = np.searchsorted(windows.keys, prints[start]), np.searchsorted(windows.keys, prints[start], side="right")
    begin, window = np.repeat(start, hi - lo), runs(lo, hi - lo)
    same = windows.at[window] == place[begin]
    begin, window = begin[same], window[same]
    equal = np.ones(len(begin), bool)
    for j in range(length):
        equal &= h[begin + j] == windows.words[window, j]
    return begin[equal], window[equal]


def _hits(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Windows] = held.value
        for batch in batches:
            *keys, texts = batch.columns
            for lo, hi, h, edge in _words_of(texts):
                n = hi - lo
                hit = np.zeros(len(h) + 1, np.int64)
                docs, items = [], []
                for w in blocks:
                    begin, window = occurrences(h, edge, w)
                    np.add.at(hit, begin, 1)
                    np.add.at(hit, begin + w.length, -1)
                    doc = np.searchsorted(edge, begin, side="right") - 1
                    seen = np.unique(np.stack([doc, window]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
                    many = w.item_from[seen[1] + 1] - w.item_from[seen[1]]
                    docs.append(np.repeat(seen[0], many))
                    items.append(w.items[runs(w.item_from[seen[1]], many)])
                covered = (np.cumsum(hit)[:-1] > 0).astype(np.int8)
                total = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])
                pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1) if docs else np.zeros((2, 0), np.int64)
                cut = np.searchsorted(pairs[0], np.arange(n + 1))
                change = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
                spans = [[] for _ in range(n)]
                if len(change):
                    a, b = change[::2], change[1::2]
                    # a run of covered words may go on into the next text
                    for s, e in zip(a.tolist(), b.tolist(), strict=True):
                        d = int(np.searchsorted(edge, s, side="right")) - 1
                        while s < e:
                            stop = min(e, int(edge[d + 1]))
                            if stop > s:
                                spans[d].append([s - int(edge[d]), stop - int(edge[d])])
                            s, d = stop, d + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        *(k.slice(lo, n) for k in keys),
                        pa.array(np.diff(edge), pa.int64()),
                        pa.array(total[edge[1:]] - total[edge[:-1]], pa.int64()),
                        pa.array([pairs[1][a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    ],
                    names=[*batch.schema.names[:-1], "n_words", "n_hit", "items", "spans"],
                )

    return frugal(run)


FOUND = "n_words long, n_hit long, items array<long>, spans array<array<long>>"
SCHEMA = "doc_id long, " + FOUND


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every document row.

    ``items``: sorted ids of the items of which a window occurs; ``spans``: the runs of
    words hit, as [first, end) word numbers.  Null and wordless texts have no words.
    An empty benchmark, or one without words: no hits.  Rows with the same id, or none,
    stay rows of their own.  Items with the same id are one item with the windows of
    both.  Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("item is not null"))
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return texts.mapInArrow(_hits(docs.sparkSession.sparkContext.broadcast(first)), SCHEMA)
    return _united(_keyed(texts), chain([first, second], blocks), SCHEMA).drop(ROW)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with a number of each row, written once so that every pass meets the same numbers."""
    return stage(rows.select(F.monotonically_increasing_id().alias(ROW), *rows.columns), "rows")


def _united(keyed: DataFrame, blocks: Iterator[list[Windows]], schema: str) -> DataFrame:
    """The hits of all blocks in each row of ``keyed`` (ROW, columns that ``schema`` has before those of FOUND, text)."""
    context, out = keyed.sparkSession.sparkContext, None
    for block in blocks:
        part = stage(keyed.mapInArrow(_hits(context.broadcast(block)), f"{ROW} long, {schema}"), "hits")
        out = part if out is None else out.union(part)
    keys = keyed.columns[:-1]
    both = out.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    merged = F.expr("aggregate(spans, cast(array() as array<array<bigint>>), (a, s) -> if(size(a) > 0 and element_at(a, -1)[1] >= s[0], concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(element_at(a, -1)[1], s[1])))), concat(a, array(s))))")
    both = both.withColumn("spans", merged)
    return both.select(*keys, "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])").alias("n_hit"), "items", "spans")


def _blocks(items: DataFrame) -> Iterator[list[Windows]]:
    """The benchmark's windows, at most ``BLOCK_WINDOWS`` (or one item's) at a time."""
    ids, texts, size = [], [], 0
    for row in items.orderBy("item").toLocalIterator():
        more = len(row.text or "") // 2 + 1
        if ids and (size + more > BLOCK_WINDOWS or len(ids) >= BLOCK_ITEMS):
            yield index_windows(ids, pa.array(texts, pa.string()))
            ids, texts, size = [], [], 0
        ids.append(row.item)
        texts.append(row.text)
        size += more
    if ids:
        yield index_windows(ids, pa.array(texts, pa.string()))


def _clean(held, column: int, min_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, edge in _words_of(batch.column(column)):
                pairs = [np.zeros((2, 0), np.int64)]
                for w in held.value:
                    begin, window = occurrences(h, edge, w)
                    many = w.item_from[window + 1] - w.item_from[window]
                    doc = np.repeat(np.searchsorted(edge, begin, side="right") - 1, many)
                    pairs.append(np.stack([doc, w.items[runs(w.item_from[window], many)]]))
                met = np.unique(np.concatenate(pairs, axis=1), axis=1)
                good = np.bincount(met[0], minlength=hi - lo) < min_items
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return frugal(run)


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """``docs`` (doc_id, text and any columns more) without the contaminated documents; all columns stay.

    Each row stands alone, whatever its id.  With a benchmark of one block this is a
    filter within the scan; with more, rows are looked up by their number.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).filter("item is not null")
    blocks = _blocks(items)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(first), docs.columns.index("text"), min_items), docs.schema)
    keyed = _keyed(docs)
    bad = _united(keyed.select(ROW, F.col("text").cast("string").alias("text")), chain([first, second], blocks), FOUND).filter(F.size("items") >= min_items).select(ROW)
    return keyed.join(bad, ROW, "left_anti").drop(ROW)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (n >= MIN_ITEMS).alias("contaminated"))


ORACLE_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark
), bw as (
  select distinct item_id, least(8, len(ws)) k, array_to_string(ws[i : i + least(8, len(ws)) - 1], ' ') g
  from (select item_id, ws, unnest(generate_series(1, greatest(len(ws) - 7, 1))) i from b where len(ws) > 0)
), ks as (select distinct k from bw), dw as (
  select doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') g
  from (select doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) i from w, ks where len(ws) >= k)
), hits as (select doc_id, dw.k, i, item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + k - 1)) p from (select distinct doc_id, k, i from hits)) group by 1),
named as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) s from (select distinct doc_id, item_id::varchar item_id from hits) group by 1)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from w left join covered using (doc_id) left join named using (doc_id)
"""
