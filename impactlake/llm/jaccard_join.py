"""Exact n-gram Jaccard join with components: a size-aware heavy-light join.

The distinct word 5-grams of a text are its set; two sets link when their Jaccard
similarity reaches ``percent`` / 100.

* Equal sets are one class first (an aggregation); only class representatives go on.
* Light: small sets enumerate all their subsets of the least overlap that a link of
  their sizes needs.  Sharing such a subset *is* a link, so each subset links its sets
  to the smallest of them, and no pair is emitted.
* Heavy: large sets are scanned through inverted lists.  A set is listed under its
  first elements only (rare ones first), enough for any link to share one.  Lists of
  rare elements are bounded by construction, and give their pairs.  Lists of frequent
  elements (large groups of near copies, common passages) are compared with a pivot
  each; most of a list then is in the pivot's component, and only what is left is
  compared further, where the triangle inequality of the Jaccard distance allows it.
* The boundary of light and heavy is the size at which the estimated cost of
  enumeration plus scanning, from the histogram of sizes, is least.

Elements are 54-bit hashes of shingles, so that two different shingles of a document
(or a pair) coincide with a chance of about n**2 / 2**55.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, dropped, frugal, partitions, read_table, shared_dir, stage, tidy_shuffles
from .components import connected_components
from .textvec import U64, mix, runs, slices, window_hashes, word_hashes, word_spans

WORDS = 5
PERCENT = 80
#: A list of at most so many sets gives its pairs; elements in more sets are "frequent".
LIST_LIMIT = 16
#: So many frequent elements at most are sent to the executors (16 bytes each), those in
#: most sets.  Others stand among the rare ones; their lists are met by length.
FREQUENT_BOUND = 2_000_000
#: A list of more sets than this is compared by pivots, whatever is known of its element.
LONG_LIST = 4 * LIST_LIMIT
#: Elements that one task sorts at a time.
RANGE_ROWS = 1_500_000
#: Elements that a task combines or deals out at a time.
FLUSH_ROWS = 400_000
#: Members of a frequent list that the sets meet which are not linked to its pivot.
FRIENDS = 8
#: Largest size for which subsets are considered, and the cost of a list entry in subsets.
LIGHT_MOST, ENTRY_COST = 24, 8
#: Sets that are compared with one copy of a partner's set.
FAN = 128
#: Sets of a block of queries and of a block that they are compared with.
QUERY_BLOCK, MEMBER_BLOCK = 256, 1024

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_BITS = 54


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sorted distinct shingles, one after the other, and their counts."""
    starts, ends, words = word_spans(raw, at, _IS_WORD)
    h = word_hashes(raw, starts, ends)
    n_words = np.diff(words)
    grams = window_hashes(h, k)
    full = np.maximum(n_words - k + 1, 0)
    flat, doc = grams[runs(words[:-1], full)], np.repeat(np.arange(len(n_words)), full)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        whole = np.array([mix(np.array([_folded(h[words[d] : words[d + 1]])], U64))[0] for d in short], U64)
        flat, doc = np.concatenate([flat, whole]), np.concatenate([doc, short])
    keys = np.sort((doc.astype(U64) << U64(_BITS)) | (flat >> U64(64 - _BITS)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    counts = np.bincount((keys >> U64(_BITS)).astype(np.int64), minlength=len(n_words))
    return keys & U64((1 << _BITS) - 1), counts


def _folded(h: np.ndarray) -> int:
    x = 0x1F83D9ABFB41BD6B + len(h)
    for v in h.tolist():
        x = ((x ^ v) * 0x9FB21C651E98DF25 + 1) & 0xFFFFFFFFFFFFFFFF
    return x


def pack(values: np.ndarray) -> bytes:
    """Seven bytes a value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpack(blob: bytes | np.ndarray) -> np.ndarray:
    raw = (blob if isinstance(blob, np.ndarray) else np.frombuffer(blob, np.uint8)).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.view("<u8").ravel()


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, at in slices(batch.column(1)):
                flat, counts = shingle_sets(raw, at, k)
                edge = np.concatenate([[0], np.cumsum(counts)])
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0x6A09E667F3BCC909):
                    total = np.concatenate([[U64(0)], np.cumsum(mix(flat ^ U64(salt)), dtype=U64)])
                    sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(counts, pa.int64()), *map(pa.array, sums)], names=["doc_id", "n", "s1", "s2"])

    return frugal(run)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, at in slices(batch.column(1)):
                flat, counts = shingle_sets(raw, at, k)
                edge = np.concatenate([[0], np.cumsum(counts)])
                packed = pack(flat)
                blobs = [packed[7 * a : 7 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n", "elements"])

    return frugal(run)


# --- frequent elements ----------------------------------------------------------------


def _counted(ranges: int):
    """Elements and how many sets have them, combined within a task, by range."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, times = np.unique(np.concatenate(held), return_counts=True)
        where = values % U64(ranges)
        order = np.argsort(where, kind="stable")
        values, times, where = values[order], times[order], where[order]
        cut = np.searchsorted(where, np.arange(ranges + 1, dtype=U64))
        rows = []
        for r in range(ranges):
            v, t = values[cut[r] : cut[r + 1]], times[cut[r] : cut[r + 1]]
            v = (v // U64(ranges)).astype(np.uint32)
            many = t > 1
            rows.append((r, v[~many].tobytes(), v[many].tobytes(), t[many].astype(np.uint32).tobytes()))
        a, b, c, d = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), *(pa.array(x, pa.binary()) for x in (b, c, d))], names=["rng", "once", "more", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, raw, _ in slices(batch.column(0), 7 * FLUSH_ROWS, 1 << 30):
                held.append(unpack(raw))
                size += len(held[-1])
                if size >= FLUSH_ROWS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return frugal(run)


def _frequent(limit: int, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        once = [np.frombuffer(x, np.uint32) for x in table["once"].to_pylist()]
        more = [np.frombuffer(x, np.uint32) for x in table["more"].to_pylist()]
        times = [np.frombuffer(x, np.uint32) for x in table["times"].to_pylist()]
        alone = sum(map(len, once))
        values = np.concatenate([*once, *more]).astype(U64)
        values <<= U64(32)
        values[:alone] |= U64(1)
        if times:
            values[alone:] |= np.concatenate(times).astype(U64)
        del once, more, times
        values.sort()
        counts = (values & U64(0xFFFFFFFF)).view(np.int64)
        values >>= U64(32)
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
        values = values[first].astype(np.int64)
        kept = total >= limit
        return pa.table({"element": pa.array(values[kept] * ranges + table["rng"][0].as_py()), "df": pa.array(total[kept].astype(np.int64))})

    return frugal(run)


# --- inverted lists --------------------------------------------------------------------


def _entries(frequent, ranges: int, percent: int, floor: int):
    """The entries of each set's first elements; the rare ones in blobs by range, frequent ones under range -1."""

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        token, doc, n, rare = (np.concatenate([p[i] for p in parts]) for i in range(4))
        where = np.where(rare, (token % U64(ranges)).astype(np.int64), -1)
        order = np.argsort(where, kind="stable")
        token, doc, n, where = token[order], doc[order], n[order], where[order]
        cut = np.searchsorted(where, np.arange(-1, ranges + 1))
        # within a range 32 bits tell candidates apart well enough: pairs are compared by whole elements
        short = (token // U64(ranges)).astype(np.uint32)
        rows = [(r - 1, (short if r else token)[a:b].tobytes(), doc[a:b].tobytes(), n[a:b].tobytes()) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        if rows:
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), *(pa.array(x, pa.binary()) for x in (b, c, d))], names=["rng", "tokens", "docs", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = frequent.value
        parts, size = [], 0
        for batch in batches:
            for doc, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n < floor:
                    continue
                values = unpack(blob)
                reduced = (values % U64(ranges)).astype(np.int64) + (values // U64(ranges)).astype(np.uint32).astype(np.int64) * ranges
                at = np.searchsorted(keys, reduced)
                at[at == len(keys)] = 0
                hot = keys[at] == reduced if len(keys) else np.zeros(n, bool)
                most = n - -(-percent * n // 100) + 1
                cold = values[~hot][:most]
                late = values[hot][np.argsort(rank[at[hot]], kind="stable")][: most - len(cold)] if len(cold) < most else values[:0]
                token = np.concatenate([cold, late])
                # of a pair the smaller set needs only so many of its first elements
                short = n - -(-2 * percent * n // (100 + percent)) + 1
                size_and_part = np.full(len(token), n, np.int32) * 2 + (np.arange(len(token)) < short).astype(np.int32)
                parts.append((token, np.full(len(token), doc, np.int64), size_and_part, np.arange(len(token)) < len(cold)))
                size += len(token)
                if size >= FLUSH_ROWS:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return frugal(run)


def _list_pairs(percent: int, boundary: int, ranges: int):
    """Distinct pairs of the lists of one range that sizes allow, as (x, y, null).

    Entries of lists beyond ``LONG_LIST`` (elements that are frequent, but not among those
    sent to the executors) come out as (x, null, list) instead.
    """

    def run(table: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x, np.uint32) for x in table["tokens"].to_pylist()])
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in table["docs"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int32) for x in table["sizes"].to_pylist()])
        order = np.lexsort((doc, n >> 1, token))
        token, doc, n = token[order], doc[order], n[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(token)))
        far = held = np.zeros(0, np.int64)
        if (many > LONG_LIST).any():
            long = np.repeat(many > LONG_LIST, many)
            # below the keys of whole elements, which are not negative
            far = -1 - (token[long].astype(np.int64) * ranges + table["rng"][0].as_py())
            held = doc[long]
            token, doc, n = token[~long], doc[~long], n[~long]
        del first, many
        small, large, d = [], [], 1
        while d < len(token):
            same = np.flatnonzero(token[d:] == token[:-d])
            if not len(same):
                break
            na, nb, part = n[same] >> 1, n[same + d] >> 1, n[same] & 1
            ok = (100 * na >= percent * nb) & (nb > boundary) & ((part == 1) | ((na == nb) & (n[same + d] & 1 == 1)))
            small.append(doc[same[ok]])
            large.append(doc[same[ok] + d])
            d += 1
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (small, large))
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        if len(x):
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            x, y = x[new], y[new]
        none = pa.nulls(len(held), pa.int64()), pa.nulls(len(x), pa.int64())
        return pa.table({"x": np.concatenate([x, held]), "y": pa.concat_arrays([pa.array(y, pa.int64()), none[0]]), "list": pa.concat_arrays([none[1], pa.array(far, pa.int64())])})

    return frugal(run)


@frugal
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of blobs as rows (token, doc)."""
    for batch in batches:
        for t, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            token, doc = np.frombuffer(t, np.int64), np.frombuffer(d, np.int64)
            for lo in range(0, len(token), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + 50_000]) for v in (token, doc)], names=["token", "x"])


@frugal
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            v = np.concatenate([unpack(a), unpack(b)])
            v.sort()
            out.append(int(np.count_nonzero(v[1:] == v[:-1])))
        both = np.array(out, np.int64)
        na = np.array([len(b) // 7 for b in batch.column(2).to_pylist()], np.int64)
        nb = np.array([len(b) // 7 for b in batch.column(3).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(na + nb - both)], names=["x", "y", "both", "either"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, both, either) of pairs (x, y): sizes of intersection and union of their sets.

    The set of a ``y`` with many partners is sent once for each ``FAN`` of them, so a
    hub's partners are dealt over many tasks.
    """
    fans = pairs.groupBy("y").agg((F.count("*") / FAN).cast("int").alias("fans")).filter("fans > 0")
    dealt = pairs.join(fans, "y", "left").select("x", "y", F.when(F.col("fans") > 0, F.pmod(F.hash("x"), F.col("fans") + 1)).otherwise(0).alias("fan"))
    left = dealt.join(sets, dealt.x == sets.doc_id).select("x", "y", "fan", F.col("elements").alias("of_x"))
    hubs = dealt.select("y", "fan").distinct()
    right = hubs.join(sets, hubs.y == sets.doc_id).select("y", "fan", F.col("elements").alias("of_y"))
    both = left.join(right, ["y", "fan"]).select("x", "y", "of_x", "of_y")
    return both.mapInArrow(_overlaps, "x long, y long, both long, either long")


# --- light sets ------------------------------------------------------------------------


def least_overlap(a: int, b: int, percent: int) -> int:
    """Elements that sets of ``a`` and ``b`` elements must share to link."""
    return -(-percent * (a + b) // (100 + percent))


def subsets_of(size: int, most: int, percent: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) for the partners' sizes up to ``most``."""
    out = []
    for other in range(1, most + 1):
        a, b = min(size, other), max(size, other)
        if 100 * a >= percent * b:
            out.append((a, b, least_overlap(a, b, percent)))
    return out


def light_boundary(histogram: dict[int, int], percent: int) -> int:
    """The size up to which sets enumerate subsets: where enumeration plus scanning costs least."""
    best, found = None, 0
    for s in range(LIGHT_MOST + 1):
        cost = 0
        for size, count in histogram.items():
            if size <= s:
                cost += count * sum(comb(size, c) for _, _, c in subsets_of(size, s, percent) if c <= size)
            if 100 * (s + 1) * percent <= 100 * 100 * size or size > s:
                cost += count * ENTRY_COST * (size - -(-percent * size // 100) + 1)
        if best is None or cost < best:
            best, found = cost, s
    return found


def _subsets(most: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, size = [], [], []
            for d, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = unpack(blob)
                for a, b, c in subsets_of(n, most, percent):
                    if c <= n:
                        some = mix(values[np.array(list(combinations(range(n), c)), np.int64)])
                        h = mix(some.sum(axis=1, dtype=U64) ^ U64(a * 1000 + b))
                        key.append(h.view(np.int64))
                        doc.append(np.full(len(h), d, np.int64))
                        size.append(np.full(len(h), 0 if n == a else 1, np.int32))
            for k, d, s in zip(key, doc, size, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(d), pa.array(s)], names=["key", "x", "larger"])

    return frugal(run)


def light_links(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Links of sets of at most ``most`` elements: each subset's sets to its smallest small set."""
    small = sets.filter(F.col("n") <= most).select("doc_id", "n", "elements")
    keys = small.mapInArrow(_subsets(most, percent), "key long, x long, larger int")
    centre = keys.groupBy("key").agg(F.min(F.when(F.col("larger") == 0, F.col("x"))).alias("a"), F.count("*").alias("many")).filter("many > 1 and a is not null")
    return keys.join(centre, "key").filter("x <> a").select("a", F.col("x").alias("b")).distinct()


# --- frequent lists --------------------------------------------------------------------


def frequent_links(entries: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """All links of the lists of frequent elements that join different components.

    entries: (token, x).  A list's sets are compared with its pivot (its smallest set),
    what is not linked to it with a few members more.  A set that after this is outside
    the component of its list's pivot is compared with all of the list's sets in other
    components, except where the distances to the pivot differ by more than a link allows.
    """
    sets = stage(sets.join(entries.select(F.col("x").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "elements"), "hot-sets")
    pivots = entries.groupBy("token").agg(F.min("x").alias("y"), F.count("*").alias("many")).filter("many > 1").select("token", "y")
    known = stage(entries.join(pivots, "token").select("token", "x", "y"), "pivots")
    compared = stage(overlaps(known.filter("x <> y").select("x", "y").distinct(), sets), "compared")
    linked = f"100 * both >= {percent} * either"
    found = links.union(compared.filter(linked).select(F.col("x").alias("a"), F.col("y").alias("b")))
    distance = F.when(F.col("x") == F.col("y"), 0.0).otherwise(1 - F.col("both") / F.col("either"))
    first = known.join(compared, ["x", "y"], "left").select("token", "x", distance.alias("d"), F.coalesce(F.expr(linked), F.lit(True)).alias("in_ball"))
    first = stage(first, "measured")
    left = first.filter("not in_ball").select("token", "x")
    # the rest of a list meets its own smallest set and some members picked by hash, so that
    # a set of the pivot's component that is not near the pivot itself seldom stays alone
    some = [F.min_by("x", F.xxhash64(F.lit(i), F.col("x"))) for i in range(FRIENDS)]
    friends = entries.join(left.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.array(*some).alias("y"))
    own = left.groupBy("token").agg(F.array(F.min("x")).alias("y"))
    tries = left.join(friends.union(own).select("token", F.explode("y").alias("y")), "token").filter("x <> y")
    tries = stage(tries.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("x")).select("x", "y").distinct(), "tries")
    near = stage(overlaps(tries, sets).filter(linked), "near")
    found = found.union(near.select(F.col("x").alias("a"), F.col("y").alias("b")))
    component = connected_components(found)
    found = stage(found.distinct(), "found")
    placed = first.join(component.select(F.col("id").alias("x"), "component"), "x", "left").select("token", "x", "d", F.coalesce("component", "x").alias("c"))
    placed = stage(placed, "placed")
    dropped(first, compared, tries, known)
    centre = placed.groupBy("token").agg(F.min_by("c", "d").alias("centre"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("token", "centre")
    members = stage(placed.join(centre, "token").select("centre", "x", "c").distinct(), "members")
    dropped(placed)
    every = stage(found.union(block_links(members, sets, percent)), "all-links")
    dropped(found, members, sets, near)
    return every


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of different components c within each ``centre``: (centre, x, c) -> (a, b).

    Two sets of the centre's own component need no look.  The others are the queries, which
    meet all members in blocks; a block's intersections are one product of 0/1 matrices.
    """
    size = members.groupBy("centre").agg(F.ceil(F.sum((F.col("c") != F.col("centre")).cast("long")) / QUERY_BLOCK).cast("int").alias("qs"), F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("ms"))
    held = members.join(size.filter("qs > 0"), "centre").join(sets.withColumnRenamed("doc_id", "x"), "x")
    queries = held.filter("c <> centre").withColumn("q", F.pmod(F.hash("x"), "qs")).withColumn("m", F.explode(F.expr("sequence(0, ms - 1)")))
    others = held.withColumn("m", F.pmod(F.hash("x"), "ms")).withColumn("q", F.explode(F.expr("sequence(0, qs - 1)")))
    keys, cols = ["centre", "q", "m"], [F.col(c).alias(c) for c in ("centre", "q", "m", "x", "c", "elements")]
    return queries.select(*cols).groupBy(*keys).cogroup(others.select(*cols).groupBy(*keys)).applyInArrow(_block(percent), "a long, b long")


def _block(percent: int):
    def tokens(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sets = [unpack(b) for b in t["elements"].to_pylist()]
        n = np.array([len(v) for v in sets], np.int64)
        return np.concatenate(sets) if sets else np.zeros(0, U64), np.repeat(np.arange(len(n)), n), n

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (lt, li, ln), (rt, ri, rn) = tokens(left), tokens(right)
        shared = np.intersect1d(lt, rt)
        both = np.zeros((len(ln), len(rn)), np.float32)
        for lo in range(0, len(shared), 2048):
            some = shared[lo : lo + 2048]
            sides = []
            for token, row, n in ((lt, li, len(ln)), (rt, ri, len(rn))):
                at = np.searchsorted(some, token)
                at[at == len(some)] = 0
                hit = some[at] == token
                grid = np.zeros((n, len(some)), np.float32)
                grid[row[hit], at[hit]] = 1
                sides.append(grid)
            both += sides[0] @ sides[1].T
        either = ln[:, None] + rn[None, :] - both
        lc, rc = (np.array(t["c"].to_pylist(), np.int64) for t in (left, right))
        a, b = np.nonzero((100 * both >= percent * either) & (lc[:, None] != rc[None, :]))
        lx, rx = (np.array(t["x"].to_pylist(), np.int64) for t in (left, right))
        return pa.table({"a": lx[a], "b": rx[b]})

    return frugal(run)


# --- the operator ------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    docs: any frame with a long id and a text; other columns are not read, whatever
    their names.  A null text and a text without words have the empty set, are linked
    with nothing and are a component of their own.  A text of fewer than ``words``
    words has one element, its whole sequence.  Rows with the same id keep their own
    sizes and are one node for links.  A row with a null id keeps its row; its component
    is that of the same set with an id, or null.  Empty input: no rows.
    """
    with tidy_shuffles(docs.sparkSession):
        return _components(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), words, percent)


def _components(texts: DataFrame, words: int, percent: int) -> DataFrame:
    spark = texts.sparkSession
    signed = stage(texts.mapInArrow(_signatures(words), "doc_id long, n long, s1 long, s2 long"), "signatures")
    classes = signed.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    classes = stage(classes, "classes")
    total, count = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sets, table = _stored_sets(texts, classes, words)
    ranges = max(12, int(total // RANGE_ROWS) + 1)

    sizes = {r.n: r["count"] for r in classes.filter(F.col("n") <= 2 * LIGHT_MOST).groupBy("n").count().collect()}
    boundary = light_boundary(sizes, percent)
    links = light_links(sets, boundary, percent) if boundary else spark.createDataFrame([], "a long, b long")

    frequent = _frequent_elements(sets, ranges)
    floor = -(-percent * (boundary + 1) // 100)
    entries = sets.filter(F.col("n") >= floor).select("doc_id", "n", "elements").mapInArrow(_entries(frequent, ranges, percent, floor), "rng int, tokens binary, docs binary, sizes binary")
    entries = stage(entries, "entries")
    frequent.unpersist()
    met = stage(entries.filter("rng >= 0").groupBy("rng").applyInArrow(_list_pairs(percent, boundary, ranges), "x long, y long, list long"), "met")
    hot = entries.filter("rng < 0").select("tokens", "docs").mapInArrow(_rows, "token long, x long")
    hot = stage(hot.union(met.filter("y is null").select(F.col("list").alias("token"), "x")), "hot")
    dropped(entries)
    pairs = stage(met.filter("y is not null").select("x", "y").distinct(), "pairs")
    dropped(met)
    near = overlaps(pairs, sets).filter(f"100 * both >= {percent} * either").select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = stage(links.union(near), "links")
    dropped(pairs)
    every = frequent_links(hot, sets, links, percent)
    component = connected_components(every)
    places = classes.join(component, classes.rep == component.id, "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("place"))
    places = stage(places, "places")
    drop_table(spark, table)
    dropped(hot, links, every, classes, component)
    out = signed.join(places, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("place", "doc_id").alias("component_id"))


def _stored_sets(texts: DataFrame, classes: DataFrame, words: int) -> tuple[DataFrame, str]:
    """The representatives' sets, written in buckets by id (later joins on the id do not move them), and their table's name."""
    spark = texts.sparkSession
    kept = texts.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    rows = kept.mapInArrow(_sets(words), "doc_id long, n long, elements binary")
    path = shared_dir(spark, "sets")
    name = "sets_" + path[-32:]
    rows.write.bucketBy(partitions(spark), "doc_id").sortBy("doc_id").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name), name


def _frequent_elements(sets: DataFrame, ranges: int):
    """A broadcast of the elements in many sets (reduced to range and 32 bits, sorted) with their frequencies."""
    spark = sets.sparkSession
    counts = sets.select("elements").mapInArrow(_counted(ranges), "rng int, once binary, more binary, times binary")
    found = stage(counts.groupBy("rng").applyInArrow(_frequent(LIST_LIMIT, ranges), "element long, df long"), "frequent")
    # the cut from sums by eighths of powers of two, so that no more than the bound reaches the driver
    grade = F.floor(F.log2("df") * 8).cast("int")
    cut, held = None, 0
    for row in sorted(found.groupBy(grade.alias("grade")).count().collect(), reverse=True):
        held += row["count"]
        if held > FREQUENT_BOUND:
            break
        cut = row["grade"]
    got = found.filter(grade >= (1 << 30 if cut is None else cut)).toPandas()
    dropped(found)
    keys = got["element"].to_numpy(np.int64)
    order = np.argsort(keys)
    df = got["df"].to_numpy(np.int64)
    return spark.sparkContext.broadcast((keys[order], df[order]))


#: From here on stand the numbers of rows without an id, by a hash of their texts.
NO_ID = 1 << 62


def near_duplicate_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id; all columns stay.

    A row without an id comes after all that have one; of those with equal texts one stays.
    Rows that repeat an id and a text are one row (the least by its columns).  Texts without
    words are no duplicates of anything: all of their rows stay.  No rows: no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))
    found = jaccard_components(docs.select(key.alias("key"), text.alias("text")), "key", "text")
    found = stage(found.filter("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("n")), "components")
    spare = stage(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__spare")).distinct(), "spare")
    twice = stage(found.filter("doc_id = component_id and n > 1").select(F.col("doc_id").alias("__spare")).distinct(), "repeated")
    dropped(found)
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.withColumn("__key", F.when(worded, key))
    rows = rows.join(spare, F.col("__key") == F.col("__spare"), "left_anti")
    if not twice.limit(1).count():
        return rows.select(*docs.columns)
    once = rows.join(twice, F.col("__key") == F.col("__spare"), "left_anti").select(*docs.columns)
    again = rows.join(twice, F.col("__key") == F.col("__spare"), "left_semi").groupBy("__key", F.xxhash64(text).alias("__text")).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return once.unionByName(again.select("__row.*").select(*docs.columns))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
