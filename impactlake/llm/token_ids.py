"""Token ids in a byte-aligned variable-length file format.

Ids are replaced by their rank in the corpus (the most frequent id is 0), and a rank
takes one to four bytes.  Lengths stand apart from the data: a control byte holds the
lengths of four ranks, so decoding is a lookup of the control bytes in a table of 256
rows, a running sum and a gather, all in numpy.

The format, written in ascending order of ids by any store Spark can write to:

* ``dictionary/``: one row, ``ids``: the id of each rank, little-endian 32 bits each;
* ``blocks/``: rows of (shard, block, docs, lengths, n_ids, control, data), Parquet.
  Blocks are ordered by (shard, block); ``docs`` and ``lengths`` are 64-bit numbers.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, frugal, partitions, read_table, shared_dir, stage, tidy_shuffles
from .textvec import runs, utf8_arrays, word_spans

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Ids in a block, unless a single document has more.
BLOCK_IDS = 1 << 18
#: Pieces whose ids a worker remembers (about 30 bytes each); the oldest go first.
CACHE_PIECES = 150_000
#: Bytes of text that are split at a time; a longer text is a run of its own.
TEXT_BYTES = 1 << 22
#: Pieces that go through the library at a time.
CALL_PIECES = 2000

# --- tokenizing --------------------------------------------------------------------------

#: The splitter for which a text's ids are those of its pieces.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _DIGIT, _MARK, _HARD = range(5)
#: What a byte is.  Letters of Latin-1 are C3 and a second byte; whatever else is not ASCII is left to the library.
_CLASS = np.full(256, _HARD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0xC3] = _LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[0x27] = _HARD  # what follows an apostrophe may be a piece with it
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def classified(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case bytes, class of each byte) of UTF-8 bytes."""
    kind, low = _CLASS[raw], _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.zeros(0, np.int64)
    if len(lead):
        second = raw[lead + 1]
        sign = (second == 0x97) | (second == 0xB7)
        kind[lead[sign]] = _HARD
        kind[lead + 1] = np.where(sign, _HARD, _LETTER)
        upper = lead[(second <= 0x9E) & ~sign] + 1
        low[upper] += 0x20
    start = np.flatnonzero(raw[:-1] == 0x3C) if len(raw) else np.zeros(0, np.int64)
    kind[start[raw[start + 1] == 0x7C]] = _HARD  # "<|" may begin a special token
    return low, kind


class Encoder:
    """ids(texts): what ``tokenizer.encode(text, add_special_tokens=False)`` gives, by distinct pieces.

    With the recognised normaliser and splitter no piece spans white space, so the ids of
    a text are those of its pieces, and the library merges each distinct piece of a run of
    texts once.  Words of ASCII and the letters of Latin-1 are cut into pieces here, where
    no normal form changes them; any other word goes through the library whole.  With
    another tokenizer whole texts go through it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        first = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_piece = normal == ["NFC", "Replace", "Lowercase"] and first.get("pattern", {}).get("Regex") == _WORD_SPLIT and made["model"].get("end_of_word_suffix") == "</w>"
        special = [x["content"] for x in made.get("added_tokens", [])]
        self.by_piece &= all(x.startswith("<|") and not re.search(r"\s", x) for x in special)
        vocab = self.tokenizer.get_vocab()
        self.width = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.size, self.pool = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, self.width)

    def _merged(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: pa.Array, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids) of distinct pieces; ``hard``: a word that the library has to split."""
        said = pieces.to_pylist()
        plain, slow = np.flatnonzero(~hard), np.flatnonzero(hard)
        order, size, pool = [], [], [np.zeros(0, self.width)]
        for lo in range(0, len(plain), CALL_PIECES):
            some = plain[lo : lo + CALL_PIECES]
            (flat,) = self._merged([b" ".join([said[i] for i in some.tolist()]).decode()])
            cut = np.flatnonzero(self.ends[flat]) + 1
            if len(cut) != len(some):
                slow = np.concatenate([slow, some])
                continue
            order.append(some)
            size.append(np.diff(cut, prepend=0))
            pool.append(flat)
        for lo in range(0, len(slow), CALL_PIECES):
            some = slow[lo : lo + CALL_PIECES]
            each = self._merged([said[i].decode() for i in some.tolist()])
            order.append(some)
            size.append(np.array([len(x) for x in each], np.int64))
            pool += each
        if not order:
            return np.zeros(0, np.int64), pool[0]
        got = np.concatenate(size)
        back = np.argsort(np.concatenate(order))
        return got[back], np.concatenate(pool)[runs((np.cumsum(got) - got)[back], got[back])]

    def _looked_up(self, pieces: pa.Array, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids) of distinct pieces, the remembered ones first looked up."""
        place = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        fresh = pieces.take(pa.array(new))
        size, pool = self._new(fresh, hard[new])
        if len(self.known) + len(new) > CACHE_PIECES:
            # the pieces of this run stay, older ones go
            met = np.flatnonzero(place >= 0)
            old = place[met]
            at = np.cumsum(self.size) - self.size
            self.pool, self.size, self.known = self.pool[runs(at[old], self.size[old])], self.size[old], pieces.take(pa.array(met))
            place[met] = np.arange(len(met))
        place[new] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, fresh])
        self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, pool])
        at = np.cumsum(self.size) - self.size
        out = self.size[place], self.pool[runs(at[place], self.size[place])]
        if len(self.known) > 2 * CACHE_PIECES:
            self._forget()
        return out

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each with ``end`` after it, and the ids before each text."""
        if not self.by_piece:
            each = self._merged(texts.to_pylist())
            before = np.concatenate([[0], np.cumsum([len(x) + 1 for x in each])]).astype(np.int64)
            return np.concatenate([np.append(x, np.array([end], self.width)) for x in each]) if each else np.zeros(0, self.width), before
        raw, at = utf8_arrays(texts)
        low, kind = classified(raw)
        # words, and which of them the library has to split
        first, last, _ = word_spans(kind, at, np.arange(256) != _SPACE)
        odd = np.flatnonzero(kind == _HARD)
        hard = np.searchsorted(odd, last) > np.searchsorted(odd, first)
        slow = np.flatnonzero(hard)
        if len(slow):
            inside = runs(first[slow], last[slow] - first[slow])
            low[inside], kind[inside] = raw[inside], _HARD
        # a piece begins where the class changes, at every digit and at every text
        begins = np.empty(len(raw), bool)
        if len(raw):
            begins[0] = True
            np.not_equal(kind[1:], kind[:-1], out=begins[1:])
            begins |= kind == _DIGIT
            begins[first] = True
            begins &= kind != _SPACE
        start = np.flatnonzero(begins)
        # pieces one after the other, without the white space between words
        dense = low[kind != _SPACE]
        spaces = first - np.concatenate([[0], np.cumsum(last - first)])[:-1]
        offsets = np.append(start - spaces[np.searchsorted(first, start, side="right") - 1], len(dense))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(dense)])
        coded = pc.dictionary_encode(pieces)
        which = np.asarray(coded.indices)
        # whether a distinct piece is a hard word: all equal pieces are
        hard_piece = np.zeros(len(coded.dictionary), bool)
        hard_piece[which] = kind[start] == _HARD
        size, pool = self._looked_up(coded.dictionary, hard_piece)
        of_piece = size[which]
        flat = pool[runs((np.cumsum(size) - size)[which], of_piece)]
        before = np.concatenate([[0], np.cumsum(of_piece)])[np.searchsorted(start, at)]
        doc = np.repeat(np.arange(len(texts)), np.diff(before))
        out = np.full(len(flat) + len(texts), end, self.width)
        out[np.arange(len(flat)) + doc] = flat
        return out, before + np.arange(len(before))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _tokenized(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            _, at = utf8_arrays(texts)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + TEXT_BYTES, side="right")) - 1)
                ids, before = own.ids(texts.slice(lo, hi - lo), end)
                raw, cut = ids.tobytes(), (before * own.width.itemsize).tolist()
                blobs = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["doc_id", "ids"])
                lo = hi

    return frugal(run)


# --- the code ----------------------------------------------------------------------------

#: For each control byte the lengths of its four ranks.
_LENGTHS = np.stack([(np.arange(256) >> (2 * j)) % 4 + 1 for j in range(4)], axis=1).astype(np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of numbers below 2**32."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] < length[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``encode_ranks``."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(length) - length
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    out = raw[at]
    for j in range(1, 4):
        more = np.flatnonzero(length > j)
        out[more] |= raw[at[more] + j] << np.uint32(8 * j)
    return out


def _frequencies(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            raw, _ = utf8_arrays(batch.column(0))
            for lo in range(0, len(raw), 1 << 22):
                got = np.bincount(raw[lo : lo + (1 << 22)].view(width))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], names=["id", "n"])

    return frugal(run)


BLOCKS = "shard int, block int, docs binary, lengths binary, n_ids long, control binary, data binary"


def _blocks(rank_of, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, shard, block = rank_of.value, TaskContext.get().partitionId(), 0
        docs, parts, size = [], [], 0

        def made():
            n = np.array([len(p) for p in parts], np.int64)
            control, data = encode_ranks(ranks[np.concatenate(parts)])
            row = [shard, block, np.array([(d is not None, d or 0) for d in docs], np.int64).tobytes(), n.tobytes(), int(n.sum()), control, data]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "docs", "lengths", "n_ids", "control", "data"])

        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if parts and size + len(blob) // np.dtype(width).itemsize > BLOCK_IDS:
                    yield made()
                    docs, parts, size, block = [], [], 0, block + 1
                docs.append(doc)
                parts.append(np.frombuffer(blob, width))
                size += len(parts[-1])
        if parts:
            yield made()

    return frugal(run)


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts below ``path``, in ascending order of document ids.

    Null and empty texts have the end id alone.  A null document id comes first; rows with
    the same id stand together, in the order of their ids' bytes.  An empty table gives an
    empty dictionary and no blocks.  Columns other than the two named are not read.  Texts of
    any length are encoded whole; ids of equal frequency rank by their number.
    """
    with tidy_shuffles(docs.sparkSession):
        _write(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), path, tokenizer, end_id)


def _write(texts: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    spark = texts.sparkSession
    tokens = stage(texts.mapInArrow(_tokenized(tokenizer, end_id), "doc_id long, ids binary"), "tokens")
    width = encoder(tokenizer).width.str
    counts = tokens.select("ids").mapInArrow(_frequencies(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # as many rows as the vocabulary at most
    ranked = counts.orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy(np.int64)
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    spark.createDataFrame([(bytearray(ranked.astype("<u4").tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/dictionary")
    ordered = tokens.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ranks = spark.sparkContext.broadcast(rank_of)
    ordered.mapInArrow(_blocks(ranks, width), BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    ranks.unpersist()
    dropped(tokens)


def _decoded(dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(dictionary.value, "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                docs = np.frombuffer(row["docs"], np.int64).reshape(-1, 2)
                n = np.frombuffer(row["lengths"], np.int64)
                raw = ids[decode_ranks(row["control"], row["data"], row["n_ids"])].astype("<u4").tobytes()
                before = np.cumsum(n) - n
                cut = (4 * np.concatenate([before, [row["n_ids"]]])).tolist()
                blobs = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                same = [pa.array(np.full(len(n), row[c], np.int32)) for c in ("shard", "block")]
                yield pa.RecordBatch.from_arrays([pa.array(docs[:, 1], mask=docs[:, 0] == 0), *same, pa.array(before), pa.array(n), pa.array(blobs, pa.binary())], names=["doc_id", "shard", "block", "before", "n_tokens", "ids"])

    return frugal(run)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [zlib.crc32(b) for b in batch.column(5).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(crc, pa.int64())], names=["doc_id", "shard", "block", "before", "n_tokens", "ids_crc32"])


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, block, before, n_tokens, ids) from the files; ``ids``: little-endian 32-bit numbers, ``before``: ids of the block before the document's."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["ids"])
    rows = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return rows.mapInArrow(_decoded(spark.sparkContext.broadcast(dictionary)), "doc_id long, shard int, block int, before long, n_tokens long, ids binary")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("shard", "block", "n_ids")
    # two levels, so that only one row for each shard meets in one task
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("all"))
    shards = shards.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("base"))
    within = Window.partitionBy("shard").orderBy("block")
    places = sizes.join(shards, "shard").select("shard", "block", (F.col("base") + F.sum("n_ids").over(within) - F.col("n_ids")).alias("base"))
    rows = read_token_ids(spark, path).mapInArrow(_sums, "doc_id long, shard int, block int, before long, n_tokens long, ids_crc32 long")
    return rows.join(places, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokenized_digest(docs: DataFrame) -> DataFrame:
    from public_tokenizers import path as tokenizer_path

    path = shared_dir(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, tokenizer_path(TOKENIZER))
    return token_digest(docs.sparkSession, path)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized_digest(read_table(spark, sf_dir, "documents"))
