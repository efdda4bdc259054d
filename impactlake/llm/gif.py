"""GIF: decoding of frames with their rules, and lossless storage of bytes as samples.

``decoded`` reads any GIF of version 87a or 89a: LZW code streams, global and local
palettes, interlace, transparency and the disposal of frames; every frame comes out
composed on the canvas, with its delay.  ``encode_payload`` stores bytes as the samples of
frames with a grey palette, compressed through the dictionary.  A value that the payload
lacks is the transparent index of its frames; bytes 0 are not drawn but shown by the
cleared canvas below them, so a stored text is read through all of these rules.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stage
from .textvec import utf8_arrays

WIDTH = 64
#: Rows of a stored frame; longer payloads go on in further frames.
FRAME_ROWS = 1024
DELAY = 10
#: Entries of a full dictionary.
TABLE = 4096
HISTOGRAM_BINS = 8


class GifError(ValueError):
    """The bytes are not a whole GIF."""


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    indices: np.ndarray  # (height, width) palette indices as stored
    palette: np.ndarray  # (colours, 3)
    canvas: np.ndarray  # (screen height, screen width, 4) after the frame was drawn


# --- LZW ---------------------------------------------------------------------------------


def lzw_encode(samples: bytes, code_size: int = 8) -> bytes:
    """A code stream of samples below 2**code_size, with a clear code whenever the dictionary is full."""
    clear = 1 << code_size
    # codes are held eight bits up, so that a code and the sample after it make a key at once
    codes, cuts = [clear << 8], []  # all codes, and how many there are when a dictionary begins
    table: dict[int, int] = {}
    find, put, nxt, full = table.get, codes.append, (clear + 2) << 8, TABLE << 8
    rest = iter(samples)
    held = next(rest, -1) << 8
    for c in rest:
        key = held | c
        got = find(key)
        if got:
            held = got
            continue
        put(held)
        if nxt < full:
            table[key] = nxt
            nxt += 256
        else:
            put(clear << 8)
            cuts.append(len(codes))
            table.clear()
            nxt = (clear + 2) << 8
        held = c << 8
    if held >= 0:
        put(held)
    put((clear + 1) << 8)
    # a code's width follows from its place in its dictionary
    edge = [1, *cuts, len(codes)]
    width = np.concatenate([[code_size + 1], *[_widths(b - a, code_size) for a, b in zip(edge[:-1], edge[1:], strict=True)]])
    at = np.cumsum(width) - width
    value = np.array(codes, np.uint32) >> np.uint32(8)
    value <<= (at & 7).astype(np.uint32)
    place, size = at >> 3, int(at[-1] + width[-1] + 7) >> 3
    # a code touches three bytes at most, and no two codes the same bit
    whole = sum(np.bincount(place + j, weights=(value >> np.uint32(8 * j)) & np.uint32(255), minlength=size + 2) for j in range(3))
    return whole[:size].astype(np.uint8).tobytes()


def _widths(n: int, code_size: int) -> np.ndarray:
    """Widths of the first ``n`` codes after a clear code: a reader's dictionary grows with each code but the first."""
    entries = (1 << code_size) + 2 + np.maximum(np.arange(n) - 1, 0)
    grown = np.searchsorted(1 << np.arange(code_size + 1, 13), np.minimum(entries, TABLE), side="right")
    return np.minimum(code_size + 1 + grown, 12)


def lzw_decode(data: bytes, code_size: int, n: int) -> np.ndarray:
    """``n`` samples of a code stream; GifError where it is broken or too short.

    The widths of the codes after a clear code are known beforehand, so all of them are cut
    from the bits at once, up to the next clear code.
    """
    clear, end = 1 << code_size, (1 << code_size) + 1
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    window = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    out, made, at, end_bit = [], 0, 0, 8 * len(data)
    while made < n:
        many = TABLE
        while True:
            widths = _widths(many, code_size)
            places = np.cumsum(widths) - widths + at
            fits = int(np.searchsorted(places + widths, end_bit, side="right"))
            codes = (window[places[:fits] >> 3] >> (places[:fits] & 7).astype(np.uint32)) & ((1 << widths[:fits]) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            # other writers go on with a full dictionary
            if len(stop) or fits < many:
                break
            many *= 4
        part = _expanded((codes[: stop[0]] if len(stop) else codes).astype(np.int64), clear)
        out.append(part)
        made += len(part)
        if made >= n:
            break
        if not len(stop):
            raise GifError("the code stream ends early")
        if codes[stop[0]] == end:
            raise GifError("too few samples")
        at = int(places[stop[0]] + widths[stop[0]])
    return np.concatenate(out)[:n] if out else np.zeros(0, np.uint8)


def _expanded(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples that the codes between two clear codes stand for.

    Entry number k of the dictionary says what code k said and one sample more, so a code
    that names it repeats the output from where code k begins.  Lengths and the literals at
    the end of these references come from following them, twice as far each time.
    """
    entry = codes - clear - 2
    index = np.arange(len(codes))
    # a full dictionary takes no more entries, and a code may name the entry it completes, but none after it
    if ((entry >= index) | (entry >= TABLE - clear - 2)).any():
        raise GifError("a code before its entry")
    up, length = np.where(entry >= 0, entry, index), np.where(entry >= 0, 1, 0)
    while True:
        far = up[up]
        if (far == up).all():
            break
        length = length + np.where(up != index, length[up], 0)
        up = far
    length = length + 1
    begin = np.cumsum(length) - length
    total = int(length.sum())
    place = np.arange(total)
    of = np.repeat(index, length)
    source = np.where(entry[of] >= 0, begin[np.maximum(entry[of], 0)] + place - begin[of], place)
    while True:
        far = source[source]
        if (far == source).all():
            break
        source = far
    return codes[of[source]].astype(np.uint8)


# --- the container -------------------------------------------------------------------------


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("a sub-block is missing")
        size = data[at]
        if not size:
            return b"".join(parts), at + 1
        if at + 1 + size > len(data):
            raise GifError("a sub-block is cut")
        parts.append(data[at + 1 : at + 1 + size])
        at += size + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise GifError("a palette is cut")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """(width, height, frames) of a whole GIF."""
    frames = [replace(f, canvas=f.canvas.copy()) for f in decoded(data)]
    return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), frames


def decoded(data: bytes) -> Iterator[Frame]:
    """The frames one after the other.  An index beyond the palette is black, as is a frame without a palette.

    ``canvas`` of a frame is the picture itself, which goes on changing with the frames after it.
    """
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("not a GIF")
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, common = 13, np.zeros((0, 3), np.uint8)
    if flags & 128:
        common, at = _palette(data, at, flags)
    # a pixel is a number of four bytes: red, green, blue and whether it is drawn
    canvas = np.zeros((height, width), "<u4")
    delay, disposal, transparent = 0, 0, None
    while True:
        if at >= len(data):
            raise GifError("the trailer is missing")
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                delay, disposal = int.from_bytes(body[1:3], "little") * 10, (body[0] >> 2) & 7
                transparent = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C or at + 10 > len(data):
            raise GifError("an unknown block")
        left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
        flags, at = data[at + 9], at + 10
        palette = common
        if flags & 128:
            palette, at = _palette(data, at, flags)
        if at >= len(data) or not 1 <= data[at] <= 11:
            raise GifError("a wrong code size")
        size = data[at]
        body, at = _sub_blocks(data, at + 1)
        indices = (lzw_decode(body, size, w * h) if w * h else np.zeros(0, np.uint8)).reshape(h, w)
        if flags & 64:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        colours = np.full((256, 4), [0, 0, 0, 255], np.uint8)
        colours[: len(palette), :3] = palette
        colours = colours.view("<u4").ravel()
        before = canvas.copy() if disposal == 3 else None
        shown = indices[: max(0, height - top), : max(0, width - left)]
        part = canvas[top : top + shown.shape[0], left : left + shown.shape[1]]
        np.copyto(part, colours[shown], where=True if transparent is None else shown != transparent)
        yield Frame(left, top, w, h, delay, disposal, transparent, indices, palette, canvas.view(np.uint8).reshape(height, width, 4))
        if disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode_payload(payload: bytes) -> bytes:
    """A GIF whose frames show the payload, which has a positive multiple of WIDTH bytes.

    Every frame covers the canvas below the rows that are left, clears it when it is over
    (disposal 2) and leaves out bytes 0, for which its transparent index stands: the
    greatest value that the payload lacks.  A payload of all 256 values has none and is
    drawn whole.
    """
    samples = np.frombuffer(payload, np.uint8)
    rows = len(samples) // WIDTH
    screen = min(rows, FRAME_ROWS)
    missing = np.flatnonzero(np.bincount(samples, minlength=256) == 0)
    clear = int(missing[-1]) if len(missing) else None
    control = bytes([2 << 2 | (clear is not None)]) + DELAY.to_bytes(2, "little") + bytes([clear or 0, 0])
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), screen.to_bytes(2, "little"), bytes([0xF7, 0, 0]), _GREY]
    for top in range(0, rows, FRAME_ROWS):
        part = samples[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        if clear is not None:
            part = np.where(part == 0, np.uint8(clear), part)
        out.append(b"\x21\xf9\x04" + control)
        out.append(b"\x2c\x00\x00\x00\x00" + WIDTH.to_bytes(2, "little") + (len(part) // WIDTH).to_bytes(2, "little") + b"\x00\x08")
        stream = lzw_encode(part.tobytes())
        out += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        out.append(b"\x00")
    out.append(b"\x3b")
    return b"".join(out)


def padded(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of WIDTH."""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def histogram(frame: Frame) -> np.ndarray:
    """Samples of the frame's own area by channel and eighth of the range: 24 counts."""
    drawn = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width]
    grey = drawn[..., 0]
    if (drawn[..., 1] == grey).all() and (drawn[..., 2] == grey).all():
        return np.tile(np.bincount(grey.ravel() >> 5, minlength=HISTOGRAM_BINS), 3)
    return np.concatenate([np.bincount(drawn[..., c].ravel() >> 5, minlength=HISTOGRAM_BINS) for c in range(3)])


# --- frames as rows --------------------------------------------------------------------------

FRAMES = "media_id long, frame int, start_ms long, delay_ms int, width int, height int, disposal int, samples binary, histogram array<long>, error string"


def timed_frames(data: bytes) -> Iterator[tuple[int, int, Frame, np.ndarray, np.ndarray]]:
    """(number, start in ms, frame, what its area shows, colour histogram) of each frame."""
    start = 0
    for k, f in enumerate(decoded(data)):
        yield k, start, f, f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, :3], histogram(f)
        start += f.delay_ms


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FRAMES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            key, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            try:
                for k, start, f, drawn, colours in timed_frames(data or b""):
                    yield batch_of([(key, k, start, f.delay_ms, f.width, f.height, f.disposal, drawn.tobytes(), colours.tolist(), None)])
            except GifError as e:
                yield batch_of([(key, None, None, None, None, None, None, None, None, str(e))])


def frames(media: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """A row for each frame of each GIF: its time, drawn samples (RGB) and colour histogram.

    Bytes that are null or no whole GIF give a row with ``error`` after the frames that
    could be read.  A GIF without frames gives no row.  Other columns are not read.
    """
    return media.select(F.col(id_col).cast("long").alias("media_id"), F.col(data_col).alias("data")).mapInArrow(_frames, FRAMES)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = utf8_arrays(pc.fill_null(batch.column(1), ""))
        whole, edge, ids = raw.tobytes(), at.tolist(), batch.column(0)
        for lo in range(0, len(ids), 500):
            media = [encode_payload(padded(whole[a:b])) for a, b in zip(edge[lo : lo + 500], edge[lo + 1 : lo + 501], strict=False)]
            n = np.diff(at[lo : lo + len(media) + 1])
            yield pa.RecordBatch.from_arrays([ids.slice(lo, len(media)), pa.array(n), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column(2):
            data = media.as_py()
            parts, total, shown = [], np.zeros(HISTOGRAM_BINS, np.int64), 0
            # a palette may map samples to any colour, so what is read back is what is drawn
            for k, start, f, drawn, colours in timed_frames(data):
                parts.append(drawn[..., 0].tobytes())
                total += colours[:HISTOGRAM_BINS]
                shown = start + f.delay_ms
            payload = b"".join(parts)
            feature = f"{k + 1}f{shown}ms:" + ",".join(map(str, total.tolist()))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a GIF, written to the shared folder and read from it.

    Null and empty texts are one row of samples 0.  Ids may be null or repeated; each row
    stands for itself, and equal texts have equal media.  A text of any length is stored
    whole, in as many frames as it needs.  Other columns are not read; no rows: no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(texts.mapInArrow(_stored, "doc_id long, n_bytes long, media binary"), "media")


def media_digest(media: DataFrame) -> DataFrame:
    """The digest of stored texts, from decoding their bytes."""
    return media.mapInArrow(_read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty; every text has at least one row of samples."""
    return media_digest(stored_texts(read_table(spark, sf_dir, "documents")))
