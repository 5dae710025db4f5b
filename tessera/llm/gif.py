"""Media columns: GIF. LZW code streams, palettes, disposal, transparency, timed frames and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructType

from .common import map_batches

WIDTH, TALLEST = 64, 65535
GREY = bytes(v for i in range(256) for v in (i, i, i))
HEADER = struct.Struct("<6sHHBBB")


@dataclass
class Frame:
    """A frame as stored (indices, rectangle, timing) and as shown (rgba: the canvas after it is drawn)."""

    left: int
    top: int
    indices: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    rgba: np.ndarray | None


def _widths(bits: int, count: int) -> np.ndarray:
    """Bits of the codes after a clear code: they grow as the table does, up to 12."""
    need = (1 << bits) + 2 + np.arange(count)
    return np.clip(np.ceil(np.log2(need)), bits + 1, 12).astype(np.int64)


def compress(data: bytes, bits: int = 8) -> bytes:
    """``data`` as an LZW stream with a growing table, cleared when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, clears = [clear], [0]
    table: dict[int, int] = {}
    get, put, free = table.get, codes.append, end + 1
    now = data[0] if data else -1
    for b in data[1:]:
        key = now << 8 | b
        k = get(key)
        if k is not None:
            now = k
            continue
        put(now)
        now = b
        if free < 4096:
            table[key] = free
            free += 1
        else:
            clears.append(len(codes))
            put(clear)
            table.clear()
            free = end + 1
    if now >= 0:
        put(now)
    put(end)
    width = np.empty(len(codes), np.int64)
    width[0] = bits + 1
    for a, z in zip(clears, [*(c + 1 for c in clears[1:]), len(codes)], strict=True):
        width[a + 1 : z] = _widths(bits, z - a - 1)
    place = np.arange(12)
    flags = (np.array(codes, np.uint16)[:, None] >> place & 1).astype(np.uint8)
    return np.packbits(flags[place < width[:, None]], bitorder="little").tobytes()


#: Codes read from a stream at once.
READ = 4096


def unpack(stream: bytes, bits: int, size: int) -> np.ndarray:
    """The first ``size`` samples of an LZW stream; ValueError if it holds fewer or a code that can't be.

    Codes are cut out READ at a time, their places being known up to the next clear code; then each is looked up in the
    table that grows as they are read.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total, width = len(stream) * 8, _widths(bits, READ)
    table, before, since, at = list(roots), b"", 0, 0
    out: list[bytes] = []
    done = 0
    while done < size:
        own = np.concatenate([width[since:], np.full(since, 12)]) if since else width  # after READ codes all have 12 bits
        place = at + np.cumsum(own) - own
        place = place[place + own <= total]
        if not len(place):
            raise ValueError("LZW stream too short")
        own = own[: len(place)]
        byte = place >> 3
        found = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7).astype(np.uint32) & ((1 << own) - 1).astype(np.uint32)
        marks = np.flatnonzero((found == clear) | (found == end))
        n = int(marks[0]) if len(marks) else len(found)
        codes = found[:n].tolist()
        if codes and not before:
            if codes[0] >= clear:
                raise ValueError("LZW code out of range")
            before = table[codes[0]]
            out.append(before)
            del codes[0]
        grown, room = len(table), 4096 - len(table)
        for code in codes[:room]:
            if code < grown:
                entry = table[code]
                table.append(before + entry[:1])
            elif code == grown:
                entry = before + before[:1]
                table.append(entry)
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            grown += 1
            before = entry
        if len(codes) > room:  # the table is full, and every code of 12 bits is in it
            out += [table[code] for code in codes[room:]]
        done += sum(map(len, out[len(out) - n :]))
        if not len(marks):
            since, at = min(READ, since + n), int(place[-1] + own[-1])
        elif found[n] == end:
            break
        else:
            table, before, since, at = list(roots), b"", 0, int(place[n] + own[n])
    if done < size:
        raise ValueError("LZW stream too short")
    return np.frombuffer(b"".join(out)[:size], np.uint8)


def _blocks(data: bytes) -> bytes:
    full = len(data) // 255
    body = np.frombuffer(data[: full * 255], np.uint8).reshape(full, 255)
    out = np.insert(body, 0, 255, axis=1).tobytes() if full else b""
    rest = data[full * 255 :]
    return out + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(frames: list[np.ndarray], palette: bytes = GREY, delay_cs: int = 10, disposal: int = 1) -> bytes:
    """Frames of palette indices (2-D uint8 arrays) as a GIF."""
    tall, wide = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    out = [HEADER.pack(b"GIF89a", wide, tall, 0xF7, 0, 0), palette.ljust(768, b"\0")]
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, f.shape[1], f.shape[0], 0))
        out += [b"\x08", _blocks(compress(f.tobytes()))]
    return b"".join(out) + b"\x3b"


def _gather(data: bytes, at: int) -> tuple[bytes, int]:
    """Sub-blocks joined, and the place after them."""
    if data[at] == 255:  # long runs of full blocks are cut out at once
        most = (len(data) - at) // 256
        heads = np.frombuffer(data, np.uint8, most * 256, at).reshape(most, 256)
        other = np.flatnonzero(heads[:, 0] != 255)
        full = int(other[0]) if len(other) else most
        parts, at = [heads[:full, 1:].tobytes()], at + full * 256
    else:
        parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode(data: bytes, shown: bool = True) -> list[Frame]:
    """The frames of a GIF; ``shown`` draws the canvas after each, by its transparency and the disposal before it.

    Interlaced rows are put in order. ValueError for anything that isn't a whole GIF.
    """
    try:
        return list(_decode(data, shown))
    except (IndexError, struct.error) as e:
        raise ValueError("GIF cut short") from e


def _decode(data: bytes, shown: bool) -> Iterator[Frame]:
    magic, wide, tall, flags, _, _ = HEADER.unpack_from(data)
    if magic not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    at, common = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        common, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas = np.zeros((tall, wide), np.uint32) if shown else None  # a pixel's four bytes as one number
    delay, disposal, clear = 0, 0, None
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
            _, at = _gather(data, at + 2)
            continue
        if kind != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if bits & 0x80:
            n = 3 << ((bits & 7) + 1)
            palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        if palette is None:
            raise ValueError("GIF frame without a palette")
        root = data[at]
        stream, at = _gather(data, at + 1)
        indices = unpack(stream, root, w * h).reshape(h, w)
        if bits & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        rgba = None
        if canvas is not None:
            saved = canvas.copy() if disposal == 3 else None
            box = canvas[top : top + h, left : left + w]
            cut = indices[: box.shape[0], : box.shape[1]]
            full = np.zeros((256, 4), np.uint8)
            full[: len(palette), :3], full[:, 3] = palette, 255
            colours = full.view(np.uint32).reshape(-1)[cut]
            box[...] = colours if clear is None else np.where(cut == clear, box, colours)
            rgba = canvas.copy().view(np.uint8).reshape(tall, wide, 4)
            if disposal == 2:
                box[:] = 0
            elif saved is not None:
                canvas = saved
        yield Frame(left, top, indices, delay * 10, disposal, clear, palette, rgba)
        delay, disposal, clear = 0, 0, None


def histogram(frame: Frame, bins: int = 4) -> np.ndarray:
    """Counts of the frame's pixels in bins x bins x bins colour cells; transparent pixels don't count."""
    per_index = np.bincount(frame.indices.reshape(-1), minlength=256)[:256]
    if frame.transparent is not None:
        per_index[frame.transparent] = 0
    step = 256 // bins
    cell = (frame.palette // step).astype(np.int64) @ np.array([bins * bins, bins, 1])
    return np.bincount(cell, weights=per_index[: len(cell)], minlength=bins**3).astype(np.int64)


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 if text else 64)


def as_frames(payload: bytes) -> list[np.ndarray]:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return [rows[i : i + TALLEST] for i in range(0, len(rows), TALLEST)]


FRAMES = "doc_id long, frame int, start_ms long, delay_ms int, disposal int, width int, height int, indices binary, rgb binary, histogram array<long>"


def decode_frames(df: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """A row for each frame of the GIFs in ``column``: timing, indices, shown canvas (RGBA bytes in ``rgb``), histogram.

    Null, empty and broken media give no rows. ``key`` becomes doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    frames = decode(data.as_py() or b"")
                except ValueError:
                    continue
                rows, start = [], 0
                for i, f in enumerate(frames):
                    rows.append({"doc_id": k, "frame": i, "start_ms": start, "delay_ms": f.delay_ms, "disposal": f.disposal, "width": f.indices.shape[1], "height": f.indices.shape[0], "indices": f.indices.tobytes(), "rgb": f.rgba.tobytes(), "histogram": histogram(f).tolist()})
                    start += f.delay_ms
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, FRAMES_ARROW)

    return map_batches(df.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{column}` as media"), run, FRAMES)


FRAMES_ARROW = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("indices", pa.binary()), ("rgb", pa.binary()), ("histogram", pa.list_(pa.int64()))])


def encode_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a binary column ``media``: each text's padded UTF-8 bytes as a grey GIF, 64 samples a row.

    A null text counts as empty. Payloads of over 65,535 rows take more frames. An old ``media`` column is replaced.
    """
    df = df.drop("media")
    schema, names = df.schema, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index(text))
            media = [encode(as_frames(payload_of((t.as_py() or "").encode()))) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(media, pa.binary())], [*names, "media"])

    return map_batches(df, run, StructType([*schema.fields]).add("media", BinaryType()))


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op6_gif(spark, sf_dir: str) -> DataFrame:
    """Each whole text through a GIF with a growing LZW table and back, frames drawn, with the digests of the stored form and the colour histogram read from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {n: [] for n in DIGEST.names}
            for doc_id, n, media in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("media"), strict=True):
                media = media.as_py()
                frames = decode(media)
                back = b"".join(f.indices.tobytes() for f in frames)
                colours = sum(histogram(f, 8) for f in frames)
                some = np.flatnonzero(colours)
                feature = f"{frames[0].indices.shape[1]}x{sum(f.indices.shape[0] for f in frames)};frames={len(frames)};ms={sum(f.delay_ms for f in frames)};" + ",".join(f"{i}:{colours[i]}" for i in some.tolist())
                for k, v in zip(DIGEST.names, (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, DIGEST)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text")
    stored = encode_texts(docs).selectExpr("doc_id", "cast(coalesce(octet_length(text), 0) as long) as n", "media")
    return map_batches(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
