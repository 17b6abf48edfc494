"""TIFF 6.0 files: a writer for 8-bit greyscale pages and a reader of image directories.

The reader walks the chain of image directories of either byte order, decodes strips or tiles that are stored plain or
by PackBits, LZW or deflate, undoes the horizontal predictor, and gives one page per directory. Damaged files give the
pages before the damage and an error text, never a crash of the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, release_worker_cache

PLAIN, LZW, DEFLATE_OLD, DEFLATE, PACKBITS = 1, 5, 32946, 8, 32773
#: Field types of the format: struct code and bytes.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
#: Bounds on what a damaged header may make the reader allocate.
MAX_PIXELS = 1 << 28


def packbits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = i + 1
        while run < n and run - i < 128 and data[run] == data[i]:
            run += 1
        if run - i >= 3:
            out += bytes((257 - (run - i), data[i]))
            i = run
            continue
        end = i
        while end < n and end - i < 128 and not (end + 2 < n and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out += bytes((end - i - 1,)) + data[i:end]
        i = end
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        code = data[i]
        if code < 128:
            out += data[i + 1 : i + 2 + code]
            i += code + 2
        else:
            if code > 128:
                out += data[i + 1 : i + 2] * (257 - code)
            i += 2 if code > 128 else 1
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes of 9 to 12 bits, width raised one code early."""
    table: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    acc, bits, width, out, word = 256, 9, 9, bytearray(), b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        acc, bits = acc << width | table[word], bits + width
        table[longer] = len(table) + 2  # two codes are not strings
        if len(table) + 2 >= 4095:
            acc, bits, table, width = acc << width | 256, bits + width, {bytes((k,)): k for k in range(256)}, 9
        elif len(table) + 2 >= (1 << width):
            width += 1
        word = data[i : i + 1]
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1
    if word:
        acc, bits = acc << width | table[word], bits + width
        if len(table) + 3 >= (1 << width) and width < 12:
            width += 1
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) // 8, "big")


def unlzw(data: bytes, size: int) -> bytes:
    out, acc, bits, at, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    last = b""
    while len(out) < size:
        while bits < width:
            if at >= len(data):
                return bytes(out[:size])
            acc, bits, at = acc << 8 | data[at], bits + 8, at + 1
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            last = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            last = word
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out += last
    return bytes(out[:size])


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: bool = True, rows_per_strip: int = 256, tile: int = 0) -> bytes:
    """A little-endian file of 8-bit greyscale pages, in strips or, with ``tile`` (a multiple of 16), in square tiles."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    pack = {PLAIN: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 6)}[compression]
    for page in pages:
        height, width = page.shape
        parts = []
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    part = np.zeros((tile, tile), np.uint8)
                    cut = page[y : y + tile, x : x + tile]
                    part[: cut.shape[0], : cut.shape[1]] = cut
                    parts.append(part)
        else:
            parts = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for part in parts:
            if predictor:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
            data = pack(np.ascontiguousarray(part).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [8]), 259: (3, [compression]), 262: (3, [1]), 277: (3, [1]), 317: (3, [2 if predictor else 1])}
        if tile:
            tags |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, offsets), 325: (4, counts)}
        else:
            tags |= {273: (4, offsets), 278: (4, [min(rows_per_strip, height)]), 279: (4, counts)}
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            body = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                at = len(out)
                out += body
                body = struct.pack("<I", at)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int
    height: int
    channels: int
    compression: int
    predictor: int
    tags: dict[int, tuple]
    pixels: np.ndarray  # height x width x channels


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count, _ = struct.unpack_from(f"{order}HHII", data, at + 2 + 12 * i)
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = count if code == "s" else count * struct.calcsize(f"={code}")
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * i)[0]
        if place + size > len(data):
            raise ValueError(f"tag {tag} reaches past the end")
        tags[tag] = (data[place : place + size],) if code == "s" else struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, place)
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, order: str, tags: dict[int, tuple], number: int) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, channels, compression, predictor = one(256, 0), one(257, 0), one(277, 1), one(259, 1), one(317, 1)
    depth = one(258, 1)
    if depth not in (8, 16) or one(284, 1) != 1:
        raise ValueError(f"{depth} bits per sample or separate planes are not read")
    if not 0 < width * height * channels <= MAX_PIXELS:
        raise ValueError("no pixels, or too many")
    kind = np.dtype(np.uint8 if depth == 8 else f"{order}u2")
    tiled = 322 in tags
    cell_w, cell_h = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    if not (cell_w and cell_h):
        raise ValueError("no strip or tile size")
    pixels = np.zeros((height, width, channels), kind)
    across = -(-width // cell_w)
    for i, (at, length) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        y, x = i // across * cell_h, i % across * cell_w
        rows = cell_h if tiled else min(cell_h, height - y)
        if rows <= 0:
            break
        size = rows * cell_w * channels * kind.itemsize
        raw = data[at : at + length]
        if compression in (DEFLATE, DEFLATE_OLD):
            raw = zlib.decompressobj().decompress(raw, size)
        elif compression == LZW:
            raw = unlzw(raw, size)
        elif compression == PACKBITS:
            raw = unpackbits(raw, size)
        elif compression != PLAIN:
            raise ValueError(f"compression {compression} is not read")
        if len(raw) < size:
            raise ValueError("a strip or tile is short")
        cell = np.frombuffer(raw[:size], kind).reshape(rows, cell_w, channels)
        if predictor == 2:
            cell = np.cumsum(cell, axis=1, dtype=kind.newbyteorder("="))
        part = pixels[y : y + rows, x : x + cell_w]
        part[...] = cell[: part.shape[0], : part.shape[1]]
    return Page(number, width, height, channels, compression, predictor, tags, pixels)


def read(data: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directories; ValueError or struct.error where the file is damaged."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(f"{order}I", data, 4), set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags, following = _directory(data, order, at)
        yield _page(data, order, tags, len(seen) - 1)
        at = following


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cell means is above its right neighbour's, on a 9 x 8 grid."""
    height, width = pixels.shape[:2]
    grey = pixels.reshape(height, width, -1)
    rows = np.arange(9) * height // 8
    cols = np.arange(10) * width // 9
    sums = np.zeros((height + 1, width + 1), np.int64)
    sums[1:, 1:] = grey.sum(axis=2, dtype=np.int64).cumsum(0).cumsum(1)
    top, bottom = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    bottom = np.minimum(bottom, height)
    top = np.minimum(top, height - 1)
    left, right = np.minimum(cols[:-1], width - 1), np.minimum(np.maximum(cols[1:], cols[:-1] + 1), width)
    total = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
    area = (bottom - top)[:, None] * (right - left)[None, :]
    mean = total / np.maximum(area, 1)
    return f"{int(''.join('1' if b else '0' for b in (mean[:, :-1] > mean[:, 1:]).ravel()), 2):016x}"


_PAGE_DDL = "page int, width int, height int, channels int, compression int, predictor int, pixels binary, pixels_sha256 string, feature string, error string"


def decode_pages(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """One row per page of every file in ``content``: key, page, width, height, channels, compression, predictor, pixels
    (row by row, native order), pixels_sha256, feature (difference hash) and error.

    A null or damaged file gives its readable pages and one row with page null and the error; repeated files are
    decoded as often as they occur. Other columns are not read; an empty table gives no rows. A file's pages are as
    many as its directories; they are sent on one by one.
    """
    bound_batches(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()
    names = [part.strip().split()[0] for part in _PAGE_DDL.split(",")]

    def rows(data: bytes | None) -> Iterator[dict]:
        try:
            for page in read(data or b""):
                raw = page.pixels.astype(page.pixels.dtype.newbyteorder("=")).tobytes()
                yield {"page": page.number, "width": page.width, "height": page.height, "channels": page.channels, "compression": page.compression, "predictor": page.predictor, "pixels": raw, "pixels_sha256": hashlib.sha256(raw).hexdigest(), "feature": difference_hash(page.pixels), "error": None}
        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as found:
            yield dict.fromkeys(names) | {"error": f"{type(found).__name__}: {found}"}

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            types = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "channels": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "pixels": pa.binary()}
            schema = pa.schema([frame.schema.field(0), *((n, types.get(n, pa.string())) for n in names)])
            for name, data in zip(frame.column(0), column(frame, content), strict=True):
                made = list(rows(data))
                columns = {n: pa.array([r[n] for r in made], schema.field(n).type) for n in names}
                yield pa.RecordBatch.from_pydict({schema.names[0]: pa.array([name.as_py()] * len(made), schema.field(0).type), **columns}, schema=schema)

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, {_PAGE_DDL}")


#: Payloads are pages of this width and at most this height; longer ones go on to further pages.
WIDTH, PAGE_ROWS = 64, 4096


def payload(text: str) -> tuple[bytes, int]:
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\0" * (WIDTH - len(data) if not data else -len(data) % WIDTH), len(data)


def store(data: bytes, **options) -> bytes:
    image = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return write([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], **options)


_TEXT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pages", pa.int32())])


def texts_as_tiff(docs: DataFrame) -> DataFrame:
    """Store every whole text as a deflated TIFF with the horizontal predictor, read the bytes back, and describe both.

    Null texts are empty and stored as one row of zeros. Repeated rows give repeated results, other columns are not read,
    and an empty table gives no rows. feature: the difference hash of each page, joined by commas.
    """
    bound_batches(docs.sparkSession)

    def describe(text: str) -> tuple:
        data, size = payload(text)
        media = store(data)
        back, features = bytearray(), []
        for page in read(media):
            back += page.pixels.tobytes()
            features.append(difference_hash(page.pixels))
        return size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(features), len(features)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        for frame in frames:
            made = [describe(text or "") for text in column(frame, "text")]
            columns = list(zip(*made, strict=True)) if made else [[]] * 8
            yield pa.RecordBatch.from_arrays([frame.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_TEXT)[1:], strict=True))], schema=_TEXT)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)
