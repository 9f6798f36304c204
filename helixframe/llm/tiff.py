"""TIFF: pages of a file by its image directories, and a writer for 8-bit grey pages.

The reader walks the chain of directories in either byte order, decodes
uncompressed, PackBits, LZW and deflate strips or tiles, undoes horizontal
differencing, and yields one page a directory. Pages are arrays of
(height, width, samples) with 8 or 16 bits a sample (1 bit unpacked to 0/1).

Edge cases of ``tiff_pages``: null or empty content gives no rows; a file that
is no TIFF, or a page that can't be decoded, whatever the reason, gives one row with
``error`` set (and page -1 if no directory was reached); sizes are held against what the
blocks' bytes can decode to before memory is taken; a chain that loops ends where it
meets itself. Repeated rows give repeated pages; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: field types with their sizes and struct codes.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_SIZE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
#: Bytes that one byte can decode to at most.
MOST = {NONE: 1, LZW: 4096, ADOBE_DEFLATE: 1040, DEFLATE: 1040, PACKBITS: 128}


class TiffError(ValueError):
    pass


class Page(NamedTuple):
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def unpack_bits(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += 2 + head
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2
        else:
            at += 1
    return b"".join(out)


RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def plain(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in RUN.finditer(data):
        plain(m.start())
        out.extend((257 - len(m[0]), m[0][0]))
        at = m.end()
    plain(len(data))
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; the width grows one code early."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last, out = list(first), 9, b"", []
    held = have = 0
    for byte in data:
        held, have = (held << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code, held = held >> have, held & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            got = table[code]
        elif code == len(table) and last:
            got = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(got)
        if last:
            table.append(last + got[:1])
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        last = got
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    bits, n, out = 256, 9, bytearray()  # starts with the clear code
    table, width, word = {bytes((i,)): i for i in range(256)}, 9, b""
    size = 258

    def put(code: int) -> None:
        nonlocal bits, n, out
        bits, n = (bits << width) | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n)
            bits &= (1 << n) - 1

    for byte in data:
        longer = word + bytes((byte,))
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size >= 4094:
            put(256)
            table, width, size = {bytes((i,)): i for i in range(256)}, 9, 258
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = bytes((byte,))
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if n:
        out.append((bits << (8 - n)) & 255)
    return bytes(out)


def _decode(data: bytes, how: int, most: int) -> bytes:
    """The block's bytes; of deflate no more than ``most``."""
    if how == NONE:
        return data
    if how in (ADOBE_DEFLATE, DEFLATE):
        return zlib.decompressobj().decompress(data, max(most, 1))
    if how == PACKBITS:
        return unpack_bits(data)
    if how == LZW:
        return lzw_decode(data)
    raise TiffError(f"compression {how}")


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The byte order and tags of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    at, met = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in met:
        met.add(at)
        if at + 2 > len(data):
            raise TiffError("directory outside the file")
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            if at + 14 + 12 * k > len(data):
                raise TiffError("directory outside the file")
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            size, code = TYPES[kind]
            spot = at + 10 + 12 * k
            if size * count > 4:
                spot = struct.unpack_from(order + "I", data, spot)[0]
            if spot + size * count > len(data):
                raise TiffError("value outside the file")
            tags[tag] = struct.unpack_from(order + code * count if len(code) > 1 else f"{order}{count}{code}", data, spot)
        yield order, tags
        end = at + 2 + 12 * n
        at = struct.unpack_from(order + "I", data, end)[0] if end + 4 <= len(data) else 0


def page_of(data: bytes, order: str, tags: dict[int, tuple]) -> Page:
    def one(tag: int, default: int) -> int:
        value = tags.get(tag, (default,))
        if not value or not isinstance(value[0], int) or value[0] < 0:
            raise TiffError(f"tag {tag} is no number")
        return value[0]

    if WIDTH not in tags or HEIGHT not in tags:
        raise TiffError("no size")
    w, h, how, predictor, per = one(WIDTH, 0), one(HEIGHT, 0), one(COMPRESSION, 1), one(PREDICTOR, 1), one(SAMPLES, 1)
    bits = one(BITS, 1)
    if bits not in (1, 8, 16) or predictor not in (1, 2) or (bits == 1 and per != 1):
        raise TiffError(f"{bits} bits, predictor {predictor}")
    if not (w and h and per) or how not in MOST:
        raise TiffError(f"{w} x {h} x {per} samples, compression {how}")
    planar = one(PLANAR, 1) == 2 and per > 1
    tiled = TILE_AT in tags
    bw, bh = (one(TILE_W, w), one(TILE_H, h)) if tiled else (w, min(one(STRIP_ROWS, h), h) or h)
    at, sizes = (tags.get(TILE_AT, ()), tags.get(TILE_SIZE, ())) if tiled else (tags.get(STRIP_AT, ()), tags.get(STRIP_SIZE, ()))
    if not sizes and len(at) == 1:
        sizes = (len(data) - at[0],)
    if not (bw and bh) or not all(isinstance(x, int) for x in (*at, *sizes)):
        raise TiffError("blocks without size")
    across, down = -(-w // bw) if bw else 0, -(-h // bh) if bh else 0
    planes, inner = (per, 1) if planar else (1, per)
    if min(len(at), len(sizes)) < across * down * planes:
        raise TiffError("blocks are missing")
    stored = sum(max(0, min(n, len(data) - k)) for k, n in zip(at, sizes))
    if w * h * per * bits // 8 > stored * MOST[how] or bw * bh > 16 * stored * MOST[how] * 8:
        raise TiffError("blocks are too short for the page's size")
    kind = np.dtype("u1") if bits < 16 else np.dtype(order + "u2")
    out = np.zeros((h, w, per), kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * bh, cell % across * bw
        rows = bh if tiled else min(bh, h - y)
        width = -(-bw // 8) if bits == 1 else bw * inner * kind.itemsize
        raw = _decode(data[at[k] : at[k] + sizes[k]], how, rows * width)
        if len(raw) < rows * width:
            raise TiffError("a block is too short")
        block = np.frombuffer(raw, "u1", rows * width).reshape(rows, width)
        if bits == 1:
            block = np.unpackbits(block, axis=1)[:, :bw].reshape(rows, bw, 1)
        else:
            block = np.frombuffer(block.tobytes(), kind).reshape(rows, bw, inner)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=out.dtype)
        part = block[: h - y, : w - x]
        into = out[y : y + part.shape[0], x : x + part.shape[1]]
        if planar:
            into[:, :, plane] = part[:, :, 0]
        else:
            into[...] = part
    return Page(w, h, per, bits, how, predictor, tiled, out)


def read_tiff(data: bytes) -> Iterator[Page]:
    for order, tags in directories(data):
        yield page_of(data, order, tags)


def write_tiff(pages: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 1, tile: int = 0, strip_rows: int = 1024, order: str = "<") -> bytes:
    """Pages of (height, width) or (height, width, samples) uint8 or uint16 as one file."""
    pack = {NONE: bytes, LZW: lzw_encode, PACKBITS: pack_bits}.get(compression, lambda b: zlib.compress(b, 1))
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        h, w, per = page.shape
        bw, bh = (tile, tile) if tile else (w, strip_rows)
        at, sizes = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                part = page[y : y + bh, x : x + bw]
                if tile:
                    full = np.zeros((bh, bw, per), page.dtype)
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                code = pack(part.astype(page.dtype.newbyteorder(order)).tobytes())
                at.append(len(out))
                sizes.append(len(code))
                out += code + b"\0" * (len(code) & 1)
        tags = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8 * page.dtype.itemsize] * per), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1 if per < 3 else 2]), SAMPLES: (3, [per]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_W: (3, [tile]), TILE_H: (3, [tile]), TILE_AT: (4, at), TILE_SIZE: (4, sizes)} if tile else {STRIP_AT: (4, at), STRIP_ROWS: (4, [strip_rows]), STRIP_SIZE: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            size, code = TYPES[kind]
            body = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(body) > 4:
                spot = len(out)
                out += body + b"\0" * (len(body) & 1)
                body = struct.pack(order + "I", spot)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), *((n, pa.int32()) for n in ("page", "width", "height", "samples", "bits", "compression", "predictor")), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])
    for batch in batches:
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not (data := data.as_py()):
                continue
            rows, k = [], -1
            try:
                for k, (order, tags) in enumerate(directories(data)):
                    try:
                        p = page_of(data, order, tags)
                        rows.append((doc, k, *p[:7], p.pixels.tobytes(), None))
                    except Exception as e:  # noqa: BLE001  whatever bytes do, the file's other pages and other files go on
                        rows.append((doc, k, *[None] * 8, f"{type(e).__name__}: {e}"))
            except Exception as e:  # noqa: BLE001
                rows.append((doc, k + 1 if rows else -1, *[None] * 8, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def tiff_pages(files: DataFrame, id_col: str, content: str) -> DataFrame:
    """One row a page: (id, page, width, height, samples, bits, compression, predictor, tiled, pixels, error)."""
    return files.select(F.col(id_col).cast("long").alias("id"), F.col(content).alias("content")).mapInArrow(_pages, f"id long, {PAGES}")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


#: How a payload is stored, by its checksum modulo their number: all that the reader decodes comes up.
FORMS = (
    {"compression": LZW},
    {"compression": PACKBITS},
    {"compression": PACKBITS, "tile": 64, "order": ">"},
    {"compression": ADOBE_DEFLATE, "predictor": 2},
    {"compression": ADOBE_DEFLATE, "tile": 64},
    {"compression": DEFLATE, "order": ">"},
    {"compression": ADOBE_DEFLATE},
    {"compression": NONE, "predictor": 2, "tile": 32},
)


def store(payload: bytes, page_rows: int = 16384) -> bytes:
    """Rows of 64 grey samples, ``page_rows`` a page, in one of FORMS."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    return write_tiff([grid[y : y + page_rows] for y in range(0, len(grid), page_rows)], **FORMS[zlib.crc32(payload) % len(FORMS)])


def feature_of(pages: list[Page]) -> str:
    flat = np.concatenate([p.pixels.reshape(-1) for p in pages])
    hist = np.bincount(flat, minlength=256)
    return f"pages={len(pages)};rows={sum(p.height for p in pages)};sum={int(hist @ np.arange(256))};high={int(hist[128:].sum())};zero={int(hist[0])};distinct={int((hist > 0).sum())};mode={int(hist.argmax())}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                n, payload = payload_of(text)
                media = store(payload)
                pages = list(read_tiff(media))
                back = b"".join(p.pixels.tobytes() for p in pages)
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pages)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def stored_texts(docs: DataFrame) -> DataFrame:
    """Each text as a TIFF, read back: what was stored and what came out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
