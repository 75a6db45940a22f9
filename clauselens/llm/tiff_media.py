"""Media columns in TIFF: writing byte payloads as pages, walking image directories, and one row for each page.

The reader takes little- and big-endian files, strips and tiles, no compression, PackBits, LZW and deflate, the
horizontal predictor, and 8-bit samples in chunky order. The writer stores a payload as grey pages of WIDTH columns
and up to PAGE_ROWS rows, deflated in strips with the horizontal predictor, with no date or other changing tag, so
that equal payloads make equal files.

A null text counts as empty. A payload is never empty: it is filled up with bytes 255 to a positive multiple of the
width. Texts are stored whole, over as many pages as they take; a page's size is bounded, and pages of a document stay
in its partition in order, so that digests need no shuffle. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clauselens.llm.shared import blocks, id_and_text

WIDTH, PAGE_ROWS, STRIP_ROWS = 576, 64, 16

#: Fixed values of the format: tags, field types with their sizes, and compressions.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "offsets": 273, "samples": 277, "rows_per_strip": 278, "counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325}
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table and 257 ends the data."""
    out, held, bits, i, width = [], 0, 0, 0, 9
    table, before = [bytes([b]) for b in range(256)] + [b"", b""], b""
    while True:
        while bits < width and i < len(data):
            held, bits, i = (held << 8 | data[i]) & 0xFFFFFFFF, bits + 8, i + 1
        if bits < width:
            break
        code, bits = held >> (bits - width) & ((1 << width) - 1), bits - width
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        width = min(12, (len(table) + 1).bit_length())
        before = entry
    return b"".join(out)


UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def pages(data: bytes) -> Iterator[np.ndarray]:
    """The samples of each page, as rows of columns (of samples, if a pixel has more than one)."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack_from(f"{order}HI", data, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(f"{order}H", data, at)
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            size = FIELD_SIZES.get(kind, 0) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * k)[0]
            if kind in (1, 3, 4):
                fields[tag] = np.frombuffer(data, f"{order}u{FIELD_SIZES[kind]}", count, place).tolist()
        yield _page(data, fields)
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def _page(data: bytes, fields: dict[int, list[int]]) -> np.ndarray:
    get = lambda name, default=None: fields.get(TAGS[name], default)
    (width,), (height,), samples = get("width"), get("height"), get("samples", [1])[0]
    if set(get("bits", [1])) != {8} or get("planar", [1]) != [1] and samples > 1:
        raise ValueError("only 8-bit samples in chunky order are read")
    tiled = get("tile_offsets") is not None
    across, down = (get("tile_width")[0], get("tile_height")[0]) if tiled else (width, min(height, get("rows_per_strip", [height])[0]))
    out = np.zeros((height, width, samples), "u1")
    columns = -(-width // across)
    unpack, predictor = UNPACK[get("compression", [NONE])[0]], get("predictor", [1])[0]
    if predictor not in (1, 2):
        raise ValueError("only the horizontal predictor is undone")
    for k, (offset, count) in enumerate(zip(get("tile_offsets" if tiled else "offsets"), get("tile_counts" if tiled else "counts"), strict=True)):
        top, left = k // columns * down, k % columns * across
        rows = down if tiled else min(down, height - top)
        part = np.frombuffer(unpack(data[offset : offset + count]), "u1", rows * across * samples).reshape(rows, across, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype="u1")
        out[top : top + rows, left : left + across] = part[: height - top, : width - left]
    return out[:, :, 0] if samples == 1 else out


def tiff(payload: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS) -> bytes:
    """A file of grey pages whose samples, page after page, are the payload, a positive multiple of `width` bytes."""
    image = np.frombuffer(payload, "u1").reshape(-1, width)
    out, link, end = bytearray(b"II*\0\0\0\0\0"), 4, 8
    for first in range(0, len(image), page_rows):
        page = image[first : first + page_rows]
        steps = page.copy()
        steps[:, 1:] -= page[:, :-1]
        strips = [zlib.compress(steps[r : r + strip_rows].tobytes(), 1) for r in range(0, len(page), strip_rows)]
        offsets = [len(out) + sum(map(len, strips[:k])) for k in range(len(strips))]
        out += b"".join(strips) + bytes(sum(map(len, strips)) % 2)
        fields = {"width": [width], "height": [len(page)], "bits": [8], "compression": [DEFLATE], "photometric": [1], "offsets": offsets, "samples": [1], "rows_per_strip": [strip_rows], "counts": [*map(len, strips)], "predictor": [2]}
        places = {}
        for name in ("offsets", "counts"):
            if len(strips) > 1:
                places[name] = len(out)
                out += struct.pack(f"<{len(strips)}I", *fields[name])
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for name, values in fields.items():
            out += struct.pack("<HHII", TAGS[name], 4, len(values), places.get(name, values[0]))
        link, end = len(out), len(out) + 4
        out += bytes(4)
    return bytes(out[:end])


def write_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes of its UTF-8 text and media, a TIFF file of the filled-up text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [(text or "").encode() for text in block.column("text").to_pylist()]
            media = [tiff(text + b"\xff" * ((-len(text)) % WIDTH if text else WIDTH)) for text in texts]
            yield pa.record_batch([block.column("doc_id"), pa.array([*map(len, texts)], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGE_ROW = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, page int, n_pages int, width int, height int, samples binary"
_PAGE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
_PAGE_NAMES = [field.split()[0] for field in PAGE_ROW.split(", ")]


def read_pages(media: DataFrame) -> DataFrame:
    """One row for each page of each file: its number from 0, its size and its samples, row after row.

    A null file has no pages. The pages of a file follow each other in its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media"):
            rows = []
            for doc_id, n_bytes, data in zip(*(c.to_pylist() for c in block.columns), strict=True):
                if data is not None:
                    found, digest = list(pages(data)), hashlib.sha256(data).hexdigest()
                    rows += [(doc_id, n_bytes, len(data), digest, k, len(found), p.shape[1], p.shape[0], p.tobytes()) for k, p in enumerate(found)]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PAGE_TYPES)], _PAGE_NAMES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, PAGE_ROW)


def page_features(pages_: DataFrame) -> DataFrame:
    """Per file the digests of its samples and a feature: shares (in ten-thousandths) of 16 ranges of sample values.

    Folds the rows of `read_pages` as they come; only one page and the running digests are held.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size, tail, counts = None, 0, b"", None
        for batch in batches:
            rows = []
            for doc_id, n_bytes, media_bytes, media_sha, page, n_pages, _, _, samples in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page == 0:
                    sha, size, tail, counts = hashlib.sha256(), 0, b"", np.zeros(16, "i8")
                sha.update(samples)
                size, tail = size + len(samples), (tail + samples[-32:])[-32:]
                counts += np.bincount(np.frombuffer(samples, "u1") >> 4, minlength=16)
                if page == n_pages - 1:
                    feature = ",".join(map(str, (counts * 10_000 // size).tolist()))
                    rows.append((doc_id, n_bytes, size, sha.hexdigest(), zlib.crc32(tail), media_bytes, media_sha, feature))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return pages_.mapInArrow(run, schema)


def op4_tiff_media(docs: DataFrame) -> DataFrame:
    return page_features(read_pages(write_tiff(docs)))
