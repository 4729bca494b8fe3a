"""Media columns: TIFF files in a binary column, one row per page.

The reader walks the chain of image directories (either byte order), decodes strips or
tiles that are stored plainly or packed by PackBits, LZW or deflate, undoes horizontal
differencing, and yields each page's samples (8 or 16 bits, in one plane or several). The writer stores bytes as 8-bit grey pages
for lossless round trips.

Edge cases: null and empty media give one row without pixels and with a message in
`error`; so do broken files, whose good pages before the break are still given; repeated
rows are read alike; texts of any length are stored whole; ties do not arise; ids may be null
or of any type; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm.columns import column

# Fixed values of the format: tag numbers, value sizes by type, and compression codes.
WIDTH, HEIGHT, BITS_PER_SAMPLE, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPE_CODES = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

ROW = 192
PAGE_ROWS = 4096
STRIP_ROWS = 256


@dataclass
class Page:
    """One decoded image directory; pixels are rows of interleaved samples."""

    number: int
    width: int
    height: int
    samples: int
    compression: int
    pixels: bytes


def unpack_packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; widths grow one code early."""
    out, buffer, bits, at = bytearray(), 0, 0, 0
    table: list[bytes] = []
    last, width = b"", 9
    while True:
        while bits < width and at < len(data):
            buffer, bits, at = (buffer << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        if bits < width:
            return bytes(out)
        bits -= width
        code = buffer >> bits & ((1 << width) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise ValueError("LZW data without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def pack_lzw(data: bytes) -> bytes:
    out, buffer, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal buffer, bits
        buffer, bits = buffer << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(buffer >> bits & 255)
        buffer &= (1 << bits) - 1

    put(256)
    table, word = {bytes([i]): i for i in range(256)}, b""
    free = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = free
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        if free == 4094:
            put(256)
            table, free, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    put(257)
    if bits:
        out.append(buffer << (8 - bits) & 255)
    return bytes(out)


#: Samples of one page at most; a file may claim any number.
MOST_SAMPLES = 1 << 30
PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_packbits}
UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_packbits}


def _directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    seen = set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("broken chain of directories")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 6 + 12 * n > len(data):
            raise ValueError("directory beyond the end")
        tags = {}
        for i in range(n):
            entry = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind not in TYPE_CODES:
                continue
            form = f"{order}{count}{TYPE_CODES[kind]}"
            where = entry + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if where + struct.calcsize(form) > len(data):
                raise ValueError("value beyond the end")
            tags[tag] = list(struct.unpack_from(form, data, where))
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _unpacked(data: bytes, packing: int, size: int) -> bytes:
    """The first `size` bytes of packed data; no more are made of deflate, and other packings
    are at most a few thousand times smaller."""
    if packing in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    return UNPACK[packing](data)


def _cell(data: bytes, place: tuple[int, int], packing: int, predictor: int, kind: np.dtype, shape: tuple[int, int, int]) -> np.ndarray:
    at, size = place
    n = int(np.prod(shape))
    cell = np.frombuffer(_unpacked(data[at : at + size], packing, n * kind.itemsize)[: n * kind.itemsize], np.uint8)
    if len(cell) < n * kind.itemsize:
        raise ValueError("too few samples")
    cell = cell.view(kind).reshape(shape).astype(kind.newbyteorder("<"))
    return np.cumsum(cell, axis=1, dtype=cell.dtype) if predictor == 2 else cell


def _plane(data: bytes, tags: dict[int, list[int]], nth: int, packing: int, predictor: int, kind: np.dtype, size: tuple[int, int, int]) -> np.ndarray:
    """The nth plane of a page: all strips or tiles of one plane in order."""
    height, width, samples = size
    tiled = TILE_OFFSETS in tags
    places = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True))
    if tiled:
        tw, th = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        if not 0 < tw <= MOST_SAMPLES or not 0 < th <= MOST_SAMPLES or tw * th * samples > MOST_SAMPLES:
            raise ValueError("tile too large")
        across, down = -(-width // tw), -(-height // th)
        if across * tw * down * th * samples > MOST_SAMPLES:
            raise ValueError("page too large")
        page = np.zeros((down * th, across * tw, samples), kind.newbyteorder("<"))
        for i, place in enumerate(places[nth * across * down : (nth + 1) * across * down]):
            y, x = i // across * th, i % across * tw
            page[y : y + th, x : x + tw] = _cell(data, place, packing, predictor, kind, (th, tw, samples))
        return page[:height, :width]
    per = min(tags.get(ROWS_PER_STRIP, [height])[0], height) or 1
    down = -(-height // per)
    if len(places) < (nth + 1) * down:
        raise ValueError("too few strips")
    cells = [_cell(data, place, packing, predictor, kind, (min(per, height - i * per), width, samples)) for i, place in enumerate(places[nth * down : (nth + 1) * down])]
    return np.concatenate(cells) if cells else np.zeros((0, width, samples), kind.newbyteorder("<"))


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in order; raises ValueError where the file breaks.

    Samples have 8 or 16 bits (pixels then are little-endian), in one plane or in one for each
    sample; a page has at most MOST_SAMPLES.
    """
    order = "<" if data[:2] == b"II" else ">"
    for number, tags in enumerate(_directories(data)):
        if any(not values for values in tags.values()):
            raise ValueError("a tag without values")
        one = lambda tag, default, tags=tags: tags.get(tag, [default])[0]
        width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        packing, predictor, planes = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
        bits = set(tags.get(BITS_PER_SAMPLE, [8]))
        if packing not in UNPACK or predictor not in (1, 2) or bits not in ({8}, {16}) or planes not in (1, 2):
            raise ValueError("unsupported kind of page")
        if width * height * samples > MOST_SAMPLES:
            raise ValueError("page too large")
        kind = np.dtype(np.uint8) if bits == {8} else np.dtype(order + "u2")
        try:
            if planes == 2:
                page = np.concatenate([_plane(data, tags, k, packing, predictor, kind, (height, width, 1)) for k in range(samples)], axis=2)
            else:
                page = _plane(data, tags, 0, packing, predictor, kind, (height, width, samples))
        except (zlib.error, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError) as e:
            raise ValueError(f"broken page: {e}") from e
        yield Page(number, width, height, samples, packing, page.tobytes())


def write_pages(payload: bytes, width: int = ROW, page_rows: int = PAGE_ROWS, packing: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Grey pages of the given width that hold the payload row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        cells = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        if tile:
            tw, th = tile
            full = np.zeros((-(-len(page) // th) * th, -(-width // tw) * tw), np.uint8)
            full[: len(page), :width] = page
            cells = [full[y : y + th, x : x + tw] for y in range(0, len(full), th) for x in range(0, full.shape[1], tw)]
        offsets, sizes = [], []
        for cell in cells:
            if predictor == 2:
                cell = np.diff(cell, axis=1, prepend=np.zeros((len(cell), 1), np.uint8))
            packed = PACK[packing](cell.tobytes())
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed
        tags = {WIDTH: [width], HEIGHT: [len(page)], BITS_PER_SAMPLE: [8], COMPRESSION: [packing], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile[0]], TILE_HEIGHT: [tile[1]], TILE_OFFSETS: offsets, TILE_COUNTS: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [strip_rows], STRIP_COUNTS: sizes}
        out += b"\0" * (len(out) % 2)
        places = {}
        for tag, values in tags.items():
            if len(values) > 1:
                places[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for tag, values in sorted(tags.items()):
            out += struct.pack(order + "HHII", tag, 4, len(values), places.get(tag, values[0]))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def tiff_pages(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, page, width, height, samples, compression, pixels, error: one row per page."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, data, rows, error = batch.column(0).slice(i, 1), batch.column(1)[i].as_py() or b"", [], None
                try:
                    for p in read_pages(data):
                        rows.append((p.number, p.width, p.height, p.samples, p.compression, p.pixels, None))
                except (ValueError, struct.error) as e:
                    error = str(e)
                if error or not rows:
                    rows.append((len(rows), None, None, None, None, None, error or "no pages"))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] * 5 + [pa.binary(), pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([key] * len(rows)), *columns], names=["id", "page", "width", "height", "samples", "compression", "pixels", "error"])

    schema = f"id {kind}, page int, width int, height int, samples int, compression int, pixels binary, error string"
    return media.select(column(id_col).alias("id"), column(media_col).cast("binary").alias("media")).mapInArrow(run, schema)


def feature(pages: list[Page]) -> str:
    """Pages, samples, their sum, a 16-bin histogram and the mean step between neighbours."""
    grey = np.frombuffer(b"".join(p.pixels for p in pages), np.uint8)
    count = np.bincount(grey >> 4, minlength=16)
    step = np.abs(np.diff(grey.astype(np.int16))).sum()
    return f"{len(pages)}:{len(grey)}:{int(grey.sum(dtype=np.int64))}:{int(step)}:" + ",".join(map(str, count))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a file, read the file back, and describe what was read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = (value.as_py() or "").encode()
                payload = text + b" " * (-len(text) % ROW or (0 if text else ROW))
                media = write_pages(payload)
                pages = list(read_pages(media))
                back = b"".join(p.pixels for p in pages)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages), len(pages)))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    return docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text")).mapInArrow(run, schema)


QUERY = "op7_tiff_pages"


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
