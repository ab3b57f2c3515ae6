"""Media columns: TIFF files in a binary column, written, walked and decoded on the executors."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of the TIFF format: tag numbers, field types' sizes and codes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, PER_PIXEL, ROWS, STRIP_LEN, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_LEN = 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
SCHEMES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
CLEAR, END = 256, 257
#: Bytes that a byte of a file can stand for in any of the schemes: 1032 in deflate, some 2,700 in LZW.
MOST_GROWTH = 4096

_RUN = re.compile(rb"(.)\1{2,127}", re.S)

#: Schemes and tiles (none: strips) that tiff_from_text deals texts to.
LAYOUTS = (("none", None), ("packbits", None), ("lzw", None), ("deflate", None), ("none", (16, 64)), ("packbits", (16, 64)), ("lzw", (16, 64)), ("deflate", (16, 64)))

PAGE_SCHEMA = "page int, width long, height long, samples_per_pixel int, bits int, compression string, predictor int, samples binary, error string"


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(piece: bytes) -> None:
        for i in range(0, len(piece), 128):
            part = piece[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literal(data[at : run.start()])
        out.append(257 - (run.end() - run.start()))
        out.append(data[run.start()])
        at = run.end()
    literal(data[at:])
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at, size = bytearray(), 0, len(data)
    while at < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _bits(codes: list[int], widths: list[int]) -> bytes:
    """Numbers of the given widths one after another, the most significant bit first."""
    codes, widths = np.array(codes, np.int64), np.array(widths, np.int64)
    ends = np.cumsum(widths)
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(widths.max())):
        has = widths > k
        out[ends[has] - 1 - k] = codes[has] >> k & 1
    return np.packbits(out).tobytes()


def lzw(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits, widened one code early as TIFF has it."""
    codes, widths, table, following, width, prefix = [CLEAR], [9], {}, 258, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        widths.append(width)
        table[key] = following
        following += 1
        if following == 4094:
            codes.append(CLEAR)
            widths.append(width)
            table, following, width = {}, 258, 9
        elif following + 1 > (1 << width):
            width += 1
        prefix = byte
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        following += 1
        if following + 1 > (1 << width) and width < 12:
            width += 1
    return _bits([*codes, END], [*widths, width])


def unlzw(data: bytes) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, table, width, bits, held, last = [], list(first), 9, 0, 0, b""
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of order")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        if len(table) + 1 >= (1 << width) and width < 12:
            width += 1
        last = entry
    return b"".join(out)


_PACK = {"none": bytes, "packbits": packbits, "lzw": lzw, "deflate": lambda data: zlib.compress(data, 6)}


def _unpack(scheme: str, data: bytes, size: int) -> bytes:
    """The first size bytes of a strip or tile; what a file says of itself doesn't let it grow past them by much."""
    if scheme == "deflate":
        return zlib.decompressobj().decompress(data, size)
    return {"none": bytes, "packbits": unpackbits, "lzw": unlzw}[scheme](data)[:size]


def encode(samples: np.ndarray, compression: str = "deflate", predictor: int = 2, rows_per_strip: int = 256, page_rows: int = 4096, tile: tuple[int, int] | None = None) -> bytes:
    """A TIFF file of the rows of an 8-bit grey image, page_rows of them to a page, in strips or in tiles (height, width)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(samples), page_rows):
        page = samples[top : top + page_rows]
        height, width = page.shape
        if tile:
            parts = [np.pad(p, ((0, tile[0] - p.shape[0]), (0, tile[1] - p.shape[1]))) for y in range(0, height, tile[0]) for x in range(0, width, tile[1]) for p in [page[y : y + tile[0], x : x + tile[1]]]]
        else:
            parts = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        at, lengths = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
            packed = _PACK[compression](part.tobytes())
            at.append(len(out))
            lengths.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        shape = [(TILE_WIDTH, [tile[1]]), (TILE_HEIGHT, [tile[0]]), (TILE_AT, at), (TILE_LEN, lengths)] if tile else [(STRIP_AT, at), (ROWS, [rows_per_strip]), (STRIP_LEN, lengths)]
        entries = b""
        fields = sorted([(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [CODES[compression]]), (PHOTOMETRIC, [1]), (PER_PIXEL, [1]), (PREDICTOR, [predictor]), *shape])
        for tag, values in fields:
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                where = struct.pack("<I", len(out))
                out += packed
                packed = where
            entries += struct.pack("<HHI", tag, 4, len(values)) + packed
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    tags = {}
    (count,) = struct.unpack_from(f"{order}H", data, at)
    for i in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        if kind in FIELD:
            form = f"{order}{n}{FIELD[kind]}"
            where = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (where,) = struct.unpack_from(f"{order}I", data, where)
            tags[tag] = struct.unpack_from(form, data, where)
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)[0]


def _page(data: bytes, tags: dict[int, tuple], order: str) -> dict:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, bits, channels = one(WIDTH), one(HEIGHT), one(BITS, 1), one(PER_PIXEL, 1)
    scheme, predictor = SCHEMES.get(one(COMPRESSION, 1)), one(PREDICTOR, 1)
    if scheme is None or bits not in (8, 16, 32) or predictor not in (1, 2) or len(set(tags.get(BITS, (bits,)))) > 1 or one(PLANAR, 1) != 1:
        raise ValueError(f"unsupported: compression {one(COMPRESSION, 1)}, {bits} bits, predictor {predictor}")
    kind = np.dtype(f"u{bits // 8}").newbyteorder(order)
    tiled = TILE_AT in tags
    ats, lengths = tags[TILE_AT if tiled else STRIP_AT], tags[TILE_LEN if tiled else STRIP_LEN]
    if min(width, height, channels) < 1 or width * height * channels * kind.itemsize > MOST_GROWTH * max(1, sum(min(n, len(data)) for n in lengths)):
        raise ValueError(f"{width} x {height} x {channels} samples can't be in {len(data)} bytes")
    image = np.zeros((height, width, channels), kind)
    down, across = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS, height), height), width)
    if min(down, across) < 1 or -(-height // down) * -(-width // across) != len(ats):
        raise ValueError("as many strips or tiles as the size asks for are not there")
    corners = [(y, x) for y in range(0, height, down) for x in range(0, width, across)]
    for (y, x), at, n in zip(corners, ats, lengths, strict=True):
        rows = down if tiled else min(down, height - y)
        raw = _unpack(scheme, data[at : at + n], rows * across * channels * kind.itemsize)
        part = np.frombuffer(raw, kind).reshape(rows, across, channels)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        image[y : y + rows, x : x + across] = part[: height - y, : width - x]
    return {"width": width, "height": height, "samples_per_pixel": channels, "bits": bits, "compression": scheme, "predictor": predictor, "samples": image.tobytes(), "error": None}


def decode(data: bytes | None) -> Iterator[dict]:
    """The pages of a TIFF file in the order of its directories; what can't be read ends in a page that has only an error."""
    page = 0
    try:
        if data is None or data[:4] not in (b"II*\0", b"MM\0*"):
            raise ValueError("not a TIFF file")
        order = "<" if data[:1] == b"I" else ">"
        (at,), seen = struct.unpack_from(f"{order}I", data, 4), set()
        while at:
            if at in seen:
                raise ValueError("directories form a ring")
            seen.add(at)
            tags, at = _directory(data, at, order)
            yield {"page": page} | _page(data, tags, order)
            page += 1
    except (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error) as e:
        yield dict.fromkeys(("width", "height", "samples_per_pixel", "bits", "compression", "predictor", "samples")) | {"page": page, "error": str(e) or type(e).__name__}


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of each TIFF in media_col: page, size, layout and samples (row by row, in the file's byte order).

    A null, a broken or an unsupported file gives one row whose error says why, after the pages before the fault.
    Repeated rows give repeated pages; an empty table gives none. Other columns of df are not read.
    """
    schema = pa.schema([("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples_per_pixel", pa.int32()), ("bits", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("samples", pa.binary()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                for page in decode(data.as_py()):
                    row = pa.RecordBatch.from_pylist([page], schema)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *row.columns], names=["id", *schema.names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(read, f"id {kind}, {PAGE_SCHEMA}").withColumnRenamed("id", id_col)


def _feature(pages: list[dict], samples: np.ndarray) -> str:
    histogram = np.bincount(samples >> 5, minlength=8)
    return f"pages={len(pages)};size={pages[0]['width']}x{sum(p['height'] for p in pages)};scheme={pages[0]['compression']};mean={samples.mean():.4f};std={samples.std():.4f};histogram={','.join(map(str, histogram))}"


def tiff_from_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 576, fill: int = 255) -> DataFrame:
    """Each text's UTF-8 bytes, filled up to whole rows of width, as one TIFF: (id, n_bytes, media).

    The layout follows the payload's checksum, so that a column holds each of LAYOUTS alike often, all with horizontal
    differencing. A null text counts as empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            lengths, files = [], []
            for text in batch.column(1).to_pylist():
                n = len(text)
                payload = text + bytes((fill,)) * (max(width, -(-n // width) * width) - n)
                scheme, tile = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
                lengths.append(n)
                files.append(encode(np.frombuffer(payload, np.uint8).reshape(-1, width), scheme, tile=tile))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(write, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def tiff_digests(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per file of tiff_from_text, over its decoded pages together: sizes, digests and a feature string."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows = []
            for data in batch.column(2).to_pylist():
                pages = list(decode(data))
                if pages[-1]["error"]:
                    raise ValueError(pages[-1]["error"])
                payload = b"".join(p["samples"] for p in pages)
                rows.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": _feature(pages, np.frombuffer(payload, np.uint8))})
            table = pa.RecordBatch.from_pylist(rows, pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *table.columns], names=["id", "n_bytes", *table.schema.names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media")).mapInArrow(read, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
