"""TIFF media columns: a reader of image directories, one row per page, and a writer for payloads of bytes.

The reader takes both byte orders, strips and tiles, no compression, PackBits, LZW and deflate, the horizontal predictor
for 8- and 16-bit samples, and any number of interleaved samples.  The writer makes 8-bit grey pages.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import annotate, col, fresh, ship

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}

WIDTH = 64
PAD = 576  # bytes: nine rows
PAGE_ROWS = 1152
STRIP_ROWS = 144


class BadTiff(ValueError):
    """The bytes are not a TIFF that this reader takes."""


# Codecs ----------------------------------------------------------------------------------------------------------


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < len(data) and j - i < 128 and not (j + 2 < len(data) and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, table, width, held, bits, last = bytearray(), list(base), 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            now = table[code]
        elif code < len(table):
            now = table[code]
            table.append(last + now[:1])
        elif code == len(table):
            now = last + last[:1]
            table.append(now)
        else:
            raise BadTiff("LZW code out of range")
        out += now
        last = now
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, width = {bytes((i,)): i for i in range(256)}, 9
    fresh_code, word = 258, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for byte in data:
        longer = word + bytes((byte,))
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = fresh_code
        fresh_code += 1
        if fresh_code == 4094:
            put(256)
            table, width, fresh_code = {bytes((i,)): i for i in range(256)}, 9, 258
        elif fresh_code >= 1 << width:
            width += 1
        word = bytes((byte,))
    if word:
        put(table[word])
        fresh_code += 1
        if fresh_code >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _unpack(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from e
    if how == LZW:
        return lzw_decode(data, size)[:size]
    if how == PACKBITS:
        return packbits_decode(data, size)[:size]
    raise BadTiff(f"compression {how}")


def _pack(data: bytes, how: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, 1), OLD_DEFLATE: lambda x: zlib.compress(x, 1), LZW: lzw_encode, PACKBITS: packbits_encode}[how](data)


# Reader ----------------------------------------------------------------------------------------------------------


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    if at + 2 > len(data):
        raise BadTiff("directory beyond the end")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise BadTiff("directory beyond the end")
    tags: dict[int, tuple[int, ...]] = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind not in _SIZES:
            continue
        letter, size = _SIZES[kind]
        place = entry + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        if place + size * count > len(data):
            raise BadTiff("values beyond the end")
        tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _pixels(data: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> tuple[dict, bytes]:
    one = lambda tag, other=None: tags.get(tag, (other,))[0]
    width, height = one(256), one(257)
    if not width or not height:
        raise BadTiff("no size")
    bits, samples, how, predictor = one(258, 1), one(277, 1), one(259, 1), one(317, 1)
    if bits not in (8, 16) or any(b != bits for b in tags.get(258, ())) or one(284, 1) != 1:
        raise BadTiff("only interleaved samples of 8 or 16 bits are read")
    if predictor not in (1, 2):
        raise BadTiff(f"predictor {predictor}")
    depth = bits // 8
    kind = np.dtype(f"{order}u{depth}")
    across, down = (one(322), one(323)) if 322 in tags else (width, min(height, one(278, height) or height))
    offsets, counts = (tags.get(324), tags.get(325)) if 322 in tags else (tags.get(273), tags.get(279))
    if not across or not down or offsets is None:
        raise BadTiff("no strips or tiles")
    wide = -(-width // across)
    if wide * across * -(-height // down) * down * samples * depth > 1 << 31:
        raise BadTiff("too large")
    if len(offsets) < wide * -(-height // down) or counts is not None and len(counts) < len(offsets):
        raise BadTiff("strips or tiles are missing")
    image = np.zeros((height, width, samples), kind)
    for k in range(wide * -(-height // down)):
        y, x = k // wide * down, k % wide * across
        rows = down if 322 in tags else min(down, height - y)
        size = rows * across * samples * depth
        end = offsets[k] + (counts[k] if counts is not None else size)
        raw = _unpack(data[offsets[k] : end], how, size)
        if len(raw) != size:
            raise BadTiff("a strip or tile is short")
        part = np.frombuffer(raw, kind).reshape(rows, across, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        image[y : y + rows, x : x + across] = part[: height - y, : width - x]
    about = {"width": width, "height": height, "bits": bits, "samples": samples, "compression": how, "predictor": predictor}
    return about, image.tobytes()


def pages(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(width, height, bits, samples, compression, predictor) and pixels (rows top down, in the file's byte order)."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadTiff("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise BadTiff("directories form a loop")
        seen.add(at)
        tags, at = _directory(data, order, at)
        yield _pixels(data, order, tags)


# Writer ----------------------------------------------------------------------------------------------------------


def write(payload: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, order: str = "<") -> bytes:
    """payload, whose length is a multiple of width, as 8-bit grey pages of at most page_rows rows.

    tile: the side of square tiles (a multiple of 16) instead of strips.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        height = len(page)
        if tile:
            full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            full[:height, :width] = page
            parts = [full[y : y + tile, x : x + tile] for y in range(0, len(full), tile) for x in range(0, full.shape[1], tile)]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate((part[:, :1], np.diff(part, axis=1)), axis=1)  # wraps, as the samples do
            packed = _pack(np.ascontiguousarray(part).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [8]), 259: (3, [compression]), 262: (3, [1]), 277: (3, [1]), 317: (3, [predictor])}
        tags |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, offsets), 325: (4, counts)} if tile else {273: (4, offsets), 278: (4, [strip_rows]), 279: (4, counts)}
        entries = bytearray()
        for tag, (kind, values) in sorted(tags.items()):
            letter, size = _SIZES[kind]
            raw = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(raw) > 4:
                place = struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
                raw = place
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload_of(text: str | None) -> bytes:
    """The text's UTF-8 bytes, filled with bytes 255 to a positive multiple of PAD."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


# Operators -------------------------------------------------------------------------------------------------------

PAGE = T.StructType([T.StructField(n, T.LongType()) for n in ("page", "width", "height", "bits", "samples", "compression", "predictor")] + [T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())])


def read_pages(data: bytes | None) -> list[dict]:
    """A row per page; pages before a fault are kept, and the fault is a last row with its message in `error`."""
    rows: list[dict] = []
    if data is None:
        return rows
    try:
        for about, pixels in pages(data):
            rows.append(about | {"page": len(rows), "pixels": pixels, "error": None})
    except (BadTiff, struct.error) as e:
        rows.append(dict.fromkeys(PAGE.names) | {"page": len(rows), "error": str(e)})
    return rows


def tiff_pages(spark: SparkSession, media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: the other columns of `media`, and those of PAGE (underscores in front where a name is taken).

    A null value has no pages; bytes that are no TIFF give one row with `error` set; an empty table gives no rows;
    repeated rows give repeated pages.  One value and its decoded pages must fit a worker's memory.
    """
    ship(spark)
    rest = [c for c in media.columns if c != media_col]
    every, one = fresh(media, "__pages"), fresh(media, "__page")
    schema = T.StructType([*(media.schema[c] for c in rest), T.StructField(every, T.ArrayType(PAGE))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                kept = [row.column(k).cast(arrow.field(k).type) for k in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([read_pages(row.column(len(rest))[0].as_py())], type=arrow.field(len(rest)).type)], schema=arrow)

    made = media.select(*map(col, rest), col(media_col)).mapInArrow(run, schema).select(*map(col, rest), F.explode(every).alias(one))
    return made.select(*map(col, rest), *(col(one)[n].alias(fresh(made.drop(one), n)) for n in PAGE.names))


STORED = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("media", T.BinaryType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("feature", T.StringType()),
])


def feature_of(rows: list[dict]) -> str:
    """Pages, rows, distinct grey levels, sum of samples, and sum of absolute steps along rows, of what was read."""
    images = [np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], -1) for r in rows]
    levels = sum((np.bincount(i.ravel(), minlength=256) for i in images), np.zeros(256, np.int64))
    steps = sum(int(np.abs(np.diff(i.astype(np.int16), axis=1)).sum()) for i in images)
    return f"pages={len(rows)};rows={sum(r['height'] for r in rows)};levels={int((levels > 0).sum())};sum={int(levels @ np.arange(256))};steps={steps}"


def store(spark: SparkSession, docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs' columns (`keep`, all by default) and a struct STORED of each text written as a TIFF and read back.

    media: the file; payload: the bytes read back from its pages; n_bytes: those before the filling.  A null text is an
    empty one, which is filled like any other.  Equal texts have equal values.  Long texts have many pages.
    """
    ship(spark)

    def make():
        def kernel(texts):
            out = {n: [] for n in STORED.names}
            for t in texts:
                media = write(payload_of(t))
                rows = read_pages(media)
                if rows[-1]["error"]:
                    raise BadTiff(rows[-1]["error"])
                payload = b"".join(r["pixels"] for r in rows)
                for n, v in zip(STORED.names, (len(payload.rstrip(b"\xff")), media, payload, feature_of(rows)), strict=True):
                    out[n].append(v)
            return out

        return kernel

    name = fresh(docs, "tiff")
    return annotate(docs, text_col, make, STORED, name, keep), name
