import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import tiff


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"a" * 200, b"ab", b"\0", b"xyz" * 90])).map(b"".join))
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_grows_to_twelve_bits_and_clears():
    data = np.random.default_rng(1).integers(0, 256, 60_000, np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("layout", [{}, {"tile": 16}, {"order": ">"}, {"width": 20, "tile": 32, "order": ">"}])
def test_files_round_trip(compression, predictor, layout):
    width = layout.get("width", 64)
    payload = np.random.default_rng(3).integers(0, 9, width * 130, np.uint8).tobytes()
    data = tiff.write(payload, page_rows=50, strip_rows=7, compression=compression, predictor=predictor, **layout)
    rows = tiff.read_pages(data)
    assert [(r["page"], r["width"], r["height"], r["error"]) for r in rows] == [(0, width, 50, None), (1, width, 50, None), (2, width, 30, None)]
    assert b"".join(r["pixels"] for r in rows) == payload


def test_sixteen_bit_colour_with_predictor():
    image = np.random.default_rng(5).integers(0, 65536, (6, 5, 3)).astype("<u2")
    steps = image.copy()
    steps[:, 1:] = image[:, 1:] - image[:, :-1]
    packed = zlib.compress(steps.tobytes())
    tags = [(256, 3, 5), (257, 3, 6), (258, 3, 16), (259, 3, 8), (262, 3, 2), (273, 4, 8), (277, 3, 3), (278, 3, 6), (279, 4, len(packed)), (317, 3, 2)]
    at = 8 + len(packed)
    data = b"II" + struct.pack("<HI", 42, at) + packed + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0\0\0\0"
    (row,) = tiff.read_pages(data)
    assert row["error"] is None and row["pixels"] == image.tobytes()


def test_faults_are_rows():
    good = tiff.write(b"x" * 640, page_rows=5)
    assert tiff.read_pages(None) == []
    for bad in (b"", b"II", b"PK\3\4" * 10, good[:40], good[:-6]):
        assert tiff.read_pages(bad)[-1]["error"]
    looped = bytearray(good)
    first = struct.unpack_from("<I", good, 4)[0]
    n = struct.unpack_from("<H", good, first)[0]
    struct.pack_into("<I", looped, first + 2 + 12 * n, first)
    rows = tiff.read_pages(bytes(looped))
    assert rows[0]["error"] is None and "loop" in rows[-1]["error"]


def test_texts_and_pages(spark):
    texts = [None, "", "é" * 100, "x" * 576, "y" * 200_000, "é" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS tiff")
    made, c = tiff.store(spark, df)
    rows = {r["doc_id"]: r for r in made.collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert rows[i][c]["n_bytes"] == len(raw) and rows[i][c]["payload"] == raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    assert rows[2][c] == rows[5][c]
    media = made.selectExpr("doc_id", f"{c}.media AS media", "7 AS page").unionByName(spark.createDataFrame([(9, None, 7), (10, bytearray(b"no"), 7)], "doc_id long, media binary, page int"))
    pages = tiff.tiff_pages(spark, media).collect()
    assert [len([p for p in pages if p["doc_id"] == i]) for i in (0, 4, 9, 10)] == [1, 3, 0, 1]
    assert [p["error"] is None for p in pages if p["doc_id"] == 10] == [False]
    whole = sorted((p for p in pages if p["doc_id"] == 4), key=lambda p: p["_page"])
    assert b"".join(p["pixels"] for p in whole) == bytes(rows[4][c]["payload"])
    assert tiff.tiff_pages(spark, media.limit(0)).count() == 0


def test_pages_beside_columns_of_their_names(spark):
    media = spark.createDataFrame([(tiff.write(tiff.payload_of("text")), 1, "a", "b", "c")], "media binary, `__pages` int, `__page` string, width string, error string")
    made = tiff.tiff_pages(spark, media)
    assert made.columns[:4] == ["__pages", "__page", "width", "error"] and "_width" in made.columns and "_error" in made.columns
    assert made.first()["__page"] == "a" and made.first()["width"] == "b"
