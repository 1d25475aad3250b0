"""Fewest moves between lists, and pixels of PNG files, against brute force and hand-made files."""

from __future__ import annotations

import struct
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.functions import lists, png
from docflow.sources import files


def done(old, steps):
    now = list(old)
    for step, x, after in steps:
        if step in ("delete", "move"):
            now.remove(x)
        if step in ("insert", "move"):
            now.insert(now.index(after) + 1 if after is not None else 0, x)
    return now


@settings(max_examples=200, deadline=None)
@given(st.permutations(list("abcdefgh")), st.integers(0, 8), st.permutations(list("abcdefghxyz")), st.integers(0, 11))
def test_steps_lead_to_the_list_with_fewest_moves(old, n, new, m):
    old, new = old[:n], new[:m]
    steps = lists.edit_steps(old, new)
    assert done(old, steps) == new
    kept = [old.index(x) for x in new if x in old]
    still = next(k for k in range(len(kept), -1, -1) if any(list(c) == sorted(c) for c in combinations(kept, k)))
    assert [s for s, *_ in steps].count("move") == len(kept) - still


RNG = np.random.default_rng(3)
PIXELS = RNG.integers(0, 256, (7, 5, 3), np.uint8)


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize(("color", "samples"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_filters_and_kinds(kind, color, samples):
    pixels = RNG.integers(0, 256, (6, 9, samples), np.uint8)
    want = pixels[:, :, :3] if samples >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)
    assert (png.decode(png.encode(pixels, kind, color)) == want).all()


def test_each_line_has_a_filter_of_its_own():
    whole = [png.filtered(PIXELS, k) for k in range(5)]
    size = 1 + 15
    lines = b"".join(whole[y % 5][y * size : (y + 1) * size] for y in range(7))
    head = struct.pack(">IIBBBBB", 5, 7, 8, 2, 0, 0, 0)
    data = png.HEAD + png.chunk(b"IHDR", head) + png.chunk(b"IDAT", zlib.compress(lines)[:9]) + png.chunk(b"IDAT", zlib.compress(lines)[9:]) + png.chunk(b"IEND", b"")
    assert (png.decode(data) == PIXELS).all()


def small(depth, color, rows, more=b"", width=None):
    head = struct.pack(">IIBBBBB", width or len(rows[0]) * 8 // depth, len(rows), depth, color, 0, 0, 0)
    return png.HEAD + png.chunk(b"IHDR", head) + more + png.chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + png.chunk(b"IEND", b"")


def test_small_depths_and_palettes():
    assert png.decode(small(1, 0, [[0b10100000]], width=3))[0, :, 0].tolist() == [255, 0, 255]
    assert png.decode(small(2, 0, [[0b00011011]]))[0, :, 1].tolist() == [0, 85, 170, 255]
    palette = png.chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6]))
    assert png.decode(small(4, 3, [[0x10]], palette))[0].tolist() == [[4, 5, 6], [1, 2, 3]]
    assert png.decode(small(16, 0, [[7, 99, 8, 1]], width=2))[0, :, 0].tolist() == [7, 8]
    with pytest.raises(png.Unreadable, match="PALETTE"):
        png.decode(small(4, 3, [[0x20]], palette))


TURNS = {1: "abc def", 2: "cba fed", 3: "fed cba", 4: "def abc", 5: "ad be cf", 6: "da eb fc", 7: "fc eb da", 8: "cf be ad"}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("how", TURNS)
def test_orientations(how, order):
    exif = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "HHHIHH", 1, 0x0112, 3, 1, how, 0)
    pixels = np.array([[[ord(c)] * 3 for c in row] for row in ("abc", "def")], np.uint8)
    shown = png.decode(png.encode(pixels, more=png.chunk(b"eXIf", exif)))
    assert " ".join("".join(map(chr, row[:, 0])) for row in shown) == TURNS[how]


def test_files_that_can_not_be_read(spark):
    good = png.encode(PIXELS)
    twisted = png.HEAD + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 2, 0, 0, 1)) + png.chunk(b"IEND", b"")
    bad = {"NOT_PNG": b"GIF89a", "TRUNCATED": good[:-20], "CHECKSUM": good[:40] + bytes([good[40] ^ 1]) + good[41:], "INTERLACED": twisted, "HEADER": small(3, 0, [[0]]), "DATA": small(8, 0, [[1, 2]], width=3), "FILTER": png.HEAD + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(b"\x05\0")) + png.chunk(b"IEND", b"")}
    for code, data in bad.items():
        with pytest.raises(png.Unreadable, match=code):
            png.decode(data)
    rows = files.normalized_images(spark.createDataFrame([("good", good), ("none", None), *bad.items()], "image_id string, content binary")).collect()
    got = {r["image_id"]: r for r in rows}
    assert (got["good"]["width"], got["good"]["height"], got["good"]["problem"]) == (5, 7, None) and (png.decode(bytes(got["good"]["png"])) == PIXELS).all()
    assert {k: r["problem"] for k, r in got.items() if k != "good"} == {"none": "NOT_PNG"} | {k: k for k in bad}


def test_inlined_functions_have_no_python(spark):
    from docflow.plans import catalog

    plan = catalog.QUERIES["sql_inlined_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("span", [3, 4096])
def test_connections_one_by_one(spark, span):
    import random

    from docflow.operators import service

    rng = random.Random(4)
    rows = [(f"d{k % 3}", "x", k, rng.choice([1, 1, -1])) for k in range(120)]
    want = {}
    for d, _, _, step in rows:
        now, refused = want.get(d, (0, 0))
        want[d] = (now, refused + 1) if step > 0 and now >= 2 else (max(now + step, 0), refused)
    got = {r["device_id"]: (r["open"], r["refused"]) for r in service.connections(spark.createDataFrame(rows, "device_id string, document_id string, seq long, step int"), span=span).collect()}
    assert got == want


def test_topic_of_a_column_is_that_of_a_message(spark):
    from docflow.operators import blocks

    said = ["a SPAN", "inline code", "pre table", "", "nothing", "Row and color"]
    rows = spark.createDataFrame([(m,) for m in said], "m string")
    assert [r[0] for r in rows.select(blocks.advice_topic(rows.m)).collect()] == [blocks.advice(m) for m in said]
