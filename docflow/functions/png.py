"""PNG files to RGB pixels and back, with the five filters of scan lines."""

from __future__ import annotations

import struct
import zlib

import numpy as np

HEAD = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type: grey, RGB, palette, grey and alpha, RGB and alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Pixels of an image at most: what is larger is refused before it is unpacked.
MOST = 1 << 28


class Unreadable(Exception):
    """Why a file can't be read; the message is a code."""


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if not data.startswith(HEAD):
        raise Unreadable("NOT_PNG")
    out, at = [], len(HEAD)
    while at < len(data):
        if at + 12 > len(data):
            raise Unreadable("TRUNCATED")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4:
            raise Unreadable("TRUNCATED")
        if zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            raise Unreadable("CHECKSUM")
        out.append((kind, body))
        at += 12 + size
        if kind == b"IEND":
            return out
    raise Unreadable("TRUNCATED")


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Scan lines (a filter byte and then bytes, ``step`` of which are a pixel) without their filters.

    A byte needs those to its left, above and above left; so all lines go together, each a pixel behind the one above.
    """
    kinds, raw = lines[:, 0], lines[:, 1:]
    if (kinds > 4).any():
        raise Unreadable("FILTER")
    height, width = len(raw), raw.shape[1] // step
    raw = raw.reshape(height, width, step)
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        kind = kinds[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        add = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[y + 1, x + 1] = (raw[y, x] + add) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, width * step)


def orientation(exif: bytes) -> int:
    """The orientation (1 to 8) in the data of an eXIf chunk; 1 where it has none."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None or len(exif) < 8:
        return 1
    at = struct.unpack(order + "I", exif[4:8])[0]
    if at + 2 > len(exif):
        return 1
    for k in range(struct.unpack(order + "H", exif[at : at + 2])[0]):
        entry = exif[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(order + "HHI", entry[:8]) == (0x0112, 3, 1):
            found = struct.unpack(order + "H", entry[8:10])[0]
            return found if 1 <= found <= 8 else 1
    return 1


def turned(pixels: np.ndarray, how: int) -> np.ndarray:
    """Pixels as they are shown under an orientation."""
    if how >= 5:
        pixels = pixels.transpose(1, 0, 2)
    mirrored = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(how, ())
    return np.flip(pixels, mirrored) if mirrored else pixels


def decode(data: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3) of a PNG file, turned as it says; alpha is left out. :class:`Unreadable` for another file, one that is damaged or
    interlaced, or one of a kind that isn't allowed."""
    parts = chunks(data)
    if parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise Unreadable("HEADER")
    width, height, depth, color, packing, filters, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if depth not in DEPTHS.get(color, ()) or packing or filters or not width or not height:
        raise Unreadable("HEADER")
    if interlaced:
        raise Unreadable("INTERLACED")
    if width * height > MOST:
        raise Unreadable("TOO_LARGE")
    samples = SAMPLES[color]
    line = (width * samples * depth + 7) // 8
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(body for kind, body in parts if kind == b"IDAT"), height * (line + 1) + 1)
    except zlib.error:
        raise Unreadable("DATA") from None
    if len(raw) != height * (line + 1):
        raise Unreadable("DATA")
    flat = unfiltered(np.frombuffer(raw, np.uint8).reshape(height, line + 1), max(1, samples * depth // 8))
    if depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)
        values = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :width]
        values = values if color == 3 else values * (255 // ((1 << depth) - 1))
    else:
        values = flat[:, :: depth // 8]  # of 16 bits the upper ones
    values = values.reshape(height, width, samples)
    if color == 3:
        palette = np.frombuffer(next((b for k, b in parts if k == b"PLTE"), b""), np.uint8).reshape(-1, 3)
        if values.max() >= len(palette):
            raise Unreadable("PALETTE")
        pixels = palette[values[:, :, 0]]
    else:
        pixels = values[:, :, :3] if samples >= 3 else values[:, :, [0, 0, 0]]
    exif = next((b for k, b in parts if k == b"eXIf"), b"")
    return np.ascontiguousarray(turned(pixels, orientation(exif)))


def filtered(pixels: np.ndarray, kind: int) -> bytes:
    """Scan lines under one of the filters."""
    height, width, step = pixels.shape
    wide = np.zeros((height + 1, width + 1, step), np.int16)
    wide[1:, 1:] = pixels
    left, up, corner = wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1]
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    less = [0, left, up, (left + up) >> 1, nearest][kind]
    lines = ((pixels - less) & 255).astype(np.uint8).reshape(height, -1)
    return np.concatenate((np.full((height, 1), kind, np.uint8), lines), axis=1).tobytes()


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray, kind: int = 2, color: int = 2, more: bytes = b"") -> bytes:
    """Pixels (height, width, samples) of 8 bits as a file of a colour type; ``more``: chunks before its data."""
    height, width, _ = pixels.shape
    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return HEAD + chunk(b"IHDR", head) + more + chunk(b"IDAT", zlib.compress(filtered(pixels, kind))) + chunk(b"IEND", b"")
