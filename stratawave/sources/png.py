"""PNG and PNM files as arrays, with the standard library and NumPy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(raw: bytes) -> np.ndarray:
    """Rows, columns[, channels] of a PNG of 8 or 16 bits without interlacing; palettes become RGB."""
    if not raw.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, packed, head, palette = 8, b"", None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
    if head is None:
        raise ValueError("a PNG without header")
    width, height, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or interlaced or colour not in CHANNELS:
        raise ValueError("only PNGs of 8 or 16 bits without interlacing are read")
    channels, unit = CHANNELS[colour], CHANNELS[colour] * depth // 8
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * unit)
    out = np.zeros((height, width * unit), np.uint8)
    above = np.zeros(width * unit, int)
    for r in range(height):
        filtered = lines[r, 1:].astype(int)
        out[r] = unfilter(int(lines[r, 0]), filtered, above, unit)
        above = out[r].astype(int)
    values = out.reshape(height, width, unit)
    values = values.view(">u2").astype(np.uint16) if depth == 16 else values
    if colour == 3:
        return palette[values[:, :, 0]]
    return values[:, :, 0] if channels == 1 else values


def unfilter(kind: int, line: np.ndarray, above: np.ndarray, unit: int) -> np.ndarray:
    if kind == 0:
        return line & 0xFF
    if kind == 1:
        return np.cumsum(line.reshape(-1, unit), axis=0).ravel() & 0xFF
    if kind == 2:
        return (line + above) & 0xFF
    if kind not in (3, 4):
        raise ValueError("unknown filter in a PNG")
    out = np.zeros(len(line), int)
    for i in range(0, len(line), unit):
        left = out[i - unit : i] if i else np.zeros(unit, int)
        up = above[i : i + unit]
        if kind == 3:
            guess = (left + up) // 2
        else:
            corner = above[i - unit : i] if i else np.zeros(unit, int)
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[i : i + unit] = (line[i : i + unit] + guess) & 0xFF
    return out


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of a gray, RGB or RGBA array of 8 bits."""
    a = np.asarray(image, np.uint8)
    a = a[:, :, None] if a.ndim == 2 else a
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[a.shape[2]]
    lines = np.hstack([np.zeros((a.shape[0], 1), np.uint8), a.reshape(a.shape[0], -1)])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode_pnm(raw: bytes) -> np.ndarray:
    """Binary PGM or PPM."""
    words, at = [], 0
    while len(words) < 4:
        end = at
        while raw[end : end + 1] not in (b" ", b"\n", b"\t", b"\r", b""):
            end += 1
        word = raw[at:end]
        if word.startswith(b"#"):
            end = raw.index(b"\n", at)
        elif word:
            words.append(word)
        at = end + 1
    if words[0] not in (b"P5", b"P6"):
        raise ValueError("only binary PGM and PPM are read")
    width, height, most = map(int, words[1:])
    channels = 3 if words[0] == b"P6" else 1
    kind = np.dtype(">u2" if most > 255 else "u1")
    values = np.frombuffer(raw, kind, width * height * channels, at).astype(kind.newbyteorder("="))
    return values.reshape((height, width, 3) if channels == 3 else (height, width))


def decode_image(raw: bytes) -> np.ndarray:
    return decode_png(raw) if raw.startswith(SIGNATURE) else decode_pnm(raw)
