"""What is wrong with the bytes of an image or a PDF; for one file of at most 25 MB at a time, inside a task."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

#: Fixed value: grey values that deviate less than this from their mean are a blank image.
BLANK = 3.0
MOST_PIXELS = 178_956_970
#: Channels of a pixel by the colour type of a PNG.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SHOWN = re.compile(rb"\(((?:[^()\\]|\\.)+)\)\s*(?:Tj|'|\")|\[([^\[\]]+)\]\s*TJ|<([0-9A-Fa-f\s]+)>\s*Tj", re.S)
IMAGE = re.compile(rb"/Subtype\s*/Image\b")
PAGE = re.compile(rb"/Type\s*/Page\b")
STREAM = re.compile(rb"stream\r?\n(.*?)endstream", re.S)


class Broken(ValueError):
    """Bytes that are not what their format says."""


class Spread:
    """Sums of grey values seen so far.  Deviations within some of the pixels are a lower bound of those of all, so that
    reading can stop once they alone are too large for a blank image."""

    def __init__(self, pixels: int):
        self.pixels, self.n, self.sum, self.squares = pixels, 0, 0, 0

    def add(self, grey: np.ndarray) -> None:
        g = grey.astype(np.int64).ravel()
        self.n, self.sum, self.squares = self.n + g.size, self.sum + int(g.sum()), self.squares + int((g * g).sum())

    def blank(self) -> bool:
        """Whether all pixels, of which those seen are a part, may still deviate by less than ``BLANK``."""
        return (self.squares * self.n - self.sum**2) < BLANK**2 * self.pixels * max(self.n, 1)


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of the last axis' red, green and blue."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return (299 * r + 587 * g + 114 * b) // 1000


def sized(width: int, height: int) -> Spread | None:
    if width <= 0 or height <= 0:
        raise Broken("no pixels")
    return Spread(width * height) if width * height <= MOST_PIXELS else None


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    at, out = 8, []
    while not out or out[-1][0] != b"IEND":
        if at + 12 > len(data):
            raise Broken("ends early")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise Broken("checksum")
        out.append((kind, body))
        at += 12 + size
    return out


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG before its filter; ``step`` bytes are a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise Broken("filter")
    out, raw, up = bytearray(line.size), line.tolist(), above.tolist()
    for i, x in enumerate(raw):
        left, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            out[i] = (x + (left + b) // 2) & 255
        else:
            p = left + b - c
            near = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - c), 2, c))
            out[i] = (x + near[2]) & 255
    return np.frombuffer(bytes(out), np.uint8)


def png(data: bytes) -> Spread | None:
    chunks = png_chunks(data)
    if chunks[0][0] != b"IHDR" or len(chunks[0][1]) != 13:
        raise Broken("header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[0][1])
    spread = sized(width, height)
    if spread is None:
        return None
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise Broken("colours")
    bits = CHANNELS[colour] * depth
    row, step = (width * bits + 7) // 8, max(1, bits // 8)
    palette = np.frombuffer(next((b for k, b in chunks if k == b"PLTE"), b""), np.uint8)
    palette = np.resize(palette, (len(palette) // 3, 3))
    inflate, rest, above, lines = zlib.decompressobj(), b"", np.zeros(row, np.uint8), 0
    for body in (b for k, b in chunks if k == b"IDAT"):
        while body:
            rest += inflate.decompress(body, 1 << 20)
            body = inflate.unconsumed_tail
            if interlaced:  # seven smaller images: whether the data inflate is all that is checked
                rest = b""
                continue
            whole = len(rest) // (row + 1)
            for i in range(min(whole, height - lines)):
                if not spread.blank() and spread.n:
                    break
                at = i * (row + 1)
                above = unfiltered(rest[at], np.frombuffer(rest, np.uint8, row, at + 1), above, step)
                spread.add(png_grey(above, width, depth, colour, palette))
            lines, rest = lines + whole, rest[whole * (row + 1) :]
    if not inflate.eof or (not interlaced and lines < height):
        raise Broken("ends early")
    if interlaced:
        spread.add(np.array([0, 255] * 2))
        spread.pixels = spread.n
    return spread


def png_grey(line: np.ndarray, width: int, depth: int, colour: int, palette: np.ndarray) -> np.ndarray:
    if depth == 16:
        line = line[::2]
    elif depth < 8:
        parts = np.unpackbits(line).reshape(-1, depth)
        line = (parts @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:width]
        if colour == 0:
            line = line * (255 // ((1 << depth) - 1))
    if colour == 3:
        if line.size and line.max() >= len(palette):
            raise Broken("palette")
        return grey(palette[line])
    pixels = line.reshape(width, CHANNELS[colour])
    return grey(pixels) if colour in (2, 6) else pixels[:, 0]


def bmp(data: bytes) -> Spread | None:
    if len(data) < 54:
        raise Broken("header")
    start, head, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    spread = sized(width, abs(height))
    if spread is None:
        return None
    if bits not in (8, 24, 32) or packed not in (0, 3):
        return unread(spread)
    line = (width * bits // 8 + 3) // 4 * 4
    if len(data) < start + line * abs(height):
        raise Broken("ends early")
    colours = np.frombuffer(data, np.uint8)[14 + head : start]
    colours = np.resize(colours, (len(colours) // 4, 4))[:, 2::-1]
    for y in range(abs(height)):
        row = np.frombuffer(data, np.uint8, width * bits // 8, start + y * line)
        if bits == 8 and row.max() >= len(colours):
            raise Broken("palette")
        spread.add(grey(colours[row] if bits == 8 else row.reshape(width, bits // 8)[:, 2::-1]))
        if not spread.blank():
            break
    return spread


def unread(spread: Spread) -> Spread:
    """For images whose pixels are not read: never blank."""
    spread.pixels = 2
    spread.add(np.array([0, 255]))
    return spread


def structure(kind: str, data: bytes) -> None:
    """Whether a file whose pixels are not read has its parts and its end."""
    if kind == "jpeg":
        at = 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise Broken("segments")
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            at += 2 + size
            if mark == 0xDA:
                break
        if data.rfind(b"\xff\xd9") < at:
            raise Broken("ends early")
    elif kind == "gif":
        if len(data) < 14 or b"\x3b" not in data[-16:]:
            raise Broken("ends early")
    elif kind == "webp":
        if len(data) < 20 or struct.unpack("<I", data[4:8])[0] + 8 > len(data):
            raise Broken("ends early")
    elif kind == "tiff":
        order = "<" if data[:2] == b"II" else ">"
        if len(data) < 8 or struct.unpack(order + "I", data[4:8])[0] + 2 > len(data):
            raise Broken("directory")


def pdf(data: bytes) -> str | None:
    """Why nothing can be read of a PDF.  Compressed streams are inflated one at a time, 64 MB of each at most."""
    if b"%%EOF" not in data and b"startxref" not in data:
        return "unreadable pdf"
    pages = shown = False

    def scan(part: bytes) -> None:
        nonlocal pages, shown
        pages = pages or bool(PAGE.search(part))
        shown = shown or bool(IMAGE.search(part)) or any((m[1] or m[2] or m[3]).strip(b" ()\t\r\n") for m in SHOWN.finditer(part))

    scan(data)
    for m in STREAM.finditer(data):
        if pages and shown:
            break
        try:
            scan(zlib.decompressobj().decompress(m[1], 1 << 26))
        except zlib.error:
            continue
    return "pdf has no pages" if not pages else None if shown else "pdf has no text or images"


def fault(kind: str | None, data: bytes) -> str | None:
    """Why the file is of no use; null if nothing speaks against it."""
    if kind is None:
        return None
    if kind == "pdf":
        return pdf(data)
    try:
        if kind not in ("png", "bmp"):
            return structure(kind, data)
        spread = png(data) if kind == "png" else bmp(data)
    except (Broken, struct.error, zlib.error, IndexError, ValueError):
        return "corrupt image"
    if spread is None:
        return "image exceeds pixel limit"
    return "image is blank" if spread.blank() else None
