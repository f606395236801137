"""Whether an image file's body is sound, from its structure and, for PNG, its data: truncated and damaged bodies are found.

No image library is needed: chunk and marker chains are walked to their end, lengths and checksums are checked, and a
PNG's pixels are inflated and counted.
"""

from __future__ import annotations

import struct
import zlib

#: Channels of PNG colour types.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: JPEG markers without a length: stand-alone, restarts, start and end of image.
BARE = {0x01, *range(0xD0, 0xDA)}


def _png(b: bytes) -> bool:
    at, data, head = 8, [], None
    while at + 12 <= len(b):
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        body = b[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(b) or zlib.crc32(kind + body) != struct.unpack(">I", b[at + 8 + size : at + 12 + size])[0]:
            return False
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    else:
        return False
    if head is None or not data or head[3] not in PNG_CHANNELS:
        return False
    try:
        pixels = len(zlib.decompress(b"".join(data)))
    except zlib.error:
        return False
    width, height, depth, colour, _, _, interlaced = head
    return pixels > 0 if interlaced else pixels == height * (1 + (width * depth * PNG_CHANNELS[colour] + 7) // 8)


def _jpeg(b: bytes) -> bool:
    at, frame = 2, False
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return False
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in BARE:
            if marker == 0xD9:
                return False  # the end before any scan
            at += 2
            continue
        size = struct.unpack(">H", b[at + 2 : at + 4])[0]
        if size < 2 or at + 2 + size > len(b):
            return False
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        at += 2 + size
        if marker == 0xDA:  # entropy-coded data up to the end marker
            return frame and b.rfind(b"\xff\xd9") >= at
    return False


def _bmp(b: bytes) -> bool:
    if len(b) < 54:
        return False
    size, _, start, _, width, height, _, depth, packed = struct.unpack("<IIIIiiHHI", b[2:34])
    need = start + (abs(width) * depth + 31) // 32 * 4 * abs(height) if packed == 0 else size
    return width > 0 and height != 0 and len(b) >= need


def _tiff(b: bytes) -> bool:
    end = "<" if b[:2] == b"II" else ">"
    at = struct.unpack(end + "I", b[4:8])[0]
    if at + 2 > len(b):
        return False
    n = struct.unpack(end + "H", b[at : at + 2])[0]
    if not n or at + 6 + 12 * n > len(b):
        return False
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack(end + "HHI", b[at + 2 + 12 * i : at + 10 + 12 * i])
        where, size = at + 10 + 12 * i, {3: 2, 4: 4}.get(kind, 0) * count
        if size > 4:
            where = struct.unpack(end + "I", b[where : where + 4])[0]
        if size and where + size <= len(b):
            tags[tag] = struct.unpack(f"{end}{count}{'H' if kind == 3 else 'I'}", b[where : where + size])
    strips, sizes = tags.get(273) or tags.get(324), tags.get(279) or tags.get(325)
    return bool(strips and sizes) and len(strips) == len(sizes) and all(o + s <= len(b) for o, s in zip(strips, sizes))


def _webp(b: bytes) -> bool:
    at, end = 12, 8 + struct.unpack("<I", b[4:8])[0]
    if end > len(b):
        return False
    found = False
    while at + 8 <= end:
        kind, size = struct.unpack("<4sI", b[at : at + 8])
        if at + 8 + size > end:
            return False
        found |= kind in (b"VP8 ", b"VP8L", b"ANMF")
        at += 8 + size + (size & 1)
    return found


def intact(b: bytes) -> bool:
    """Whether the bytes are a whole image of a known format."""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(b)
        if b[:3] == b"\xff\xd8\xff":
            return _jpeg(b)
        if b[:2] == b"BM":
            return _bmp(b)
        if b[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(b)
        return b[:4] == b"RIFF" and b[8:12] == b"WEBP" and _webp(b)
    except struct.error:
        return False
