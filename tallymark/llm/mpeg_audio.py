"""Media columns: MPEG audio.

``parse`` walks any MPEG-1/2/2.5 layer I-III stream: it reads ID3v2, ID3v1 and APE tags, finds frame headers
again after damage, reads Xing/Info/VBRI tables and the encoder delay, verifies the CRC-16 of protected
frames of all layers, and returns exact durations in samples and the byte offset of every frame. ``wrap`` stores arbitrary bytes losslessly as the
ancillary data of protected, silent layer III frames of variable bit rate.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_row, written

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), sampling rates by version bits.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Layer II allocation tables B.2a to B.2d, and B.1 of the lower sampling rates: (bits of a subband's allocation, so many subbands).
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}

UNIT = 576


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None, c: int = 0xFFFF) -> int:
    """The frame checksum over ``bits`` leading bits of ``data`` (default: all)."""
    whole, rest = divmod(len(data) * 8 if bits is None else bits, 8)
    for x in data[:whole]:
        c = ((c << 8) & 0xFFFF) ^ CRC[(c >> 8) ^ x]
    for k in range(rest):
        bit = (data[whole] >> (7 - k)) & 1
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


def crc16_arc(data: bytes) -> int:
    c = 0
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ 0xA001 if c & 1 else c >> 1
    return c


#: What header words mean and what checksums came out, remembered while small; plain dictionaries travel with the functions.
_HEADERS: dict[int, tuple | None] = {}
_SUMS: dict[tuple, int] = {}


def header(word: int) -> tuple | None:
    if word not in _HEADERS:
        if len(_HEADERS) > 65536:
            _HEADERS.clear()
        _HEADERS[word] = _header(word)
    return _HEADERS[word]


def _header(word: int) -> tuple | None:
    """(layer, sampling rate, kbit/s, length or 0 for free format, samples, side bytes, protected, mode, extension, likeness, padding) or None."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 10 & 3
    if version == 1 or layer == 4 or rate == 3 or word >> 12 & 15 == 15 or word & 3 == 2:
        return None
    one, hz, pad, mode = version == 3, RATES[version][rate], word >> 9 & 1, word >> 6 & 3
    kbps = KBPS[one, layer][word >> 12 & 15]
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    side = 0 if layer != 3 else (17 if mode == 3 else 32) if one else (9 if mode == 3 else 17)
    return layer, hz, kbps, length if kbps else 0, samples, side, not word >> 16 & 1, mode, word >> 4 & 3, word & 0xFFFE0C00, pad


def _crc_of(head: bytes, body: bytes, bits: int) -> int:
    key = head, body, bits
    if key not in _SUMS:
        if len(_SUMS) > 4096:
            _SUMS.clear()
        _SUMS[key] = crc16(body, bits, crc16(head))
    return _SUMS[key]


def allocation(hz: int, kbps: int, channels: int) -> list[int]:
    """The bits of each subband's allocation in a layer II frame; free format has the tables of high bit rates."""
    each = kbps // channels or 384
    if hz < 32000:
        name = "low"
    elif each < 56:
        name = "d" if hz == 32000 else "c"
    else:
        name = "a" if hz == 48000 or each < 96 else "b"
    return [width for width, n in ALLOCATION[name] for _ in range(n)]


def protected_bits(body: bytes, h: tuple) -> int:
    """How many bits of a layer II frame's ``body`` the CRC covers: allocations, then two for each allocated subband and channel."""
    channels, ext = 1 if h[7] == 3 else 2, h[8]
    widths = allocation(h[1], h[2], channels)
    bound = 4 * (ext + 1) if h[7] == 1 else len(widths)
    bits, at, chosen = int.from_bytes(body, "big"), len(body) * 8, 0
    for k, width in enumerate(widths):
        for _ in range(channels if k < bound else 1):  # beyond the bound both channels share one allocation
            at -= width
            if at < 0:
                return len(body) * 8 + 1
            chosen += (bits >> at & (1 << width) - 1 > 0) * (1 if k < bound else channels)
    return len(body) * 8 - at + 2 * chosen


def checked(data: bytes, at: int, h: tuple, end: int) -> bool | None:
    """Does the CRC of the protected frame ``data[at:end]`` hold? None without one; a frame too short for what it covers fails."""
    layer, _, _, _, _, side, protected, mode, ext, _, _ = h
    if not protected:
        return None
    if layer == 3:
        bits = side * 8
    elif layer == 2:
        bits = protected_bits(data[at + 6 : min(end, at + 48)], h)
    else:
        n = 1 if mode == 3 else 2
        bound = 4 * (ext + 1) if mode == 1 else 32
        bits = 4 * (n * bound + 32 - bound)
    body = data[at + 6 : min(end, at + 6 + -(-bits // 8))]
    if len(body) * 8 < bits:
        return False
    return _crc_of(data[at + 2 : at + 4], body, bits) == int.from_bytes(data[at + 4 : at + 6], "big")


def _safe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _rejoined(b: bytes) -> bytes:
    """Bytes without the zeros that unsynchronisation put in."""
    return b.replace(b"\xff\0", b"\xff")


def _plain(body: bytes, version: int, flags: int, unsynced: bool) -> bytes | None:
    """A tag frame's content without what its format flags add to it; None where it is compressed or encrypted."""
    if version == 4:
        if flags & 0x0C:
            return None
        body = body[(1 if flags & 0x40 else 0) + (4 if flags & 1 else 0) :]
        return _rejoined(body) if unsynced or flags & 2 else body
    if version == 3:
        return None if flags & 0xC0 else body[1:] if flags & 0x20 else body
    return body


def id3v2(version: int, flags: int, body: bytes, found: dict[str, str]) -> None:
    """Adds the text frames in the ``body`` of one ID3v2 tag."""
    unsynced, p = bool(flags & 0x80), 0
    if unsynced and version < 4:  # the whole tag; from version 4 on frame by frame
        body = _rejoined(body)
    if flags & 0x40 and version >= 3 and len(body) >= 4:
        p = _safe(body) if version == 4 else int.from_bytes(body[:4], "big") + 4
    head, letters = (6, 3) if version == 2 else (10, 4)
    while p + head <= len(body) and body[p]:
        name, raw = body[p : p + letters].decode("latin1"), body[p + letters : p + (6 if version == 2 else 8)]
        n = _safe(raw) if version == 4 else int.from_bytes(raw, "big")
        text = _plain(body[p + head : p + head + n], version, body[p + 9] if version > 2 else 0, unsynced)
        if name[0] == "T" and text:
            code = ("latin1", "utf-16", "utf-16-be", "utf-8")[text[0] & 3]
            parts = text[1:].decode(code, "replace").split("\0")
            own = name[:3] == "TXX" and len(parts) > 1
            found[f"{name}:{parts[0]}" if own else name] = parts[1].removeprefix("\ufeff") if own else parts[0]
        p += head + n


def ape_items(body: bytes, count: int, found: dict[str, str]) -> None:
    """Adds the text items of an APE tag, named ``APE:`` and their key; binary items and links are passed over."""
    p = 0
    for _ in range(count):
        stop = body.find(b"\0", p + 8)
        if stop < 0:
            return
        n, flags = struct.unpack("<II", body[p : p + 8])
        if flags >> 1 & 3 == 0:
            found["APE:" + body[p + 8 : stop].decode("latin1")] = body[stop + 1 : stop + 1 + n].decode("utf-8", "replace")
        p = stop + 1 + n


def tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text tags, and where the audio begins and ends."""
    found, at, end = {}, 0, len(data)
    while True:
        if data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128:
            version, flags, size = data[at + 3], data[at + 5], _safe(data[at + 6 : at + 10])
            id3v2(version, flags, data[at + 10 : at + 10 + size], found)
            at = min(at + 10 + size + (10 if version == 4 and flags & 0x10 else 0), len(data))
        elif data[at : at + 8] == b"APETAGEX" and len(data) >= at + 32:
            size, count = struct.unpack("<II", data[at + 12 : at + 20])
            ape_items(data[at + 32 : at + 32 + size], count, found)
            at = min(at + 32 + size, len(data))
        else:
            break
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
            if text := data[end - 128 + a : end - 128 + b].split(b"\0")[0].decode("latin1").strip():
                found.setdefault(name, text)
        end -= 128
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
        if 32 <= size <= end - at:
            ape_items(data[end - size : end - 32], count, found)
            end = max(at, end - size - (32 if flags & 0x80000000 else 0))
        else:  # a damaged size: only the footer goes
            end -= 32
    return found, at, end


def vbr_table(data: bytes, at: int, h: tuple) -> dict | None:
    """The Xing/Info or VBRI table of the frame at ``at``."""
    x = at + 4 + (2 if h[6] else 0) + h[5]
    if h[0] == 3 and data[x : x + 4] not in (b"Xing", b"Info"):
        x = at + 4 + h[5]  # some writers leave no room for the checksum
    if h[0] == 3 and data[x : x + 4] in (b"Xing", b"Info") and len(data) >= x + 8:
        out = {"kind": data[x : x + 4].decode(), "frames": None, "bytes": None, "toc": None, "delay": 0, "padding": 0, "tag_crc": None}
        flags, p = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = data[p : p + n] if n == 100 else int.from_bytes(data[p : p + n], "big")
                p += n
        if len(data) >= p + 36 and data[p : p + 4] in (b"LAME", b"Lavc", b"Lavf", b"TLYM"):
            d = int.from_bytes(data[p + 21 : p + 24], "big")
            out |= {"delay": d >> 12, "padding": d & 0xFFF, "tag_crc": crc16_arc(data[at : p + 34]) == int.from_bytes(data[p + 34 : p + 36], "big")}
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI" and len(data) >= x + 26:
        _, delay, _, size, frames, n, scale, width, _ = struct.unpack(">HHHIIHHHH", data[x + 4 : x + 26])
        toc = [int.from_bytes(data[x + 26 + k * width : x + 26 + (k + 1) * width], "big") * scale for k in range(n)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "delay": delay, "padding": 0, "tag_crc": None}
    return None


def parse(data: bytes | None) -> dict:
    """All that is stored about a stream. Null or empty bytes, or bytes without any frame, give no frames and no duration."""
    data = data or b""
    found, at, end = tags(data)
    out = {"tags": found, "table": None, "offsets": [], "lengths": [], "sizes": {}, "samples": 0, "rate": 0, "layer": 0, "skipped": 0, "resyncs": 0, "crc_ok": 0, "crc_bad": 0, "crc_unchecked": 0, "truncated": False}
    like, free, locked = None, 0, True
    word = lambda p: int.from_bytes(data[p : p + 4], "big") if p + 4 <= end else 0
    while at + 4 <= end:
        h = header(word(at))
        if h and like is not None and h[9] != like:
            h = None
        n = 0
        if h:
            if h[3] == 0 and not free:  # free format: the next header of the same kind tells the length
                p = data.find(b"\xff", at + 24, min(end, at + 8192))
                while p >= 0 and not ((g := header(word(p))) and g[9] == h[9] and g[3] == 0):
                    p = data.find(b"\xff", p + 1, min(end, at + 8192))
                free = p - at - (h[10] * (4 if h[0] == 1 else 1)) if p > 0 else 0
            n = h[3] or (free + h[10] * (4 if h[0] == 1 else 1) if free else 0)
        good = n > 0
        if good and (not locked or like is None):  # to lock, the next frame must follow, or the data end there
            g = header(word(at + n))
            good = at + n == end or (g is not None and g[9] == h[9]) or (at + n > end and like is not None)
        if not good:
            out["resyncs"] += locked
            locked = False
            p = data.find(b"\xff", at + 1, end)
            p = end if p < 0 else p
            out["skipped"] += p - at
            at = p
            continue
        locked = True
        if at + n > end:
            out["truncated"] = True
            break
        if like is None:
            like, out["layer"], out["rate"] = h[9], h[0], h[1]
            out["table"] = vbr_table(data, at, h)
            if out["table"]:
                at += n
                continue
        ok = checked(data, at, h, at + n)
        out["crc_unchecked" if ok is None else "crc_ok" if ok else "crc_bad"] += 1
        out["offsets"].append(at)
        out["lengths"].append(n)
        out["sizes"][h[2]] = out["sizes"].get(h[2], 0) + 1
        out["samples"] += h[4]
        at += n
    if locked is False or at < end:
        out["skipped"] += 0 if out["truncated"] else max(0, end - at)
    t = out["table"]
    out["played"] = max(0, out["samples"] - (t["delay"] + t["padding"])) if t else out["samples"]
    return out


# The stored form: MPEG-1 layer III, 48 kHz stereo, protected; 3 bytes of frame a kbit/s.
_HZ, _SIDE, _OVER = 48000, 32, 4 + 2 + 32
_FITS = [(3 * k - _OVER, i) for i, k in enumerate(KBPS[True, 3]) if k]


def _frame(index: int, body: bytes) -> bytes:
    head = (0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 1 << 10).to_bytes(4, "big")
    side = bytes(_SIDE)
    size = 3 * KBPS[True, 3][index]
    return b"".join((head, _crc_of(head[2:], side, _SIDE * 8).to_bytes(2, "big"), side, body, bytes(size - _OVER - len(body))))


def wrap(payload: bytes) -> bytes:
    """``payload`` as a stream: an ID3v2 tag with its length, a Xing table, then the smallest frames that hold it."""
    frames, at, most = [], 0, _FITS[-1]
    while len(payload) - at > most[0]:
        frames.append(_frame(most[1], payload[at : at + most[0]]))
        at += most[0]
    rest = payload[at:]
    frames.append(_frame(next(i for room, i in _FITS if room >= len(rest)), rest))
    sizes = np.cumsum([0, *map(len, frames)])
    total = int(sizes[-1])
    toc = bytes(min(255, int(256 * int(sizes[len(frames) * k // 100]) // max(1, total))) for k in range(100))
    first = 576  # a 192 kbit/s frame holds the table
    table = b"Xing" + struct.pack(">III", 7, len(frames), total + first) + toc
    lame = b"LAME3.100" + bytes(12) + bytes(3) + bytes(4) + struct.pack(">I", total + first) + bytes(2)
    info = bytearray(_frame(11, table + lame))
    upto = _OVER + len(table) + len(lame)
    info[upto : upto + 2] = crc16_arc(bytes(info[:upto])).to_bytes(2, "big")
    text = lambda name, s: name + bytes((0, 0, len(s) >> 7, len(s) & 127, 0, 0)) + s
    tag = text(b"TXXX", b"\x03payload_bytes\0" + str(len(payload)).encode()) + text(b"TLEN", b"\x03" + str(len(frames) * 24).encode())
    return b"".join((b"ID3\x04\0\0", bytes((len(tag) >> 21 & 127, len(tag) >> 14 & 127, len(tag) >> 7 & 127, len(tag) & 127)), tag, bytes(info), *frames))


def unwrap(data: bytes, seen: dict) -> bytes:
    """The bytes that ``wrap`` stored; ``seen`` is ``parse(data)``."""
    body = b"".join(data[a + _OVER : a + n] for a, n in zip(seen["offsets"], seen["lengths"]))
    return body[: int(seen["tags"].get("TXXX:payload_bytes", len(body)))]


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FACTS = pa.schema([("frames", pa.int64()), ("sample_rate", pa.int64()), ("samples", pa.int64()), ("duration_s", pa.float64()), ("seek_offsets", pa.list_(pa.int64())), ("vbr_kind", pa.string()), ("crc_ok", pa.int64()), ("crc_bad", pa.int64()), ("resyncs", pa.int64()), ("skipped_bytes", pa.int64()), ("tag_names", pa.list_(pa.string()))])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), *FACTS])


def facts(seen: dict) -> tuple:
    rate = seen["rate"]
    return len(seen["offsets"]), rate, seen["played"], seen["played"] / rate if rate else 0.0, seen["offsets"], seen["table"]["kind"] if seen["table"] else None, seen["crc_ok"], seen["crc_bad"], seen["resyncs"], seen["skipped"], sorted(seen["tags"])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} " + (f"array<{kinds[f.type.value_type]}>" if pa.types.is_list(f.type) else kinds[f.type]) for f in schema)


def audio_facts(df: DataFrame, key: str, media: str) -> DataFrame:
    """``key`` and what ``parse`` finds in the binary column ``media``; other columns are not returned. Null media: no frames."""
    schema = pa.schema([("key", pa.int64()), *FACTS])
    out = df.selectExpr(f"`{key}` as key", f"`{media}` as media").mapInArrow(by_row(lambda k, m: (k, *facts(parse(m))), ["key", "media"], schema), ddl(schema))
    return out.withColumnRenamed("key", key)


def store_texts(docs: DataFrame) -> DataFrame:
    """Each whole text as a stream: ``doc_id, n_bytes, media``. Null texts count as empty."""

    def one(doc, text):
        payload, n = padded(text)
        return doc, n, wrap(payload)

    return docs.select("doc_id", "text").mapInArrow(by_row(one, ["doc_id", "text"], STORED), ddl(STORED))


def digests(stored: DataFrame) -> DataFrame:
    """What the stored streams say when read back; equal texts have equal rows but for ``doc_id``."""

    def one(doc, n, media):
        seen = parse(media)
        payload = unwrap(media, seen)
        x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
        crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        rates = "+".join(f"{k}x{v}" for k, v in sorted(seen["sizes"].items()))
        feature = f"layer{seen['layer']}/{seen['rate']}/{seen['played']}/{rates}/{int((x * x).sum())}/{crossings}"
        return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, *facts(seen)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(by_row(one, ["doc_id", "n_bytes", "media"], DIGEST), ddl(DIGEST))


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text as MPEG audio in the shared folder, read it back and describe it.

    Null texts are empty; an empty text is one unit of padding; repeated rows give repeated rows; an empty
    table gives none; columns other than ``doc_id`` and ``text`` are ignored; a null ``doc_id`` stays null.
    """
    return digests(written(store_texts(docs), "media"))
