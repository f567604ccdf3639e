"""MPEG audio in media columns: a writer of tagged variable-bitrate Layer III files and a resynchronising reader.

The writer stores bytes losslessly: every frame has empty side information, so it decodes to silence, and its
main data area carries the bytes as ancillary data. The reader takes any MPEG-1/2/2.5 stream of Layers I to III.

Defined results: null content gives null columns; bytes without any frame give zero frames; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes

# Fixed values of the format: bitrates in kbit/s by (is MPEG-1, layer), sampling rates by version bits.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
SIDE_MONO = 17
WRITE_RATE_INDEX, WRITE_RATE = 2, 32000


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        v = byte << 8
        for _ in range(8):
            v = (v << 1 ^ 0x8005 if v & 0x8000 else v << 1) & 0xFFFF
        out.append(v)
    return out


CRC_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of a protected frame: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    v = 0xFFFF
    for b in data:
        v = (v << 8 & 0xFFFF) ^ CRC_TABLE[(v >> 8) ^ b]
    return v


def syncsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def _frame_head(index: int) -> bytes:
    """Header, checksum and empty side information of a mono MPEG-1 Layer III frame of this bitrate index."""
    header = bytes([0xFF, 0xFA, index << 4 | WRITE_RATE_INDEX << 2, 0xC0])
    return header + crc16(header[2:] + bytes(SIDE_MONO)).to_bytes(2, "big") + bytes(SIDE_MONO)


SIZES = [144_000 * kbps // WRITE_RATE for kbps in BITRATES[True, 3]]
HEADS = [b"", *(_frame_head(i) for i in range(1, 15))]
ROOM = [0, *(SIZES[i] - len(HEADS[i]) for i in range(1, 15))]


def write_mpeg(payload: bytes) -> bytes:
    """A tag that states the payload's length, a variable-bitrate table, then full frames and the smallest last one."""
    frames = []
    for at in range(0, len(payload), ROOM[14]):
        part = payload[at : at + ROOM[14]]
        index = next(i for i in range(1, 15) if ROOM[i] >= len(part))
        frames.append(HEADS[index] + part.ljust(ROOM[index], b"\0"))
    sizes = [len(x) for x in frames]
    index = next(i for i in range(1, 15) if ROOM[i] >= 116)
    total = SIZES[index] + sum(sizes)
    starts, at = [], SIZES[index]
    for n in sizes:
        starts.append(at)
        at += n
    toc = bytes(min(255, 256 * starts[i * len(starts) // 100] // total) for i in range(100)) if starts else bytes(100)
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag_frame = b"TXXX" + syncsafe(len(text)) + b"\0\0" + text
    return b"".join([b"ID3\x04\0\0", syncsafe(len(tag_frame)), tag_frame, HEADS[index], table.ljust(ROOM[index], b"\0"), *frames])


def header_at(data: bytes, at: int) -> dict | None:
    """Fields of the frame header at this offset; None if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    kbps_index, rate_index = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or kbps_index in (0, 15) or rate_index == 3:
        return None
    first, rate = version == 3, RATES[version][rate_index]
    kbps, pad = BITRATES[first, layer][kbps_index], data[at + 2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12_000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    mono = data[at + 3] >> 6 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return {"version": version, "layer": layer, "rate": rate, "kbps": kbps, "samples": samples, "size": size, "mono": mono, "bound": 4 * (data[at + 3] >> 4 & 3) + 4 if data[at + 3] >> 6 == 1 else 32, "crc": not data[at + 1] & 1, "side": side if layer == 3 else 0}


def read_tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2 tag, and where the tag ends."""
    if len(data) < 10 or data[:3] != b"ID3":
        return {}, 0
    size = 10 + sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    end, at, tags = min(size, len(data)), 10, {}
    while at + 10 <= end and data[at : at + 1].strip(b"\0"):
        raw = data[at + 4 : at + 8]
        n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if data[3] >= 4 else int.from_bytes(raw, "big")
        body = data[at + 10 : min(at + 10 + n, end)]
        name = data[at : at + 4].decode("latin-1")
        if name[:1] == "T" and body:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            key, _, value = body[1:].decode(codec, "replace").partition("\0")
            tags[key if name == "TXXX" else name] = value if name == "TXXX" else key
        at += 10 + n
    return tags, end


# Fixed values of the format: Layer II bit allocation tables as (bands, bits of each allocation field by band).
ALLOCATION_BITS = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "lsf": [4] * 4 + [3] * 7 + [2] * 19}


def allocation_fields(h: dict) -> tuple[list[int], int, int]:
    """Layers I and II: bits of the allocation field of each subband, channels, and from which subband channels share one."""
    channels = 1 if h["mono"] else 2
    if h["layer"] == 1:
        fields = [4] * 32
    elif h["version"] != 3:
        fields = ALLOCATION_BITS["lsf"]
    else:
        each = h["kbps"] // channels
        low = each in (32, 48)
        fields = ALLOCATION_BITS[("d" if h["rate"] == 32000 else "c") if low else "a" if h["rate"] == 48000 or 56 <= each <= 80 else "b"]
    return fields, channels, min(h["bound"], len(fields))


def protected_bytes(data: bytes, at: int, h: dict) -> tuple[bytes, int]:
    """What the checksum of the frame at `at` covers: bytes and the number of bits of them that count.

    The last two bytes of the header, then the side information of Layer III, or the bit allocation of Layer I, or bit
    allocation and scale factor selection of Layer II.
    """
    body = data[at + 6 : at + h["size"]]
    if h["layer"] == 3:
        return data[at + 2 : at + 4] + body[: h["side"]], 8 * (2 + h["side"])
    fields, channels, bound = allocation_fields(h)
    bits, used, selected = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 0, 0
    for band, width in enumerate(fields):
        for _ in range(channels if band < bound else 1):
            value = bits >> (512 - used - width) & ((1 << width) - 1)
            used += width
            if value and h["layer"] == 2:  # a shared allocation still has a selection for each channel
                selected += 2 * (1 if band < bound else channels)
    total = 16 + used + selected
    return data[at + 2 : at + 4] + body[: (used + selected + 7) // 8], total


def crc16_bits(data: bytes, bits: int) -> int:
    """As crc16, over the first so many bits."""
    v = crc16(data[: bits // 8])
    for i in range(bits // 8 * 8, bits):
        bit = data[i // 8] >> (7 - i % 8) & 1
        v = (v << 1 & 0xFFFF) ^ (0x8005 if (v >> 15 ^ bit) & 1 else 0)
    return v


def bitrate_table(data: bytes, start: int, end: int, at: int) -> dict | None:
    """A variable-bitrate table in a first frame: Xing or Info after the side information, or VBRI at a fixed place.

    frames, bytes and seek are None where the table does not have them; seek holds byte offsets from the first frame at
    even steps of the playing time.
    """
    number = lambda p, n: int.from_bytes(data[p : p + n], "big")
    if data[start : start + 4] in (b"Xing", b"Info") and start + 8 <= end:
        out: dict = {"kind": data[start : start + 4].decode(), "frames": None, "bytes": None, "seek": None}
        flags, p = number(start + 4, 4), start + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and p + 4 <= end:
                out[name] = number(p, 4)
                p += 4
        if flags & 4 and p + 100 <= end and out["bytes"] is not None:
            out["seek"] = [x * out["bytes"] // 256 for x in data[p : p + 100]]
        return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= end:
        entries, scale, size = number(p + 18, 2), number(p + 20, 2), number(p + 22, 2)
        out = {"kind": "VBRI", "frames": number(p + 14, 4), "bytes": number(p + 10, 4), "seek": None}
        if size and p + 26 + entries * size <= end:
            out["seek"], total = [], 0
            for i in range(entries):
                out["seek"].append(total)
                total += number(p + 26 + i * size, size) * scale
        return out
    return None


def whole_number(text: str) -> int | None:
    """A plain decimal number; digits of other scripts and signs are none."""
    return int(text) if text.isascii() and text.isdigit() and len(text) <= 18 else None


def read_mpeg(data: bytes) -> dict:
    """Tags, frames, checksums, the variable-bitrate table and the carried bytes of one file.

    A header counts if the next frame's header, or the end of the data, follows where it says; else the
    reader looks for the next sync pattern and counts the bytes that it skips. The last 128 bytes are an ID3v1 tag only
    if they say so and no frame reaches into them: the bytes that a frame carries may say so too.
    """
    tags, at = read_tags(data)
    end = len(data)
    tag_at = end - 128 if end - at >= 128 and data[-128:-125] == b"TAG" else end
    offsets, body, kbps, samples, rate, bad, checked, skipped, table, first = [], [], set(), 0, 0, 0, 0, 0, None, None
    while at < end and at != tag_at:
        h = header_at(data, at)
        after = at + h["size"] if h else 0
        if h is None or after > end or (after not in (tag_at, end) and header_at(data, after) is None):
            stop = tag_at if at < tag_at else end
            sync = data.find(b"\xff", at + 1, stop)
            sync = stop if sync < 0 else sync
            skipped += sync - at
            at = sync
            continue
        start = min(after, at + 4 + 2 * h["crc"] + h["side"])
        if h["crc"] and h["size"] >= 6:
            checked += 1
            bad += crc16_bits(*protected_bytes(data, at, h)) != int.from_bytes(data[at + 4 : at + 6], "big")
        if first is None:
            first = h
            table = bitrate_table(data, start, after, at) if h["layer"] == 3 else None
            if table is not None:
                at = after
                continue
        offsets.append(at)
        body.append(data[start:after])
        kbps.add(h["kbps"])
        samples, rate = samples + h["samples"], h["rate"]
        at = after
    payload = b"".join(body)
    stated = whole_number(tags.get("payload_bytes", ""))
    seconds = Fraction(samples, rate) if rate else Fraction(0)
    return {
        "tags": tags, "first": first, "offsets": offsets, "kbps": sorted(kbps), "samples": samples, "rate": rate, "seconds": seconds,
        "checked": checked, "bad": bad, "skipped": skipped, "table": table, "payload": payload if stated is None else payload[:stated],
    }


def feature(x: dict) -> str:
    """A canonical line of what the reader found; equal bytes give equal lines."""
    h, t = x["first"], x["table"]
    if h is None:
        return f"none;skipped={x['skipped']}"
    said = lambda x: "none" if x is None else x
    vbr = f"{said(t['frames'])}/{said(t['bytes'])}" if t else "none"
    return (
        f"mpeg{VERSIONS[h['version']]}-layer{h['layer']};rate={x['rate']};channels={1 if h['mono'] else 2};frames={len(x['offsets'])};samples={x['samples']};"
        f"seconds={x['seconds'].numerator}/{x['seconds'].denominator};kbps={'-'.join(map(str, sorted({min(x['kbps'], default=0), max(x['kbps'], default=0)})))};"
        f"crc={x['checked'] - x['bad']}/{x['checked']};skipped={x['skipped']};vbr={vbr}"
    )


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8, padded by zero bytes to a positive multiple of `unit`, as MPEG audio."""

    def make():
        def one(key, data):
            data = data or b""
            return key, len(data), write_mpeg(data + bytes(max(unit, -len(data) % unit + len(data)) - len(data)))

        return one

    return map_rows(text_bytes(docs, id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, media binary")


PROBE = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_seconds double, n_frames long, crc_failures long, frame_offsets array<long>"


def probe_media(table: DataFrame, id_col: str, media_col: str, *keep: str) -> DataFrame:
    """One row per row: what the reader finds in a column of MPEG audio, with exact durations and seek offsets."""
    kinds = dict(table.dtypes)

    def make():
        def one(key, media, *rest):
            if media is None:
                return key, *rest, *[None] * 10
            x = read_mpeg(media)
            p = x["payload"]
            return key, *rest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(x), float(x["seconds"]), len(x["offsets"]), x["bad"], x["offsets"]

        return one

    chosen = table.select(F.col(id_col), F.col(media_col).alias("_bytes"), *keep)
    return map_rows(chosen, make, ", ".join([f"{id_col} {kinds[id_col]}", *(f"{c} {kinds[c]}" for c in keep), PROBE]))
