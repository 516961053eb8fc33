"""Media columns: MPEG Layer III streams built (as MPEG-1) from and parsed (all versions) back to bytes.

A stream is an ID3v2.3 tag, an Info/Xing frame with frame count, byte count and 100 seek points, and audio
frames. Each audio frame is protected by the CRC-16 of its header and side information, has empty granules
(it plays as silence), and carries its share of the payload as ancillary data, so any bytes are kept
losslessly. The tag states the payload's length; the last frame takes the smallest bit rate that holds the
rest, so streams have a variable bit rate.

The parser takes nothing on trust: it reads ID3v1 and ID3v2.2 to 2.4 tags (extended headers, unsynchronisation and
both kinds of frame sizes), seeks the first offset at which a header is followed by another, steps by frame length,
resynchronises after damage by looking for the next header of the same version and sample rate that is followed by
another, checks every CRC, reads Xing, Info and VBRI tables, and compares them with the frames found. The channel mode
may change from frame to frame.

Null or empty texts give one block of blanks; rows are independent, equal texts give equal values.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# Fixed values of Layer III: kbit/s by header index for MPEG-1 and for the lower rates of MPEG-2 and 2.5, Hz by header
# index, samples a frame, bytes of side information (mono, else), CRC-16 polynomial.
BIT_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0)
LOW_BIT_RATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0)
SAMPLE_RATES = (44100, 48000, 32000)
SAMPLES, LOW_SAMPLES = 1152, 576
SIDE, LOW_SIDE = (17, 32), (9, 17)
POLYNOMIAL = 0x8005
BLOCK = 192


def _crc_table() -> list[int]:
    table = []
    for k in range(256):
        x = k << 8
        for _ in range(8):
            x = (x << 1) ^ POLYNOMIAL if x & 0x8000 else x << 1
        table.append(x & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    x = 0xFFFF
    for b in data:
        x = ((x << 8) & 0xFFFF) ^ _CRC[(x >> 8) ^ b]
    return x


def header(rate_index: int, sample_index: int = 2, mode: int = 3, protected: bool = True) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, rate_index << 4 | sample_index << 2, mode << 6])


#: Divisor of the sample rates by version bits: MPEG-2.5, none, MPEG-2, MPEG-1.
_DIVISOR = (4, 0, 2, 1)


def parse_header(four: bytes) -> dict | None:
    """The fields of a frame header, or None if these four bytes are none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE6 != 0xE2:
        return None
    divisor, rate, sample = _DIVISOR[four[1] >> 3 & 3], four[2] >> 4, four[2] >> 2 & 3
    low = divisor > 1
    kbps = (LOW_BIT_RATES if low else BIT_RATES)[rate]
    if not divisor or not kbps or sample == 3:
        return None
    hz, samples = SAMPLE_RATES[sample] // divisor, LOW_SAMPLES if low else SAMPLES
    return {
        "kbps": kbps,
        "hz": hz,
        "samples": samples,
        "length": samples * 125 * kbps // hz + (four[2] >> 1 & 1),
        "side": (LOW_SIDE if low else SIDE)[four[3] >> 6 != 3],
        "protected": not four[1] & 1,
    }


def _frame_kinds() -> list[tuple[int, bytes]]:
    """Bytes of payload and the finished first 23 bytes (header, CRC, side information) of each bit rate at 32 kHz mono."""
    kinds = []
    for k, kbps in enumerate(BIT_RATES):
        if kbps:
            head = header(k)
            kinds.append((144_000 * kbps // 32_000 - 23, head + struct.pack(">H", crc16(head[2:] + bytes(17))) + bytes(17)))
    return kinds


_KINDS = _frame_kinds()


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _text_frame(name: str, value: str) -> bytes:
    body = b"\x00" + value.encode("latin-1")
    return name.encode() + struct.pack(">IH", len(body), 0) + body


def build(payload: bytes) -> bytes:
    """The stream that stores payload."""
    room, full = _KINDS[-1]
    frames = [full + payload[k : k + room] for k in range(0, len(payload) - room + 1, room)]
    rest = payload[len(frames) * room :]
    if rest or not frames:
        held, front = next(k for k in _KINDS if k[0] >= len(rest))
        frames.append(front + rest + bytes(held - len(rest)))
    sizes = np.array([len(f) for f in frames], np.int64)
    front = _KINDS[4][1]  # 64 kbit/s: 288 bytes, enough for the 120 of the table
    total = int(sizes.sum()) + 288
    ends = np.concatenate([[288], 288 + np.cumsum(sizes)])
    seek = seek_points(ends[:-1], total)
    steady = len(set(sizes.tolist())) == 1
    table = (b"Info" if steady else b"Xing") + struct.pack(">III", 7, len(frames), total) + seek
    lead = front + table
    tags = _text_frame("TIT2", "payload") + _text_frame("TXXX", f"payload_bytes\x00{len(payload)}")
    return b"".join([b"ID3\x03\x00\x00", _syncsafe(len(tags)), tags, lead, bytes(288 - len(lead)), *frames])


def _latin(raw: bytes) -> str:
    """A tag's text by its encoding byte."""
    kinds = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    return raw[1:].decode(kinds.get(raw[0], "latin-1"), "replace") if raw else ""


def _safe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _tags(stream: bytes) -> tuple[int, dict[str, str]]:
    """Where the audio can begin, and the text frames of an ID3v2 tag."""
    if stream[:3] != b"ID3" or len(stream) < 10:
        return 0, {}
    version, flags = stream[3], stream[5]
    end = min(len(stream), 10 + _safe(stream[6:10]))
    body, found, at = stream[10:end], {}, 0
    if flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and version > 2 and len(body) >= 4:
        at = _safe(body[:4]) if version == 4 else 4 + struct.unpack(">I", body[:4])[0]
    id_, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at : at + id_].strip(b"\x00"):
        name, size = body[at : at + id_].decode("latin-1"), body[at + id_ : at + id_ + id_]
        length = _safe(size) if version == 4 else int.from_bytes(size, "big")
        if name[0] == "T":
            value = _latin(body[at + head : at + head + length]).rstrip("\x00")
            if name in ("TXXX", "TXX"):
                name, _, value = value.partition("\x00")
            found[name] = value
        at += head + length
    return end + 10 * (version == 4 and flags >> 4 & 1), found


def _table(stream: bytes, at: int, body: int) -> dict | None:
    """The bit-rate table that a first frame may hold instead of audio: Xing or Info behind the side information, VBRI 32 bytes behind the header."""
    mark = stream[body : body + 4]
    if mark in (b"Xing", b"Info") and len(stream) >= body + 8:
        flags, k = struct.unpack(">I", stream[body + 4 : body + 8])[0], body + 8
        out = {"kind": mark.decode(), "at": at}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(stream[k : k + 4], "big")
                k += 4
        return out | ({"seek": stream[k : k + 100]} if flags & 4 else {})
    k = at + 36
    if stream[k : k + 4] == b"VBRI" and len(stream) >= k + 26:
        size, frames, entries, scale, width, step = struct.unpack(">IIHHHH", stream[k + 10 : k + 26])
        raw = stream[k + 26 : k + 26 + entries * width]
        lengths = [int.from_bytes(raw[j : j + width], "big") * scale for j in range(0, len(raw), width)] if width else []
        return {"kind": "VBRI", "at": at, "frames": frames, "bytes": size, "step": step, "lengths": lengths}
    return None


def parse(stream: bytes) -> dict:
    """Tags, frames (offset, length, Hz, CRC verdict), the bit-rate table, and the carried bytes."""
    at, tags = _tags(stream)
    end = len(stream)
    if stream[-128:-125] == b"TAG" and end - 128 >= at:
        end -= 128
        tags.setdefault("TIT2", stream[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1"))
    fixed, skipped, offsets, pieces, table, bad, seen, lost = None, 0, [], [], None, 0, 0, True
    heads: dict[bytes, bool] = {}
    while at + 4 <= end:
        four = stream[at : at + 4]
        h = parse_header(four)
        if h and fixed and (h["hz"], h["samples"]) != fixed or h and at + h["length"] > end:
            h = None
        if h and lost:  # after damage and at the start a header counts only if another, or the end, follows its frame
            n = parse_header(stream[at + h["length"] : at + h["length"] + 4])
            h = h if at + h["length"] == end or n and (n["hz"], n["samples"]) == (h["hz"], h["samples"]) else None
        if not h:
            nxt = stream.find(b"\xff", at + 1, end)
            skipped += (nxt if nxt >= 0 else end) - at
            at, lost = (nxt if nxt >= 0 else end), True
            continue
        fixed, lost = (h["hz"], h["samples"]), False
        body = at + 4 + 2 * h["protected"] + h["side"]
        if h["protected"]:
            side = stream[at + 4 : body]
            key = four + side
            if key not in heads:
                heads[key] = struct.unpack(">H", side[:2])[0] == crc16(four[2:] + side[2:])
            bad += not heads[key]
        found = None if seen else _table(stream, at, body)
        if found:
            table = found
        else:
            offsets.append(at)
            pieces.append(stream[body : at + h["length"]])
        seen += 1
        at += h["length"]
    carried = b"".join(pieces)
    if (n := tags.get("payload_bytes", "")).isdigit():
        carried = carried[: int(n)]
    hz, samples = fixed or (0, SAMPLES)
    return {"tags": tags, "hz": hz, "samples": samples, "offsets": offsets, "skipped": skipped, "crc_errors": bad, "table": table, "payload": carried, "end": at}


def seek_offset(parsed: dict, seconds: float) -> int | None:
    """The byte offset of the frame that plays at this second."""
    k = int(seconds * parsed["hz"] // parsed["samples"])
    return parsed["offsets"][k] if 0 <= k < len(parsed["offsets"]) else None


def seek_points(starts: np.ndarray, total: int) -> bytes:
    """Where in 256ths of the stream each hundredth of the frames begins; starts: offsets of the frames."""
    return bytes(np.minimum(255, starts[np.arange(100) * len(starts) // 100] * 256 // total).astype(np.uint8))


def features(parsed: dict) -> str:
    """Exact duration as samples over Hz, frame count, and agreement of the stored table, seek points included, with the frames."""
    table, offsets = parsed["table"], parsed["offsets"]
    agrees = bool(table) and table.get("frames") == len(offsets) and table.get("bytes") == parsed["end"] - table["at"]
    seeks = np.array(offsets, "<i8")
    if agrees and "seek" in table:
        agrees = bool(offsets) and table["seek"] == seek_points(seeks - table["at"], table["bytes"])
    if agrees and "lengths" in table:  # a VBRI table gives the bytes of every `step` frames
        ends = np.append(seeks, parsed["end"])
        agrees = table["lengths"] == np.diff(ends[np.minimum(np.arange(len(table["lengths"]) + 1) * table["step"], len(offsets))]).tolist()
    return json.dumps(
        {
            "samples": parsed["samples"] * len(offsets),
            "hz": parsed["hz"],
            "frames": len(offsets),
            "vbr": bool(table) and table["kind"] != "Info",
            "table_agrees": agrees,
            "crc_errors": parsed["crc_errors"],
            "skipped": parsed["skipped"],
            "first": offsets[0] if offsets else None,
            "last": offsets[-1] if offsets else None,
            "seek_crc32": zlib.crc32(seeks.tobytes()),
        },
        separators=(",", ":"),
    )


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def media(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """doc_id, the measures of the stored stream, and, if keep_media, the stream and its frame offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            raw = data.tobytes()
            for lo, hi in common.blocks(offsets):
                rows = []
                for k in range(lo, hi):
                    own = raw[offsets[k] : offsets[k + 1]]
                    stream = build(padded(own))
                    got = parse(stream)
                    rows.append((len(own), len(got["payload"]), common.sha(got["payload"]), zlib.crc32(got["payload"][-16:]), len(stream), common.sha(stream), features(got), stream, got["offsets"]))
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media", "frame_offsets"] * keep_media
                columns = {"doc_id": batch.column("doc_id").slice(lo, hi - lo)}
                columns |= {n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=False)}
                kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "frame_offsets": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_pydict({n: pa.array(c, kinds[n]) if n in kinds else c for n, c in columns.items()})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.texts(docs).mapInArrow(run, schema + ", media binary, frame_offsets array<long>" * keep_media)
