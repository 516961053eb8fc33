import hashlib
import json
import os
import zlib

from wavecairn.llm import audio, common
from wavecairn.llm.queries import op6_mpeg_audio


def test_round_trip_of_any_bytes():
    for n in (0, 1, 121, 122, 1416, 1417, 1418, 2834, 100_000):
        raw = os.urandom(n) + b"\xff\xfa\x38\xc0" * (n > 1000)
        got = audio.parse(audio.build(raw))
        assert got["payload"] == raw and not got["crc_errors"] and not got["skipped"]
        assert json.loads(audio.features(got))["table_agrees"]
        assert audio.seek_offset(got, 0) == got["offsets"][0]


def test_damage_is_found_and_resynchronised():
    stream = audio.build(b"some payload " * 2000)
    whole = audio.parse(stream)
    at = whole["offsets"][3]
    broken = audio.parse(stream[:at] + b"junk" + stream[at:])
    assert broken["skipped"] == 4 and len(broken["offsets"]) == len(whole["offsets"])
    flipped = bytearray(stream)
    flipped[at + 10] ^= 1
    assert audio.parse(bytes(flipped))["crc_errors"] == 1
    lost = bytearray(stream)
    lost[at] = 0
    assert len(audio.parse(bytes(lost))["offsets"]) == len(whole["offsets"]) - 1
    assert audio.parse(b"")["offsets"] == [] and audio.parse(b"\xff" * 50)["offsets"] == []


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in op6_mpeg_audio(spark, sf_dir).collect()}
    for d in common.documents(spark, sf_dir).collect():
        raw = (d.text or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pay[-16:])


def test_null_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (None, "é" * 7, 7)], "doc_id long, text string, n_bytes int")
    got = audio.media(docs).collect()
    assert sorted(r.n_bytes for r in got) == [0, 0, 0, 14] and {r.payload_bytes for r in got} == {192}
    assert audio.media(docs.limit(0)).count() == 0


def test_wrong_seek_points_do_not_agree():
    stream = audio.build(os.urandom(50_000))
    whole = audio.parse(stream)
    assert json.loads(audio.features(whole))["table_agrees"]
    for k in (0, 50, 99):
        wrong = bytearray(stream)
        wrong[stream.index(whole["table"]["seek"]) + k] ^= 1
        assert not json.loads(audio.features(audio.parse(bytes(wrong))))["table_agrees"]


def second_reader(stream):
    """The plain features of a stream of the query's kind, by another way: frames are found from the end of the tag by their table of lengths."""
    lengths = {k: 144_000 * r // 32_000 for k, r in enumerate(audio.BIT_RATES) if r}
    size = sum((b & 127) << (21 - 7 * k) for k, b in enumerate(stream[6:10]))
    at, starts = 10 + size, []
    while at < len(stream):
        assert stream[at : at + 2] == b"\xff\xfa"
        starts.append(at)
        at += lengths[stream[at + 2] >> 4]
    assert at == len(stream)
    told = stream[starts[0] + 23 :]
    sizes = {b - a for a, b in zip(starts[1:], [*starts[2:], at], strict=True)}
    total, frames = at - starts[0], len(starts) - 1
    seek = bytes(min(255, (starts[1 + k * frames // 100] - starts[0]) * 256 // total) for k in range(100))
    agrees = told[8:12] == frames.to_bytes(4, "big") and told[12:16] == total.to_bytes(4, "big") and told[16:116] == seek
    places = b"".join(s.to_bytes(8, "little") for s in starts[1:])
    return {"samples": 1152 * frames, "hz": 32000, "frames": frames, "vbr": len(sizes) > 1, "table_agrees": agrees, "crc_errors": 0, "skipped": 0, "first": starts[1], "last": starts[-1], "seek_crc32": zlib.crc32(places)}


def test_features_by_a_second_reader(spark, sf_dir):
    for r in audio.media(common.documents(spark, sf_dir)).collect():
        want = second_reader(bytes(r.media))
        assert json.loads(r.feature) == want and want["table_agrees"] and list(r.frame_offsets)[0] == want["first"]


def low_frame(k, version, mode=3, fill=b""):
    """A frame of MPEG-2 (2) or 2.5 (0) at the lowest sample rate index, without CRC."""
    hz = 44100 // (2 if version == 2 else 4)
    length = 72_000 * audio.LOW_BIT_RATES[k] // hz
    head = bytes([0xFF, 0xE3 | version << 3, k << 4, mode << 6])
    return (head + bytes(9 if mode == 3 else 17) + fill).ljust(length, b"\0")


def test_other_versions_modes_and_tables():
    for version, hz in ((2, 22050), (0, 11025)):
        frames = [low_frame(k, version, mode, b"part %d" % k) for k, mode in ((8, 3), (9, 0), (8, 1), (8, 3))]
        got = audio.parse(b"".join(frames))
        assert got["hz"] == hz and got["samples"] == 576 and len(got["offsets"]) == 4 and not got["skipped"] and got["payload"].startswith(b"part 8")
        body = [low_frame(8, version) for _ in range(6)]
        n = len(body[0])
        told = b"VBRI" + bytes(6) + (7 * n).to_bytes(4, "big") + (6).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (3, 2, 2, 2)) + (n).to_bytes(2, "big") * 3
        lead = (low_frame(8, version)[:36] + told).ljust(n, b"\0")
        assert json.loads(audio.features(audio.parse(lead + b"".join(body))))["table_agrees"]
        assert not json.loads(audio.features(audio.parse(lead + b"".join(body[:5]))))["table_agrees"]


def test_tags_of_all_versions():
    audio_part = audio.build(b"x" * 500)
    start = audio._tags(audio_part)[0]
    frames = audio_part[start:]
    safe = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    text = b"\x03" + "Grüße ".encode() * 40
    four = b"TIT2" + safe(len(text)) + b"\0\0" + text
    extended = safe(6) + b"\x01\x00"
    two = b"TT2" + len(text).to_bytes(3, "big") + b"\x00" + "Gr\xfc\xdfe ".encode("latin-1") * 40
    two = b"TT2" + (len(two) - 6).to_bytes(3, "big") + two[6:]
    plain = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\x00a\xffb"
    cases = [(4, 0x40, extended + four, "TIT2", "Grüße " * 40), (2, 0, two, "TT2", "Grüße " * 40), (3, 0x80, plain.replace(b"\xff", b"\xff\x00"), "TIT2", "a\xffb")]
    for version, flags, body, name, want in cases:
        got = audio.parse(b"ID3" + bytes([version, 0, flags]) + safe(len(body)) + body + frames)
        assert got["tags"][name] == want and not got["skipped"] and got["payload"][:500] == b"x" * 500
