"""MPEG audio columns: Layer III streams written from bytes, resynchronised, parsed, checked and indexed for seeking.

A payload rides losslessly in the ancillary data of silent MPEG-1 Layer III frames, 192 bytes a frame (32 kHz, 48 kbit/s,
mono, protected). Their side information says that no bits of main data are used, so the rest of a frame is free.
The reader takes any Layer I, II or III stream: it skips tags, finds frame headers again after damage, reads Xing, Info and
VBRI tables, verifies checksums and reports durations in exact samples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rulelens.llm.common import by_batch

UNIT = 192  # payload bytes of a frame

# Fixed values of ISO 11172-3 and 13818-3: kbit/s by (version 1 or 2, layer), Hz by version, samples a frame.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by the version bits
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

HEADER = bytes([0xFF, 0xFA, 0x38, 0xC0])  # MPEG-1 Layer III with checksum, 48 kbit/s, 32 kHz, mono
FRAME, SIDE, BODY = 216, 17, 23  # bytes of a frame, of its side information, before its ancillary data


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table.astype(np.uint32)


CRC = _crc_table()


def checksums(covered: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of an array of bytes, as MPEG audio starts and shifts it."""
    crc = np.full(len(covered), 0xFFFF, dtype=np.uint32)
    for column in covered.T:
        crc = ((crc << 8) & 0xFFFF) ^ CRC[(crc >> 8) ^ column]
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes((n >> shift) & 0x7F for shift in (21, 14, 7, 0))


def _silent(payload: np.ndarray) -> np.ndarray:
    """One frame for each row of ``payload``."""
    frames = np.zeros((len(payload), FRAME), dtype=np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, dtype=np.uint8)
    crc = int(checksums(np.frombuffer(HEADER[2:] + bytes(SIDE), dtype=np.uint8)[None])[0])
    frames[:, 4:6] = crc >> 8, crc & 255
    frames[:, BODY : BODY + UNIT] = payload
    return frames


def padded(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of the unit."""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode(data: bytes) -> bytes:
    """A tagged stream: ID3v2 with the unpadded length, an Info frame with its seek table, one frame a unit, ID3v1."""
    payload = np.frombuffer(padded(data), dtype=np.uint8).reshape(-1, UNIT)
    text = b"\x03length\x00%d" % len(data)
    tag = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    n, size = len(payload), (len(payload) + 1) * FRAME
    info = _silent(np.zeros((1, UNIT), dtype=np.uint8))
    where = (1 + np.arange(100) * n // 100) * FRAME  # a hundredth of the duration each
    table = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + size.to_bytes(4, "big") + (where * 256 // size).astype(np.uint8).tobytes()
    info[0, BODY : BODY + len(table)] = np.frombuffer(table, dtype=np.uint8)
    last = b"TAG" + bytes(124) + b"\xff"
    return b"ID3\x04\x00\x00" + _syncsafe(len(tag)) + tag + info.tobytes() + _silent(payload).tobytes() + last


def header_at(data: bytes, at: int) -> tuple | None:
    """(version bits, layer, protected, kbit/s, Hz, mono, bytes, samples) of the frame header at ``at``, if there is one."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = (data[at + 1] >> 3) & 3, 4 - ((data[at + 1] >> 1) & 3)
    rate, speed = (data[at + 2] >> 2) & 3, data[at + 2] >> 4
    if version == 1 or layer == 4 or rate == 3 or speed in (0, 15):  # reserved, or a free format without a length
        return None
    kind = 1 if version == 3 else 2
    kbits, hz, samples = KBITS[kind, layer][speed], RATES[version][rate], SAMPLES[kind, layer]
    pad = (data[at + 2] >> 1) & 1
    size = (12 * kbits * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hz + pad
    return version, layer, not data[at + 1] & 1, kbits, hz, data[at + 3] >> 6 == 3, size, samples


def _same_stream(a: tuple, b: tuple) -> bool:
    return a[0] == b[0] and a[1] == b[1] and a[4] == b[4]


def resynchronise(data: bytes, at: int, end: int) -> int:
    """The next place from ``at`` with a header that another of its kind, or the end, follows; ``end`` if there is none."""
    while (at := data.find(b"\xff", at, end)) >= 0:
        head = header_at(data, at)
        if head and at + head[6] <= end:
            after = header_at(data, at + head[6]) if at + head[6] < end else head
            if after and _same_stream(head, after):
                return at
        at += 1
    return end


def tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """Where the frames begin and end, and the text fields of the ID3v2 and ID3v1 tags around them."""
    at, end, found = 0, len(data), {}
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        size = sum((b & 0x7F) << shift for b, shift in zip(data[at + 6 : at + 10], (21, 14, 7, 0)))
        stop, p = min(at + 10 + size, len(data)), at + 10
        wide = data[at + 3] < 4  # version 3 writes plain lengths
        while p + 10 <= stop and data[p : p + 1].isalnum():
            n = int.from_bytes(data[p + 4 : p + 8], "big") if wide else sum((b & 0x7F) << shift for b, shift in zip(data[p + 4 : p + 8], (21, 14, 7, 0)))
            body = data[p + 10 : min(p + 10 + n, stop)]
            if data[p : p + 1] == b"T" and body:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8")
                name, _, value = body[1:].decode(code, "replace").partition("\0")
                key = data[p : p + 4].decode("latin-1")
                found[name if key == "TXXX" else key] = value if key == "TXXX" else name
            p += 10 + n
        at = stop + 10 * bool(data[at + 5] & 0x10)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if value := data[end + lo : end + hi].rstrip(b"\0 "):
                found.setdefault(key, value.decode("latin-1"))
    return min(at, end), end, found


def frames(data: bytes, at: int, end: int) -> tuple[np.ndarray, list[tuple], int]:
    """Offsets and headers of all frames, and the bytes skipped to find them again. Runs of like frames are taken at once."""
    offsets, heads, skipped = [], [], 0
    raw = np.frombuffer(data, dtype=np.uint8)
    while at < end:
        head = header_at(data, at)
        if head is None or at + head[6] > end or (at + head[6] < end and header_at(data, at + head[6]) is None and resynchronise(data, at, end) != at):
            found = resynchronise(data, at + 1, end)
            skipped, at = skipped + found - at, found
            continue
        size, run = head[6], 1
        if more := (end - at) // size - 1:  # how many frames with the very same header follow without a gap
            grid = raw[at + size : at + size * (more + 1)].reshape(more, size)[:, :4]
            differs = (grid != raw[at : at + 4]).any(axis=1)
            run += int(differs.argmax()) if differs.any() else more
        offsets.append(at + size * np.arange(run))
        heads += [(head, run)]
        at += size * run
    return (np.concatenate(offsets) if offsets else np.zeros(0, dtype=np.int64)), heads, skipped


def table_of(data: bytes, at: int, head: tuple) -> tuple[str, int | None, int | None, bytes] | None:
    """The variable-bitrate table in a first frame: its kind, number of frames, bytes and seek table."""
    side = (17 if head[5] else 32) if head[0] == 3 else (9 if head[5] else 17)
    for start in (at + 4 + side, at + 6 + side):
        if (kind := data[start : start + 4]) in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[start + 4 : start + 8], "big"), start + 8
            values: list[int | None] = []
            for bit in (1, 2):
                values.append(int.from_bytes(data[p : p + 4], "big") if flags & bit else None)
                p += 4 * bool(flags & bit)
            return kind.decode(), values[0], values[1], data[p : p + 100] if flags & 4 else b""
    if data[at + 36 : at + 40] == b"VBRI":
        size, n = int.from_bytes(data[at + 46 : at + 50], "big"), int.from_bytes(data[at + 50 : at + 54], "big")
        entries, width = int.from_bytes(data[at + 54 : at + 56], "big"), int.from_bytes(data[at + 58 : at + 60], "big")
        return "VBRI", n, size, data[at + 62 : at + 62 + entries * width]
    return None


def parse(data: bytes) -> dict:
    """Everything known of a stream; damaged or foreign bytes are counted, never an error."""
    start, end, fields = tags(data)
    offsets, heads, skipped = frames(data, start, end)
    table = table_of(data, int(offsets[0]), heads[0][0]) if len(offsets) else None
    raw, bad, protected, place = np.frombuffer(data, dtype=np.uint8), 0, 0, 0
    for head, run in heads:
        if head[2] and head[1] == 3:
            side = (17 if head[5] else 32) if head[0] == 3 else (9 if head[5] else 17)
            covered = raw[offsets[place : place + run, None] + np.r_[2:4, 6 : 6 + side]]
            told = raw[offsets[place : place + run, None] + np.r_[4:6]].astype(np.uint32)
            bad += int((checksums(covered) != (told[:, 0] << 8 | told[:, 1])).sum())
            protected += run
        place += run
    skip = int(table is not None)  # the table's frame is silent and not played
    samples = sum(h[7] * n for h, n in heads) - (heads[0][0][7] if skip else 0)
    rate = heads[0][0][4] if heads else 0
    return {"fields": fields, "offsets": offsets[skip:], "samples": samples, "rate": rate, "table": table, "frames": len(offsets) - skip, "skipped": skipped, "protected": protected, "bad": bad, "kbits": sorted({h[3] for h, _ in heads})}


def payload_of(data: bytes, found: dict) -> bytes:
    """The padded payload that ``encode`` stored."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(found["offsets"]):
        return b""
    return raw[found["offsets"][:, None] + np.arange(BODY, BODY + UNIT)].tobytes()


SEEK_EVERY = 28  # frames between two kept seek points: about a second at 32 kHz


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = [encode((t or "").encode()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and media: every whole text as an MPEG stream.

    Null and empty text: one frame of spaces. Null doc_id, ties and repeated rows: kept as they are, row by row. Other columns
    are ignored. An empty table gives no rows. A text is held by one task at a time; batches are bounded in bytes.
    """
    return by_batch(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _encode_batches, "doc_id long, media binary")


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "payload", "media_bytes", "media_sha256", "n_bytes", "frames", "samples", "rate", "duration_us", "kbits", "table_kind", "table_frames", "protected", "bad_checksums", "skipped", "seek"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    for b in batches:
        rows = []
        for doc_id, media in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
            media = media or b""
            found = parse(media)
            length, table = found["fields"].get("length"), found["table"]
            rows.append((
                doc_id, payload_of(media, found) if length is not None else None, len(media), hashlib.sha256(media).hexdigest(), int(length) if length and length.isdigit() else None, found["frames"], found["samples"], found["rate"],
                found["samples"] * 1_000_000 // found["rate"] if found["rate"] else 0, found["kbits"], table and table[0], table and table[1], found["protected"], found["bad"], found["skipped"], found["offsets"][::SEEK_EVERY].tolist(),
            ))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)


def parse_media(media: DataFrame) -> DataFrame:
    """Each stream of (doc_id, media) read back: payload, exact samples and duration, tables, checksums, seek offsets.

    Null or foreign media: no frames, duration 0, null payload. Bytes that belong to no frame are counted in ``skipped``.
    """
    return by_batch(
        media.select("doc_id", "media"), _parse_batches,
        "doc_id long, payload binary, media_bytes long, media_sha256 string, n_bytes long, frames long, samples long, rate int, duration_us long, kbits array<int>, table_kind string, table_frames long, protected long, bad_checksums long, skipped long, seek array<long>",
    )


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        r, rows = b.to_pydict(), []
        for i, p in enumerate(r["payload"]):
            seek = zlib.crc32(np.array(r["seek"][i], dtype="<i8").tobytes())
            feature = f"{r['frames'][i]} frames, {r['samples'][i]} samples at {r['rate'][i]}, {r['duration_us'][i]} us, {r['kbits'][i]} kbit/s, {r['table_kind'][i]} {r['table_frames'][i]}, {r['bad_checksums'][i]} of {r['protected'][i]} bad, {r['skipped'][i]} skipped, seek {seek:08x}"
            rows.append((r["doc_id"][i], r["n_bytes"][i], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), r["media_bytes"][i], r["media_sha256"][i], feature))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_digest(docs: DataFrame) -> DataFrame:
    """The digest of every text's stream after a round trip: what went in, what came back, what the stream says of itself."""
    return by_batch(parse_media(to_media(docs)), _digest_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
