"""MPEG audio in a column: frame headers with resynchronisation, tags, variable-bitrate tables, checksums, exact
durations and the offset of every frame; and a lossless carrier that keeps bytes in the frames' main data."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from ._common import materialize, pieces

#: Fixed values of ISO 11172-3 and 13818-3: kbit/s by (MPEG-1 or not, layer), Hz by version, nbal of Layer II by table.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (0, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (0, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (0, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
NBAL = {"a": (4,) * 11 + (3,) * 12 + (2,) * 4, "b": (4,) * 11 + (3,) * 12 + (2,) * 7, "c": (4,) * 2 + (3,) * 6, "d": (4,) * 2 + (3,) * 10, "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19}
#: The least common multiple of all sampling rates: durations are whole numbers of these ticks.
TICKS = 14_112_000

SCHEMA = (
    "version string, layer int, sample_rate int, channels int, n_frames long, samples long, duration_ticks long, duration_s double, "
    "min_kbps int, max_kbps int, vbr_kind string, vbr_frames long, vbr_bytes long, vbr_toc array<int>, encoder_delay int, encoder_padding int, "
    "crc_checked long, crc_bad long, skipped_bytes long, tags map<string,string>, frame_offsets array<long>"
)


@lru_cache(1 << 14)
def header(word: bytes) -> tuple | None:
    """(bytes, samples, Hz, kbit/s, version bits, layer, channels, mode extension, has CRC, side bytes) of four header bytes."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, crc = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), not word[1] & 1
    rate, kbps, pad = word[2] >> 2 & 3, word[2] >> 4, word[2] >> 1 & 1
    if version == 1 or layer == 4 or rate == 3 or kbps in (0, 15) or word[3] & 3 == 2:
        return None
    hz, kbps, mode = RATES[version][rate], BITRATES[version == 3, layer][kbps], word[3] >> 6
    if layer == 1:
        size, samples = (12_000 * kbps // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * 1000 * kbps // hz + pad
    side = ((17 if mode == 3 else 32) if version == 3 else (9 if mode == 3 else 17)) if layer == 3 else 0
    return size, samples, hz, kbps, version, layer, 1 if mode == 3 else 2, (word[3] >> 4 & 3) if mode == 1 else -1, crc, side


_CRC = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1 ^ 0x8005 if _c & 0x8000 else _c << 1) & 0xFFFF
    _CRC.append(_c)


@lru_cache(1 << 12)
def crc16(data: bytes, bits: int) -> int:
    """CRC-16 (polynomial 0x8005, all ones at the start) of the first bits of data."""
    crc = 0xFFFF
    for x in data[: bits // 8]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ x]
    for k in range(bits % 8):
        bit = (data[bits // 8] >> (7 - k) & 1) ^ crc >> 15
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if bit else 0)
    return crc


def _protected_bits(h: tuple, body: bytes) -> int:
    """How many bits behind the checksum it protects, by layer."""
    _, _, hz, kbps, version, layer, channels, joint, _, side = h
    if layer == 3:
        return 8 * side
    bound = 4 * (joint + 1) if joint >= 0 else 32
    if layer == 1:
        return 4 * (channels * min(bound, 32) + 32 - min(bound, 32))
    per = kbps // channels
    table = "lsf" if version != 3 else ("c" if hz != 32000 else "d") if per <= 48 else "a" if per <= 80 or hz == 48000 else "b"
    bits, used, value = 0, 0, int.from_bytes(body[:64].ljust(64, b"\0"))
    for band, n in enumerate(NBAL[table]):
        for _ in range(channels if band < bound else 1):
            code = value >> (512 - bits - n) & ((1 << n) - 1)
            bits += n
            used += (channels if band >= bound else 1) if code else 0
    return bits + 2 * used


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _decode(raw: bytes) -> str:
    kind, raw = raw[:1], raw[1:]
    name = {b"\1": "utf-16", b"\2": "utf-16-be", b"\3": "utf-8"}.get(kind, "latin-1")
    return raw.decode(name, "replace").rstrip("\0").replace("\0", "=")


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Tags, and where the audio between them starts and ends. Where an Info table tells the length of the audio and no
    byte is beyond it, the end of the last frame may look like a tag and is none."""
    tags, start, end = {}, 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= len(data) and not any(x & 0x80 for x in data[start + 6 : start + 10]):
        size, major = _syncsafe(data[start + 6 : start + 10]), data[start + 3]
        body, at = data[start + 10 : start + 10 + size], 0
        while major >= 3 and at + 10 <= len(body) and body[at : at + 4].isalnum():
            n = (_syncsafe if major == 4 else int.from_bytes)(body[at + 4 : at + 8])
            if body[at : at + 1] == b"T" and n:
                key, text = body[at : at + 4].decode(), _decode(body[at + 10 : at + 10 + n])
                if key == "TXXX":
                    key, _, text = text.partition("=")
                tags[key] = text
            at += 10 + n
        start += 10 + size + (10 if data[start + 5] & 0x10 else 0)
    if _told_end(data, start) == end:
        return tags, min(start, end), end
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        v1 = data[end - 128 : end]
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := v1[a:b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(key, text)
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, n, flags = (int.from_bytes(data[end - 32 + a : end - 28 + a], "little") for a in (12, 16, 20))
        at, stop = end - size, end - 32
        for _ in range(n if size <= end - start else 0):
            length, zero = int.from_bytes(data[at : at + 4], "little"), data.find(b"\0", at + 8, stop)
            if zero < 0:
                break
            tags.setdefault(data[at + 8 : zero].decode("latin-1"), data[zero + 1 : zero + 1 + length].decode("utf-8", "replace"))
            at = zero + 1 + length
        end = max(start, end - size - (32 if flags >> 31 else 0))
    return tags, min(start, end), end


def _told_end(data: bytes, start: int) -> int | None:
    """Where the audio ends by the table in its first frame, if that has one."""
    h = header(data[start : start + 4])
    table = _vbr(data, start, h) if h and start + h[0] <= len(data) else None
    return start + table["bytes"] if table and table.get("bytes") else None


def _vbr(data: bytes, at: int, h: tuple) -> dict | None:
    """The Xing/Info or VBRI table of a frame, if it holds one instead of sound."""
    for place in {at + 4 + h[9], at + 6 + h[9]}:
        if (kind := data[place : place + 4]) in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(data[place + 4 : place + 8]), place + 8, {"kind": kind.decode()}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key], p = int.from_bytes(data[p : p + 4]), p + 4
            if flags & 4:
                out["toc"], p = list(data[p : p + 100]), p + 100
            p += 4 if flags & 8 else 0
            if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and p + 24 <= at + h[0]:
                gap = int.from_bytes(data[p + 21 : p + 24])
                out["delay"], out["padding"] = gap >> 12, gap & 0xFFF
            return out
    if data[at + 36 : at + 40] == b"VBRI":
        size, frames = int.from_bytes(data[at + 46 : at + 50]), int.from_bytes(data[at + 50 : at + 54])
        n, scale, width = (int.from_bytes(data[at + a : at + a + 2]) for a in (54, 56, 58))
        toc = [int.from_bytes(data[p : p + width]) * scale for p in range(at + 62, min(at + 62 + n * width, at + h[0]), max(1, width))]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def _next_frame(data: bytes, at: int, end: int) -> int:
    """The first offset from which two frames (or one that ends the sound) follow each other, or end."""
    while 0 <= (at := data.find(b"\xff", at, end)) < end:
        if (h := header(data[at : at + 4])) and at + h[0] <= end and (at + h[0] == end or header(data[at + h[0] : at + h[0] + 4])):
            return at
        at += 1
    return end


def parse(data: bytes | None) -> dict | None:
    """What SCHEMA lists, of one stream. None for null; streams without a frame have n_frames 0 and null formats."""
    if data is None:
        return None
    tags, start, end = _tags(data)
    offsets, samples, ticks, skipped, checked, bad, rates, vbr, first = [], 0, 0, 0, 0, 0, [], None, None
    at = start
    while at < end:
        h = header(data[at : at + 4])
        ok = h is not None and at + h[0] <= end
        if not ok or (at + h[0] < end and header(data[at + h[0] : at + h[0] + 4]) is None):
            # what no frame follows is one itself only if none starts within it
            found = _next_frame(data, at + 1, end)
            if not ok or found < at + h[0] or not offsets:
                skipped += found - at
                at = found
                continue
        size, n, hz, kbps, *_ = h
        if h[8]:
            body = data[at + 6 : at + 6 + max(h[9], 64)]
            bits = _protected_bits(h, body)
            checked += 1
            bad += crc16(data[at + 2 : at + 4] + body[: -(-bits // 8)], 16 + bits) != int.from_bytes(data[at + 4 : at + 6])
        if first is None:
            first = h
            if (vbr := _vbr(data, at, h)) is not None:
                at += size  # a table, not sound
                continue
        offsets.append(at)
        samples += n
        ticks += n * (TICKS // hz)
        rates.append(kbps)
        at += size
    vbr, h = vbr or {}, first or (None,) * 10
    return {
        "version": {3: "1", 2: "2", 0: "2.5"}.get(h[4]), "layer": h[5], "sample_rate": h[2], "channels": h[6], "n_frames": len(offsets), "samples": samples,
        "duration_ticks": ticks, "duration_s": ticks / TICKS, "min_kbps": min(rates, default=None), "max_kbps": max(rates, default=None), "vbr_kind": vbr.get("kind"),
        "vbr_frames": vbr.get("frames"), "vbr_bytes": vbr.get("bytes"), "vbr_toc": vbr.get("toc"), "encoder_delay": vbr.get("delay"), "encoder_padding": vbr.get("padding"),
        "crc_checked": checked, "crc_bad": bad, "skipped_bytes": skipped, "tags": tags, "frame_offsets": offsets,
    }


# ---- carrying bytes -------------------------------------------------------------------------------------------------

_HEAD = bytes((0xFF, 0xFA, 0xE8, 0x00))  # MPEG-1 Layer III, checksum, 320 kbit/s, 32 kHz, stereo: 1440 bytes a frame
_SIZE, _SIDE = header(_HEAD)[0], header(_HEAD)[9]
_FRONT = _HEAD + crc16(_HEAD[2:] + bytes(_SIDE), 16 + 8 * _SIDE).to_bytes(2) + bytes(_SIDE)
#: Bytes that a frame carries.
UNIT = _SIZE - len(_FRONT)
_LENGTH = "CARRIED_BYTES"


def carry(payload: bytes) -> bytes:
    """An MPEG stream with payload as the frames' main data (granules of length 0 leave all of it ancillary), an ID3v2.4 tag with its length and an Info table."""
    n = -(-len(payload) // UNIT)
    frames = np.zeros((n, _SIZE), np.uint8)
    frames[:, : len(_FRONT)] = np.frombuffer(_FRONT, np.uint8)
    body = np.zeros(n * UNIT, np.uint8)
    body[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames[:, len(_FRONT) :] = body.reshape(n, UNIT)
    total = (n + 1) * _SIZE
    toc = bytes(min(255, (1 + i * n // 100) * _SIZE * 256 // total) for i in range(100))
    info = bytes((0xFF, 0xFB, *_HEAD[2:])) + bytes(_SIDE) + b"Info" + (7).to_bytes(4) + n.to_bytes(4) + total.to_bytes(4) + toc
    text = b"\3" + _LENGTH.encode() + b"\0" + str(len(payload)).encode()
    safe = lambda v: bytes(v >> s & 127 for s in (21, 14, 7, 0))
    frame = b"TXXX" + safe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + safe(len(frame)) + frame + info.ljust(_SIZE, b"\0") + frames.tobytes()


def carried(data: bytes, parsed: dict) -> bytes:
    """The payload that carry() stored."""
    parts = [data[o + len(_FRONT) : o + _SIZE] for o in parsed["frame_offsets"]]
    return b"".join(parts)[: int(parsed["tags"][_LENGTH])]


# ---- DataFrames ------------------------------------------------------------------------------------------------------


def analyse_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with a struct column ``audio`` (SCHEMA) for each stream in media_col; null streams give null.

    Empty or damaged streams give n_frames 0 or the frames that can be found, with the bytes skipped. A column named
    audio that df has already is replaced. Repeated rows and other columns pass through.
    """
    rest = [c for c in df.columns if c != "audio"]
    kept = df.select(*rest)
    out = StructType([*kept.schema.fields, StructField("audio", StructType.fromDDL(SCHEMA))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _audio_type()
        for batch in pieces(batches, 500):
            rows = [parse(v.as_py()) for v in batch.column(media_col)]
            for r in rows:
                if r is not None:
                    r["tags"] = list(r["tags"].items())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kinds)], [*rest, "audio"])

    return kept.mapInArrow(run, out)


def _audio_type() -> pa.DataType:
    names = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.struct([pa.field(*(k, names[t])) for k, t in (x.strip().split(" ", 1) for x in SCHEMA.split(", "))])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text's UTF-8 bytes (null: none), padded with bytes 0 to a positive multiple of 64, as an MPEG stream.

    Rows that repeat an id, and null ids, each have theirs; other columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 500):
            n, media = [], []
            for v in batch.column(1).cast(pa.large_binary()):
                raw = v.as_py() or b""
                n.append(len(raw))
                media.append(carry(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def digest_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads stored streams back: the payload's and the stream's digests and what parse() finds, as one string. One row for each
    row of store_texts(), none for an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column("media"):
                data = v.as_py()
                p = parse(data)
                payload = carried(data, p)
                seek = zlib.crc32(np.array(p["frame_offsets"], "<i8").tobytes())
                feature = f"mpeg{p['version']}-layer{p['layer']} rate={p['sample_rate']} frames={p['n_frames']}/{p['vbr_frames']} samples={p['samples']} ticks={p['duration_ticks']} kbps={p['min_kbps']}-{p['max_kbps']} crc={p['crc_checked'] - p['crc_bad']}/{p['crc_checked']} skipped={p['skipped_bytes']} seek={seek:08x}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema[id_col].dataType.simpleString()
    return stored.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    stored = store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digest_media(materialize(stored, "media", compression="zstd"))
