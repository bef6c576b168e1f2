"""Media columns that hold MPEG audio: write, resynchronise, verify, index.

``probe`` reads any byte string as an MPEG audio stream (versions 1, 2 and 2.5, layers I to III): it
skips and parses ID3 tags at both ends, finds frame headers again after foreign bytes by asking for a
second consistent header where the first one says the next frame starts, reads the Xing/Info and VBRI
tables of variable-bitrate files, checks the 16-bit checksum of every protected frame, and returns the
exact duration as samples over the sampling rate together with the byte offset of every frame.

``encode`` stores a payload losslessly in such a stream: units of 192 bytes travel as ancillary data of
protected layer III frames (one to four units a frame, hence four bitrates and a Xing table with 100
seek points), and ``read_back`` returns them from the stored bytes.

Defined cases: null counts as empty; an empty payload is one unit of blanks; a stream without any frame
has duration 0 and no offsets; bytes that belong to no frame or tag are counted as ``skipped``; a last
frame that is cut short is dropped and its bytes are skipped; a frame of free-format bitrate is not
recognised; equal texts give equal values in every column; repeated rows are answered one by one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import documents

NAME = "op6_mpeg_audio_columns"
ORACLE = None  # frames cannot be written in SQL
UNIT = 192
BATCH_BYTES = 16 << 20

# Fixed values of the MPEG audio standards. Bitrates in kbit/s by (MPEG-1?, layer), index 1 to 14.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
CRC_POLYNOMIAL = 0x8005


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ (CRC_POLYNOMIAL if value & 0x8000 else 0)
        out.append(value & 0xFFFF)
    return out


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """Checksum of a frame's protected bytes: the header's last two and the side information."""
    table, value = _crc_table(), 0xFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFF) ^ table[(value >> 8) ^ byte]
    return value


@lru_cache(maxsize=4096)
def header(four: bytes) -> tuple | None:
    """``(length, samples, rate, kbps, version, layer, protected, side_bytes)`` of a frame header, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    bit, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or bit in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    first, hz, pad = version == "1", RATES[version][rate], four[2] >> 1 & 1
    kbps = BITRATES[first, layer][bit - 1]
    if layer == 1:
        samples, length = 384, (12 * kbps * 1000 // hz + pad) * 4
    else:
        samples = 576 if layer == 3 and not first else 1152
        length = samples // 8 * kbps * 1000 // hz + pad
    mono = four[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return length, samples, hz, kbps, version, layer, not four[1] & 1, side


def _syncsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def leading_tags(data: bytes) -> tuple[int, dict[str, str]]:
    """Where audio may start after ID3v2 tags, and the text frames of those tags."""
    at, found = 0, {}
    while data[at: at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6: at + 10]) < 0x80:
        major, size = data[at + 3], _syncsafe(data[at + 6: at + 10])
        end = min(len(data), at + 10 + size)
        p = at + 10
        while major in (3, 4) and p + 10 <= end and data[p: p + 4].isalnum():
            n = _syncsafe(data[p + 4: p + 8]) if major == 4 else int.from_bytes(data[p + 4: p + 8], "big")
            body = data[p + 10: min(end, p + 10 + n)]
            if data[p: p + 1] == b"T" and body:
                name = data[p: p + 4].decode("ascii")
                encoding = {1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                found[name] = body[1:].decode(encoding, "replace").rstrip("\0")
            p += 10 + n
        at = at + 10 + size + (10 if data[at + 5] & 0x10 else 0)
    return min(at, len(data)), found


def trailing_tag(data: bytes) -> tuple[int, dict[str, str]]:
    """Where audio ends before an ID3v1 tag, and its fields."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return len(data), {}
    tag = data[-128:]
    text = lambda a, b: tag[a:b].split(b"\0")[0].decode("latin-1").rstrip()
    return len(data) - 128, {"v1_title": text(3, 33), "v1_artist": text(33, 63), "v1_album": text(63, 93), "v1_year": text(93, 97)}


def vbr_table(frame: bytes, side: int) -> dict | None:
    """The Xing/Info or VBRI table of a stream's first frame."""
    for at in (4 + side, 6 + side):
        if frame[at: at + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(frame[at + 4: at + 8], "big"), at + 8
            out = {"kind": frame[at: at + 4].decode()}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key] = int.from_bytes(frame[p: p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(frame[p: p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        count, scale, width, per = (int.from_bytes(frame[54 + 2 * i: 56 + 2 * i], "big") for i in range(4))
        toc = [int.from_bytes(frame[62 + width * i: 62 + width * (i + 1)], "big") * scale for i in range(count)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "toc": toc, "per": per}
    return None


def probe(data: bytes) -> dict:
    """Everything the frames of a stream tell; ``frames`` holds ``(offset, length, samples, rate, kbps, crc_ok)``."""
    start, tags = leading_tags(data)
    end, old = trailing_tag(data)
    end = max(end, start)
    frames, skipped, at, locked, table = [], 0, start, False, None
    while at < end:
        head = header(data[at: at + 4])
        fits = head is not None and at + head[0] <= end
        if fits and not locked:  # after foreign bytes one header proves nothing: the next must agree in version, layer and rate
            after = header(data[at + head[0]: at + head[0] + 4])
            fits = at + head[0] == end or (after is not None and (after[2], after[4], after[5]) == (head[2], head[4], head[5]))
        if not fits:
            nxt = data.find(b"\xff", at + 1, end)
            skipped += (nxt if nxt >= 0 else end) - at
            at, locked = (nxt if nxt >= 0 else end), False
            continue
        length, samples, hz, kbps, _, layer, protected, side = head
        frame = data[at: at + length]
        if not frames and table is None and layer == 3 and (table := vbr_table(frame, side)):
            table["offset"] = at
        else:
            good = crc16(frame[2:4] + frame[6: 6 + side]) == int.from_bytes(frame[4:6], "big") if protected and layer == 3 else None
            frames.append((at, length, samples, hz, kbps, good))
        at, locked = at + length, True
    return {"tags": tags | old, "table": table, "frames": frames, "skipped": skipped}


def seek(info: dict, fraction: float) -> int:
    """Byte offset of the frame that plays at ``fraction`` of the duration."""
    frames = info["frames"]
    return frames[min(len(frames) - 1, int(fraction * len(frames)))][0] if frames else 0


# Bytes before the payload in an own frame: header, checksum, mono side information.
OWN_HEAD = 4 + 2 + 17
UNITS_TO_KBPS = {1: 80, 2: 160, 3: 224, 4: 320}


@lru_cache(maxsize=8)
def _own_head(units: int) -> bytes:
    bit = BITRATES[True, 3].index(UNITS_TO_KBPS[units]) + 1
    two = bytes([bit << 4 | RATES["1"].index(48000) << 2, 0xC0])  # 48 kHz, one channel
    side = bytes(17)  # no main data: all that follows is ancillary
    return b"\xff\xfa" + two + crc16(two + side).to_bytes(2, "big") + side


def padded(data: bytes) -> bytes:
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def encode(payload: bytes, title: str = "") -> bytes:
    """A stream that carries ``payload``, whose length is a positive multiple of 192."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes, not {len(payload)}")
    body, sizes = [], []
    for at in range(0, len(payload), 4 * UNIT):
        part = payload[at: at + 4 * UNIT]
        head = _own_head(len(part) // UNIT)
        size = header(head[:4])[0]
        body.append((head + part).ljust(size, b"\0"))
        sizes.append(size)
    text = b"\x03" + title.encode("utf-8")
    frame = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
    tag = b"ID3\x03\0\0" + bytes(len(frame) >> s & 0x7F for s in (21, 14, 7, 0)) + frame
    table_size = header(_own_head(1)[:4])[0]
    total = table_size + sum(sizes)
    starts, at = [], table_size
    for size in sizes:
        starts.append(at)
        at += size
    toc = bytes(starts[i * len(starts) // 100] * 256 // total for i in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    v1 = b"TAG" + title.encode("latin-1", "replace")[:30].ljust(30, b"\0") + bytes(94) + b"\xff"
    return tag + (_own_head(1) + table).ljust(table_size, b"\0") + b"".join(body) + v1


def read_back(data: bytes, info: dict) -> bytes:
    """The payload of a stream that ``encode`` wrote, from the frames that ``probe`` found."""
    parts = []
    for at, length, *_ in info["frames"]:
        units = (length - OWN_HEAD) // UNIT
        parts.append(data[at + OWN_HEAD: at + OWN_HEAD + units * UNIT])
    return b"".join(parts)


def _batches(rows, schema):
    """Record batches of bounded size from rows, so that no batch of long media outgrows its task."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)


def store(rows: DataFrame) -> DataFrame:
    """``rows(key, text)`` to ``(key, n_bytes, media)``."""
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def each(batches):
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                media = encode(padded(raw), f"{len(raw)} bytes")
                yield (key.as_py(), len(raw), media), len(media)

    return rows.mapInArrow(lambda batches: _batches(each(batches), schema), "key long, n_bytes long, media binary")


PROBE_SCHEMA = ("key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
                "feature string, frames long, samples long, sample_rate long, duration_s double, crc_bad long, skipped_bytes long, "
                "frame_offsets array<long>")
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
          pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def describe(media: bytes) -> tuple:
    """Columns of ``PROBE_SCHEMA`` after ``n_bytes``."""
    info = probe(media)
    payload, frames, table = read_back(media, info), info["frames"], info["table"]
    samples = sum(f[2] for f in frames)
    rate = frames[0][3] if frames else 0
    seconds = sum(f[2] / f[3] for f in frames) if len({f[3] for f in frames}) > 1 else samples / rate if rate else 0.0
    bad = sum(f[5] is False for f in frames)
    mix = ",".join(f"{k}x{sum(f[4] == k for f in frames)}" for k in sorted({f[4] for f in frames}))
    agrees = table is not None and table.get("frames") == len(frames)
    feature = (f"samples={samples};rate={rate};bitrates={mix};table={table['kind'] if table else 'none'}:{'ok' if agrees else 'differs'};"
               f"crc_bad={bad};skipped={info['skipped']};first={seek(info, 0)};middle={seek(info, 0.5)};title={info['tags'].get('TIT2', '')}")
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature,
            len(frames), samples, rate, seconds, bad, info["skipped"], [f[0] for f in frames])


def inspect(stored: DataFrame) -> DataFrame:
    """``stored(key, n_bytes, media)`` to ``PROBE_SCHEMA``, from the stored bytes alone."""
    names = [x.split(" ")[0] for x in PROBE_SCHEMA.split(", ")]
    schema = pa.schema(list(zip(names, _TYPES)))

    def each(batches):
        for batch in batches:
            for key, n, media in zip(*(batch.column(i) for i in range(3))):
                row = (key.as_py(), n.as_py(), *describe(media.as_py() or b""))
                yield row, 300 + 8 * row[8]

    return stored.mapInArrow(lambda batches: _batches(each(batches), schema), PROBE_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return inspect(store(docs)).withColumnRenamed("key", "doc_id")
