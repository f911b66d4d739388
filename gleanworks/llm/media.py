"""Media columns: AVI files of motion JPEG, written, parsed and cut into timed clips.

Frames are JPEG images of the lossless process (SOF3, 8-bit samples, one component), each an
intra frame of its own. The writer's Huffman table gives difference category ``s`` a code of
``9 - s`` bits; with its ``s`` further bits every sample then takes 9 bits, so that whole runs
of frames are coded and decoded as arrays. The reader finds frames through the ``idx1`` index,
reads the markers of each frame, and also decodes other tables and predictors, sample by
sample. Shots end where the difference of two frames' histograms stands out from those before.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.arrow import map_batches, utf8
from gleanworks.session import table

WIDTH, HEIGHT, FPS = 16, 12, 25
SAMPLES = WIDTH * HEIGHT
PACKED = SAMPLES * 9 // 8
#: Frames worked on at a time.
RUN = 4096
#: Histogram bins, frames looked back on, deviations that stand out, and the least difference of a cut.
BINS, LOOK_BACK, DEVIATIONS, LEAST_CUT = 16, 12, 2.5, 0.2

# ---------------------------------------------------------------- JPEG, lossless process


def _words_by_difference() -> tuple[np.ndarray, np.ndarray]:
    """The 9-bit word of each difference -255..255, and the difference of each word."""
    to = np.zeros(511, np.uint16)
    back = np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2  # 0, 10, 110, ... for categories 8, 7, 6, ...
        word = code << s | (d if d > 0 else d + (1 << s) - 1)
        to[d + 255] = word
        back[word] = d
    return to, back


_WORD, _DIFFERENCE = _words_by_difference()
_HEADER = b"".join(
    (
        b"\xff\xd8",
        b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)),
        b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0),
        b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0),
    )
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG for each frame of ``samples`` (frames, HEIGHT, WIDTH) uint8."""
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    w = _WORD[d.reshape(-1, 8) + 255]
    out = np.empty((len(w), 9), np.uint8)
    out[:, 0] = w[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (w[:, k - 1] & ((1 << k) - 1)) << (8 - k) | w[:, k] >> (k + 1)
    out[:, 8] = w[:, 7] & 255
    raw = out.tobytes()
    return [_HEADER + raw[i : i + PACKED].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(raw), PACKED)]


@lru_cache(maxsize=64)
def _parse_header(head: bytes) -> tuple[int, int, int, tuple]:
    """(height, width, predictor, ((code, length, category), ...)) of the bytes before a scan."""
    at, tables, size, picked, predictor = 2, {}, None, 0, 1
    while at < len(head):
        marker, length = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        body = head[at + 4 : at + 2 + length]
        if marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                code, k, codes = 0, 17, []
                for bits, count in enumerate(counts, 1):
                    for _ in range(count):
                        codes.append((code, bits, body[k]))
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = tuple(codes)
                body = body[17 + n :]
        elif marker == 0xC3:
            bits, height, width, parts = struct.unpack(">BHHB", body[:6])
            if (bits, parts) != (8, 1):
                raise ValueError("only frames of one component of 8 bits are read")
            size = height, width
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"process {marker:#x} is not the lossless one")
        elif marker == 0xDA:
            picked, predictor = body[2] >> 4, body[3]
        at += 2 + length
    if size is None:
        raise ValueError("a frame without a size")
    return *size, predictor, tables[picked]


def _split(frame: bytes) -> tuple[bytes, bytes]:
    """The bytes of a frame up to its scan, and the scan without stuffing."""
    if frame.startswith(_HEADER):
        cut = len(_HEADER)
    else:
        cut = 2
        while frame[cut + 1] != 0xDA:
            cut += 2 + struct.unpack(">H", frame[cut + 2 : cut + 4])[0]
        cut += 2 + struct.unpack(">H", frame[cut + 2 : cut + 4])[0]
    return frame[:cut], frame[cut : frame.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")


def _decode_one(head: bytes, scan: bytes) -> np.ndarray:
    """Any table and predictor 1 to 7, a sample at a time."""
    height, width, predictor, codes = _parse_header(head)
    by = {(bits, code): s for code, bits, s in codes}
    stream, at = int.from_bytes(scan, "big"), 0
    total = len(scan) * 8

    def take(n: int) -> int:
        nonlocal at
        at += n
        if at > total:
            raise ValueError("a scan that ends early")
        return stream >> (total - at) & ((1 << n) - 1)

    if height * width > total:
        raise ValueError("more samples than a scan of that length can hold")
    x = np.zeros((height, width), np.int64)
    for r in range(height):
        for c in range(width):
            code, bits = 0, 0
            while (bits, code) not in by:
                code, bits = code << 1 | take(1), bits + 1
                if bits > 16:
                    raise ValueError("a code that no table has")
            s = by[bits, code]
            extra = take(s) if s else 0
            d = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
            a, b = (x[r, c - 1] if c else 0), (x[r - 1, c] if r else 0)
            e = x[r - 1, c - 1] if r and c else 0
            if r == 0:
                guess = a if c else 128
            elif c == 0:
                guess = b
            else:
                guess = (0, a, b, e, a + b - e, a + ((b - e) >> 1), b + ((a - e) >> 1), (a + b) >> 1)[predictor]
            x[r, c] = (guess + d) & 255
    return x.astype(np.uint8)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(frames, height, width) uint8 of the samples of the frames."""
    parts = [_split(frame) for frame in frames]
    if all(head == _HEADER and len(scan) == PACKED for head, scan in parts):
        b = np.frombuffer(b"".join(scan for _, scan in parts), np.uint8).reshape(-1, 9).astype(np.uint16)
        w = np.empty((len(b), 8), np.uint16)
        for k in range(8):
            w[:, k] = (b[:, k] & ((1 << (8 - k)) - 1)) << (k + 1) | b[:, k + 1] >> (7 - k)
        d = _DIFFERENCE[w].reshape(-1, HEIGHT, WIDTH).astype(np.int32)
        d[:, 0, 0] += 128
        d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
        return np.cumsum(d, axis=2).astype(np.uint8)
    return np.stack([_decode_one(head, scan) for head, scan in parts])


# ---------------------------------------------------------------- AVI


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI of motion JPEG whose samples are ``payload`` (a positive multiple of 192 bytes)."""
    if not payload or len(payload) % SAMPLES:
        raise ValueError(f"a payload takes a positive multiple of {SAMPLES} bytes")
    samples = np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH)
    parts, index, at, largest = [], [], 4, 0
    for i in range(0, len(samples), RUN):
        for frame in encode_frames(samples[i : i + RUN]):
            parts.append(_chunk(b"00dc", frame))
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
            at += len(parts[-1])
            largest = max(largest, len(frame))
    n = len(samples)
    avih = struct.pack("<10I16x", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, WIDTH, HEIGHT)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi = _chunk(b"LIST", b"movi" + b"".join(parts))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, frames) of the video stream, as the index lists them."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index, lists = 0.0, None, None, [(12, len(media))]
    while lists:
        at, end = lists.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    lists.append((at + 12, min(end, at + 8 + size)))
            elif name == b"strh" and media[at + 8 : at + 12] == b"vids":
                scale, ticks = struct.unpack("<II", media[at + 28 : at + 36])
                if not scale or not ticks:
                    raise ValueError("a video stream without a frame rate")
                rate = ticks / scale
            elif name == b"idx1":
                index = np.frombuffer(media[at + 8 : at + 8 + size], np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
            at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without movi or idx1")
    if not rate:
        raise ValueError("an AVI file without a video stream")
    index = index[index["id"] == b"00dc"]
    base = movi if not len(index) or media[movi + index["at"][0] : movi + index["at"][0] + 4] == b"00dc" else 0
    starts = (index["at"].astype(np.int64) + base + 8).tolist()
    return rate, [media[a : a + n] for a, n in zip(starts, index["size"].tolist(), strict=True)]


# ---------------------------------------------------------------- shots


def clips_of(histograms: np.ndarray, rate: float) -> list[tuple[int, float, float, int, float]]:
    """(clip, start second, end second, frames, mean difference inside) by adaptive cuts.

    A cut stands before a frame whose histogram differs from the last one's by more than the
    mean and ``DEVIATIONS`` standard deviations of the ``LOOK_BACK`` differences before it,
    and by ``LEAST_CUT`` at least.
    """
    n = len(histograms)
    change = np.zeros(n)
    if n > 1:
        total = max(1, int(histograms[0].sum()))
        change[1:] = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2.0 * total)
    sums, squares = np.concatenate([[0.0], np.cumsum(change)]), np.concatenate([[0.0], np.cumsum(change**2)])
    low = np.maximum(1, np.arange(n) - LOOK_BACK)
    count = np.maximum(np.arange(n) - low, 0)
    seen = np.maximum(count, 1)
    mean = (sums[np.arange(n)] - sums[np.minimum(low, np.arange(n))]) / seen
    spread = np.sqrt(np.maximum((squares[np.arange(n)] - squares[np.minimum(low, np.arange(n))]) / seen - mean**2, 0))
    cut = (change > mean + DEVIATIONS * spread) & (change >= LEAST_CUT) & (count > 0)
    edges = [0, *np.flatnonzero(cut).tolist(), n]
    return [
        (k, a / rate, b / rate, b - a, float(change[a + 1 : b].mean()) if b - a > 1 else 0.0)
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        if b > a
    ]


def payload_of(text: bytes) -> bytes:
    """The text's bytes, filled up with spaces to a positive multiple of 192."""
    return text + b" " * (max(1, -(-len(text) // SAMPLES)) * SAMPLES - len(text))


def read_back(media: bytes) -> tuple[bytes, list[tuple[int, float, float, int, float]]]:
    """The samples of a stored file, and its clips."""
    rate, frames = read_avi(media)
    parts, histograms = [], []
    for i in range(0, len(frames), RUN):
        x = decode_frames(frames[i : i + RUN])
        parts.append(x.tobytes())
        flat = (x.reshape(len(x), -1) >> 4).astype(np.int64) + np.arange(len(x))[:, None] * BINS
        histograms.append(np.bincount(flat.ravel(), minlength=len(x) * BINS).reshape(-1, BINS))
    return b"".join(parts), clips_of(np.concatenate(histograms), rate)


CLIP = "struct<clip:int,start_s:double,end_s:double,frames:int,mean_change:double>"
_CLIP = pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("mean_change", pa.float64())])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the AVI file of each document's text, as column ``media``.

    A null text is stored as the empty one: a single frame of spaces. Every row gives a row;
    other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in utf8(batch.column(1))]
        media = [write_avi(payload_of(t)) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, "doc_id bigint, n_bytes bigint, media binary")


def _read(media: bytes | None) -> tuple[bytes | None, list | None, str | None]:
    """(payload, clips, error): a file that can't be read is an error of its own row only."""
    if media is None:
        return None, None, None
    try:
        return *read_back(media), None
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return None, None, f"{type(e).__name__}: {e}"


def read_media(media: DataFrame) -> DataFrame:
    """Reads column ``media`` back: payload and clips of each file, and digests of both.

    A file that is no AVI, is cut off, has no video stream or no frame rate, or holds frames of
    another process than the lossless one of one 8-bit component, or frames with more samples
    than their bytes can hold, has null for all that is read, and says why in ``error``. A null
    file has nulls only.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column(2).to_pylist()
        read = [_read(m) for m in files]
        cols = [
            batch.column(0),
            batch.column(1),
            pa.array([p for p, _, _ in read], pa.binary()),
            pa.array([None if p is None else zlib.crc32(p[-16:]) for p, _, _ in read], pa.int64()),
            pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p, _, _ in read], pa.string()),
            pa.array([None if m is None else len(m) for m in files], pa.int64()),
            pa.array([None if m is None else hashlib.sha256(m).hexdigest() for m in files], pa.string()),
            pa.array([clips and [dict(zip(("clip", "start_s", "end_s", "frames", "mean_change"), c, strict=True)) for c in clips] for _, clips, _ in read], pa.list_(_CLIP)),
            pa.array([e for _, _, e in read], pa.string()),
        ]
        names = ["doc_id", "n_bytes", "payload", "tail_crc32", "payload_sha256", "media_bytes", "media_sha256", "clips", "error"]
        return pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, n_bytes bigint, payload binary, tail_crc32 bigint, payload_sha256 string, media_bytes bigint, media_sha256 string"
    return map_batches(media.select("doc_id", "n_bytes", "media"), run, f"{schema}, clips array<{CLIP}>, error string")


def clip_rows(read: DataFrame) -> DataFrame:
    """A row per clip: doc_id, clip, start_s, end_s, frames, mean_change."""
    return read.select("doc_id", F.inline("clips"))


def op4_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as AVI motion JPEG, read back, and digested."""
    read = read_media(store_media(table(spark, sf_dir, "documents")))
    frames = F.aggregate("clips", F.lit(0), lambda n, c: n + c["frames"])
    ends = F.concat_ws(",", F.transform("clips", lambda c: c["end_s"].cast("decimal(18,2)").cast("string")))
    feature = F.format_string("frames=%d;clips=%d;ends=%s", frames, F.size("clips"), F.md5(ends))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )
