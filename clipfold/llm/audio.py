"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE files, to resampled PCM.

mu-law and A-law bytes expand through 256-entry tables that are built from
their defining rules. ADPCM blocks carry their own start, so one numpy step
decodes the same sample of every block of a batch. Resampled PCM is stored
without loss in two bands: even samples, and what odd ones differ by from the
mean of their neighbours, which is nothing in what was upsampled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfold.llm.arrowtext import raw_bytes, slices, text_array
from clipfold.llm.store import saved, with_text

RATE, BLOCK = 8000, 64
#: WAVE format tags.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")
#: zstd's level for what is kept: audio is several times as large as its text.
LEVEL = 12

#: Change of the step index by the low three bits of an ADPCM code.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
#: The 89 step sizes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
    24623, 27086, 29794, 32767,
], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = ((((code & 0x0F).astype(np.int32) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    part, low = ((code >> 4) & 7).astype(np.int32), ((code & 0x0F).astype(np.int32) << 4) + 8
    size = np.where(part == 0, low, (low + 256) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def adpcm_samples(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples of whole ADPCM blocks, one row per block: the one in its header and two per byte."""
    blocks = data.reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((len(blocks), 1 + 2 * (block - 4)), dtype=np.int16)
    out[:, 0] = value
    for k in range(1, out.shape[1]):
        byte = blocks[:, 4 + (k - 1) // 2]
        code = (byte & 15 if k % 2 else byte >> 4).astype(np.int32)
        step = STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code & 7], 0, 88)
        out[:, k] = value
    return out


def wave(codec: str, payload: bytes, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A WAVE file whose data chunk is ``payload``, untouched."""
    if codec == "adpcm":
        each = 1 + 2 * (block - 4)
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * block // each, block, 4, 2, each)
        samples = len(payload) // block * each
    else:
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
        samples = len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and data of a WAVE file, chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate, block, data = 12, "", 0, 1, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
            codec = next(k for k, v in TAGS.items() if v == tag)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return codec, rate, block, data


def resampled(pcm: np.ndarray, offsets: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Linear resampling of each clip between two offsets by ``up / down``; no clip sees its neighbour."""
    counts = np.diff(offsets)
    if up % down == 0:  # every sample has as many successors: no positions are needed
        times = up // down
        a, b = pcm.astype(np.int32), np.append(pcm[1:], pcm[-1:]).astype(np.int32)
        last = offsets[1:][counts > 0] - 1
        b[last] = a[last]
        out = np.empty((len(pcm), times), dtype=np.int16)
        for k in range(times):
            out[:, k] = (a * (times - k) + b * k) // times
        return out.reshape(-1), offsets * times
    sizes = -(-counts * up // down)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(counts)), sizes)
    place = (np.arange(ends[-1]) - ends[owner]) * down
    left, part = place // up, place % up
    right = np.minimum(left + 1, counts[owner] - 1)
    a, b = pcm[offsets[owner] + left].astype(np.int32), pcm[offsets[owner] + right].astype(np.int32)
    return ((a * (up - part) + b * part) // up).astype(np.int16), ends


def _halves(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which samples are odd in their clips, where even and odd ones of each clip begin among their like, and the even neighbours of each odd one."""
    sizes = np.diff(ends)
    odd = (np.arange(ends[-1]) & 1).astype(bool) ^ np.repeat((ends[:-1] & 1).astype(bool), sizes)
    evens, odds = (np.concatenate([[0], np.cumsum(n)]) for n in ((sizes + 1) // 2, sizes // 2))
    left = np.arange(odds[-1]) + np.repeat(evens[:-1] - odds[:-1], sizes // 2)
    right = np.minimum(left + 1, np.repeat(evens[1:] - 1, sizes // 2))
    return odd, evens, odds, left, right


def banded(pcm: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both bands of clips between offsets, and the offsets of each: even samples, and odd ones less the mean of their neighbours.

    Differences wrap at 16 bits, so nothing is lost whatever the samples are.
    """
    odd, evens, odds, left, right = _halves(ends)
    low = pcm[~odd]
    even = low.astype(np.int32)
    return low, evens, (pcm[odd] - ((even[left] + even[right]) >> 1)).astype(np.int16), odds


def unbanded(low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The samples that ``banded`` was given, of clips between ``ends``."""
    odd, _, _, left, right = _halves(ends)
    even = low.astype(np.int32)
    pcm = np.empty(ends[-1], np.int16)
    pcm[~odd] = low
    pcm[odd] = (high + ((even[left] + even[right]) >> 1)).astype(np.int16)
    return pcm


def pcm_of(low: list[bytes], high: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Samples of stored clips and their offsets."""
    ends = np.concatenate([[0], np.cumsum([(len(a) + len(b)) // 2 for a, b in zip(low, high, strict=True)])]).astype(np.int64)
    a, b = (np.frombuffer(b"".join(x), dtype="<i2") for x in (low, high))
    return unbanded(a, b, ends), ends


def _features(pcm: np.ndarray, ends: np.ndarray) -> list[str]:
    """Samples, root mean square, zero crossings and peak of each clip between two offsets; none is empty."""
    wide, starts = pcm.astype(np.int32), ends[:-1]
    power, peaks = np.add.reduceat(wide * wide, starts, dtype=np.int64), np.maximum(np.maximum.reduceat(wide, starts), -np.minimum.reduceat(wide, starts))
    sign = pcm < 0
    turns = np.zeros(len(pcm), dtype=bool)
    turns[1:] = sign[1:] != sign[:-1]
    turns[starts] = False
    turned = np.add.reduceat(turns, starts, dtype=np.int64)
    return [f"samples={n};rms={(p / n) ** 0.5:.3f};crossings={t};peak={k}" for n, p, t, k in zip(np.diff(ends).tolist(), power.tolist(), turned.tolist(), peaks.tolist(), strict=True)]


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: the text's bytes, padded, as the samples of a WAVE file.

    A null text is the empty text; padding is zero bytes up to a positive
    multiple of 64. The codec follows from the payload's CRC, so equal texts
    make equal files. Repeated rows stay apart; an empty table stays empty.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = raw_bytes(text_array(batch.column("text")))
            whole, files = data.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                payload = whole[a:b].ljust(max(BLOCK, -(-(b - a) // BLOCK) * BLOCK), b"\0")
                files.append(wave(CODECS[zlib.crc32(payload) % len(CODECS)], payload))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return with_text(docs, "doc_id").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _clips(read: list[tuple[str, int, int, bytes]], rate: int) -> tuple[np.ndarray, np.ndarray]:
    """PCM of files at ``rate`` and the offsets of each, in order; files of one codec, rate and block size are decoded at once."""
    clips: list[np.ndarray] = [np.zeros(0, np.int16)] * len(read)
    for codec, own, block in sorted({r[:3] for r in read}):
        mine = [i for i, r in enumerate(read) if r[:3] == (codec, own, block)]
        data = [r[3] for r in (read[i] for i in mine)]
        if codec == "adpcm":
            data = [x[: len(x) // block * block] for x in data]
        flat, per = np.frombuffer(b"".join(data), dtype=np.uint8), np.array([len(x) for x in data])
        if codec == "adpcm":
            pcm, per = adpcm_samples(flat, block).reshape(-1), per // block * (1 + 2 * (block - 4))
        else:
            pcm = (MULAW if codec == "mulaw" else ALAW)[flat]
        pcm, ends = resampled(pcm, np.concatenate([[0], np.cumsum(per)]), rate, own)
        for i, clip in zip(mine, np.split(pcm, ends[1:-1]), strict=True):
            clips[i] = clip
    return np.concatenate(clips), np.concatenate([[0], np.cumsum([len(c) for c in clips])]).astype(np.int64)


def _cut(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The 16-bit values between offsets, a binary each."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(data.astype("<i2"))])


def decoded(media: DataFrame, rate: int = 16_000) -> DataFrame:
    """Adds ``payload`` (the data chunk), ``codec``, and ``low`` and ``high``: the bands of the PCM, resampled to ``rate`` (see ``banded``).

    Each file is read by its own rate and block size; a last ADPCM block that
    isn't whole makes no samples. Further columns pass through; those of the
    names above are replaced. A null file is an error, an empty table stays empty.
    """
    made = ("payload", "codec", "low", "high")
    own = [f for f in media.schema if f.name not in made]
    names = [f.name for f in own]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 500_000):
            read = [read_wave(m) for m in batch.column("media").to_pylist()]
            low, evens, high, odds = banded(*_clips(read, rate))
            added = [pa.array([r[3] for r in read], pa.binary()), pa.array([r[0] for r in read], pa.string()), _cut(low, evens), _cut(high, odds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added], names=[*names, *made])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own)
    return media.mapInArrow(work, f"{fields}payload binary, codec string, low binary, high binary")


def resampled_media(docs: DataFrame) -> DataFrame:
    """Stores every document as audio, reads the files back and stores their resampled PCM (``low`` and ``high``) with digests of what they hold."""
    back = decoded(saved(stored(docs), "audio", LEVEL))
    return saved(back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "codec", "low", "high",
    ), "pcm", LEVEL)


def media_digests(docs: DataFrame) -> DataFrame:
    """The digests of every document's stored audio; ``feature`` is of the stored PCM, read back.

    It has the number of samples, their root mean square, zero crossings and
    peak. Texts of any length are whole files; further columns aren't read.
    """
    media = resampled_media(docs)
    names = [c for c in media.columns if c not in ("codec", "low", "high")]
    fields = ", ".join(f"{c} {media.schema[c].dataType.simpleString()}" for c in names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "low", 1_000_000):
            texts = _features(*pcm_of(batch.column("low").to_pylist(), batch.column("high").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), batch.column("codec")], names=[*names, "feature", "codec"])

    return media.mapInArrow(work, f"{fields}, feature string, codec string")
