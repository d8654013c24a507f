"""Telephony audio columns: WAVE files of mu-law, A-law or IMA ADPCM codes, their PCM and features."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks

#: WAVE format tags.
ALAW, MULAW, ADPCM = 6, 7, 17
#: Data bytes of an ADPCM block, after its 4 bytes of header.
BLOCK = 192
#: ADPCM blocks decoded in one go, and codes or samples of other work in pieces.
_TOGETHER, _PIECE = 1 << 12, 1 << 19
#: Fixed values of the IMA ADPCM standard: index change by code, and the 89 step sizes.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
        876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """G.711: the 16-bit sample of each mu-law code."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711: the 16-bit sample of each A-law code."""
    code = np.arange(256) ^ 0x55
    exponent, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, low + 8, low + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """uint8 (blocks, 4 + n) -> int16 (blocks, 1 + 2n): code by code, over all blocks at once."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    value, index = head, np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.empty((blocks.shape[1] * 2 - 8, len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for i, code in enumerate(codes, 1):
        step = STEPS[index]
        # step * (2 * size + 1) / 8, summed in the standard's whole-number parts
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, 88)
        out[i] = value
    return out.T


def pack_wave(payload: bytes, tag: int, rate: int = 8000) -> bytes:
    """A mono WAVE file that holds ``payload`` byte by byte: one 8-bit code a sample, or ADPCM blocks of
    ``BLOCK`` bytes (payload padded to whole blocks by the caller), each with a neutral header."""
    if tag == ADPCM:
        n = len(payload) // BLOCK
        blocks = np.zeros((n, 4 + BLOCK), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8, n * BLOCK).reshape(n, BLOCK)
        data, per_block = blocks.tobytes(), 2 * BLOCK + 1
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * (BLOCK + 4) // per_block, BLOCK + 4, 4, 2, per_block)
        count = n * per_block
    else:
        data, count = payload, len(payload)
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    fact = struct.pack("<4sII", b"fact", 4, count)
    pad = b"\0" * (len(data) % 2)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format tag, rate, block size, data) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or at + 8 + n > len(media):
                raise ValueError("a WAVE file without format, or cut short")
            return form[0], form[2], form[4], memoryview(media)[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("a WAVE file without data")


def payload_of(tag: int, block: int, data: memoryview) -> bytes:
    """The bytes that pack_wave() was given."""
    if tag != ADPCM:
        return bytes(data)
    return np.frombuffer(data, np.uint8).reshape(-1, block)[:, 4:].tobytes()


def decode(tag: int, block: int, data: memoryview) -> np.ndarray:
    """int16 PCM."""
    codes = np.frombuffer(data, np.uint8)
    if tag == ADPCM:
        return adpcm_decode(codes.reshape(-1, block)).ravel()
    if tag not in TABLES:
        raise ValueError(f"no codec for WAVE format {tag}")
    return TABLES[tag][codes]


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation, rounded to int16; n samples give ceil(n * to / rate)."""
    if rate == to or not len(pcm):
        return pcm.copy()
    n = -(-len(pcm) * to // rate)
    place = np.arange(n, dtype=np.int64) * rate
    low, part = place // to, place % to
    here = pcm.astype(np.int64)
    there = here[np.minimum(low + 1, len(pcm) - 1)]
    here = here[low]
    return ((2 * (here * (to - part) + there * part) + to) // (2 * to)).astype(np.int16)


def features(pcm: np.ndarray, rate: int) -> str:
    """duration in ms : peak : root mean square : zero crossings : crc32 of the PCM."""
    wide = pcm.astype(np.int64)
    rms = int(np.sqrt((wide * wide).sum() / len(pcm))) if len(pcm) else 0
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    peak = int(np.abs(wide).max()) if len(pcm) else 0
    return f"{len(pcm) * 1000 // rate}ms:{peak}:{rms}:{crossings}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def _encode(padded: int, tags: tuple[int, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, texts) in byte_chunks(batches, 1):
            n, codec, media = [], [], []
            for text in texts:
                text = text or b""
                payload = text + b" " * (max(padded, -(-len(text) // padded) * padded) - len(text))
                tag = tags[zlib.crc32(payload) % len(tags)]
                n.append(len(text))
                codec.append(tag)
                media.append(pack_wave(payload, tag))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(codec, pa.int32()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "format_tag", "media"])

    return run


def encode_texts(docs: DataFrame, padded: int = BLOCK, tags: tuple[int, ...] = (MULAW, ALAW, ADPCM)) -> DataFrame:
    """(doc_id, n_bytes, format_tag, media): each text's UTF-8, with bytes 32 up to a positive multiple of ``padded``,
    as codes of a telephony WAVE file.  The format goes by the payload's crc32, so equal texts give
    equal files.  Null text: as empty.  Repeated rows and null ids: row by row."""
    if padded % BLOCK:
        raise ValueError(f"padded must be a multiple of {BLOCK}")
    return _texts(docs).mapInArrow(_encode(padded, tags), "doc_id long, n_bytes long, format_tag int, media binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def pieces(files: list[tuple[int, int, memoryview]]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, samples) of files (tag, block, data): each file's PCM in order, in pieces of a bounded size.  ADPCM blocks of
    one size are decoded together, _TOGETHER at a time, whichever files they are of."""
    by_block: dict[int, list[int]] = {}
    for i, (tag, block, data) in enumerate(files):
        if tag == ADPCM:
            by_block.setdefault(block, []).append(i)
        else:
            for at in range(0, len(data), _PIECE):
                yield i, decode(tag, block, data[at : at + _PIECE])
    for block, own in by_block.items():
        parts = [(i, at, min(at + _TOGETHER, len(files[i][2]) // block)) for i in own for at in range(0, len(files[i][2]) // block, _TOGETHER)]
        ends = np.cumsum([stop - start for _, start, stop in parts])
        first = 0
        while first < len(parts):
            # At least one part, and as many more as make up no more than _TOGETHER blocks.
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _TOGETHER, "right")))
            group = parts[first:last]
            rows = np.concatenate([np.frombuffer(files[i][2], np.uint8, (stop - start) * block, start * block) for i, start, stop in group]).reshape(-1, block)
            for (i, _, _), part in zip(group, np.split(adpcm_decode(rows), np.cumsum([stop - start for _, start, stop in group])[:-1]), strict=True):
                yield i, part.ravel()
            first = last


def decode_all(files: list[tuple[int, int, memoryview]]) -> list[np.ndarray]:
    """The whole PCM of each (tag, block, data)."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.int16)] for _ in files]
    for i, part in pieces(files):
        out[i].append(part)
    return [np.concatenate(x) for x in out]


class Recorder:
    """Takes a file's PCM piece by piece: resamples it as resample() does, measures it as features() does, and keeps its
    little-endian bytes, as they are or as one zstandard frame.  Beside what it keeps, it holds a piece at a time."""

    def __init__(self, rate: int, to: int, keep: str | None) -> None:
        self.rate, self.to = rate, to
        self.buffer, self.base, self.taken = np.empty(0, np.int64), 0, 0
        self.n = self.peak = self.squares = self.crossings = self.crc = 0
        self.below: bool | None = None
        self.kept = bytearray() if keep else None
        self.packer = zstandard.ZstdCompressor(level=1).compressobj() if keep == "zstd" else None

    def add(self, pcm: np.ndarray) -> None:
        if self.rate == self.to:
            self.put(pcm)
            return
        self.buffer = np.concatenate([self.buffer, pcm])
        known = self.base + len(self.buffer)
        # Samples that lie between two known ones.
        self.fill(max(self.taken, ((known - 1) * self.to - 1) // self.rate + 1))
        low = min(self.taken * self.rate // self.to, known)
        self.buffer, self.base = self.buffer[low - self.base :], low

    def fill(self, until: int) -> None:
        for start in range(self.taken, until, _PIECE):
            place = np.arange(start, min(start + _PIECE, until), dtype=np.int64) * self.rate
            low, part = place // self.to - self.base, place % self.to
            here, there = self.buffer[low], self.buffer[np.minimum(low + 1, len(self.buffer) - 1)]
            self.put(((2 * (here * (self.to - part) + there * part) + self.to) // (2 * self.to)).astype(np.int16))
        self.taken = max(self.taken, until)

    def put(self, pcm: np.ndarray) -> None:
        if not len(pcm):
            return
        wide, below = pcm.astype(np.int64), pcm < 0
        self.n += len(pcm)
        self.peak = max(self.peak, int(np.abs(wide).max()))
        self.squares += int((wide * wide).sum())
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + int(self.below is not None and self.below != below[0])
        self.below = below[-1]
        data = pcm.astype("<i2").tobytes()
        self.crc = zlib.crc32(data, self.crc)
        if self.kept is not None:
            self.kept += self.packer.compress(data) if self.packer else data

    def end(self) -> tuple[str, bytearray | None]:
        """features() of all samples, and what was kept."""
        if self.rate != self.to:
            self.fill(-(-(self.base + len(self.buffer)) * self.to // self.rate))
        if self.packer:
            self.kept += self.packer.flush()
        rms = int(np.sqrt(self.squares / self.n)) if self.n else 0
        return f"{self.n * 1000 // self.to}ms:{self.peak}:{rms}:{self.crossings}:{self.crc:08x}", self.kept


DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"


def _describe(rate: int, keep: str | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, n, _, media) in byte_chunks(batches, 3):
            there = [i for i, m in enumerate(media) if m is not None]
            files = [read_wave(media[i]) for i in there]
            recorders = [Recorder(own, rate, keep) for _, own, _, _ in files]
            for k, samples in pieces([(tag, block, data) for tag, _, block, data in files]):
                recorders[k].add(samples)
            rows: list[list] = [[None] * 7 for _ in media]
            for i, (tag, _, block, data), recorder in zip(there, files, recorders, strict=True):
                payload, (feature, pcm) = payload_of(tag, block, data), recorder.end()
                rows[i] = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), f"{tag}:{feature}", pcm]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return run


def describe_media(media: DataFrame, rate: int = 16000, keep_pcm: bool | str = True) -> DataFrame:
    """Rows (doc_id, n_bytes, format_tag, media) -> payload and file digests, ``feature`` and ``pcm``: the samples at
    ``rate`` as little-endian 16-bit, with keep_pcm="zstd" as a zstandard frame of them, with False null.
    Null media: nulls.  Damaged files raise.

    Files are decoded, resampled and measured in pieces; of a long one only the file and the column's value are held whole.
    """
    return media.select("doc_id", "n_bytes", "format_tag", "media").mapInArrow(_describe(rate, _kept(keep_pcm)), DESCRIBED)


def record_texts(docs: DataFrame, padded: int = BLOCK, tags: tuple[int, ...] = (MULAW, ALAW, ADPCM), rate: int = 16000, keep_pcm: bool | str = "zstd") -> DataFrame:
    """describe_media(encode_texts(docs)) in one pass: each file is made, read back and let go in the same worker."""
    if padded % BLOCK:
        raise ValueError(f"padded must be a multiple of {BLOCK}")
    encode, describe = _encode(padded, tags), _describe(rate, _kept(keep_pcm))
    return _texts(docs).mapInArrow(lambda batches: describe(encode(batches)), DESCRIBED)


def _kept(keep_pcm: bool | str) -> str | None:
    if keep_pcm not in (True, False, "zstd"):
        raise ValueError(f"keep_pcm must be True, False or 'zstd', not {keep_pcm!r}")
    return {True: "raw", False: None}.get(keep_pcm, keep_pcm)
