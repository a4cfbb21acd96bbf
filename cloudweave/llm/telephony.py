"""Telephony audio columns: G.711 and IMA ADPCM containers, decoded to resampled PCM.

A media column holds whole WAV files. ``encode_mulaw`` stores bytes losslessly as 8-bit mu-law samples;
``decode`` reads any of the three telephony formats back. Companded samples are expanded by 256-entry
lookup tables; ADPCM blocks are decoded side by side, one numpy step a sample for all blocks of a batch.
Decoded samples are resampled to twice the rate by an eight-point filter and stored as 16-bit PCM.

Defined cases: a null or empty text becomes one block of 192 spaces; equal texts give equal media and
features; texts of any length are processed in segments of bounded size; an empty table gives no rows;
extra columns are ignored; repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import batch, documents, session_for, text_bytes

#: Payloads are a positive multiple of this many bytes, which is also one ADPCM block.
BLOCK = 192
RATE = 8000
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17

# Fixed values of the IMA ADPCM format: step sizes and index moves.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
    107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
], dtype=np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law byte: inverted bits, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    b = ~np.arange(256) & 0xFF
    value = (((b & 15) << 3) + 132 << ((b >> 4) & 7)) - 132
    return np.where(b & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law byte: alternate bits inverted, the lowest segment linear."""
    b = np.arange(256) ^ 0x55
    exponent, mantissa = (b >> 4) & 7, ((b & 15) << 4) + 8
    value = np.where(exponent == 0, mantissa, (mantissa + 256) << np.maximum(exponent - 1, 0))
    return np.where(b & 128, value, -value).astype(np.int16)


MU, A = mulaw_table(), alaw_table()
#: What one nibble adds at one step index, and the index that follows; row = index * 16 + nibble.
_IDX, _NIB = np.divmod(np.arange(89 * 16), 16)
_STEP = IMA_STEPS[_IDX]
_MAG = (_STEP >> 3) + np.where(_NIB & 4, _STEP, 0) + np.where(_NIB & 2, _STEP >> 1, 0) + np.where(_NIB & 1, _STEP >> 2, 0)
IMA_DELTA = np.where(_NIB & 8, -_MAG, _MAG).astype(np.int32)
IMA_NEXT = (np.clip(_IDX + IMA_MOVES[_NIB & 7], 0, 88) * 16).astype(np.int32)


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono ADPCM blocks, one block a row: predictor, step index, then low nibble first."""
    n, width = blocks.shape
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    state = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    out[0] = head
    for k in range(2 * (width - 4)):
        row = state + (data[k // 2] >> 4 if k % 2 else data[k // 2] & 15)
        head += IMA_DELTA[row]
        np.clip(head, -32768, 32767, out=head)
        state = IMA_NEXT[row]
        out[k + 1] = head
    return out.T


def ima_encode(samples: np.ndarray, width: int = BLOCK) -> np.ndarray:
    """ADPCM blocks of int16 samples (padded with the last one); lossy, for making telephony input."""
    per = 1 + 2 * (width - 4)
    samples = np.asarray(samples, dtype=np.int16)
    short = -len(samples) % per
    rows = np.concatenate([samples, np.repeat(samples[-1:] if len(samples) else np.zeros(1, np.int16), short)]).reshape(-1, per).astype(np.int32)
    blocks = np.zeros((len(rows), width), dtype=np.uint8)
    blocks[:, :2] = rows[:, 0].astype("<i2")[:, None].view(np.uint8)
    head, state = rows[:, 0].copy(), np.zeros(len(rows), dtype=np.int32)
    for k in range(1, per):
        choices = head[:, None] + IMA_DELTA[state[:, None] + np.arange(16)]
        nibble = np.abs(np.clip(choices, -32768, 32767) - rows[:, k, None]).argmin(axis=1)
        row = state + nibble
        head = np.clip(head + IMA_DELTA[row], -32768, 32767)
        state = IMA_NEXT[row]
        blocks[:, 4 + (k - 1) // 2] |= (nibble << (4 * ((k - 1) % 2))).astype(np.uint8)
    return blocks


def _midpoint_filter(points: int) -> np.ndarray:
    """Weights, in 2048ths, of the samples around a midpoint: the polynomial through them (Lagrange)."""
    at = np.arange(points) - (points - 1) / 2
    weights = [np.prod([-at[j] / (at[i] - at[j]) for j in range(points) if j != i]) for i in range(points)]
    return np.rint(np.array(weights) * 2048).astype(np.int32)


MIDPOINT = _midpoint_filter(8)
#: Samples resampled in one go.
STRETCH = 1 << 16


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the midpoint to the next by an eight-point filter (end samples held, clipped to 16 bits)."""
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[::2] = pcm
    before = len(MIDPOINT) // 2 - 1
    wide = np.pad(pcm, (before, before + 1), mode="edge") if len(pcm) else pcm
    for lo in range(0, len(pcm), STRETCH):
        part = wide[lo : lo + STRETCH + len(MIDPOINT) - 1].astype(np.int32)
        n = len(part) - len(MIDPOINT) + 1
        total = sum(w * part[k : k + n] for k, w in enumerate(MIDPOINT.tolist()))
        out[2 * lo + 1 : 2 * (lo + n) : 2] = np.clip((total + 1024) >> 11, -32768, 32767)
    return out


def wav(data: bytes, kind: int = MULAW, rate: int = RATE) -> bytes:
    """A mono WAV file of one of the four formats."""
    bits, align = {PCM: (16, 2), ALAW: (8, 1), MULAW: (8, 1), IMA: (4, BLOCK)}[kind]
    per = 1 + 2 * (BLOCK - 4)
    samples = len(data) // BLOCK * per if kind == IMA else len(data) // align
    speed = rate * BLOCK // per if kind == IMA else rate * align
    extra = struct.pack("<HH", 2, per) if kind == IMA else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, speed, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """(format, rate, data) of a mono WAV file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate = struct.unpack_from("<HHI", media, at + 8)
            if channels != 1:
                raise ValueError("only mono is supported")
        elif name == b"data":
            if kind is None:
                raise ValueError("data before fmt")
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(media: bytes) -> np.ndarray:
    """int16 samples of a telephony WAV file."""
    kind, _, data = read_wav(media)
    if kind == PCM:
        return np.frombuffer(data, dtype="<i2")
    raw = np.frombuffer(data, dtype=np.uint8)
    return ima_decode(raw.reshape(-1, BLOCK)).reshape(-1) if kind == IMA else (MU if kind == MULAW else A)[raw]


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK or (0 if text else BLOCK))


#: Blocks decoded in one go: bounds memory whatever the length of a text.
SEGMENT = 2048


def features(payloads: list[bytes]) -> list[str]:
    """One string a payload (each a multiple of BLOCK bytes): what the samples hold under the three decoders.

    mu-law and A-law mean squares, mu-law peak and sign changes inside blocks, and the checksum of the PCM that the bytes
    decode to as ADPCM blocks.
    """
    sizes = np.array([len(p) // BLOCK for p in payloads])
    ends = np.cumsum(sizes)
    blocks = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK)
    sums = np.zeros((4, len(payloads)), dtype=np.int64)
    crcs = [0] * len(payloads)
    for lo in range(0, len(blocks), SEGMENT):
        part = blocks[lo : lo + SEGMENT]
        mu, a = MU[part], A[part]
        adpcm = np.ascontiguousarray(ima_decode(part))
        wide = mu.astype(np.int64)
        first = int(np.searchsorted(ends, lo, side="right"))
        last = int(np.searchsorted(ends, lo + len(part) - 1, side="right"))
        starts = np.maximum(np.concatenate([[0], ends[:-1]])[first : last + 1] - lo, 0)
        each = (
            (wide * wide).sum(axis=1), (a.astype(np.int64) ** 2).sum(axis=1), np.abs(wide).max(axis=1),
            ((mu[:, 1:] < 0) != (mu[:, :-1] < 0)).sum(axis=1),
        )
        for k in (0, 1, 3):
            sums[k, first : last + 1] += np.add.reduceat(each[k], starts)
        sums[2, first : last + 1] = np.maximum(sums[2, first : last + 1], np.maximum.reduceat(each[2], starts))
        stops = np.append(starts[1:], len(part))
        for d, b, e in zip(range(first, last + 1), starts, stops, strict=True):
            crcs[d] = zlib.crc32(adpcm[b:e], crcs[d])
    n = np.maximum(sizes, 1) * BLOCK
    return [
        f"mu={sums[0, i] // n[i]};alaw={sums[1, i] // n[i]};peak={sums[2, i]};turns={sums[3, i]};adpcm={c:08x}"
        for i, c in enumerate(crcs)
    ]


def telephony_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Per row: the id, n_bytes, the digests of the stored and reread form, features, and the size and digest of the stored PCM.

    ``media`` is the mu-law file and ``pcm`` the file of its samples resampled to twice the rate, 16 bits each; keep_media returns
    both. The feature's pcm16k is the checksum of the samples read back from the PCM file.
    """
    session_for(df)
    schema = pa.schema([
        ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm_bytes", pa.int64()), ("pcm_sha256", pa.string()),
        *([("media", pa.binary()), ("pcm", pa.binary())] if keep_media else []),
    ])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            media = [wav(pad(t)) for t in texts]
            back = [read_wav(m)[2] for m in media]
            pcm = [wav(resample(decode(m)).tobytes(), PCM, 2 * RATE) for m in media]
            out = {
                "n_bytes": [len(t) for t in texts], "payload_bytes": [len(p) for p in back],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p in back],
                "tail_crc32": [zlib.crc32(p[-16:]) for p in back],
                "media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                "feature": [f"{x};pcm16k={zlib.crc32(read_wav(p)[2]):08x}" for x, p in zip(features(back) if back else [], pcm, strict=True)],
                "pcm_bytes": [len(p) for p in pcm], "pcm_sha256": [hashlib.sha256(p).hexdigest() for p in pcm],
            }
            if keep_media:
                out |= {"media": media, "pcm": pcm}
            yield pa.RecordBatch.from_arrays([b.column(0), *batch(schema, out).columns], names=["doc_id", *schema.names])

    rows = df.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_t"))
    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in schema)
    return rows.mapInArrow(convert, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}")


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony_column(documents(spark, sf_dir), keep_media=False)
