"""Operator 6: FLAC media columns, decoded to PCM blocks with seekable sample offsets.

``encode_media`` stores bytes losslessly as 8-bit mono FLAC streams;
``decode_media`` parses streams, decodes Rice residuals and linear predictors of
all frames of a chunk in lockstep (see ``flac``), verifies header and frame
checksums, the sample count and the MD5 of the samples, and returns the PCM bytes
with the byte offset of every frame; ``pcm_blocks`` cuts them to rows that start
at known samples. All are maps over rows without an exchange, and work on slices
of ``LANES`` frames, so besides a stream and its samples memory does not follow the
length of a stream, and time follows it in proportion.

Defined results: null media gives null PCM; a damaged stream raises; ids are only
passed on, so null or repeated ones do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from . import kernels as K

LANES = 2048
_SYNC = 0xFFF81402


def _encoded(batches):
    for batch in batches:
        column = batch.column("payload")
        lo = 0
        sizes = np.diff(_offsets(column))
        while lo < batch.num_rows:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), K.CHUNK)))
            media = _encode_rows([x.as_py() for x in column.slice(lo, hi - lo)])
            yield pa.record_batch([batch.column("id").slice(lo, hi - lo), pa.array(media, pa.binary())], ["id", "media"])
            lo = hi


def _encode_rows(payloads: list[bytes | None]) -> list[bytes | None]:
    real = [x for x in payloads if x is not None]
    if any(len(x) == 0 or len(x) % flac.BLOCK for x in real):
        raise ValueError(f"payloads must be positive multiples of {flac.BLOCK} bytes")
    if not real:
        return [None] * len(payloads)
    samples = np.frombuffer(b"".join(real), np.uint8).reshape(-1, flac.BLOCK)
    counts = np.array([len(x) // flac.BLOCK for x in real])
    number = np.arange(len(samples)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts, sizes = [], []
    for lo in range(0, len(samples), LANES):
        data, size = flac.encode_frames((samples[lo : lo + LANES] ^ 0x80).view(np.int8), number[lo : lo + LANES])
        parts.append(data.tobytes())
        sizes.append(size)
    data, size = b"".join(parts), np.concatenate(sizes)
    ends = np.concatenate(([0], np.cumsum(size)))
    out, at, frame = [], 0, 0
    for x in payloads:
        if x is None:
            out.append(None)
            continue
        n = counts[at]
        out.append(flac.stream_header(x, size[frame : frame + n]) + data[ends[frame] : ends[frame + n]])
        at, frame = at + 1, frame + n
    return out


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def encode_media(payloads: DataFrame) -> DataFrame:
    """``payloads(id, payload)`` as (id, media): each payload a FLAC stream of its bytes."""
    kind = payloads.schema["id"].dataType.simpleString()
    return payloads.select("id", "payload").mapInArrow(_encoded, f"id {kind}, media binary")


#: No frame of BLOCK samples is longer.
_FRAME_MOST = 1 << 16


def _frame_starts(data: np.ndarray, first: np.ndarray, end: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Starts of all frames, by their sync codes, numbers and header checksums.

    Where a residual looks like the header of a frame, the end of the frame before says which it is.
    """
    padded = np.concatenate((data, np.zeros(12, np.uint8)))
    at = np.flatnonzero((padded[:-3] == 0xFF) & (padded[1:-2] == 0xF8) & (padded[2:-1] == 0x14) & (padded[3:] == 0x02))
    lead = padded[at + 4].astype(np.int64)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(more == 0, lead, lead & (0x3F >> more))
    for j in range(1, int(more.max(initial=0)) + 1):
        number = np.where(j <= more, (number << 6) | (padded[at + 4 + np.minimum(j, 7)] & 0x3F), number)
    rows = padded[np.minimum(at[:, None] + np.arange(11), len(padded) - 1)]
    good = flac.crc8(rows, 5 + more) == rows[np.arange(len(at)), np.minimum(5 + more, 10)]
    stream = np.maximum(np.searchsorted(first, at, "right") - 1, 0)
    good &= (at >= first[stream]) & (at < end[stream]) & (number < count[stream])
    at, number, stream = at[good], number[good], stream[good]
    place = (np.cumsum(count) - count)[stream] + number
    found = np.bincount(place, minlength=int(count.sum()))
    if (found == 0).any():
        raise ValueError("FLAC: a frame is missing")
    order = np.argsort(place, kind="stable")
    at, number, stream = at[order], number[order], stream[order]
    head = np.cumsum(found) - found
    starts = at[head]
    for j in np.flatnonzero(found > 1):
        here = first[stream[head[j]]]
        if number[head[j]] > 0:
            before = int(starts[j - 1])
            here = before + flac.decode_frames(data[before : before + _FRAME_MOST], np.array([0]), number[head[j] : head[j] + 1] - 1)[1][0]
        starts[j] = here
    return starts


def decode_rows(media: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """PCM bytes (unsigned 8-bit) and byte offsets of the frames of each stream."""
    data = np.frombuffer(b"".join(media), np.uint8)
    size = np.array([len(x) for x in media], np.int64)
    end = np.cumsum(size)
    begin = end - size
    samples = np.zeros(len(media), np.int64)
    first = np.zeros(len(media), np.int64)
    for i, x in enumerate(media):
        if x[:4] != b"fLaC" or len(x) < flac.HEADER or x[4] & 0x7F != 0:
            raise ValueError("FLAC: no stream marker or no stream info")
        at, block = 4, 0
        while not block & 0x80:  # metadata blocks, of which the first describes the stream
            block, length = x[at], int.from_bytes(x[at + 1 : at + 4], "big")
            at += 4 + length
        fields = int.from_bytes(x[18:26], "big")
        samples[i], first[i] = fields & ((1 << 36) - 1), begin[i] + at
        if int.from_bytes(x[8:10], "big") != flac.BLOCK or samples[i] % flac.BLOCK or (fields >> 36) & 31 != 7 or (fields >> 41) & 7:
            raise ValueError("FLAC: not a stream of this profile")
    count = samples // flac.BLOCK
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = _frame_starts(data, first, end, count)
    pcm, ends = [], []
    for lo in range(0, len(starts), LANES):
        # the frames of a slice lie together: bit readers are made over its own bytes only
        base = int(starts[lo])
        x, stop = flac.decode_frames(data[base : int(starts[lo + LANES]) if lo + LANES < len(starts) else len(data)], starts[lo : lo + LANES] - base, number[lo : lo + LANES])
        pcm.append((x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes())
        ends.append(stop + base)
    raw, ends = b"".join(pcm), np.concatenate(ends) if ends else np.zeros(0, np.int64)
    frames = np.concatenate(([0], np.cumsum(count)))
    last = np.repeat(end, count)
    following = np.append(starts[1:], 0)
    following[frames[1:][count > 0] - 1] = end[count > 0]
    if (ends != following).any() or (last < ends).any():
        raise ValueError("FLAC: frames do not fill the stream")
    out, offsets = [], []
    for i, x in enumerate(media):
        own = raw[frames[i] * flac.BLOCK : frames[i + 1] * flac.BLOCK]
        if hashlib.md5((np.frombuffer(own, np.uint8) ^ 0x80).tobytes()).digest() != x[26:42]:
            raise ValueError("FLAC: MD5 of the samples")
        out.append(own)
        offsets.append(starts[frames[i] : frames[i + 1]] - begin[i])
    return out, offsets


def _decoded(batches):
    for batch in batches:
        column = batch.column("media")
        lo = 0
        sizes = np.diff(_offsets(column))
        while lo < batch.num_rows:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), K.CHUNK)))
            media = [x.as_py() for x in column.slice(lo, hi - lo)]
            pcm, offsets = decode_rows([x for x in media if x is not None])
            pcm, offsets = iter(pcm), iter(offsets)
            rows = [(None, None) if x is None else (next(pcm), next(offsets)) for x in media]
            yield pa.record_batch(
                [batch.column("id").slice(lo, hi - lo), column.slice(lo, hi - lo), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.list_(pa.int64()))],
                ["id", "media", "pcm", "frame_offsets"],
            )
            lo = hi


def decode_media(media: DataFrame) -> DataFrame:
    """``media(id, media)`` as (id, media, pcm, frame_offsets), verified."""
    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "media").mapInArrow(_decoded, f"id {kind}, media binary, pcm binary, frame_offsets array<bigint>")


def pcm_blocks(decoded: DataFrame, samples: int = 4096) -> DataFrame:
    """(id, block, first_sample, media_offset, pcm): rows of whole frames that can be sought by sample.

    ``media_offset`` is the byte of the stream at which decoding for
    ``first_sample`` may start. Write it sorted or partitioned by id to seek.
    """
    frames = max(1, samples // flac.BLOCK)
    block = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("frame_offsets") - 1) / frames)).cast("int")))
    rows = decoded.where("pcm is not null").select("id", "pcm", "frame_offsets", block.alias("block"))
    start = F.col("block").cast("long") * frames * flac.BLOCK
    return rows.select(
        "id",
        "block",
        start.alias("first_sample"),
        F.element_at("frame_offsets", F.col("block") * frames + 1).alias("media_offset"),
        F.substring("pcm", (start + 1).cast("int"), F.lit(frames * flac.BLOCK)).alias("pcm"),
    )


def padded_payload(text) -> F.Column:
    """UTF-8 bytes of a text (null: none), padded with spaces to a positive multiple of the block."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    short = F.greatest(F.lit(1), F.ceil(size / flac.BLOCK)) * flac.BLOCK - size
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), short.cast("int")), "UTF-8"))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as FLAC, read back, and digested; the feature is of the decoded samples."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n")).alias("id"), padded_payload(F.col(text_col)).alias("payload"))
    decoded = decode_media(encode_media(rows))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("samples="), F.octet_length("pcm").cast("string")),
        F.concat(F.lit("frames="), F.size("frame_offsets").cast("string")),
        F.concat(F.lit("crc="), F.crc32("pcm").cast("string")),
        F.concat(F.lit("bits_per_1000_samples="), F.floor(F.octet_length("media").cast("long") * 8000 / F.octet_length("pcm")).cast("string")),
    )
    return decoded.select(
        F.col("id.id").alias(id_col),
        F.col("id.n").alias("n_bytes"),
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
