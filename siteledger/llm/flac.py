"""FLAC: a lossless codec for 8-bit mono PCM, with all frames of a batch worked on at once.

The decoder reads the format's constant, verbatim, fixed and linear-predictor subframes,
decodes partitioned Rice residuals, verifies the CRC of every frame header and frame, the
sample count and the MD5 of the samples, and writes PCM blocks with the sample offset at
which each begins. The encoder chooses a fixed predictor and Rice parameters per frame (or
uses given linear predictors) and writes a seek table.
"""

from __future__ import annotations

import hashlib
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, narrow, small_batches

by_value(sys.modules[__name__])

BLOCK = 576
#: Frames that are encoded or decoded together.
FRAMES = 2048
SAMPLE_RATE = 8000
PARTITION_ORDER = 2
#: A seek point for every so many frames; with one for each, frames are found without reading those before.
SEEK_EVERY = 1


def _crc_table(bits: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    top, mask = np.uint32(1 << (bits - 1)), np.uint32((1 << bits) - 1)
    for _ in range(8):
        table = np.where(table & top, (table << np.uint32(1)) ^ np.uint32(poly), table << np.uint32(1)) & mask
    return table


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crcs(raw: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of many stretches of ``raw`` at once."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    crc = np.zeros(len(start), np.uint32)
    active = len(start)
    for k in range(int(length[0]) if len(length) else 0):
        while active and length[active - 1] <= k:
            active -= 1
        c = crc[:active]
        crc[:active] = table[((c >> np.uint32(bits - 8)) ^ raw[start[:active] + k]) & np.uint32(0xFF)] ^ ((c << np.uint32(8)) & np.uint32((1 << bits) - 1))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    parts = []
    limit = 0x40
    while n >= limit:
        parts.append(0x80 | (n & 0x3F))
        n >>= 6
        limit = 1 << (6 - len(parts))
    lead = (0xFF00 >> (len(parts) + 1)) & 0xFF
    return bytes([lead | n, *reversed(parts)])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    more = 0
    while first & (0x80 >> (more + 1)):
        more += 1
    n = first & ((0x40 >> more) - 1)
    for k in range(1, more + 1):
        if data[at + k] & 0xC0 != 0x80:
            raise ValueError("frame number is malformed")
        n = n << 6 | data[at + k] & 0x3F
    return n, at + 1 + more


# --------------------------------------------------------------------------- encoder


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width) -> None:
    """Write values of ``width`` bits (one number, or one per value) at bit positions."""
    width = np.broadcast_to(np.asarray(width), at.shape)
    for k in range(int(width.max()) if len(width) else 0):
        use = width > k
        bits[(at + width - 1 - k)[use]] = (value[use] >> k) & 1


def encode_frames(samples: np.ndarray, numbers: np.ndarray, predictors: tuple[list[int], int] | None = None) -> list[bytes]:
    """FLAC frames of the rows of ``samples`` (frames x BLOCK, -128..127) with these frame numbers.

    ``predictors``: (integer coefficients, shift) for linear-predictor subframes; by
    default each frame takes the fixed predictor of order 0 to 2 with the smallest residuals.
    """
    n, size = samples.shape
    x = samples.astype(np.int64)
    residual = np.empty((n, size), np.int64)
    constant = (x == x[:, :1]).all(1)
    if predictors is None:
        diffs = [x]
        for _ in range(2):
            step = diffs[-1].copy()
            step[:, 1:] -= diffs[-1][:, :-1]
            diffs.append(step)
        cost = np.stack([np.abs(d[:, 2:]).sum(1) for d in diffs])
        order = cost.argmin(0)
        residual = np.choose(order[:, None], diffs)
        setup = np.zeros(n, np.int64)
    else:
        taps, shift = predictors
        order = np.full(n, len(taps))
        guess = np.zeros_like(x)
        for k, c in enumerate(taps):
            guess[:, len(taps) :] += c * x[:, len(taps) - 1 - k : size - 1 - k]
        residual = x - (guess >> shift)
        setup = np.full(n, 4 + 5 + 12 * len(taps))
    parts = 1 << PARTITION_ORDER
    folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    warm = np.arange(size)[None, :] < order[:, None]
    folded = np.where(warm, 0, folded)
    split = folded.reshape(n, parts, size // parts)
    means = split.mean(2)
    rice = np.clip(np.ceil(np.log2(np.maximum(means, 1e-9) * 0.6931 + 1e-9)), 0, 14).astype(np.int64)
    k = np.repeat(rice, size // parts, axis=1)
    width = np.where(warm, 0, (folded >> k) + 1 + k)
    heads = [bytes([0xFF, 0xF8, 0x24, 0x02]) + _coded_number(int(i)) for i in numbers]
    head_len = np.array([len(h) + 1 for h in heads], np.int64)
    body_bits = np.where(constant, 16, 8 + 8 * order + setup + 6 + 4 * parts + width.sum(1))
    total = head_len + (body_bits + 7) // 8 + 2
    start = np.cumsum(total) - total
    bits = np.zeros(int(total.sum()) * 8, np.uint8)
    body = (start + head_len) * 8
    kind = np.where(constant, 0, np.where(setup > 0, 0x20 | (order - 1), 0x08 | order))
    _put(bits, body, kind << 1, 8)
    flat = np.flatnonzero(constant)
    _put(bits, body[flat] + 8, x[flat, 0] & 0xFF, 8)
    live = ~constant
    at = body + 8
    for w in range(int(order.max()) if n else 0):
        use = np.flatnonzero(live & (order > w))
        _put(bits, at[use] + 8 * w, x[use, w] & 0xFF, 8)
    at = at + 8 * order
    if predictors is not None:
        use = np.flatnonzero(live)
        _put(bits, at[use], np.full(len(use), 11), 4)
        _put(bits, at[use] + 4, np.full(len(use), shift), 5)
        for j, c in enumerate(taps):
            _put(bits, at[use] + 9 + 12 * j, np.full(len(use), c & 0xFFF), 12)
        at = at + setup
    _put(bits, at[live], np.full(int(live.sum()), PARTITION_ORDER), 6)
    at = at + 6
    before = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(width.reshape(n, parts, -1).sum(2), axis=1)], axis=1)
    for p in range(parts):
        _put(bits, (at + before[:, p] + 4 * p)[live], rice[live, p], 4)
    ends = np.cumsum(width, axis=1)
    place = at[:, None] + ends - width + 4 * (np.arange(size)[None, :] // (size // parts) + 1)
    use = live[:, None] & ~warm
    place, value, low = place[use], folded[use], k[use]
    stop = place + (value >> low)
    bits[stop] = 1
    _put(bits, stop + 1, value & ((1 << low) - 1), low)
    raw = np.packbits(bits)
    head_raw = np.frombuffer(b"".join(h + b"\0" for h in heads), np.uint8)
    first = np.cumsum(head_len) - head_len
    raw[np.repeat(start - first, head_len) + np.arange(len(head_raw))] = head_raw
    raw[start + head_len - 1] = _crcs(raw, start, head_len - 1, CRC8, 8)
    crc = _crcs(raw, start, total - 2, CRC16, 16)
    raw[start + total - 2], raw[start + total - 1] = crc >> 8, crc & 0xFF
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(start, start + total)]


def _stream(frames: list[bytes], payload: bytes) -> bytes:
    """Marker, stream information, seek table and frames."""
    sizes = [len(f) for f in frames]
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    rate = SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    info += rate.to_bytes(8, "big") + hashlib.md5(signed).digest()
    seeks, offset = b"", 0
    for n, size in enumerate(sizes):
        if n % SEEK_EVERY == 0:
            seeks += (n * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + BLOCK.to_bytes(2, "big")
        offset += size
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seeks).to_bytes(3, "big") + seeks + b"".join(frames)


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes filled with 255 to a positive multiple of BLOCK, and their own number."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (max(-(-len(data) // BLOCK), 1) * BLOCK - len(data)), len(data)


def encode(payloads: list[bytes], predictors: tuple[list[int], int] | None = None) -> list[bytes]:
    """A FLAC stream per payload; byte b is stored as the sample b - 128."""
    counts = [len(p) // BLOCK for p in payloads]
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16).reshape(-1, BLOCK) - 128
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.empty(0, np.int64)
    frames: list[bytes] = []
    for at in range(0, len(x), FRAMES):
        frames += encode_frames(x[at : at + FRAMES], numbers[at : at + FRAMES], predictors)
    ends = np.cumsum(counts)
    return [_stream(frames[b - c : b], p) for p, b, c in zip(payloads, ends, counts)]


# --------------------------------------------------------------------------- decoder


class _Bits:
    """Reads numbers at many bit positions of one buffer at once."""

    def __init__(self, raw: np.ndarray):
        whole = np.concatenate([raw, np.zeros(8, np.uint8)])
        wide = whole.astype(np.uint64)
        n = len(raw) + 3
        self.word = wide[:n] << np.uint64(32) | wide[1 : n + 1] << np.uint64(24) | wide[2 : n + 2] << np.uint64(16) | wide[3 : n + 3] << np.uint64(8) | wide[4 : n + 4]
        bits = len(raw) * 8
        place = np.where(np.unpackbits(raw), np.arange(bits, dtype=np.int32), np.int32(bits))
        self.next_one = np.append(np.minimum.accumulate(place[::-1])[::-1], np.int32(bits))

    def read(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned numbers of up to 32 bits."""
        width = np.asarray(width, np.uint64)
        shift = np.uint64(40) - (at & 7).astype(np.uint64) - width
        return ((self.word[at >> 3] >> shift) & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)


def _signed(value: np.ndarray, width: int) -> np.ndarray:
    return value - ((value >> (width - 1)) << width)


def read_header(data: bytes) -> dict:
    """Stream information, seek points and the place of the first frame."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, found = 4, False, {"seek": []}
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if kind == 0:
            rate = int.from_bytes(block[10:18], "big")
            found |= {"block": int.from_bytes(block[:2], "big"), "channels": (rate >> 41 & 7) + 1, "bits": (rate >> 36 & 31) + 1, "samples": rate & ((1 << 36) - 1), "md5": block[18:34]}
        elif kind == 3:
            found["seek"] = [(int.from_bytes(block[k : k + 8], "big"), int.from_bytes(block[k + 8 : k + 16], "big")) for k in range(0, size, 18)]
        at += 4 + size
    if found.get("bits") != 8 or found.get("channels") != 1 or found.get("block") != BLOCK:
        raise ValueError("only 8-bit mono streams of the fixed block size are read")
    return found | {"first": at}


def _frame_heads(raw: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Checks sync codes, frame numbers and header CRCs; returns where the subframes begin."""
    for k, want in enumerate((0xFF, 0xF8, 0x24, 0x02)):
        if (raw[at + k] != want).any():
            raise ValueError("no frame where one was due")
    want = [_coded_number(int(n)) for n in numbers]
    size = np.array([len(w) for w in want], np.int64)
    flat = np.frombuffer(b"".join(want), np.uint8)
    first = np.cumsum(size) - size
    if (raw[np.repeat(at + 4 - first, size) + np.arange(len(flat))] != flat).any():
        raise ValueError("a frame number is wrong")
    end = at + 4 + size
    if (_crcs(raw, at, end - at, CRC8, 8) != raw[end]).any():
        raise ValueError("a frame header fails its checksum")
    return end + 1


def decode_frames(raw: np.ndarray, at: np.ndarray, numbers: np.ndarray, checked: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames x BLOCK) and ends of the frames that begin at the bytes ``at`` of ``raw``.

    The residuals of all frames are read side by side, one sample at a time.
    """
    n = len(at)
    pos = _frame_heads(raw, at, numbers) * 8
    bits = _Bits(raw)
    kind = bits.read(pos, 8) >> 1
    pos = pos + 8
    out = np.zeros((n, BLOCK), np.int64)
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind & 0x38) == 0x08, (kind & 0x20) == 0x20
    if not (constant | verbatim | fixed | linear).all():
        raise ValueError("unknown kind of subframe")
    order = np.where(linear, (kind & 0x1F) + 1, np.where(fixed, kind & 7, 0))
    out[constant] = _signed(bits.read(pos[constant], 8), 8)[:, None]
    pos = np.where(constant, pos + 8, pos)
    for f in np.flatnonzero(verbatim):
        out[f] = _signed(bits.read(pos[f] + 8 * np.arange(BLOCK), 8), 8)
        pos[f] += 8 * BLOCK
    live = np.flatnonzero(fixed | linear)
    if len(live):
        p, own = pos[live], order[live]
        top = int(own.max())
        x = np.zeros((len(live), BLOCK), np.int64)
        for w in range(top):
            x[:, w] = np.where(own > w, _signed(bits.read(p + 8 * w, 8), 8), 0)
        p = p + 8 * own
        taps = np.zeros((len(live), max(top, 4)), np.int64)
        shift = np.zeros(len(live), np.int64)
        for o, c in enumerate(((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))):
            taps[np.ix_((own == o) & fixed[live], range(len(c)))] = c
        use = np.flatnonzero(linear[live])
        if len(use):
            precision = bits.read(p[use], 4) + 1
            shift[use] = bits.read(p[use] + 4, 5)
            for j in range(top):
                has = own[use] > j
                value = bits.read(p[use] + 9 + precision * j, precision)
                taps[use, j] = np.where(has, value - ((value >> (precision - 1)) << precision), 0)
            p[use] += 9 + precision * own[use]
        method, depth = bits.read(p, 2), bits.read(p + 2, 4)
        if (method > 1).any():
            raise ValueError("unknown residual coding")
        width_of = 4 + method
        p = p + 6
        rice, raw_bits = np.zeros(len(live), np.int64), np.full(len(live), -1)
        per_part = BLOCK >> depth
        residual = np.zeros((len(live), BLOCK), np.int64)
        for s in range(BLOCK):
            fresh = (s % per_part == 0) if s else np.ones(len(live), bool)
            if fresh.any():
                rice = np.where(fresh, bits.read(p, width_of), rice)
                p = np.where(fresh, p + width_of, p)
                escape = fresh & (rice == (1 << width_of) - 1)
                raw_bits = np.where(fresh, -1, raw_bits)
                if escape.any():
                    raw_bits = np.where(escape, bits.read(p, 5), raw_bits)
                    p = np.where(escape, p + 5, p)
            todo = own <= s
            plain = todo & (raw_bits < 0)
            # the next set bit ends the quotient
            stop = bits.next_one[p].astype(np.int64)
            value = (stop - p) << rice | bits.read(np.minimum(stop + 1, len(raw) * 8), rice)
            folded = (value >> 1) ^ -(value & 1)
            residual[:, s] = np.where(plain, folded, 0)
            p = np.where(plain, stop + 1 + rice, p)
            if (todo & ~plain).any():
                use = np.flatnonzero(todo & ~plain)
                value = bits.read(p[use], raw_bits[use])
                half = np.maximum(raw_bits[use] - 1, 0)
                residual[use, s] = value - ((value >> half & (raw_bits[use] > 0)) << raw_bits[use])
                p[use] += raw_bits[use]
        for s in range(BLOCK):
            if top and s:
                reach = min(top, s)
                past = x[:, s - reach : s][:, ::-1]
                guess = (taps[:, :reach] * past).sum(1) >> shift
            else:
                guess = 0
            x[:, s] = np.where(own <= s, residual[:, s] + guess, x[:, s])
        out[live], pos[live] = x, p
    end = (pos + 7) // 8
    if checked:
        got = raw[end].astype(np.uint32) << np.uint32(8) | raw[end + 1]
        if (_crcs(raw, at, end - at, CRC16, 16) != got).any():
            raise ValueError("a frame fails its checksum")
    return out, end + 2


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples (int8) of each stream; a damaged stream raises ValueError.

    Frames named by a full seek table are read together, across streams; a stream without
    one is read frame after frame.
    """
    out: list[np.ndarray | None] = [None] * len(streams)
    infos = [read_header(s) for s in streams]
    pending: list[tuple[int, int, int, int]] = []  # stream, frame, begin, end
    for n, (data, info) in enumerate(zip(streams, infos)):
        frames = -(-info["samples"] // BLOCK)
        out[n] = np.empty((frames, BLOCK), np.int8)
        begins = [info["first"] + at for _, at in info["seek"]]
        if [s for s, _ in info["seek"]] == list(range(0, frames * BLOCK, BLOCK)):
            pending += list(zip([n] * frames, range(frames), begins, [*begins[1:], len(data)]))
            continue
        raw, at = np.frombuffer(data, np.uint8), info["first"]
        for k in range(frames):
            block, end = decode_frames(raw[at:], np.zeros(1, np.int64), np.array([k]))
            out[n][k] = block[0]
            at += int(end[0])
    for at in range(0, len(pending), FRAMES):
        part = pending[at : at + FRAMES]
        raw = np.frombuffer(b"".join(streams[n][a:b] for n, _, a, b in part), np.uint8)
        sizes = np.array([b - a for _, _, a, b in part], np.int64)
        begins = np.cumsum(sizes) - sizes
        blocks, ends = decode_frames(raw, begins, np.array([k for _, k, _, _ in part]))
        if (ends != begins + sizes).any():
            raise ValueError("a frame does not end where the next begins")
        for (n, k, _, _), block in zip(part, blocks.astype(np.int8)):
            out[n][k] = block
    whole = [x.reshape(-1)[: info["samples"]] for x, info in zip(out, infos)]
    for x, info in zip(whole, infos):
        if hashlib.md5(x.tobytes()).digest() != info["md5"]:
            raise ValueError("the samples fail the checksum of the stream")
    return whole


def features(samples: np.ndarray) -> str:
    """Loudness, zero crossings and peak of the samples, the same for the same samples."""
    x = samples.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"rms={np.sqrt((x * x).sum() / len(x)):.6f};zcr={crossings / max(len(x) - 1, 1):.6f};peak={int(np.abs(x).max())}"


# --------------------------------------------------------------------------- Spark


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded, as a FLAC stream.

    A null text counts as empty; it is one block of padding. Null ids and repeated rows
    keep their rows; equal texts give equal streams.
    """
    small_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col)

    def run(batches):
        for batch in batches:
            made = [padded(t) for t in batch.column(1).to_pylist()]
            media = encode([p for p, _ in made])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return rows.mapInArrow(run, schema)


LONG, TEXT = (T.LongType(), pa.int64()), (T.StringType(), pa.string())


def _mapped(media: DataFrame, keep: list[str], fields: dict, make) -> DataFrame:
    """The kept columns with what ``make`` gives for the samples and bytes of each stream: rows of values."""
    small_batches(media.sparkSession)
    source = media.select(F.struct(*keep).alias("k"), "media")
    schema = T.StructType([source.schema["k"], *[T.StructField(n, t) for n, (t, _) in fields.items()]])
    types = [t for _, t in fields.values()]

    def run(batches):
        for batch in batches:
            streams = batch.column(1).to_pylist()
            made = [make(x, s) for x, s in zip(decode(streams), streams)]
            owner = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
            columns = list(zip(*[row for m in made for row in m])) or [[] for _ in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *[pa.array(list(c), t) for c, t in zip(columns, types)]], names=schema.names)

    return source.mapInArrow(run, schema).select("k.*", *schema.names[1:])


def pcm_blocks(media: DataFrame, keep: list[str]) -> DataFrame:
    """Decoded blocks of the streams in ``media``: the kept columns, first_sample, n_samples and pcm (signed 8-bit).

    A reader that wants sample s of a stream takes the block with the largest first_sample not above s.
    """

    def make(samples: np.ndarray, _: bytes) -> list[tuple]:
        return [(at, len(samples[at : at + BLOCK]), samples[at : at + BLOCK].tobytes()) for at in range(0, len(samples), BLOCK)]

    return _mapped(media, keep, {"first_sample": LONG, "n_samples": LONG, "pcm": (T.BinaryType(), pa.binary())}, make)


def digests(media: DataFrame, keep: list[str]) -> DataFrame:
    """What the stored streams say of themselves when they are read back, one row per stream."""

    def make(samples: np.ndarray, stream: bytes) -> list[tuple]:
        payload = (samples.view(np.uint8) ^ 0x80).tobytes()
        return [(len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), features(samples))]

    fields = {"payload_bytes": LONG, "payload_sha256": TEXT, "tail_crc32": LONG, "media_bytes": LONG, "media_sha256": TEXT, "feature": TEXT}
    return _mapped(media, keep, fields, make)
