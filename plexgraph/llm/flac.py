"""FLAC streams as a media column: lossless 8-bit mono, encoded and decoded for many frames at once.

A payload of whole blocks of 576 samples becomes one stream: STREAMINFO with the MD5 of the samples, a SEEKTABLE, and a
frame for each block. The decoder reads STREAMINFO and SEEKTABLE, checks every header's CRC-8 and every frame's CRC-16,
reads Rice residuals, undoes fixed and quantised linear predictors, and checks the MD5. Frames do not depend on each
other, so all frames of a batch of documents go through each step together: the k-th residual of every frame is read
in one numpy operation.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import table

BLOCK = 576
RATE = 32_000
#: Frames that go through the arrays at once; bounds memory.
AT_ONCE = 2048
SEEK_EVERY = 1


class FlacError(ValueError):
    """A stream that is not well formed or fails a checksum."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, dtype=np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[i] = c
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Leading zeros of each 16-bit number.
_ZEROS = np.array([16] + [16 - i.bit_length() for i in range(1, 65536)], dtype=np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans of flat: the k-th byte of every span in one step."""
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    c = np.zeros(len(at), dtype=np.uint32)
    for k in range(len(live)):
        m = live[k]
        c[:m] = ((c[:m] << 8) & 0xFFFF) ^ _CRC16[(c[:m] >> 8) ^ flat[at[:m] + k]]
    out = np.empty_like(c)
    out[order] = c
    return out


def _number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n]) + bytes(reversed(tail))


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    more = 8 - (first ^ 0xFF).bit_length() - 1
    n = first & (0x3F >> more)
    for b in data[at + 1 : at + 1 + more]:
        n = n << 6 | b & 0x3F
    return n, at + 1 + more


def _header(number: int) -> bytes:
    """Fixed block size 576 (code 2), rate from STREAMINFO, mono, 8 bits."""
    head = bytes([0xFF, 0xF8, 0x20, 0x02]) + _number(number)
    return head + bytes([crc8(head)])


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """samples: (frames, 576) signed 8-bit; the frames' bytes. Each takes the fixed predictor, up to order 4, whose
    residual is smallest, or constant or verbatim coding where that is shorter."""
    x = samples.astype(np.int64)
    count = len(x)
    diffs = [x]
    for _ in range(4):
        diffs.append(np.diff(diffs[-1], axis=1))
    cost = np.stack([np.abs(d[:, 4 - o :]).sum(1) for o, d in enumerate(diffs)], axis=1)
    order = cost.argmin(1)
    constant = (x == x[:, :1]).all(1)
    parts: list[bytes] = [b""] * count
    for o in range(5):
        rows = np.flatnonzero((order == o) & ~constant)
        if not len(rows):
            continue
        r = diffs[o][rows]
        u = np.where(r >= 0, 2 * r, -2 * r - 1)
        # One Rice parameter a frame: the one with the fewest bits.
        bits = np.stack([(u >> k).sum(1) + (k + 1) * u.shape[1] for k in range(13)], axis=1)
        k = bits.argmin(1)
        body = bits[np.arange(len(rows)), k]
        size = 8 + 8 * o + 2 + 4 + 4 + body
        verbatim = 8 + 8 * BLOCK
        plain = size >= verbatim
        for j in np.flatnonzero(plain):
            parts[rows[j]] = b"\x02" + samples[rows[j]].astype(np.int8).tobytes()
        keep = np.flatnonzero(~plain)
        if not len(keep):
            continue
        rows, u, k, size = rows[keep], u[keep], k[keep], size[keep]
        stride = (size + 7) // 8 * 8
        base = np.concatenate([[0], np.cumsum(stride)])
        flat = np.zeros(int(base[-1]), dtype=np.uint8)
        start = base[:-1]

        def put(at: np.ndarray, values: np.ndarray, width: int, flat: np.ndarray = flat) -> None:
            for b in range(width):
                flat[at + b] = (values >> (width - 1 - b)) & 1

        put(start, np.full(len(rows), (8 + o) << 1), 8)
        for w in range(o):
            put(start + 8 + 8 * w, x[rows, w] & 0xFF, 8)
        put(start + 8 + 8 * o, np.zeros(len(rows), dtype=np.int64), 6)
        put(start + 14 + 8 * o, k, 4)
        q = u >> k[:, None]
        length = q + 1 + k[:, None]
        at = start[:, None] + 18 + 8 * o + np.cumsum(length, axis=1) - length
        flat[at + q] = 1
        low = at + q + 1
        for b in range(int(k.max())):
            use = k > b
            shift = (k[use] - 1 - b)[:, None]
            flat[low[use] + b] = (u[use] >> shift) & 1
        packed = np.packbits(flat).tobytes()
        edges = (base // 8).tolist()
        for j, row in enumerate(rows.tolist()):
            parts[row] = packed[edges[j] : edges[j + 1]]
    for row in np.flatnonzero(constant).tolist():
        parts[row] = b"\x00" + samples[row, :1].astype(np.int8).tobytes()
    frames = [_header(n) + p for n, p in zip(numbers.tolist(), parts)]
    flat = np.frombuffer(b"".join(frames), dtype=np.uint8)
    lengths = np.array([len(f) for f in frames], dtype=np.int64)
    sums = crc16(flat, np.cumsum(lengths) - lengths, lengths)
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, sums)]


def stream(frames: list[bytes], md5: bytes) -> bytes:
    """Metadata and frames of one document. The seek table has a point every SEEK_EVERY frames."""
    sizes = [len(f) for f in frames]
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 7 << 36 | len(frames) * BLOCK).to_bytes(8, "big") + md5
    points, at = [], 0
    for i, n in enumerate(sizes):
        if i % SEEK_EVERY == 0:
            points.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + BLOCK.to_bytes(2, "big"))
        at += n
    seek = b"".join(points)
    # A block's length has 24 bits: very long documents keep every 2nd, 4th, ... point.
    while len(seek) >= 1 << 24:
        points = points[::2]
        seek = b"".join(points)
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each payload, whose length is a positive multiple of 576. Byte b becomes sample b - 128."""
    out, waiting, frames_of = [], [], []
    for p in payloads:
        samples = (np.frombuffer(p, dtype=np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
        frames_of.append(len(samples))
        waiting.append(samples)
    every = np.concatenate(waiting) if waiting else np.zeros((0, BLOCK), dtype=np.int8)
    numbers = np.concatenate([np.arange(n) for n in frames_of]) if frames_of else np.zeros(0, dtype=np.int64)
    frames: list[bytes] = []
    for at in range(0, len(every), AT_ONCE):
        frames += encode_frames(every[at : at + AT_ONCE], numbers[at : at + AT_ONCE])
    at = 0
    for samples in waiting:
        out.append(stream(frames[at : at + len(samples)], hashlib.md5(samples.tobytes()).digest()))
        at += len(samples)
    return out


def _metadata(media: bytes) -> tuple[int, int, bytes, list[tuple[int, int]], int]:
    """Block size, samples, MD5, seek points, and where the frames start."""
    if media[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, last, info, points = 4, False, None, []
    while not last:
        last, kind, n = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + n]
        if kind == 0:
            info = body
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, n, 18)]
        at += 4 + n
    if info is None:
        raise FlacError("no STREAMINFO")
    rest = int.from_bytes(info[10:18], "big")
    if (rest >> 41 & 7, rest >> 36 & 31) != (0, 7) or info[:2] != info[2:4]:
        raise FlacError("only 8-bit mono of a fixed block size is supported")
    return int.from_bytes(info[:2], "big"), rest & (1 << 36) - 1, info[18:34], points, at


class _Bits:
    """Reads the same field from many places of one buffer at once."""

    def __init__(self, flat: np.ndarray):
        self.words = np.ndarray(shape=(len(flat),), dtype=">u8", buffer=np.concatenate([flat, np.zeros(16, np.uint8)]), strides=(1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each position, of which the first 57 are certain."""
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self.window(at) >> np.uint64(64 - width)).astype(np.int64)


def _signed(values: np.ndarray, width) -> np.ndarray:
    half = np.left_shift(np.int64(1), np.asarray(width, dtype=np.int64) - 1)
    return (values ^ half) - half


def _unary(bits: _Bits, at: np.ndarray) -> np.ndarray:
    """Zeros before the next one at each place, for runs of 16 and more."""
    run, pos, todo = np.zeros(len(at), dtype=np.int64), at.copy(), np.arange(len(at))
    while len(todo):
        z = _ZEROS[bits.read(pos[todo], 16)]
        run[todo] += z
        pos[todo] += z
        todo = todo[z == 16]
    return run


def _residuals(bits: _Bits, at: np.ndarray, order: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The residual of each frame, from sample `order` on, and where each ends."""
    n = len(at)
    if bits.read(at, 2).max(initial=0) > 1:
        raise FlacError("reserved residual coding")
    wide, split = 4 + bits.read(at, 2), bits.read(at + 2, 4)
    at = at + 6
    size = block >> split
    if (size <= order).any() or (size << split != block).any():
        raise FlacError("partitions do not fit the block")
    out = np.zeros((n, block), dtype=np.int64)
    k, raw, escaped = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    sizes, most, one = np.unique(size).tolist(), int(order.max(initial=0)), np.uint64(1)
    none = True
    for i in range(block):
        if i <= most or any(i % s == 0 for s in sizes):
            # A partition starts with its parameter; the first one before its first residual.
            starts = np.flatnonzero((i >= order) & ((i % size == 0) | (i == order)))
            w = wide[starts]
            k[starts] = value = (bits.window(at[starts]) >> (64 - w).astype(np.uint64)).astype(np.int64)
            at[starts] += w
            escaped[starts] = value == (1 << w) - 1
            e = starts[escaped[starts]]
            raw[e] = bits.read(at[e], 5)
            at[e] += 5
            none = not escaped.any()
            down, low = (64 - np.maximum(k, 1)).astype(np.uint64), (k > 0).astype(np.int64)
        rows = slice(None) if none and i >= most else np.flatnonzero((i >= order) & ~escaped)
        word = bits.window(at[rows])
        zeros = _ZEROS[(word >> np.uint64(48)).astype(np.int64)]
        rest = ((word << (zeros.astype(np.uint64) + one)) >> down[rows]).astype(np.int64)
        deep = np.flatnonzero(zeros == 16)
        if len(deep):
            zeros[deep] = _unary(bits, at[rows][deep])
            rest[deep] = (bits.window(at[rows][deep] + zeros[deep] + 1) >> down[rows][deep]).astype(np.int64)
        u = (zeros << k[rows]) | (rest * low[rows])
        out[rows, i] = (u >> 1) ^ -(u & 1)
        at[rows] += zeros + 1 + k[rows]
        if not none:
            rows = np.flatnonzero((i >= order) & escaped)
            w = raw[rows]
            some = np.maximum(w, 1)
            value = _signed((bits.window(at[rows]) >> (64 - some).astype(np.uint64)).astype(np.int64), some)
            out[rows, i] = np.where(w > 0, value, 0)
            at[rows] += w
    return out, at


def decode_frames(flat: np.ndarray, starts: np.ndarray, bodies: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Samples (frames, block). starts, bodies and ends: where each frame, its subframe and its CRC-16 stand."""
    sums = crc16(flat, starts, ends - starts)
    if (sums != flat[ends].astype(np.uint32) * 256 + flat[ends + 1]).any():
        raise FlacError("a frame fails its CRC-16")
    bits = _Bits(flat)
    at = bodies * 8
    kind = bits.read(at, 8)
    if (kind & 0x81).any():
        raise FlacError("wasted bits or a reserved bit")
    kind >>= 1
    at = at + 8
    out = np.zeros((len(starts), block), dtype=np.int64)
    stops = np.zeros(len(starts), dtype=np.int64)
    rows = np.flatnonzero(kind == 0)
    out[rows] = _signed(bits.read(at[rows], 8), 8)[:, None]
    stops[rows] = at[rows] + 8
    rows = np.flatnonzero(kind == 1)
    for i in range(block) if len(rows) else ():
        out[rows, i] = _signed(bits.read(at[rows] + 8 * i, 8), 8)
    stops[rows] = at[rows] + 8 * block
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind < 2)).all():
        raise FlacError("reserved subframe type")
    every = np.flatnonzero(fixed)
    r, stops[every] = _residuals(bits, at[every] + 8 * (kind[every] - 8), kind[every] - 8, block)
    for o in np.unique(kind[fixed]):
        mine = np.flatnonzero(kind[every] == o)
        rows, o = every[mine], int(o) - 8
        warm = np.stack([_signed(bits.read(at[rows] + 8 * i, 8), 8) for i in range(o)], axis=1) if o else np.zeros((len(rows), 0), np.int64)
        x = r[mine, o:]
        # Undo one difference after the other: each is a running sum from the last warm-up difference.
        firsts = [warm]
        for _ in range(o):
            firsts.append(np.diff(firsts[-1], axis=1))
        for d in range(o - 1, -1, -1):
            x = firsts[d][:, -1:] + np.cumsum(x, axis=1)
        out[rows, :o], out[rows, o:] = warm, x
    for o in np.unique(kind[linear]):
        rows, o = np.flatnonzero(kind == o), int(o) - 31
        here = at[rows]
        for i in range(o):
            out[rows, i] = _signed(bits.read(here + 8 * i, 8), 8)
        here = here + 8 * o
        precision = bits.read(here, 4) + 1
        shift = _signed(bits.read(here + 4, 5), 5)
        here += 9
        weights = np.zeros((len(rows), o), dtype=np.int64)
        for i in range(o):
            weights[:, i] = _signed((bits.window(here) >> (64 - precision).astype(np.uint64)).astype(np.int64), precision)
            here = here + precision
        r, stops[rows] = _residuals(bits, here, np.full(len(rows), o), block)
        x = out[rows]
        for i in range(o, block):
            x[:, i] = r[:, i] + ((weights * x[:, i - o : i][:, ::-1]).sum(1) >> shift)
        out[rows] = x
    if ((stops + 7) // 8 != ends).any():
        raise FlacError("a subframe does not end where its frame does")
    return out


def decode(media: list[bytes]) -> list[bytes]:
    """The payload of each stream; FlacError if any checksum fails."""
    spans, wholes = [], []
    for m in media:
        block, samples, md5, points, at = _metadata(m)
        frames = list(_frames(m, at, samples // block, dict(points), block))
        spans.append(frames)
        wholes.append((md5, block, samples))
    out: list[bytes] = []
    flat_parts, base, starts, bodies, ends = [], 0, [], [], []
    for m, frames in zip(media, spans):
        flat_parts.append(np.frombuffer(m, dtype=np.uint8))
        for s, b, e in frames:
            starts.append(base + s)
            bodies.append(base + b)
            ends.append(base + e)
        base += len(m)
    flat = np.concatenate(flat_parts) if flat_parts else np.zeros(0, np.uint8)
    a, b, e = (np.array(v, dtype=np.int64) for v in (starts, bodies, ends))
    blocks = {w[1] for w in wholes}
    if len(blocks) > 1:
        return [decode([m])[0] for m in media]
    got = []
    for i in range(0, len(a), AT_ONCE):
        lo, hi = int(a[i]), int(e[min(i + AT_ONCE, len(e)) - 1]) + 2
        part = slice(i, i + AT_ONCE)
        got.append(decode_frames(flat[lo:hi], a[part] - lo, b[part] - lo, e[part] - lo, blocks.copy().pop()).astype(np.int8))
    every = np.concatenate(got) if got else np.zeros((0, BLOCK), np.int8)
    at = 0
    for (md5, block, samples), frames in zip(wholes, spans):
        mine = every[at : at + len(frames)]
        at += len(frames)
        if hashlib.md5(mine.tobytes()).digest() != md5 or mine.size != samples:
            raise FlacError("the samples fail their MD5")
        out.append((mine.view(np.uint8) ^ 0x80).tobytes())
    return out


def _frame_end(m: bytes, at: int, body: int, n: int, count: int, points: dict[int, int], first: int, block: int) -> int:
    """Where frame n ends: at the next seek point, or at the next place that holds the next frame's header with a right
    CRC-8, if the CRC-16 before it is right too (else that place was a chance match, and the search goes on)."""
    if n + 1 == count:
        return len(m)
    if (n + 1) * block in points:
        return first + points[(n + 1) * block]
    head, end = _header(n + 1), body
    while (end := m.find(head, end + 1)) >= 0:
        flat = np.frombuffer(m[at:end], dtype=np.uint8)
        if crc16(flat, np.array([0]), np.array([end - 2 - at]))[0] == int.from_bytes(m[end - 2 : end], "big"):
            return end
    raise FlacError("a frame is missing")


def _frames(m: bytes, at: int, count: int, points: dict[int, int], block: int) -> Iterator[tuple[int, int, int]]:
    """(start, subframe, CRC-16) of each frame."""
    first = at
    for n in range(count):
        number, body = _read_number(m, at + 4)
        if m[at : at + 2] != b"\xff\xf8" or number != n or crc8(m[at:body]) != m[body]:
            raise FlacError("a frame header fails its CRC-8")
        end = _frame_end(m, at, body, n, count, points, first, block)
        if end - 2 <= body:
            raise FlacError("a seek point does not lead to a frame")
        yield at, body + 1, end - 2
        at = end
    if at != len(m):
        raise FlacError("bytes after the last frame")


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False, at_once: int = 4 << 20) -> DataFrame:
    """Store each text as a FLAC stream, read it back and describe both.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and the stream
    as media if asked for). feature: blocks, seek points, the mean square and zero crossings of the samples read back.
    at_once: payload bytes of the documents that are worked on together. Defined results: a null or empty text is one
    block of 576 bytes 255; equal texts give equal values, whatever their rows; null ids stay; an empty table gives no
    rows. A stream that does not read back as it was fails the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            todo: list[tuple] = []
            held = 0
            for k, text in enumerate(batch.column(1)):
                n, p = payload(text.as_py())
                todo.append((ids[k], n, p))
                held += len(p)
                if held >= at_once:
                    yield finish(todo)
                    todo, held = [], 0
            if todo:
                yield finish(todo)

    def finish(todo: list[tuple]) -> pa.RecordBatch:
        media = encode([p for _, _, p in todo])
        back = decode(media)
        rows = []
        for (doc_id, n, p), m, b in zip(todo, media, back):
            if b != p:
                raise FlacError("a payload does not read back")
            x = (np.frombuffer(b, dtype=np.uint8) ^ 0x80).view(np.int8)
            square = int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
            crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
            points = len(_metadata(m)[3])
            feature = f"blocks={len(b) // BLOCK};points={points};mean_square={square // len(x)};crossings={crossings}"
            row = (doc_id, n, len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature)
            rows.append(row + ((m,) if keep_media else ()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names[: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA + (", media binary" if keep_media else ""))


def pcm_block(media: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The block that holds a sample, reached over the seek table: its first sample's number and its samples."""
    block, samples, _, points, first = _metadata(media)
    if not 0 <= sample < samples:
        raise IndexError(sample)
    want = sample // block
    start, offset = max((p for p in points if p[0] <= want * block), default=(0, 0))
    at, n = first + offset, start // block
    while True:
        _, body = _read_number(media, at + 4)
        end = _frame_end(media, at, body, n, samples // block, dict(points), first, block)
        if n == want:
            part = np.frombuffer(media[at:end], dtype=np.uint8)
            x = decode_frames(part, np.array([0]), np.array([body + 1 - at]), np.array([end - 2 - at]), block)
            return n * block, x[0].astype(np.int8)
        at, n = end, n + 1


def op6(spark, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents"))
