"""Media column: baseline JPEG, written and read without loss, with DC thumbnails.

A payload of bytes is stored as the quantised coefficients of a baseline JPEG (three components,
no subsampling, quantiser 1): each unit of 192 bytes is one MCU of three blocks of 64
coefficients. Byte b is the coefficient whose magnitude category is 8 and whose extra bits are b,
that is b for b >= 128 and b - 255 below. The Huffman tables give category 8 a one-bit code, so
every coefficient takes nine bits and an MCU takes 216 bytes; a restart marker after each MCU
resets the DC prediction. The MCUs form a near-square image; the true payload length stands in a
comment marker, MCUs beyond it are filled with category-8 zeros.

The reader is a general one for baseline files: it parses markers, Huffman-decodes the scan with
lookup tables, all restart intervals of all images of a batch with equal tables side by side in
numpy, undoes the DC prediction
and returns the coefficients, from which come the payload and the luminance thumbnail made of DC
values only. It takes any tables, sampling factors and restart intervals; progressive or
arithmetic files are refused.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import read_table

UNIT = 192
_ROWS_A_BATCH = 64  #: images decoded side by side
_SOI, _EOI, _SOF0, _DHT, _DQT, _DRI, _SOS, _COM, _APP0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE, 0xE0


def padded(text: bytes) -> bytes:
    """The text, filled up with blanks to a positive multiple of UNIT."""
    return text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))


# --- writing -----------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payload: bytes) -> bytes:
    """A baseline JPEG whose coefficients are the payload's bytes."""
    n = len(payload) // UNIT
    wide = int(np.ceil(np.sqrt(n)))
    high = -(-n // wide)
    mcus = np.zeros((wide * high, UNIT), np.uint8)
    mcus[:n] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    bits = np.zeros((len(mcus), UNIT, 9), np.uint8)  # a zero bit is the code of category 8
    bits[:, :, 1:] = np.unpackbits(mcus[:, :, None], axis=2)
    packed = np.packbits(bits.reshape(len(mcus), -1), axis=1)
    stuffed = packed == 0xFF
    place = np.arange(packed.size).reshape(packed.shape) + (np.cumsum(stuffed.ravel()) - stuffed.ravel()).reshape(packed.shape) + 2 * np.arange(len(mcus))[:, None]
    scan = np.zeros(packed.size + int(stuffed.sum()) + 2 * len(mcus), np.uint8)
    scan[place] = packed
    ends = place[:, -1] + stuffed[:, -1] + 1
    scan[ends], scan[ends + 1] = 0xFF, 0xD0 + np.arange(len(mcus)) % 8
    table = bytes([1] + [0] * 15) + b"\x08"  # one code of one bit, for category 8 after no zeros
    frame = struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    return b"".join(
        (
            b"\xff\xd8",
            _segment(_APP0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
            _segment(_COM, b"payload=%d" % len(payload)),
            _segment(_DQT, b"\0" + b"\x01" * 64),
            _segment(_SOF0, frame),
            _segment(_DHT, b"\x00" + table + b"\x10" + table),
            _segment(_DRI, struct.pack(">H", 1)),
            _segment(_SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
            scan[:-2].tobytes(),
            b"\xff\xd9",
        )
    )


# --- reading -----------------------------------------------------------------------------------------------------


class Header:
    """What the markers before the scan say."""

    def __init__(self, data: bytes):
        self.quant, self.huff, self.comments, self.restart, at = {}, {}, [], 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if marker == _DQT:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == _SOF0:
                precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                if precision != 8:
                    raise ValueError("not 8-bit")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (_DHT, 0xC8, 0xCC):
                raise ValueError("not a baseline file")
            elif marker == _DHT:
                while body:
                    counts = body[1:17]
                    self.huff[body[0]] = _lookup(counts, body[17 : 17 + sum(counts)])
                    body = body[17 + sum(counts) :]
            elif marker == _DRI:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == _COM:
                self.comments.append(body)
            elif marker == _SOS:
                self.tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.scan = at
        top = [max(p[i] for p in self.parts) for i in (1, 2)]
        single = len(self.parts) == 1
        self.mcus_wide = -(-self.width // (8 * (1 if single else top[0])))
        self.mcus_high = -(-self.height // (8 * (1 if single else top[1])))
        #: component index of each block of an MCU
        self.blocks = [0] if single else [i for i, p in enumerate(self.parts) for _ in range(p[1] * p[2])]
        self.total = self.mcus_wide * self.mcus_high
        self.every = self.restart or self.total
        #: images with equal keys can be decoded side by side
        self.key = (self.every, tuple(self.blocks), tuple(self.tables[p[0]] for p in self.parts), *sorted((k, *v[2:]) for k, v in self.huff.items()))


@functools.lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray, bytes, bytes]:
    """For each next 16 bits: length of the code they begin with (0: none) and its symbol."""
    length, symbol, code, k = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            a, b = code << (16 - bits), (code + 1) << (16 - bits)
            length[a:b], symbol[a:b] = bits, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol, counts, symbols


def _intervals(data: bytes, head: Header) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing, and the byte at which each restart interval begins."""
    raw = np.frombuffer(data, np.uint8)[head.scan :]
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    marks = ff[raw[ff + 1] != 0]
    end = marks[(raw[marks + 1] & 0xF8) != 0xD0]
    marks = marks[marks <= end[0]] if len(end) else np.append(marks, len(raw))
    keep = np.ones(len(raw), bool)
    keep[ff[raw[ff + 1] == 0] + 1] = False
    starts = np.concatenate([[0], marks[:-1] + 2])
    lanes = starts - np.searchsorted(ff[raw[ff + 1] == 0] + 1, starts)
    n = -(-head.total // head.every)
    if len(lanes) < n:
        raise ValueError("restart intervals are missing")
    # Markers stay between the intervals as bytes that no interval reaches in a sound file.
    return raw[keep], lanes[:n]


def coefficients(images: list[tuple[bytes, Header]]) -> list[np.ndarray]:
    """For each image (MCU, block of the MCU, 64) quantised coefficients in zigzag order, DC prediction undone."""
    groups, out = defaultdict(list), [None] * len(images)
    for i, (_, head) in enumerate(images):
        groups[head.key].append(i)
    for members in groups.values():
        for i, found in zip(members, _decode([images[i] for i in members]), strict=True):
            out[i] = found
    return out


def _decode(images: list[tuple[bytes, Header]]) -> list[np.ndarray]:
    """`coefficients` of images with equal keys."""
    head, scans, lanes, sizes, at = images[0][1], [], [], [], 0
    every = head.every
    for data, h in images:
        scan, starts = _intervals(data, h)
        scans.append(scan)
        lanes.append(starts + at)
        sizes.append(np.minimum(every, h.total - every * np.arange(len(starts))))
        at += len(scan)
    ends = np.cumsum([len(x) for x in lanes])
    pos, sizes = np.concatenate(lanes).astype(np.int64) * 8, np.concatenate(sizes)
    clean = np.concatenate([*scans, np.zeros(8, np.uint8)]).astype(np.uint64)
    m = len(clean) - 4
    window = (clean[:m] << np.uint64(32)) | (clean[1 : m + 1] << np.uint64(24)) | (clean[2 : m + 2] << np.uint64(16)) | (clean[3 : m + 3] << np.uint64(8)) | clean[4 : m + 4]
    flat = np.zeros((len(pos), every * len(head.blocks) * 64), np.int16)
    where = np.arange(len(pos))
    prediction = np.zeros((len(head.parts), len(pos)), np.int64)

    def read(table, live):
        """Next symbol of the live lanes, and their 40 bits shifted past it."""
        p = pos[live]
        bits = (window[np.minimum(p >> 3, m - 1)] << (p & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFFFF)
        look = (bits >> np.uint64(24)).astype(np.int64)
        return table[1][look].astype(np.int64), table[0][look].astype(np.int64), bits

    def extend(size, used, bits):
        """Value of `size` extra bits after `used` bits."""
        v = ((bits >> (np.uint64(40) - (used + size).astype(np.uint64))) & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)

    for unit in range(every):
        for b, part in enumerate(head.blocks):
            live = where[sizes > unit]
            spec = head.tables[head.parts[part][0]]
            base = (unit * len(head.blocks) + b) * 64
            symbol, used, bits = read(head.huff[spec >> 4], live)
            if not used.all():
                raise ValueError("bad Huffman code")
            prediction[part][live] += extend(symbol, used, bits)
            flat[live, base] = prediction[part][live]
            pos[live] += used + symbol
            ac, k = head.huff[16 + (spec & 15)], np.ones(len(live), np.int64)
            while len(live):
                symbol, used, bits = read(ac, live)
                if not used.all():
                    raise ValueError("bad Huffman code")
                run, size = symbol >> 4, symbol & 15
                k = k + run
                put = size > 0
                if put.all():
                    flat[live, base + k] = extend(size, used, bits)
                else:
                    flat[live[put], base + k[put]] = extend(size[put], used[put], bits[put])
                pos[live] += used + size
                k = np.where(put, k + 1, np.where(symbol == 0xF0, k + 1, 64))
                if k[0] == 64 or (k == 64).any():
                    go = k < 64
                    live, k = live[go], k[go]
    found = np.split(flat, ends[:-1])
    return [x.reshape(-1, len(head.blocks), 64)[: h.total] for x, (_, h) in zip(found, images, strict=True)]


def payload_of(head: Header, coef: np.ndarray) -> bytes:
    """The bytes that `encode` stored."""
    said = next((c for c in head.comments if c.startswith(b"payload=")), None)
    v = coef.reshape(-1)[: int(said[8:]) if said else None].astype(np.int32)
    return np.where(v < 0, v + 255, v).astype(np.uint8).tobytes()


def thumbnail(head: Header, coef: np.ndarray) -> np.ndarray:
    """Luminance from DC values only: one pixel a block (of the first component), 0..255."""
    _, h, v, q = head.parts[0]
    if len(head.parts) == 1:
        h = v = 1
    dc = coef[:, : h * v, 0].astype(np.int64).reshape(head.mcus_high, head.mcus_wide, v, h) * int(head.quant[q][0])
    dc = dc.transpose(0, 2, 1, 3).reshape(head.mcus_high * v, head.mcus_wide * h)
    return np.clip(dc // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray, side: int = 8) -> int:
    """64 bits: whether each of side x side areas is brighter than the mean of all of them."""
    rows = np.arange(side + 1) * thumb.shape[0] // side
    cols = np.arange(side + 1) * thumb.shape[1] // side
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    a, b, c, d = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    area = (b - a)[:, None] * (d - c)[None, :]
    means = (sums[np.ix_(b, d)] - sums[np.ix_(a, d)] - sums[np.ix_(b, c)] + sums[np.ix_(a, c)]) / area
    return int.from_bytes(np.packbits((means > means.mean()).ravel()).tobytes(), "big")


# --- Spark -------------------------------------------------------------------------------------------------------


def _by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, _ROWS_A_BATCH):
            yield b.slice(i, _ROWS_A_BATCH)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a JPEG; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_rows(batches):
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumb_hash long, thumb_mean double"


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes say, read back: payload digests, dimensions and thumbnail hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_rows(batches):
            rows = []
            ids, sizes, media_bytes = (c.to_pylist() for c in b.columns)
            images = [(data, Header(data)) for data in media_bytes]
            for doc, n, (data, head), coef in zip(ids, sizes, images, coefficients(images), strict=True):
                payload, thumb = payload_of(head, coef), thumbnail(head, coef)
                bits = average_hash(thumb)
                rows.append(
                    (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest())
                    + (f"{head.width}x{head.height}:{bits:016x}", head.width, head.height, bits - (1 << 64 if bits >> 63 else 0), round(float(thumb.mean()), 6))
                )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES)


def op2_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts give equal rows but for doc_id; empty tables give none."""
    return features(store(read_table(spark, sf_dir, "documents")))
