import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import jpeg as J


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    payload = J.padded(data)
    assert len(payload) % 192 == 0 and payload and payload.startswith(data)
    media = J.encode(payload)
    head = J.Header(media)
    (coef,) = J.coefficients([(media, head)])
    assert J.payload_of(head, coef) == payload


def test_images_decode_side_by_side():
    payloads = [J.padded(os.urandom(n)) for n in (0, 1, 191, 192, 193, 5000, 40000)]
    images = [(m, J.Header(m)) for m in map(J.encode, payloads)]
    assert [J.payload_of(h, c) for (_, h), c in zip(images, J.coefficients(images), strict=True)] == payloads


def test_reader_takes_other_tables_subsampling_and_no_restarts():
    """A file written by a plain bit-by-bit encoder: two luminance blocks a MCU, run lengths, end-of-block codes."""
    r = random.Random(2)
    dc = {s: f"{s:04b}" for s in range(12)}
    ac = {}
    code = 0
    symbols = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    for n, s in enumerate(symbols):
        ac[s] = f"{n:08b}"
    def table(kind, book, length):
        counts = [0] * 16
        counts[length - 1] = len(book)
        return bytes([kind, *counts]) + bytes(sorted(book, key=lambda s: book[s]))
    blocks = [[[r.choice([0, 0, 0, r.randint(-90, 90)]) for _ in range(64)] for _ in range(4)] for _ in range(6)]  # 6 MCUs of Y Y Cb Cr
    bits, last = "", [0, 0, 0]
    size = lambda v: abs(v).bit_length()
    value = lambda v: "" if not v else f"{v if v > 0 else v + (1 << size(v)) - 1:0{size(v)}b}"
    for mcu in blocks:
        for b, part in zip(mcu, (0, 0, 1, 2), strict=True):
            d = b[0] - last[part]
            last[part] = b[0]
            bits += dc[size(d)] + value(d)
            run = 0
            for k in range(1, 64):
                if b[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + ac[0xF0], run - 16
                bits, run = bits + ac[run << 4 | size(b[k])] + value(b[k]), 0
            if run:
                bits += ac[0]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, 16, 48, 3) + bytes([1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])
    data = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(range(1, 65))) + seg(0xC0, frame) + seg(0xC4, table(0, dc, 4) + table(0x10, ac, 8)) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    head = J.Header(data)
    (coef,) = J.coefficients([(data, head)])
    assert (head.width, head.height, head.mcus_wide, head.mcus_high) == (48, 16, 3, 2)
    assert np.array_equal(coef, np.array(blocks))
    assert J.thumbnail(head, coef).shape == (2, 6)
    with pytest.raises(ValueError):
        J.Header(data.replace(b"\xff\xc0", b"\xff\xc2", 1))


def test_query_digests(spark, tmp_path):
    texts = [(1, "hällo wörld"), (2, None), (3, ""), (4, "x" * 192), (5, "y" * 100_000), (6, "hällo wörld"), (None, "z")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in J.op2_media_jpeg(spark, str(tmp_path)).collect()}
    for i, t in texts:
        payload = J.padded((t or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(J.encode(payload)) and r.media_sha256 == hashlib.sha256(J.encode(payload)).hexdigest()
    assert rows[1].feature == rows[6].feature and rows[2].feature == rows[3].feature
