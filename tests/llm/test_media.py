"""Image decoding, resizing and the media table."""

import hashlib
import io
import zlib

import numpy as np
import pytest

from gridspark.llm import media
from gridspark.llm.common import id_text
from text_tables import odd_texts, table  # noqa: F401


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (8, 64)])
def test_forms_give_the_samples_back(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode_image(media.encode_pgm(image)) == image).all()
    assert (media.decode_image(media.encode_bmp(image)) == image).all()
    plain = b"P2\n# note\n%d %d\n255\n" % shape[::-1] + b" ".join(b"%d" % v for v in image.ravel())
    assert (media.decode_image(plain) == image).all()


def test_colour_forms():
    image = np.random.default_rng(2).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    assert (media.decode_image(b"P6 5 3 255\n" + image.tobytes()) == image).all()
    body = np.zeros((3, 16), np.uint8)
    body[:, :15] = image[::-1, :, ::-1].reshape(3, 15)
    head = bytearray(media.encode_bmp(np.zeros((3, 5), np.uint8))[:54])
    head[10:14], head[28:30] = (54).to_bytes(4, "little"), (24).to_bytes(2, "little")
    assert (media.decode_image(bytes(head) + body.tobytes()) == image).all()
    assert media.grey(image).shape == (3, 5)


def test_area_resize_equals_plain_means():
    image = np.random.default_rng(3).integers(0, 256, (6, 9)).astype(np.uint8)
    wanted = image.reshape(3, 2, 3, 3).mean((1, 3))
    assert (media.area_resize(image, 3, 3) == np.rint(wanted)).all()
    # Bounds between samples: repeat every sample, then take plain means.
    fine = np.repeat(np.repeat(image, 4, 0), 4, 1).reshape(4, 6, 4, 9).mean((1, 3))
    assert np.abs(media.area_resize(image, 4, 4).astype(float) - fine).max() <= 0.5 + 1e-9


def test_difference_hash_follows_brightness():
    rising = np.tile(np.arange(0, 252, 4, dtype=np.uint8), (64, 1))
    assert media.difference_hash(rising) == "ff" * 8
    assert media.difference_hash(rising[:, ::-1]) == "00" * 8


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_payloads_are_whole(table, odd_texts, form):
    stored = media.text_media(id_text(table(odd_texts)), form)
    rows = {r.doc_id: r for r in media.media_features(stored).collect()}
    assert len(rows) == len(odd_texts)
    for key, text in enumerate(odd_texts):
        data = (text or "").encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        row = rows[key]
        assert (row.n_bytes, row.payload_bytes) == (len(data), len(padded))
        assert row.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert row.tail_crc32 == zlib.crc32(padded[-64:])
    assert rows[3][1:] == rows[4][1:] and rows[0][1:] == rows[1][1:]
    assert media.media_features(media.text_media(id_text(table([])), form)).count() == 0


def test_tiles_are_npy_and_broken_images_are_told(spark):
    good = media.encode_bmp(np.arange(64, dtype=np.uint8).reshape(8, 8))
    frame = spark.createDataFrame([(1, good), (2, b"P5 9 9 255\nxx"), (3, None), (4, b"")], "doc_id bigint, media binary")
    rows = {r.doc_id: r for r in media.media_tiles(frame, 4).collect()}
    tile = np.load(io.BytesIO(rows[1].tile))
    assert tile.shape == (4, 4) and tile.dtype == np.uint8 and rows[1].error is None
    assert all(rows[k].tile is None and rows[k].error for k in (2, 3, 4))
