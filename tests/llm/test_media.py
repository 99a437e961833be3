import hashlib
import zlib

import numpy as np
import pytest

from lodestone.llm import media


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 9])
def test_round_trip(text):
    payload = media.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.rstrip(b"\0") == text.rstrip(b"\0")
    assert media.from_wav(media.to_wav(payload)) == payload


def brute_magnitudes(samples):
    x = [s - 128 for s in samples]
    count = 1 + max(0, -(-(len(x) - media.FRAME) // media.HOP))
    x += [0] * (media.FRAME + media.HOP * (count - 1) - len(x))
    n, window = media.FRAME, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
    basis = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    return np.array([np.abs(basis @ (np.array(x[i * media.HOP : i * media.HOP + n]) * window)) for i in range(count)])


def test_transform_equals_the_definition():
    samples = np.random.default_rng(1).integers(0, 256, 1000, np.uint8).tobytes()
    assert np.allclose(media.magnitudes(samples), brute_magnitudes(samples), rtol=1e-3, atol=0.05)


def test_tone_and_shift():
    t = np.arange(128 * 200)
    rng = np.random.default_rng(2)
    noise = np.clip(128 + rng.normal(0, 30, len(t)), 0, 255).astype(np.uint8)
    times, codes = media.fingerprint(noise.tobytes())
    later, moved = media.fingerprint(noise[10 * media.HOP :].tobytes())
    assert len(codes) > 100
    shared = {(a, b) for a, b in zip(times.tolist(), codes.tolist())} & {(a + 10, b) for a, b in zip(later.tolist(), moved.tolist())}
    assert len(shared) > 0.9 * len(moved)
    assert len(media.fingerprint(b"\x80" * 5000)[0]) == 0
    spectrum = media.magnitudes((128 + 100 * np.sin(2 * np.pi * 20 * t / 256)).astype(np.uint8).tobytes())
    assert (spectrum[:, 1:].argmax(axis=1) + 1 == 20).all()


def test_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc", "z"), (2, None, "z"), (3, "", None), (4, "abc", "q"), (5, "é" * 4000, "")], "doc_id long, text string, media string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in media.op10_media(spark, str(tmp_path)).collect()}
    assert rows[1].feature == rows[4].feature and rows[2].feature == rows[3].feature
    want = "é".encode() * 4000
    assert (rows[5].n_bytes, rows[5].payload_bytes, rows[5].payload_sha256) == (8000, 8000, hashlib.sha256(want).hexdigest())
    assert rows[1].tail_crc32 == zlib.crc32(b"abc".ljust(64, b"\0"))
    arrays = media.fingerprint_media(media.store_media(docs.limit(0)))
    assert arrays.collect() == []


def test_repeated_and_missing_ids(spark):
    """Rows with the same id, alike or not, and rows without one: each its own result; equal texts, equal values."""
    import hashlib
    import zlib

    from lodestone.llm import media

    rows = [(1, "a" * 70), (1, "a" * 70), (1, "b"), (None, "a" * 70), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.mode("overwrite").parquet(f"{_folder(spark)}/documents.parquet")
    found = media.op10_media(spark, _folder(spark)).collect()
    assert len(found) == len(rows)
    for text in {t for _, t in rows}:
        payload = (text or "").encode()
        payload += b"\0" * (64 - len(payload) % 64 if len(payload) % 64 or not payload else 0)
        own = [r for r in found if r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.n_bytes == len((text or "").encode())]
        assert len(own) >= sum(t == text for _, t in rows)
        assert {(r.payload_bytes, r.tail_crc32) for r in own} == {(len(payload), zlib.crc32(payload[-64:]))} and len({(r.media_sha256, r.feature) for r in own}) == 1


def _folder(spark):
    return f"{spark.sparkContext.getCheckpointDir()}/odd-media"
