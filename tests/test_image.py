import numpy as np
import pytest

from xylem.functions import image as I  # noqa: N812

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (16, 16, 3), (3, 40, 3)])
def test_png_round_trip(shape):
    image = RNG.integers(0, 256, shape, dtype=np.uint8)
    assert (I.decode_png(I.encode_png(image)) == I.colour(image)).all()


def test_png_filters_and_junk():
    import struct
    import zlib

    image = RNG.integers(0, 256, (10, 6, 3), dtype=np.uint8)
    raw = image[..., ::-1].reshape(10, 18).astype(int)
    out = b""
    for y in range(10):
        kind, up = y % 5, raw[y - 1] if y else np.zeros(18, int)
        left = np.concatenate([[0] * 3, raw[y][:-3]])
        corner = np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * left, left, up, (left + up) // 2, paeth][kind]
        out += bytes([kind]) + ((raw[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = I.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")
    assert (I.decode_png(png) == image).all()
    for bad in (b"", b"junk", png[:40], I.SIGNATURE, png[:60] + b"\0" * 30):
        assert I.decode_png(bad) is None


def test_peaks():
    v = [0, 1, 0, 2, 2, 2, 0, 3, 1, 1, 5]
    assert I.peaks(v).tolist() == [1, 4, 7]
    assert I.peaks([0, 3, 0, 2, 0, 3, 0], distance=3).tolist() == [1, 5]
    assert I.peaks([0, 1, 0.5, 3, 0], prominence=0.6).tolist() == [3]
    assert I.peaks([5, 5, 5]).tolist() == [] and I.peaks([]).tolist() == [] and I.peaks([1, 2]).tolist() == []


def test_greedy():
    assert I.greedy([1, 3, 6, 7, 20], 5) == [1, 6, 20] and I.greedy([], 5) == []


def test_components_and_filling():
    ring = np.zeros((12, 14), bool)
    ring[2:9, 3:10] = True
    ring[4:7, 5:8] = False
    ring[11, 13] = True
    labels, n = I.components(ring, True)
    assert n == 2 and (labels > 0).sum() == ring.sum()
    assert I.largest_filled(ring).sum() == 49
    diagonal = np.eye(4, dtype=bool)
    assert I.components(diagonal, True)[1] == 1 and I.components(diagonal, False)[1] == 4
    assert not I.largest_filled(np.zeros((3, 3), bool)).any()
    brute = RNG.random((30, 30)) < 0.45
    labels, n = I.components(brute, False)
    seen, count = np.zeros_like(brute), 0
    for y, x in zip(*np.nonzero(brute)):
        if not seen[y, x]:
            count += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 30 and 0 <= b < 30 and brute[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert n == count


def test_flat_images_stay_flat():
    flat = np.full((40, 50), 77, np.uint8)
    assert (I.blur(flat, 5, 1.0) == 77).all() and I.gradient(flat).max() == 0 and (I.equalise(flat) == 77).all() and I.stretch(flat).max() == 0
    assert len(np.unique(I.clahe(flat))) == 1 and (I.unsharp(flat) == 77).all() and (I.resize(flat, 13, 17) == 77).all()


def test_morphology():
    m = np.zeros((21, 21), bool)
    m[10, 10] = True
    assert I.dilate(m, 2).sum() == 25 and not I.erode(m, I.ellipse_offsets(11)).any()
    assert I.erode(np.ones((30, 30), bool), I.ellipse_offsets(11), 2).all()
    assert len(I.ellipse_offsets(11)) == len(set(I.ellipse_offsets(11))) and I.ellipse_offsets(3) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]


def test_sectors_share_out_the_image():
    whole = sum(I.sector_mask(31, 40, 20, 15, 7, k).astype(int) for k in range(7))
    assert (whole == 1).all()
    first = I.sector_mask(101, 101, 50, 50, 4, 0)
    assert first[10, 90] and not first[90, 90] and not first[10, 10]


def test_smooth_and_median():
    v = RNG.random(30)
    half = 10
    padded = np.pad(v, half, mode="symmetric")
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / 2.5) ** 2)
    assert np.allclose(I.smooth(v, 2.5), np.convolve(padded, w / w.sum(), "valid"))
    assert np.allclose(I.smooth(np.ones(4), 2.5), 1)
    assert (I.median_rows(np.repeat([[3.0]], 9, axis=0)) == 3).all()


def test_largest_filled_measures_every_part():
    mask = np.zeros((100, 200), bool)
    mask[10:51, 10:51] = True
    mask[11:50, 11:50] = False  # a thin ring of 160 pixels around 41 x 41
    for i in range(10):
        mask[60 + 20 * (i // 5) : 74 + 20 * (i // 5), 20 * (i % 5) : 20 * (i % 5) + 14] = True  # ten blobs of 196
    filled = I.largest_filled(mask)
    assert filled.sum() == 41 * 41 and filled[10:51, 10:51].all()
    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((24, 30)) < 0.45
        labels, n = I.components(mask, True)
        sizes = []
        for k in range(1, n + 1):
            outside, _ = I.components(np.pad(labels != k, 1, constant_values=True), False)
            sizes.append(int((outside != outside[0, 0]).sum()))
        assert I.largest_filled(mask).sum() == max(sizes)
