"""Rasters against plain loops."""

import numpy as np
import pytest

from paperloom.functions import pixels
from paperloom.operators import scoring


def noise(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)


@pytest.mark.parametrize(("h", "w", "a", "b"), [(12, 9, 4, 3), (10, 7, 4, 5), (5, 5, 5, 5), (3, 50, 1, 7)])
def test_area(h, w, a, b):
    """Each pixel is the mean of the stretch that it covers, parts of pixels counting in part."""
    image = noise(h, w)
    got = pixels.resized(image, a, b)
    for i in range(a):
        for j in range(b):
            y0, y1, x0, x1 = i * h / a, (i + 1) * h / a, j * w / b, (j + 1) * w / b
            total = weight = 0.0
            for y in range(h):
                for x in range(w):
                    part = max(0, min(y1, y + 1) - max(y0, y)) * max(0, min(x1, x + 1) - max(x0, x))
                    total, weight = total + part * image[y, x], weight + part
            assert abs(got[i, j] - total / weight) <= 0.5 + 1e-6


def test_cubic():
    """Flat images stay flat, straight slopes stay straight inside, the same size changes nothing."""
    assert (pixels.resized(np.full((7, 9), 77, np.uint8), 21, 13, smooth=True) == 77).all()
    slope = np.tile(np.arange(20, dtype=np.uint8) * 10, (8, 1))
    big = pixels.resized(slope, 8, 40, smooth=True).astype(int)
    assert np.abs(big[3, 6:-6] - ((np.arange(40) + 0.5) / 2 - 0.5)[6:-6] * 10).max() <= 1
    image = noise(9, 11)
    assert (pixels.resized(image, 9, 11, smooth=True) == image).all()
    assert np.allclose(pixels.cubic_weights(5, 17).sum(1), 1)


def test_local_contrast():
    """A flat image stays flat, order within a tile is kept, a faint one gains contrast, and no more than the limit allows."""
    flat = pixels.local_contrast(np.full((64, 64), 100, np.uint8))
    assert flat.min() == flat.max()
    faint = (100 + noise(256, 256) % 10).astype(np.uint8)
    got = pixels.local_contrast(faint).astype(int)
    assert 2 * 9 < got.max() - got.min() < 4 * 9
    one = pixels.local_contrast(faint, tiles=1).astype(int)
    assert (np.diff([one[faint == v].mean() for v in range(100, 110)]) > 0).all() and all(np.ptp(one[faint == v]) == 0 for v in range(100, 110))
    assert pixels.local_contrast(noise(13, 5)).shape == (13, 5)


def test_variants():
    got = pixels.variants(noise(40, 101))
    assert [v.shape for v in got] == [(32 + 48, 81 + 48), (88, 149), (48 + 48, 121 + 48)]
    assert all((v[:24] == 255).all() and (v[:, -24:] == 255).all() for v in got)


def test_model_inputs():
    f = pixels.page_features(noise(300, 220))
    assert f.shape == (9216,) and abs(f.mean()) < 1e-5 and f.std() == pytest.approx(1, abs=1e-3)
    assert pixels.digit_input(noise(64, 100)).shape == (32, 50) and pixels.digit_input(noise(100, 5)).shape == (32, 8)
    assert pixels.digit_input(noise(10, 46)) is None and pixels.digit_input(np.zeros((0, 5), np.uint8)) is None and pixels.digit_input(None) is None
    got = pixels.digit_input(np.full((32, 32), 255, np.uint8))
    assert (got == 1).all()


def test_features_column(spark):
    """Pages to classes: bytes to features in Python, the model in the engine; what can't be read has none."""
    side = 20

    def image(data):
        return np.frombuffer(data, np.uint8).reshape(side, side)

    rows = [(1, noise(side, side, 1).tobytes()), (2, b"torn"), (3, noise(side, side, 2).tobytes())]
    pages = spark.createDataFrame(rows, "page int, content binary")
    found = pixels.with_features(pages, image)
    coef = np.random.default_rng(4).normal(0, 0.02, (3, 9216))
    got = {r["page"]: r["b"] for r in found.select("page", scoring.softmax_best(scoring.logits(found["features"], coef.tolist(), [0.0, 0.1, 0.2]), ["a", "b", "c"]).alias("b")).collect()}
    for page, data in rows:
        if page == 2:
            assert got[2] is None or got[2]["label"] is None
            continue
        z = coef @ pixels.page_features(image(data)) + [0, 0.1, 0.2]
        p = np.exp(z - z.max())
        assert got[page]["label"] == "abc"[int(z.argmax())] and got[page]["conf"] == pytest.approx((p / p.sum()).max(), rel=1e-6)
