"""Noise, blur and pixelate against numpy."""

import numpy as np
from pyspark.sql import functions as F

from corvane.functions import uncertainty as U

SHAPE = (2, 5, 7)
LEVELS = {"gaussian_noise": (0.1,), "gaussian_blur": (0.4, 2.0), "contrast": (0.3,), "brightness": (0.2,), "pixelate": (0.9, 0.5, 0.01)}


def blurred(image, sigma):
    reach = round(3 * sigma)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        widths = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(image, widths, mode="reflect")
        image = np.apply_along_axis(lambda line: np.convolve(line, taps, mode="valid"), axis, padded)
    return image


def pixelated(image, factor):
    h, w = image.shape
    sh, sw = max(1, int(h * factor)), max(1, int(w * factor))
    box = lambda i, n, small: slice(i * n // small, -(-(i + 1) * n // small))
    small = np.array([[image[box(i, h, sh), box(j, w, sw)].mean() for j in range(sw)] for i in range(sh)])
    return np.array([[small[i * sh // h, j * sw // w] for j in range(w)] for i in range(h)])


def test_each_kind_equals_numpy_on_images_with_channels(spark):
    images = np.random.default_rng(1).uniform(0, 1, (6, *SHAPE))
    rows = [(i, x.ravel().tolist(), "kept") for i, x in enumerate(images)] + [(90, None, "kept"), (91, [0.5] * 3, "kept")]
    got = U.corrupted(spark.createDataFrame(rows, "id int, e array<double>, other string"), "id", "e", SHAPE, LEVELS).collect()
    assert len(got) == len(rows) * 8 and {r.other for r in got} == {"kept"}
    for r in got:
        if r.id >= 90:
            assert r.e is None
            continue
        image, p = images[r.id], LEVELS[r.kind][r.severity - 1]
        out = np.array(r.e).reshape(SHAPE)
        assert out.min() >= 0 and out.max() <= 1
        if r.kind == "gaussian_blur":
            want = np.stack([blurred(c, p) for c in image])
        elif r.kind == "pixelate":
            want = np.stack([pixelated(c, p) for c in image])
        elif r.kind == "contrast":
            mean = image.mean(axis=(1, 2), keepdims=True)
            want = (image - mean) * p + mean
        elif r.kind == "brightness":
            want = image + p
        else:
            continue
        assert np.allclose(out, np.clip(want, 0, 1))


def test_noise_is_normal_and_the_same_however_rows_are_dealt_out(spark):
    rows = spark.range(3000).select("id", U.normal_draws(F.col("id"), 20, seed=5).alias("z"))
    first = {r.id: r.z for r in rows.repartition(7).collect()}
    assert first == {r.id: r.z for r in rows.orderBy(F.desc("id")).coalesce(1).collect()}
    z = np.array([first[i] for i in range(3000)])
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs((z**4).mean() - 3) < 0.15
    assert np.abs(np.corrcoef(z.T) - np.eye(20)).max() < 0.08  # places are independent
    assert abs(np.corrcoef(z[:-1].ravel(), z[1:].ravel())[0, 1]) < 0.02  # and so are rows
    other = np.array([r.z for r in spark.range(3000).select(U.normal_draws(F.col("id"), 20, seed=6).alias("z")).collect()])
    assert abs(np.corrcoef(z.ravel(), other.ravel())[0, 1]) < 0.02


def test_resampling_works_on_columns_not_on_objects(spark):
    from pyspark.sql import functions as F

    from corvane.functions import uncertainty as U

    made = U.resampled(U.box_weights, 0.5, (1, 2, 2))
    assert made.evalType == F.arrow_udf(lambda x: x, "int").evalType
    rows = spark.createDataFrame([(0, [0.0, 1.0, 0.0, 1.0]), (1, None), (2, [1.0]), (3, [1.0, 1.0, 1.0, 1.0])], "i int, e array<double>").coalesce(1)
    got = {r.i: r.x for r in rows.select("i", made("e").alias("x")).collect()}
    assert got[1] is None and got[2] is None and got[3] == [1.0] * 4 and len(got[0]) == 4
