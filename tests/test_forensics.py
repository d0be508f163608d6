"""Forensic families against plain loops, and vectors that never raise."""

import math

import numpy as np
import pytest

from plumbline.functions import forensics as fs


def image(h, w, seed=0):
    return np.random.default_rng(seed).uniform(0, 255, (h, w, 3))


def at(x, i, n):
    """Index of a mirrored border: d c b a | a b c d | d c b a."""
    i = i % (2 * n)
    return x[i if i < n else 2 * n - 1 - i]


def test_smoothing_and_laplacian_by_loops():
    x = image(9, 7)[..., 0]
    k = [math.exp(-(i**2) / 2) for i in range(-4, 5)]
    k = [v / sum(k) for v in k]
    want = np.array([[sum(k[a + 4] * k[b + 4] * at(at(x, i + a, 9), j + b, 7) for a in range(-4, 5) for b in range(-4, 5)) for j in range(7)] for i in range(9)])
    assert np.allclose(fs.smooth(x), want)
    lap = np.array([[at(x, i - 1, 9)[j] + at(x, i + 1, 9)[j] + at(x[i], j - 1, 7) + at(x[i], j + 1, 7) - 4 * x[i, j] for j in range(7)] for i in range(9)])
    assert np.allclose(fs.laplacian(x), lap)


def test_residual_tiles():
    x = image(70, 66, 1)[..., 1]
    got = dict(zip(fs.RESIDUAL, fs.residual(x), strict=True))
    left = x - fs.smooth(x)
    var = [left[i * 32 : i * 32 + 32, j * 32 : j * 32 + 32].var() for i in range(2) for j in range(2)]
    logs = sorted(math.log1p(v) for v in var)
    assert got["res_tilevar_std"] == pytest.approx(np.std(logs)) and got["res_tilevar_iqr"] == pytest.approx((logs[2] + 0.25 * (logs[3] - logs[2])) - (logs[0] + 0.75 * (logs[1] - logs[0])))
    assert got["res_tilevar_maxratio"] == pytest.approx(max(var) / np.median(var)) and got["res_hf_energy"] == pytest.approx((left**2).mean())
    assert all(math.isnan(v) for k, v in zip(fs.RESIDUAL, fs.residual(x[:40, :40]), strict=True) if "tilevar" in k)


def test_dct_by_loops():
    x = image(16, 24, 2)[..., 2] * 3
    c = lambda k: math.sqrt((1 if k == 0 else 2) / 8)
    ac = []
    for bi in range(2):
        for bj in range(3):
            b = x[bi * 8 : bi * 8 + 8, bj * 8 : bj * 8 + 8]
            for k in range(8):
                for q in range(8):
                    if k + q:
                        ac.append(c(k) * c(q) * sum(b[i, j] * math.cos(math.pi * (2 * i + 1) * k / 16) * math.cos(math.pi * (2 * j + 1) * q / 16) for i in range(8) for j in range(8)))
    first = [int(str(int(abs(round(v))))[0]) for v in ac if abs(round(v)) >= 1]
    chi2 = sum((first.count(d) / len(first) - math.log10(1 + 1 / d)) ** 2 / (math.log10(1 + 1 / d) + 1e-9) for d in range(1, 10))
    got = dict(zip(fs.DCT, fs.dct(x), strict=True))
    assert got["dct_benford_chi2"] == pytest.approx(chi2) and got["dct_ac_std"] == pytest.approx(np.std(ac)) and got["dct_zero_frac"] == np.mean([abs(v) < 0.5 for v in ac])
    down = [abs(x[i + 1, j] - x[i, j]) for i in (7,) for j in range(24)]
    across = [abs(x[i, j + 1] - x[i, j]) for i in range(16) for j in (7, 15)]
    on = (np.mean(down) + np.mean(across)) / 2
    assert got["jpeg_blockiness"] == pytest.approx(on)
    assert got["jpeg_grid_ratio"] == pytest.approx(on / ((np.abs(np.diff(x, axis=0)).mean() + np.abs(np.diff(x, axis=1)).mean()) / 2))


def test_spectrum_of_known_waves():
    n = 32
    i, j = np.mgrid[:n, :n]
    x = 10 * np.cos(2 * np.pi * 5 * j / n)
    power = fs.log_power(x)
    assert np.count_nonzero(power > 1) == 2 and power[n // 2, n // 2 + 5] == pytest.approx(math.log1p((10 * n * n / 2) ** 2))
    profile = fs.radial(power, 16)
    ring = int(5 / (math.hypot(16, 16) + 1e-9) * 16)
    assert profile.argmax() == ring
    out = dict(zip(fs.SPECTRUM, fs.spectrum(image(n, n)[..., 0]), strict=True))
    assert len(out) == 20 and out["spec_hf_lf_ratio"] > 0 and out["spec_peak_max"] > 0


def test_vector_never_raises(spark):
    assert len(fs.FEATURES) == 66 and len(set(fs.FEATURES)) == 66
    good = dict(zip(fs.FEATURES, fs.feature_vector(image(80, 64), 5000.0), strict=True))
    assert [k for k, v in good.items() if v != v] == list(fs.ERROR_LEVELS)
    assert good["meta_w"] == 64 and good["meta_h"] == 80 and good["meta_bits_per_pixel"] == pytest.approx(5000 * 8 / (64 * 80 * 3))
    tiny = dict(zip(fs.FEATURES, fs.feature_vector(image(1, 1)), strict=True))
    assert tiny["meta_w"] == 1 and tiny["col_r_mean"] != tiny["col_r_mean"] and tiny["meta_log_filebytes"] != tiny["meta_log_filebytes"]
    assert all(v != v for v in fs.feature_vector(None)) and all(v != v for v in fs.feature_vector(np.zeros((0, 0, 3))))
    flat = dict(zip(fs.FEATURES, fs.feature_vector(np.full((64, 64, 3), 3.0)), strict=True))
    assert flat["col_gray_skew"] == 0 and flat["col_frac_dark"] == 1 and flat["dct_zero_frac"] == 1
    x = image(4, 4).ravel().tolist()
    rows = spark.createDataFrame([(1, x, 9.0), (2, [1.0], 9.0), (3, None, None)], "id int, p array<double>, b double")
    got = {r.id: r.f for r in fs.with_vector(rows, "f", fs.feature_vector, "p", (4, 4, 3), "b").collect()}
    assert len(got[1]) == 66 and got[2] is None and got[3] is None


def test_maps():
    x = image(64, 64, 4)[..., 0]
    radial, pooled = fs.spectral_map(x)
    assert len(radial) == 64 and len(pooled) == 1024 and np.mean(pooled) == pytest.approx(0, abs=1e-9)
    stats, _, _ = fs.upsampling_map(x.copy())
    left = [[x[i, j] - x[i // 2 * 2, j // 2 * 2] for j in range(64)] for i in range(64)]
    assert stats[2] == pytest.approx(np.abs(left).mean()) and stats[0] == pytest.approx(np.std(left, ddof=1))
    doubled = x[::2, ::2].repeat(2, 0).repeat(2, 1)
    assert fs.upsampling_map(doubled)[0][2] == 0


def test_region_noise_finds_the_odd_tile():
    x = np.random.default_rng(3).normal(128, 5, (64, 64))
    plain = fs.region_noise(x, 8)
    y = x.copy()
    y[16:24, 16:24] = 128
    odd = fs.region_noise(y, 8)
    assert len(plain) == len(odd) == 27
    assert odd[9 + 5] > 2 * plain[9 + 5]  # greatest difference of a tile's residual to its neighbours
    grid = np.arange(16.0).reshape(4, 4) ** 2
    got = fs.self_reference(grid)
    pad = np.pad(grid, 1, mode="edge")
    near = np.array([[(pad[i : i + 3, j : j + 3].sum() - grid[i, j]) / 8 for j in range(4)] for i in range(4)])
    d = np.sort(np.abs(grid - near).ravel())[::-1]
    assert got[5:8] == pytest.approx([d[0], d[:5].mean(), d.std(ddof=1)]) and got[3] == 225 - 49


def test_patch_anomaly():
    v = np.tile([1.0, 0.0, 0.0], (16, 1))
    v[5] = [0, 1, 0]
    out = fs.patch_anomaly(v, 4)
    assert len(out) == 12 and out[0] == pytest.approx(1 - 1 / math.hypot(15, 1)) and out[6] == pytest.approx(1)
    assert out[5] > 3 and out[2] < 0.1
