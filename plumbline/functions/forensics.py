"""Forensic number families of images, in NumPy over Arrow batches.

An image is a float matrix height x width x 3; a grey one is height x width.
Families never raise in a vector: one that fails, or can't be computed, gives
NaN at its places, and all others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Side of the analysed square, rings of the radial profile, weights of grey, first-digit law.
CROP, N_RADIAL = 512, 16
GREY = np.array([0.299, 0.587, 0.114])
FIRST_DIGITS = np.log10(1 + 1 / np.arange(1, 10))
#: The names of the vector, by family and in order.
META = ("meta_w", "meta_h", "meta_aspect", "meta_megapix", "meta_filebytes", "meta_log_filebytes", "meta_bits_per_pixel")
COLOUR = (*[f"col_{c}_{m}" for c in ("r", "g", "b", "gray") for m in ("mean", "std", "skew", "kurt")], "col_sat_mean", "col_sat_std", "col_frac_bright", "col_frac_dark")
RESIDUAL = ("res_std", "res_skew", "res_kurt", "res_tilevar_std", "res_tilevar_iqr", "res_tilevar_maxratio", "res_lap_std", "res_hf_energy")
DCT = ("dct_benford_chi2", "dct_ac_std", "dct_ac_kurt", "dct_zero_frac", "jpeg_blockiness", "jpeg_grid_ratio")
SPECTRUM = (*[f"spec_radial_{i}" for i in range(N_RADIAL)], "spec_slope", "spec_hf_lf_ratio", "spec_peak_count", "spec_peak_max")
#: Error levels need a JPEG codec; their places stay NaN.
ERROR_LEVELS = ("ela_mean", "ela_std", "ela_max", "ela_p99", "ela_frac_high")
FEATURES = META + COLOUR + RESIDUAL + DCT + SPECTRUM + ERROR_LEVELS
NAN = float("nan")


def centre_square(image: np.ndarray, side: int = CROP) -> np.ndarray:
    h, w = image.shape[:2]
    s = min(side, h, w)
    return image[(h - s) // 2 : (h - s) // 2 + s, (w - s) // 2 : (w - s) // 2 + s]


def moments(x: np.ndarray) -> list[float]:
    """Mean, population deviation, corrected skewness and excess kurtosis; under four values NaN, without spread 0."""
    x = np.ravel(x)
    n, mean, sd = len(x), x.mean() if len(x) else NAN, x.std() if len(x) else NAN
    if n < 4:
        return [NAN] * 4
    if sd <= 1e-9:
        return [mean, sd, 0.0, 0.0]
    z = (x - mean) / sd
    skew, kurt = (z**3).mean(), (z**4).mean() - 3
    return [mean, sd, skew * np.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)]


def _weighted(x: np.ndarray, kernel: Sequence[float], axis: int, edge: str) -> np.ndarray:
    """Sum of neighbours along an axis with an odd kernel; ``edge`` is NumPy's padding."""
    r, n = len(kernel) // 2, x.shape[axis]
    padded = np.pad(x, [(r, r) if a == axis else (0, 0) for a in range(x.ndim)], mode=edge)
    return sum(k * np.take(padded, range(i, i + n), axis) for i, k in enumerate(kernel))


def smooth(x: np.ndarray, sigma: float = 1.0, radius: int = 4, edge: str = "symmetric") -> np.ndarray:
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    return _weighted(_weighted(x, kernel, 0, edge), kernel, 1, edge)


def laplacian(x: np.ndarray, edge: str = "symmetric") -> np.ndarray:
    return _weighted(x, (1, -2, 1), 0, edge) + _weighted(x, (1, -2, 1), 1, edge)


def tiles(x: np.ndarray, side: int) -> np.ndarray:
    """(rows, columns, side * side): whole tiles from the top left."""
    h, w = x.shape[0] // side, x.shape[1] // side
    return x[: h * side, : w * side].reshape(h, side, w, side).swapaxes(1, 2).reshape(h, w, side * side)


def meta(width: float, height: float, size: float) -> list[float]:
    known = size == size
    return [
        width, height, width / height if height else NAN, width * height / 1e6,
        size, np.log10(size + 1) if known else NAN, size * 8 / (width * height * 3) if known and width and height else NAN,
    ]


def colour(rgb: np.ndarray) -> list[float]:
    grey = rgb @ GREY
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    saturation = np.divide(top - low, top + 1e-6, out=np.zeros_like(top), where=top > 0)
    channels = [m for x in (*np.moveaxis(rgb, 2, 0), grey) for m in moments(x)]
    return [*channels, saturation.mean(), saturation.std(), (grey > 250).mean(), (grey < 5).mean()]


def residual(grey: np.ndarray, side: int = 32) -> list[float]:
    left = grey - smooth(grey)
    _, sd, skew, kurt = moments(left)
    t = tiles(left, side)
    spread = [NAN] * 3
    if min(t.shape[:2]) >= 2:
        var = t.var(axis=2).ravel()
        quarter, three = np.percentile(np.log1p(var), (25, 75))
        spread = [np.log1p(var).std(), three - quarter, var.max() / (np.median(var) + 1e-9)]
    return [sd, skew, kurt, *spread, laplacian(grey).std(), (left**2).mean()]


def dct_basis(n: int = 8) -> np.ndarray:
    k, i = np.mgrid[:n, :n]
    return np.where(k, 1, np.sqrt(0.5)) * np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))


def dct(grey: np.ndarray) -> list[float]:
    out = [NAN] * 4
    t = tiles(grey, 8)
    if t.size:
        d = dct_basis()
        ac = np.einsum("ki,...ij,lj->...kl", d, t.reshape(-1, 8, 8), d).reshape(-1, 64)[:, 1:].ravel()
        whole = np.abs(np.rint(ac))
        whole = whole[whole >= 1]
        chi2 = NAN
        if len(whole):
            digits = np.clip(whole // 10.0 ** np.floor(np.log10(whole)), 1, 9).astype(int)
            chi2 = ((np.bincount(digits, minlength=10)[1:] / len(whole) - FIRST_DIGITS) ** 2 / (FIRST_DIGITS + 1e-9)).sum()
        out = [chi2, ac.std(), moments(ac)[3], (np.abs(ac) < 0.5).mean()]
    down, across = np.abs(np.diff(grey, axis=0)), np.abs(np.diff(grey, axis=1))
    grid = [x.mean() if n > 8 else NAN for x, n in ((down[7::8], len(down)), (across[:, 7::8], across.shape[1]))]
    mean = lambda xs: np.mean([x for x in xs if x == x]) if any(x == x for x in xs) else NAN
    on, off = mean(grid), mean([x.mean() if x.size else NAN for x in (down, across)])
    return [*out, on, on / (off + 1e-9)]


def rings(shape: tuple[int, int], n: int) -> np.ndarray:
    """The ring of each cell by its distance from the centre, n rings of equal width."""
    y, x = np.indices(shape)
    r = np.hypot(y - shape[0] / 2, x - shape[1] / 2)
    return np.minimum((r / (r.max() + 1e-9) * n).astype(int), n - 1)


def radial(x: np.ndarray, n: int) -> np.ndarray:
    at = rings(x.shape, n).ravel()
    return np.bincount(at, x.ravel(), n) / (np.bincount(at, minlength=n) + 1e-9)


def log_power(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(x))) ** 2)


def spectrum(grey: np.ndarray, n: int = N_RADIAL) -> list[float]:
    profile = radial(log_power(grey - grey.mean()), n)
    slope = np.polyfit(np.log(np.arange(1, n)), np.log(profile[1:]), 1)[0] if (profile[1:] > 0).all() else NAN
    above = profile - _weighted(profile, (1 / 3, 1 / 3, 1 / 3), 0, "symmetric")
    sd = above.std() + 1e-9
    return [*profile, slope, profile[n // 2 :].mean() / (profile[: n // 2].mean() + 1e-9), float((above > 2 * sd).sum()), above.max() / sd]


def _or_nan(n: int, f: Callable[[], Sequence[float]]) -> list[float]:
    try:
        out = [float(x) for x in f()]
    except Exception:  # noqa: BLE001  a family that fails leaves the others
        return [NAN] * n
    return out if len(out) == n else [NAN] * n


def feature_vector(rgb: np.ndarray | None, size: float = NAN, crop: int = CROP) -> list[float]:
    """All families of one image in the order of FEATURES; an image that can't be read is None."""
    if rgb is None or rgb.ndim != 3 or not rgb.size:
        return [NAN] * len(FEATURES)
    square = centre_square(rgb, crop)
    grey = square @ GREY
    families = ((META, lambda: meta(rgb.shape[1], rgb.shape[0], size)), (COLOUR, lambda: colour(square)), (RESIDUAL, lambda: residual(grey)), (DCT, lambda: dct(grey)), (SPECTRUM, lambda: spectrum(grey)))
    with np.errstate(all="ignore"):
        return [x for names, f in families for x in _or_nan(len(names), f)] + [NAN] * len(ERROR_LEVELS)


# --- maps ---


def _standardised(power: np.ndarray) -> np.ndarray:
    return (power - power.mean()) / (power.std(ddof=1) + 1e-9)


def _pooled(x: np.ndarray, down: int) -> np.ndarray:
    return tiles(x, len(x) // down).mean(axis=2).ravel()


def spectral_map(grey: np.ndarray, n_radial: int = 64, down: int = 32) -> tuple[list[float], list[float]]:
    """Radial profile and pooled map of a square image's standardised residual power."""
    power = _standardised(log_power(grey - smooth(grey, edge="reflect")))
    return radial(power, n_radial).tolist(), _pooled(power, down).tolist()


def upsampling_map(grey: np.ndarray, n_radial: int = 64, down: int = 32) -> tuple[list[float], list[float], list[float]]:
    """Of the image less the doubling of its even rows and columns: (deviation, kurtosis, mean absolute), radial profile and pooled map."""
    left = grey - grey[::2, ::2].repeat(2, axis=0).repeat(2, axis=1)
    sd = left.std(ddof=1) + 1e-9
    power = _standardised(log_power(left))
    return [sd, (((left - left.mean()) / sd) ** 4).mean() - 3, np.abs(left).mean()], radial(power, n_radial).tolist(), _pooled(power, down).tolist()


def summary(d: np.ndarray) -> list[float]:
    """Greatest, mean of the five greatest, mean, deviation, 90th percentile, and how many deviations the greatest is above the mean."""
    top = np.sort(d)[::-1]
    sd = d.std(ddof=1)
    return [top[0], top[:5].mean(), d.mean(), sd, np.quantile(d, 0.9), (top[0] - d.mean()) / (sd + 1e-6)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _around(grid: np.ndarray) -> np.ndarray:
    """Mean of the eight neighbours of every cell of (n, n, ...); the border repeats its cells."""
    whole = _weighted(_weighted(grid, (1, 1, 1), 0, "edge"), (1, 1, 1), 1, "edge")
    return (whole - grid) / 8


def patch_anomaly(vectors: np.ndarray, side: int) -> list[float]:
    """Summaries of the cosine distances of a grid's vectors to the mean vector, and to the mean of their neighbours."""
    unit = _unit(vectors)
    to_mean = 1 - unit @ _unit(vectors.mean(axis=0))
    grid = unit.reshape(side, side, -1)
    to_near = 1 - (grid * _unit(_around(grid))).sum(axis=2)
    return summary(to_mean) + summary(to_near.ravel())


def self_reference(grid: np.ndarray) -> list[float]:
    """Nine numbers of a tile map: robust scores of all tiles, and differences to the mean of their neighbours.

    The median is the lower one of an even number of tiles.
    """
    flat = grid.ravel()
    lower = lambda v: np.sort(v)[(len(v) - 1) // 2]
    median = lower(flat)
    z = (flat - median) / (lower(np.abs(flat - median)) + 1e-6)
    d = np.abs(grid - _around(grid)).ravel()
    top = lambda v: np.sort(v)[::-1][:5].mean()
    return [
        z.max(), top(z), flat.std(ddof=1) / (abs(flat.mean()) + 1e-6), flat.max() - median, np.quantile(flat, 0.99) - np.quantile(flat, 0.5),
        d.max(), top(d), d.std(ddof=1), np.quantile(d, 0.99),
    ]


def region_noise(grey: np.ndarray, tile: int = 32) -> list[float]:
    """27 numbers: self_reference of the tiles' log residual variance, mean absolute residual and log mean absolute Laplacian."""
    left = grey - smooth(grey, edge="reflect")
    maps = (np.log1p(tiles(left, tile).var(axis=2, ddof=1)), np.abs(tiles(left, tile)).mean(axis=2), np.log1p(np.abs(tiles(laplacian(grey, "reflect"), tile)).mean(axis=2)))
    return [x for m in maps for x in self_reference(m)]


# --- columns ---


def with_vector(df: DataFrame, out: str, f: Callable[..., Sequence[float]], pixels: str, shape: tuple[int, ...], size: str | None = None) -> DataFrame:
    """Add ``out``, an array: f of each row's flat pixels in the given shape (and of its bytes, if named). What fails is null."""

    def one(a, *more):
        try:
            x = np.asarray(a, float).reshape(shape)
            with np.errstate(all="ignore"):
                return [float(z) for z in f(x, *more)]
        except Exception:  # noqa: BLE001  a row that can't be computed is null
            return None

    def run(batches):
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)) for c in (pixels, size) if c]
            found = [one(a.values, *(z.as_py() for z in more)) if a.is_valid else None for a, *more in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float64()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def outer_image(v: Column, side: int, scale: float = 4000.0) -> Column:
    """A flat side x side x 3 image made of products of a vector's entries (for queries over tables without images)."""
    at = F.sequence(F.lit(0), F.lit(side - 1))
    last = F.size(v) - 1
    level = lambda a, b: F.lit(128.0) + F.lit(scale) * F.get(v, a) * F.get(v, b)
    return F.flatten(F.flatten(F.transform(at, lambda i: F.transform(at, lambda j: F.array(level(i, j), level(i, last - j), level(last - i, j))))))
