"""Small numpy kernels for one tensor row or one bounded matrix; Spark distributes the rows."""

from __future__ import annotations

import numpy as np


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def smoothed(cubes: np.ndarray, sigma: float = 5.0, axes: tuple[int, ...] | None = None, truncate: float = 4.0, fill: float | np.ndarray | None = None) -> np.ndarray:
    """Separable Gaussian along all axes or some; outside lies ``fill`` (of each cube of a stack, if it is an array), by default the median of everything."""
    w = gaussian_weights(sigma, truncate)
    fill = np.median(cubes) if fill is None else fill
    out, r = np.asarray(cubes, float) - fill, len(w) // 2
    for axis in range(out.ndim) if axes is None else axes:
        padded = np.pad(np.moveaxis(out, axis, -1), [(0, 0)] * (out.ndim - 1) + [(r, r)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, len(w), axis=-1)
        out = np.moveaxis(windows @ w, -1, axis)
    return out + fill


def bilinear(images: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Samples of the last two axes, with reflection at the edge."""
    h, w = images.shape[-2:]
    reflect = lambda i, n: np.where((m := np.mod(i, 2 * n)) >= n, 2 * n - 1 - m, m)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    at = lambda a, b: images[..., reflect(a, h), reflect(b, w)]
    return (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))


def polar_map(images: np.ndarray, radii: int, angles: int = 360) -> np.ndarray:
    """angles x radii samples around the middle of each image, out to the nearer edge."""
    cy, cx = images.shape[-2] // 2, images.shape[-1] // 2
    theta = np.radians(np.arange(angles) * 360.0 / angles)[:, None]
    r = np.linspace(0, min(cy, cx), radii)[None, :]
    return bilinear(images, cy + r * np.sin(theta), cx + r * np.cos(theta))


def outlines(images: np.ndarray, radii: int, degree_bins: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, surround, in-out) of each image: binned angles, mean over radii, scaled by the number of radii; 0 where undefined."""
    polar = polar_map(images, radii)
    e = polar.reshape(*polar.shape[:-2], 360 // degree_bins, degree_bins, radii).mean(-2)
    sides = []
    for part in (np.maximum(e, 0), np.minimum(e, 0)):
        high, low = part.max((-2, -1)), part.min((-2, -1))
        peak = np.where(high > 0, high, low)[..., None]
        sides.append(np.divide(part.mean(-1) * radii, peak, out=np.zeros(part.shape[:-1]), where=peak != 0))
    return sides[0], sides[1], e.mean(-2)


def dominant_pixel(cov: np.ndarray) -> int:
    """Position of the largest component of the leading direction of a covariance matrix (the first among equals)."""
    _, vectors = np.linalg.eigh(cov)
    lead = np.abs(vectors[:, -1])
    return int(np.argmax(lead > lead.max() - 1e-9))


def principal_axes(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, axes as rows), largest first; each axis' largest component is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], vectors.T[::-1][:most].copy()
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return np.maximum(values, 0), axes


def analytic(signal: np.ndarray) -> np.ndarray:
    """Complex signal without negative frequencies, along the first axis."""
    n = len(signal)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(signal, axis=0) * gain.reshape(-1, *[1] * (signal.ndim - 1)), axis=0)


def band_passed(signal: np.ndarray, low: float, high: float, rate: float, order: int = 5) -> np.ndarray:
    """Zero-phase band-pass with a Butterworth gain (applied forth and back), mirrored at the ends."""
    n = len(signal)
    long = np.concatenate([2 * signal[0] - signal[:0:-1], signal, 2 * signal[-1] - signal[-2::-1]])
    f = np.fft.rfftfreq(len(long), 1 / rate)
    with np.errstate(divide="ignore", invalid="ignore"):
        shape = (f**2 - low * high) / (f * (high - low))
        gain = np.where(f > 0, 1 / (1 + shape ** (2 * order)), 0.0)
    return np.fft.irfft(np.fft.rfft(long) * gain, len(long))[n - 1 : 2 * n - 1]


def fir_decimated(signal: np.ndarray, factor: int, taps: int | None = None) -> np.ndarray:
    """Low-pass by a windowed sinc, then every factor-th value, along the last axis; the edge values continue."""
    n = taps or 20 * factor + 1
    t = np.arange(n) - n // 2
    w = np.sinc(t / factor) * np.hamming(n)
    w /= w.sum()
    padded = np.pad(signal, [(0, 0)] * (signal.ndim - 1) + [(n // 2, n // 2)], mode="edge")
    return (np.lib.stride_tricks.sliding_window_view(padded, n, axis=-1) @ w)[..., ::factor]


def best_offset(a_at: np.ndarray, b_at: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(dy, dx, score): where sum a(p) b(p - offset) is largest, up to 1e-9; the smallest offset among equals. Only offsets that some pair of pixels has compete."""
    low_a, low_b = a_at.min(0), b_at.min(0)
    size = a_at.max(0) - low_a + b_at.max(0) - low_b + 1
    grids = []
    for at, low, values in ((a_at, low_a, a), (b_at, low_b, b), (a_at, low_a, np.ones(len(a))), (b_at, low_b, np.ones(len(b)))):
        grid = np.zeros(size)
        np.add.at(grid, tuple((at - low).T), values)
        grids.append(np.fft.rfft2(grid))
    score, pairs = (np.fft.irfft2(x * np.conj(y), s=tuple(size)) for x, y in (grids[:2], grids[2:]))
    offsets = np.stack(np.meshgrid(*[np.arange(n) for n in size], indexing="ij"), -1).reshape(-1, 2)
    reach = a_at.max(0) - low_a
    offsets = np.where(offsets > reach, offsets - size, offsets) + low_a - low_b
    score, real = score.ravel(), pairs.ravel() > 0.5
    offsets, score = offsets[real], score[real]
    first = np.lexsort((offsets[:, 1], offsets[:, 0], -np.floor(score * 1e9)))[0]
    return int(offsets[first, 0]), int(offsets[first, 1]), float(score[first])


def covariance_edges(cov: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, weight) with p < q and a magnitude above the threshold."""
    p, q = np.nonzero(np.triu(np.abs(cov) > threshold, 1))
    return p, q, cov[p, q]


def column_leaders(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, n): how often p has the largest covariance above the diagonal of a column; zeros below it compete, the first wins."""
    p, n = np.unique(np.triu(cov, 1).argmax(0)[1:], return_counts=True)
    return p, n


def pixel_components(nodes: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Smallest node of each pixel's 4-connected region: labels flow to both neighbours along each axis until they stand."""
    low, size = np.array([y.min(), x.min()]), (y.max() - y.min() + 3, x.max() - x.min() + 3)
    top = np.iinfo(np.int64).max
    grid, on = np.full(size, top), np.zeros(size, bool)
    at = (y - low[0] + 1, x - low[1] + 1)
    grid[at], on[at] = nodes, True
    while True:
        before = grid
        for axis in (0, 1):
            for flip in (False, True):
                # within each run of pixels along the axis the smallest label so far goes on
                g, m = (np.flip(a, axis) if flip else a for a in (grid, on))
                g, m = np.moveaxis(g, axis, 0).copy(), np.moveaxis(m, axis, 0)
                for k in range(1, len(g)):
                    g[k] = np.where(m[k], np.minimum(g[k], g[k - 1]), top)
                g = np.moveaxis(g, 0, axis)
                grid = np.flip(g, axis) if flip else g
        if (grid == before).all():
            return grid[at]
