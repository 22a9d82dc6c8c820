"""Raster kernels in numpy: public image-processing formulae on whole arrays or on tiles with a halo."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Weights of red, green and blue in brightness, fixed values.
GREY = np.array([0.299, 0.587, 0.114])
#: sRGB to XYZ, and the white point, fixed values.
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def grey(rgb: np.ndarray) -> np.ndarray:
    """Brightness of an array whose last axis is colour."""
    return rgb @ GREY


def _reflected(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    """a padded by r along an axis as a mirror shows it, the edge itself not repeated."""
    n = a.shape[axis]
    if n == 1:
        return np.repeat(a, 2 * r + 1, axis=axis)
    place = np.abs(np.arange(-r, n + r)) % (2 * n - 2)
    return np.take(a, np.where(place >= n, 2 * n - 2 - place, place), axis=axis)


def convolve(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with an odd kernel along an axis, borders mirrored."""
    r, n = len(kernel) // 2, a.shape[axis]
    padded = _reflected(np.asarray(a, float), r, axis)
    out = np.zeros(a.shape)
    for k, w in enumerate(kernel):
        out += w * np.take(padded, np.arange(k, k + n), axis=axis)
    return out


def gaussian_kernel(sigma: float) -> np.ndarray:
    size = int(round(8 * sigma + 1)) | 1
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def blur5(a: np.ndarray) -> np.ndarray:
    """The 5 by 5 binomial blur over the first two axes."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    return convolve(convolve(a, k, 0), k, 1)


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur; wide ones go through the Fourier domain, which costs the same at any width."""
    k = gaussian_kernel(sigma)
    if len(k) <= 63:
        return convolve(convolve(a, k, 0), k, 1)
    for axis in (0, 1):
        r, n = len(k) // 2, a.shape[axis]
        padded = _reflected(np.asarray(a, float), r, axis)
        size = padded.shape[axis] + len(k) - 1
        spectrum = np.fft.rfft(padded, size, axis=axis) * np.fft.rfft(k, size).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
        a = np.take(np.fft.irfft(spectrum, size, axis=axis), np.arange(2 * r, 2 * r + n), axis=axis)
    return a


def sobel_magnitude(g: np.ndarray) -> np.ndarray:
    across, along = np.array([-1, 0, 1]), np.array([1, 2, 1])
    return np.hypot(convolve(convolve(g, across, 1), along, 0), convolve(convolve(g, across, 0), along, 1))


def lab(rgb: np.ndarray) -> np.ndarray:
    """8-bit LAB of 8-bit RGB: L * 255 / 100, a + 128, b + 128."""
    v = np.asarray(rgb, float) / 255
    v = np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)
    xyz = v @ TO_XYZ.T / WHITE
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    out = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(out), 0, 255)


def change_score(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """0 to 1 per pixel from two 8-bit RGB images: mostly the colour's distance, in part the edges'."""
    b, a = np.rint(blur5(before)), np.rint(blur5(after))
    colour = np.linalg.norm(lab(a) - lab(b), axis=-1) / (255 * math.sqrt(3))
    edge = np.abs(sobel_magnitude(np.rint(grey(a))) - sobel_magnitude(np.rint(grey(b)))) / (255 * math.sqrt(2))
    return np.clip(0.8 * colour + 0.2 * edge, 0, 1)


def stretch(rgb: np.ndarray, valid: np.ndarray, limits: list[tuple[float, float]] | None = None) -> np.ndarray:
    """Each band (first axis) between its 2nd and 98th percentile of valid pixels as 8 bits; colour becomes the last axis."""
    out = np.zeros(rgb.shape, np.uint8)
    for band in range(len(rgb)):
        values = rgb[band][valid & np.isfinite(rgb[band])]
        if limits or values.size:
            low, high = limits[band] if limits else np.percentile(values, (2, 98))
            out[band] = np.clip(np.nan_to_num((rgb[band] - low) * 255.0 / max(high - low, 1.0)), 0, 255).astype(np.uint8)
    return np.moveaxis(out, 0, -1)


def ellipse(size: int) -> np.ndarray:
    """An elliptic structuring element of odd size."""
    r = size // 2
    if r == 0:
        return np.ones((1, 1), bool)
    off = np.arange(size) - r
    reach = np.rint(r * np.sqrt(np.maximum(0, (r * r - off**2) / (r * r)))).astype(int)
    return np.abs(off)[None, :] <= reach[:, None]


def _spread(mask: np.ndarray, element: np.ndarray, outside: bool) -> np.ndarray:
    r = len(element) // 2
    padded = np.pad(mask, r, constant_values=outside)
    h, w = mask.shape
    out = np.zeros((h, w), bool)
    for i in range(len(element)):
        columns = np.flatnonzero(element[i])
        if len(columns):  # rows of an ellipse are runs: a running count serves a run of any length
            run = np.cumsum(np.pad(padded[i : i + h].astype(np.int32), ((0, 0), (1, 0))), axis=1)
            a, b = columns[0], columns[-1] + 1
            out |= run[:, b : b + w] - run[:, a : a + w] > 0
    return out


def dilate(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    return _spread(np.asarray(mask, bool), element, False)


def erode(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    """The image's edge does not erode."""
    return ~_spread(~np.asarray(mask, bool), element, False)


def opened_closed(mask: np.ndarray, size: int) -> np.ndarray:
    if size <= 1:
        return np.asarray(mask, bool)
    e = ellipse(size)
    m = dilate(erode(mask, e), e)
    return erode(dilate(m, e), e)


def label(mask: np.ndarray, eight: bool = True) -> tuple[np.ndarray, int]:
    """Labels from 1 of the connected regions, in reading order of their first pixel."""
    mask = np.asarray(mask, bool)
    h, w = mask.shape
    ids = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    links = [(mask[:, 1:] & mask[:, :-1], ids[:, 1:], ids[:, :-1]), (mask[1:] & mask[:-1], ids[1:], ids[:-1])]
    if eight:
        links += [(mask[1:, 1:] & mask[:-1, :-1], ids[1:, 1:], ids[:-1, :-1]), (mask[1:, :-1] & mask[:-1, 1:], ids[1:, :-1], ids[:-1, 1:])]
    a, b = (np.concatenate([x[i][x[0]] for x in links]) for i in (1, 2))
    root = np.arange(h * w + 1)
    while True:  # hook roots to the least neighbour, then halve paths, until all agree
        ra, rb = root[a], root[b]
        unlike = ra != rb
        if not unlike.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[unlike], np.minimum(ra, rb)[unlike])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    found = root[ids]
    names, inverse = np.unique(found, return_inverse=True)
    out = inverse.reshape(h, w) + (0 if len(names) and names[0] == 0 else 1)
    return out.astype(np.int64), int(out.max()) if out.size else 0


def split_by_shadow(mask: np.ndarray, shadow: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Regions mostly outside shadow, and those that are deferred."""
    if not 0 < least <= 1:
        raise ValueError("the shadow overlap must be over 0 and at most 1")
    labels, n = label(mask)
    size, dark = np.bincount(labels.ravel(), minlength=n + 1), np.bincount(labels.ravel(), weights=np.asarray(shadow, float).ravel(), minlength=n + 1)
    defer = np.concatenate([[False], dark[1:] / np.maximum(size[1:], 1) >= least])
    return np.asarray(mask, bool) & ~defer[labels], defer[labels]


def shadow_mask(rgb: np.ndarray, valid: np.ndarray, pixel_m: float, percentile: float = 8.0, relative: float = 0.6, context_m: float = 8.0, dilation_m: float = 0.5) -> np.ndarray:
    """Pixels both among the scene's darkest and dark beside their surroundings, widened. Colour is the first axis."""
    if not 0 < percentile < 100 or not 0 < relative < 1:
        raise ValueError("shadow parameters are outside their ranges")
    g = grey(np.moveaxis(np.nan_to_num(rgb), 0, -1))
    values = g[valid]
    if not values.size or values.max() - values.min() < 5:
        return np.zeros(valid.shape, bool)
    out = valid & (g <= np.percentile(values, percentile)) & (g <= blur(g, max(1.0, context_m / pixel_m)) * relative)
    size = odd_size(dilation_m, pixel_m)
    return dilate(out, ellipse(size)) & valid if size > 1 else out


def odd_size(size_m: float, pixel_m: float) -> int:
    n = max(1, round(size_m / pixel_m))
    return n if n % 2 else n + 1


@dataclass(frozen=True)
class Shift:
    """A registration: whether applied, by how many pixels, and why not."""

    applied: bool
    dx: float = 0.0
    dy: float = 0.0
    reason: str = ""


def moved(a: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """a sampled at (x + dx, y + dy), bilinear; 0 outside."""
    h, w = a.shape[:2]
    x, y = np.arange(w) + dx, np.arange(h) + dy
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    pick = lambda yy, xx: np.where(_in(yy, h)[:, None] & _in(xx, w)[None, :] if a.ndim == 2 else (_in(yy, h)[:, None] & _in(xx, w)[None, :])[..., None], a[np.clip(yy, 0, h - 1)][:, np.clip(xx, 0, w - 1)], 0)
    wide = lambda v, axis: v.reshape([-1 if i == axis else 1 for i in range(a.ndim)])
    top = pick(y0, x0) * (1 - wide(fx, 1)) + pick(y0, x0 + 1) * wide(fx, 1)
    low = pick(y0 + 1, x0) * (1 - wide(fx, 1)) + pick(y0 + 1, x0 + 1) * wide(fx, 1)
    return top * (1 - wide(fy, 0)) + low * wide(fy, 0)


def _in(v: np.ndarray, n: int) -> np.ndarray:
    return (v >= 0) & (v < n)


def register(before: np.ndarray, after: np.ndarray, valid: np.ndarray, limit: float = 10.0, enabled: bool = True, longest: int = 1200) -> Shift:
    """The shift that lays before on after, found on reduced grey images: a phase correlation for the whole pixels, then
    Gauss-Newton steps for the rest."""
    h, w = before.shape[:2]
    if not enabled:
        return Shift(False, reason="disabled")
    if min(h, w) < 32 or valid.sum() < 1024:
        return Shift(False, reason="insufficient_valid_pixels")
    k = max(1, math.ceil(max(h, w) / longest))
    small = lambda img: blur5(grey(img)[: h // k * k, : w // k * k].reshape(h // k, k, w // k, k).mean(axis=(1, 3)))
    b, a = small(before) / 255, small(after) / 255
    m = valid[: h // k * k, : w // k * k].reshape(h // k, k, w // k, k).all(axis=(1, 3))
    window = np.outer(np.hanning(len(a)), np.hanning(a.shape[1]))
    fa, fb = np.fft.rfft2((a - a[m].mean()) * window * m), np.fft.rfft2((b - b[m].mean()) * window * m)
    power = fb * np.conj(fa)
    peak = np.fft.irfft2(power / np.maximum(np.abs(power), 1e-12), a.shape)
    y, x = np.unravel_index(peak.argmax(), peak.shape)
    dy, dx = (float(v - n if v > n // 2 else v) for v, n in ((y, a.shape[0]), (x, a.shape[1])))
    if a[m].std() < 1e-6 or b[m].std() < 1e-6:
        return Shift(False, reason="no_texture")
    if math.hypot(dx, dy) * k > 4 * limit:
        dx = dy = 0.0
    for _ in range(80):
        now, inside = moved(b, dx, dy), (moved(m.astype(float), dx, dy) > 0.999) & m
        gy, gx = np.gradient(now)
        p, q = now[inside], a[inside]
        if p.size < 64 or p.std() < 1e-9:
            break
        residual = (q - q.mean()) / q.std() * p.std() - (p - p.mean())
        g = np.stack([gx[inside], gy[inside]], axis=1)
        step = np.linalg.lstsq(g.T @ g + 1e-9 * np.eye(2), g.T @ residual, rcond=None)[0]
        dx, dy = dx + float(np.clip(step[0], -1, 1)), dy + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-4:
            break
    dx, dy = dx * k, dy * k
    return Shift(True, dx, dy) if math.hypot(dx, dy) <= limit else Shift(False, dx, dy, "shift_exceeds_limit")


def grow(seeds: np.ndarray, score: np.ndarray, valid: np.ndarray, pixel_m: float, percentile: float, reach_m: float, closing_m: float = 0.0) -> tuple[np.ndarray, float]:
    """Seeds grown through pixels of a high score, each no farther than the reach; regions without a seed never appear."""
    if not 0 < percentile < 100 or reach_m <= 0:
        raise ValueError("growth parameters are outside their ranges")
    if not valid.any():
        raise ValueError("there are no valid pixels")
    cut = float(np.percentile(score[valid], percentile))
    growable = (score >= cut) & valid
    reach = max(1, round(reach_m / pixel_m))
    element = ellipse(2 * reach + 1)
    labels, n = label(seeds)
    out = np.zeros(seeds.shape, bool)
    for k in range(1, n + 1):
        rows, columns = np.nonzero(labels == k)
        r0, r1, c0, c1 = max(0, rows.min() - reach), rows.max() + reach + 1, max(0, columns.min() - reach), columns.max() + reach + 1
        seed = labels[r0:r1, c0:c1] == k
        regions, _ = label(growable[r0:r1, c0:c1] & dilate(seed, element))
        touched = np.setdiff1d(np.unique(regions[seed]), [0])
        out[r0:r1, c0:c1] |= np.isin(regions, touched)
    size = odd_size(closing_m, pixel_m) if closing_m > 0 else 1
    if size > 1:
        e = ellipse(size)
        out = erode(dilate(out, e), e)
    return out, cut


def windows(length: int, window: int, stride: int) -> list[int]:
    """Starts that cover a length, the last flush with its end."""
    last = max(0, length - window)
    return sorted({*range(0, last + 1, stride), last})


def softmax(logits: np.ndarray, axis: int = 0) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


#: Mean and deviation by which image models expect their input, fixed values.
MODEL_MEAN, MODEL_STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def model_input(tile: np.ndarray) -> np.ndarray:
    """8-bit RGB (colour last) as a normalised array, colour first."""
    return np.moveaxis((tile / 255.0 - MODEL_MEAN) / MODEL_STD, -1, 0).astype(np.float32)


def infer(session, rgb: np.ndarray, valid: np.ndarray, window: int = 256, stride: int = 192) -> np.ndarray:
    """Probability of the first class by a model (an object with run(names, feed)), averaged where windows overlap."""
    h, w = valid.shape
    total, seen = np.zeros((h, w)), np.zeros((h, w))
    for y in windows(h, window, stride):
        for x in windows(w, window, stride):
            part = rgb[y : y + window, x : x + window]
            tile = np.zeros((window, window, 3), part.dtype)
            tile[: part.shape[0], : part.shape[1]] = part
            logits = np.asarray(session.run(None, {"input": model_input(tile)[None]})[0])[0]
            p = softmax(logits)[0][: part.shape[0], : part.shape[1]]
            total[y : y + part.shape[0], x : x + part.shape[1]] += p
            seen[y : y + part.shape[0], x : x + part.shape[1]] += 1
    return np.where(valid, total / np.maximum(seen, 1), 0)


def patch_distance(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """1 - cosine of two grids of feature vectors (last axis), in 0..1."""
    norm = lambda v: np.maximum(np.linalg.norm(v, axis=-1), 1e-8)
    return np.clip(1 - (before * after).sum(axis=-1) / (norm(before) * norm(after)), 0, 1)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, centres aligned."""
    h, w = a.shape[:2]
    y, x = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def feature_change(model, before: np.ndarray, after: np.ndarray, tile: int = 518, stride: int = 392) -> np.ndarray:
    """Mean patch distance by a feature model (callable: batch of two normalised tiles to two grids of vectors)."""
    h, w = before.shape[:2]
    total, seen = np.zeros((h, w)), np.zeros((h, w))
    for y in windows(h, tile, stride):
        for x in windows(w, tile, stride):
            parts = [img[y : y + tile, x : x + tile] for img in (before, after)]
            ph, pw = parts[0].shape[:2]
            batch = np.zeros((2, tile, tile, 3))
            for k, p in enumerate(parts):
                batch[k, :ph, :pw] = p
            grids = model(np.stack([model_input(b) for b in batch]))
            d = resize(patch_distance(np.asarray(grids[0]), np.asarray(grids[1])), tile, tile)
            total[y : y + ph, x : x + pw] += d[:ph, :pw]
            seen[y : y + ph, x : x + pw] += 1
    return total / np.maximum(seen, 1)
