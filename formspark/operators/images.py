"""Page-image operators: numpy kernels for the inside of ``applyInPandas`` or ``mapInPandas``.

Images are two-dimensional uint8 arrays, ink is True.  A page is one row, so
pages run in parallel and nothing crosses them; decoding a PDF or a PNG needs
a library that a deployment brings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _shifts(x: np.ndarray, radius_y: int, radius_x: int, pick) -> np.ndarray:  # noqa: ANN001
    """Running extreme over a window, one axis after the other."""
    for axis, r in ((0, radius_y), (1, radius_x)):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        wide = np.pad(x, pad, mode="edge")
        views = np.lib.stride_tricks.sliding_window_view(wide, 2 * r + 1, axis=axis)
        x = pick(views, axis=-1)
    return x


def dilate(x: np.ndarray, radius_y: int, radius_x: int | None = None) -> np.ndarray:
    return _shifts(x, radius_y, radius_y if radius_x is None else radius_x, np.max)


def erode(x: np.ndarray, radius_y: int, radius_x: int | None = None) -> np.ndarray:
    return _shifts(x, radius_y, radius_y if radius_x is None else radius_x, np.min)


def flatten(gray: np.ndarray, size: int = 41) -> np.ndarray:
    """Even lighting: the page divided by its background, a closing of it."""
    ground = erode(dilate(gray, size // 2), size // 2).astype(float)
    return np.clip(gray / np.maximum(ground, 1) * 255, 0, 255).astype(np.uint8)


def binarize(gray: np.ndarray, block: int = 41, offset: int = 15, least: int = 0) -> np.ndarray:
    """Ink: darker than the mean around by the offset, after a median of three; small specks go."""
    views = np.lib.stride_tricks.sliding_window_view(np.pad(gray, 1, mode="edge"), (3, 3))
    calm = np.median(views, axis=(2, 3))
    r = block // 2
    sums = np.pad(np.pad(calm, r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    mean = (sums[block:, block:] - sums[:-block, block:] - sums[block:, :-block] + sums[:-block, :-block]) / block**2
    ink = calm < mean - offset
    return drop_specks(ink, least) if least else ink


def components(ink: np.ndarray) -> np.ndarray:
    """Labels of 8-connected components, 0 for paper: runs of each line joined by union-find."""
    labels = np.zeros(ink.shape, np.int64)
    parent = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[tuple[int, int, int]] = []
    for y in range(len(ink)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ink[y].astype(np.int8), [0]))))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            own = 0
            for p, q, k in before:
                if p <= b and a <= q:  # ends are open, so touching corners count
                    k = root(k)
                    if own and k != own:
                        parent[max(own, k)] = min(own, k)
                    own = min(own, k) if own else k
            if not own:
                own = len(parent)
                parent.append(own)
            now.append((a, b, own))
            labels[y, a:b] = own
        before = now
    return np.array([root(i) for i in range(len(parent))])[labels]


def drop_specks(ink: np.ndarray, least: int) -> np.ndarray:
    labels = components(ink)
    return ink & (np.bincount(labels.ravel())[labels] >= least)


def strip_rules(ink: np.ndarray, length: int = 80, thick: int = 5) -> np.ndarray:
    """Without printed rules: components that are long one way and thin the other."""
    labels = components(ink)
    ys, xs = np.nonzero(ink)
    n = int(labels.max()) + 1
    low = np.full((2, n), 1 << 30)
    high = np.full((2, n), -1)
    of = labels[ys, xs]
    for k, v in enumerate((ys, xs)):
        np.minimum.at(low[k], of, v)
        np.maximum.at(high[k], of, v)
    tall, wide = high - low + 1
    rule = ((wide >= length) & (tall <= thick)) | ((tall >= length) & (wide <= thick))
    rule[0] = False
    return ink & ~rule[labels]


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The projective map of matched points, by least squares on normalised points."""

    def norm(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, s = p.mean(axis=0), np.sqrt(2) / max(p.std(), 1e-9)
        t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return (p - c) * s, t

    a, ta = norm(np.asarray(source, float))
    b, tb = norm(np.asarray(target, float))
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    h = np.linalg.inv(tb) @ h @ ta
    return h / h[2, 2]


def robust_homography(source: np.ndarray, target: np.ndarray, reach: float = 4.0, draws: int = 500, least: int = 25, seed: int = 0) -> tuple[np.ndarray | None, int]:
    """The map that most matches agree with, and how many; none below ``least``."""
    rng, best = np.random.default_rng(seed), np.zeros(len(source), bool)
    if len(source) < max(4, least):
        return None, 0
    for _ in range(draws):
        own = rng.choice(len(source), 4, replace=False)
        try:
            near = np.linalg.norm(project(homography(source[own], target[own]), source) - target, axis=1) <= reach
        except np.linalg.LinAlgError:
            continue
        best = near if near.sum() > best.sum() else best
    return (homography(source[best], target[best]), int(best.sum())) if best.sum() >= least else (None, int(best.sum()))


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.column_stack([points, np.ones(len(points))]) @ h.T
    return p[:, :2] / p[:, 2:]


def rescaled(h: np.ndarray, factor: float) -> np.ndarray:
    """A map fitted at one resolution, for another."""
    s = np.diag([factor, factor, 1.0])
    return s @ h @ np.linalg.inv(s)


def decompose(h: np.ndarray) -> dict[str, float]:
    """Scale, rotation, shear and stretch of a map's linear part, and its perspective."""
    u, s, v = np.linalg.svd(h[:2, :2])
    turn = u @ v
    return {"scale": float(np.sqrt(s[0] * s[1])), "stretch": float(s[0] / s[1]), "degrees": float(np.degrees(np.arctan2(turn[1, 0], turn[0, 0]))), "perspective": float(np.hypot(h[2, 0], h[2, 1]))}


def warp(image: np.ndarray, h: np.ndarray, shape: tuple[int, int], fill: int = 255) -> np.ndarray:
    """The image seen through the inverse of h: bilinear."""
    ys, xs = np.mgrid[: shape[0], : shape[1]]
    at = project(np.linalg.inv(h), np.column_stack([xs.ravel(), ys.ravel()]).astype(float))
    x, y = at[:, 0], at[:, 1]
    inside = (x >= 0) & (y >= 0) & (x <= image.shape[1] - 1) & (y <= image.shape[0] - 1)
    x0, y0 = np.clip(x.astype(int), 0, image.shape[1] - 2), np.clip(y.astype(int), 0, image.shape[0] - 2)
    fx, fy = x - x0, y - y0
    mix = image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x0 + 1] * fx * (1 - fy) + image[y0 + 1, x0] * (1 - fx) * fy + image[y0 + 1, x0 + 1] * fx * fy
    return np.where(inside, np.round(mix), fill).astype(np.uint8).reshape(shape)


def offset(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """By how much b is moved against a: the peak of the phase correlation."""
    f = np.fft.rfft2(a - a.mean()) * np.conj(np.fft.rfft2(b - b.mean()))
    peak = np.fft.irfft2(f / np.maximum(np.abs(f), 1e-9), a.shape)
    y, x = np.unravel_index(np.argmax(peak), a.shape)
    return -float(x if x <= a.shape[1] / 2 else x - a.shape[1]), -float(y if y <= a.shape[0] / 2 else y - a.shape[0])


def coverage(template: np.ndarray, page: np.ndarray, radius: int = 3) -> float:
    """The share of the template's ink that has the page's ink near."""
    return float((dilate(page, radius) & template).sum() / max(1, template.sum()))


def new_ink(page: np.ndarray, template: np.ndarray, radius: int = 3) -> np.ndarray:
    """The page's ink without what the template prints, and some around it."""
    return page & ~dilate(template, radius)


def ink_share(ink: np.ndarray, rect: tuple[float, float, float, float], inset: float, scale: float) -> float:
    x0, y0, x1, y1 = (round(v * scale) for v in (rect[0] + inset, rect[1] + inset, rect[2] - inset, rect[3] - inset))
    part = ink[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]
    return float(part.mean()) if part.size else 0.0


def ownership(shape: tuple[int, int], boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest box of each pixel (ties to the first) and its distance; boxes are pixel x0, y0, x1, y1."""
    ys, xs = np.mgrid[: shape[0], : shape[1]]
    best, whose = np.full(shape, np.inf), np.full(shape, -1)
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        far = np.hypot(np.maximum(0, np.maximum(x0 - xs, xs - x1)), np.maximum(0, np.maximum(y0 - ys, ys - y1)))
        nearer = far < best
        best, whose = np.where(nearer, far, best), np.where(nearer, i, whose)
    return whose, best


def owned(ink: np.ndarray, whose: np.ndarray, far: np.ndarray, box: int, seed: float, share: float = 0.6, reclaim: bool = False) -> np.ndarray:
    """A box's ink: its pixels near it, and the components these start, where they are its own or mostly so."""
    near = ink & (whose == box) & (far <= seed)
    labels = components(ink)
    started = np.unique(labels[near])
    started = started[started > 0]
    mine = ink & (whose == box) & np.isin(labels, started)
    if reclaim:
        for k in started:
            part = labels == k
            if (part & (whose == box)).sum() >= share * part.sum():
                mine |= part
    return mine


def extent(mask: np.ndarray, low: float = 0.4, high: float = 99.6) -> list[float] | None:
    """The rectangle that holds all but outlying pixels."""
    ys, xs = np.nonzero(mask)
    return [float(np.percentile(v, q)) for q in (low, high) for v in (xs, ys)] if len(xs) else None


def crop(image: np.ndarray, rect: tuple[float, float, float, float], pad_x: float, pad_y: float, scale: float) -> np.ndarray:
    x0, y0, x1, y1 = rect
    h, w = image.shape
    a, b = max(0, round((x0 - pad_x) * scale)), min(w, round((x1 + pad_x) * scale))
    c, d = max(0, round((y0 - pad_y) * scale)), min(h, round((y1 + pad_y) * scale))
    return image[c:d, a:b]


def stacked(images: list[np.ndarray], gap: int = 8, fill: int = 255) -> np.ndarray:
    """Images under each other."""
    width = max(i.shape[1] for i in images)
    rows = []
    for i in images:
        rows += [np.pad(i, ((0, gap), (0, width - i.shape[1])), constant_values=fill)]
    return np.concatenate(rows)


def measured(pages: DataFrame, boxes: dict[str, tuple[float, float, float, float]], inset: float = 1.3, halo: float = 4.0) -> DataFrame:
    """(page, field, interior, halo) of each box of each page; pages(page, height, width, ink: packed bits)."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for p in pdf.itertuples():
                ink = np.unpackbits(np.frombuffer(p.ink, np.uint8))[: p.height * p.width].reshape(p.height, p.width).astype(bool)
                rows += [(p.page, name, ink_share(ink, r, inset, 1.0), ink_share(ink, r, -halo, 1.0)) for name, r in boxes.items()]
            yield pd.DataFrame(rows, columns=["page", "field", "interior", "halo"])

    return pages.mapInPandas(run, T.StructType([T.StructField("page", T.LongType()), T.StructField("field", T.StringType()), T.StructField("interior", T.DoubleType()), T.StructField("halo", T.DoubleType())]))
