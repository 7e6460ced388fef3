"""NumPy kernels for one object at a time: registration, sampling, phase correlation.

They run inside Arrow-batched functions, one sensor message (or pair of messages) each.
"""

from __future__ import annotations

import numpy as np


def nearest(points: np.ndarray, queries: np.ndarray, limit: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest point of each query; -1 and inf beyond ``limit``.

    Points are sorted by grid cell. Each round looks at the 27 cells around the queries
    still open and doubles the cells for those whose nearest point found so far lies
    farther than a cell, as a nearer one could be outside. Ties go to the smaller index.
    """
    n, m = len(points), len(queries)
    best, at = np.full(m, np.inf), np.full(m, -1)
    open_ = np.flatnonzero(np.isfinite(queries).all(axis=1)) if m else np.zeros(0, int)
    finite = np.flatnonzero(np.isfinite(points).all(axis=1)) if n else np.zeros(0, int)
    if not len(finite) or not len(open_):
        return at, best
    p = points[finite]
    low = np.minimum(p.min(axis=0), queries[open_].min(axis=0))
    extent = float(np.max(np.maximum(p.max(axis=0), queries[open_].max(axis=0)) - low))
    own = float(np.max(np.ptp(p, axis=0)))
    cell = max(own / max(len(p) ** (1 / 3), 1), extent * 1e-5, 1e-9)
    if limit is not None:
        cell = max(min(cell, limit), extent * 1e-5, 1e-9)
    shifts = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    while len(open_):
        span = int(extent / cell) + 4
        key = lambda c: ((c[:, 0] + 1) * span + c[:, 1] + 1) * span + c[:, 2] + 1
        codes = key(np.floor((p - low) / cell).astype(np.int64))
        order = np.argsort(codes, kind="stable")
        ordered = codes[order]
        home = np.floor((queries[open_] - low) / cell).astype(np.int64)
        for shift in shifts:
            wanted = key(home + shift)
            first, last = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
            count = last - first
            total = int(count.sum())
            if not total:
                continue
            for part in np.array_split(np.flatnonzero(count), max(1, total // 2_000_000)):
                c = count[part]
                row = np.repeat(part, c)
                place = np.repeat(first[part], c) + np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
                candidate = order[place]
                d = np.sqrt(((p[candidate] - queries[open_[row]]) ** 2).sum(axis=1))
                pick = np.lexsort((candidate, d, row))
                head = pick[np.concatenate([[True], row[pick][1:] != row[pick][:-1]])]
                q = open_[row[head]]
                better = (d[head] < best[q]) | ((d[head] == best[q]) & (finite[candidate[head]] < at[q]))
                best[q[better]], at[q[better]] = d[head][better], finite[candidate[head]][better]
        if cell > extent or (limit is not None and cell >= limit):
            break
        open_ = open_[best[open_] > cell]
        cell *= 2
    if limit is not None:
        out = best > limit
        best[out], at[out] = np.inf, -1
    return at, best


def best_fit_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rigid transform of least squares from source to target."""
    a, b = source.mean(axis=0), target.mean(axis=0)
    u, _, vt = np.linalg.svd((source - a).T @ (target - b))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    out = np.eye(4)
    out[:3, :3] = vt.T @ flip @ u.T
    out[:3, 3] = b - out[:3, :3] @ a
    return out


def plane_step(source: np.ndarray, target: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Small rigid motion that brings source points onto the planes of the target points."""
    a = np.hstack([np.cross(source, normals), normals])
    b = ((target - source) * normals).sum(axis=1)
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    angle = np.linalg.norm(x[:3])
    out = np.eye(4)
    if angle > 0:
        k = x[:3] / angle
        m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        out[:3, :3] = np.eye(3) + np.sin(angle) * m + (1 - np.cos(angle)) * m @ m
    out[:3, 3] = x[3:]
    return out


def moved(points: np.ndarray, transform: np.ndarray) -> np.ndarray:
    return points @ transform[:3, :3].T + transform[:3, 3]


def normals_of(points: np.ndarray, k: int = 8) -> np.ndarray:
    """Unit normals from the k nearest neighbours, the largest component positive."""
    n = len(points)
    if n < 3:
        raise ValueError("normals need at least three points")
    out = np.empty((n, 3))
    k = min(max(k, 3), n)
    for part in np.array_split(np.arange(n), max(1, n * n // 4_000_000)):
        d = ((points[part, None] - points[None]) ** 2).sum(axis=2)
        near = points[np.argsort(d, axis=1, kind="stable")[:, :k]]
        near = near - near.mean(axis=1, keepdims=True)
        _, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", near, near))
        out[part] = vectors[:, :, 0]
    return signed(out)


def signed(vectors: np.ndarray) -> np.ndarray:
    """Vectors turned so that their component of largest size is positive."""
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1)
    return vectors * np.where(largest < 0, -1.0, 1.0)


def icp(source: np.ndarray, target: np.ndarray, initial: np.ndarray | None = None, method: str = "point_to_point", iterations: int = 20, limit: float | None = None, rmse_tolerance: float = 1e-6, fitness_tolerance: float = 1e-6, least: int | None = None, normals: np.ndarray | None = None, normal_k: int = 8) -> dict:
    """Register ``source`` to ``target``: transform, fitness, inlier_rmse, correspondences, iterations, converged."""
    if method not in ("point_to_point", "point_to_plane"):
        raise ValueError(f"unknown method {method}")
    plane = method == "point_to_plane"
    least = (6 if plane else 3) if least is None else least
    transform = np.eye(4) if initial is None else np.asarray(initial, float).reshape(4, 4)
    if plane and normals is None:
        normals = normals_of(target, normal_k) if len(target) >= 3 else np.zeros((len(target), 3))

    def measure(t: np.ndarray):
        here = moved(source, t)
        at, d = nearest(target, here, limit)
        hit = at >= 0
        miss = ((target[at[hit]] - here[hit]) * normals[at[hit]]).sum(axis=1) if plane else d[hit]
        return here, at, hit, float(np.sqrt(np.mean(miss**2))) if hit.any() else float("inf"), float(hit.mean()) if len(hit) else 0.0

    here, at, hit, rmse, fitness = measure(transform)
    before, converged, done = (np.inf, 0.0), False, 0
    for done in range(1, iterations + 1):
        if hit.sum() < least:
            break
        step = plane_step(here[hit], target[at[hit]], normals[at[hit]]) if plane else best_fit_transform(here[hit], target[at[hit]])
        transform = step @ transform
        here, at, hit, rmse, fitness = measure(transform)
        if abs(before[0] - rmse) <= rmse_tolerance and (plane or abs(before[1] - fitness) <= fitness_tolerance):
            converged = True
            break
        before = (rmse, fitness)
    return {"transform": transform, "fitness": fitness, "inlier_rmse": rmse, "correspondence_count": int(hit.sum()), "iterations": done, "converged": converged}


def voxel_means(points: np.ndarray, size: float) -> np.ndarray:
    """Mean of the points of each voxel, in the order of the voxels."""
    if not len(points):
        return points
    _, inverse, counts = np.unique(np.floor(points[:, :3] / size).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    return np.stack([np.bincount(inverse, points[:, c]) for c in range(points.shape[1])], 1) / counts[:, None]


def farthest_points(points: np.ndarray, count: int, start: int = 0) -> np.ndarray:
    """Greedy farthest-point sampling: each next index is the farthest from all before, the first on ties."""
    count = min(count, len(points))
    if count <= 0:
        return np.zeros(0, int)
    chosen = [start]
    distance = ((points - points[start]) ** 2).sum(axis=1)
    while len(chosen) < count:
        distance[chosen[-1]] = -1.0
        chosen.append(int(distance.argmax()))
        fresh = ((points - points[chosen[-1]]) ** 2).sum(axis=1)
        distance = np.where(distance < 0, distance, np.minimum(distance, fresh))
    return np.array(chosen)


def image_shift(reference: np.ndarray, moving: np.ndarray, bound: int | None = None) -> tuple[int, int]:
    """Integer shift (rows, columns) of ``moving`` against ``reference``, by phase correlation; within ``bound`` of zero if given."""
    if reference.shape != moving.shape:
        raise ValueError("images differ in shape")
    gray = lambda im: np.asarray(im, float).mean(axis=2) if np.ndim(im) == 3 else np.asarray(im, float)
    a, b = gray(reference), gray(moving)
    cross = np.fft.fft2(b - b.mean()) * np.conj(np.fft.fft2(a - a.mean()))
    size = np.abs(cross)
    peak = np.real(np.fft.ifft2(np.divide(cross, size, out=np.zeros_like(cross), where=size > 1e-12)))
    h, w = peak.shape
    rows, columns = (np.arange(h) + h // 2) % h - h // 2, (np.arange(w) + w // 2) % w - w // 2
    if bound is not None:
        outside = (np.abs(rows)[:, None] > bound) | (np.abs(columns)[None] > bound)
        peak = np.where(outside, -np.inf, peak)
    r, c = np.unravel_index(int(peak.argmax()), peak.shape)
    return int(rows[r]), int(columns[c])


def translate(image: np.ndarray, shift: tuple[int, int], fill: float = 0) -> np.ndarray:
    """The image moved by whole pixels, with ``fill`` where nothing comes from."""
    dr, dc = int(shift[0]), int(shift[1])
    out = np.full_like(image, fill)
    h, w = image.shape[:2]
    if abs(dr) < h and abs(dc) < w:
        out[max(dr, 0) : h + min(dr, 0), max(dc, 0) : w + min(dc, 0)] = image[max(-dr, 0) : h + min(-dr, 0), max(-dc, 0) : w + min(-dc, 0)]
    return out


def band_filter(frames: np.ndarray, low: float = 0.1, high: float = 0.9, last: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Temporal band-pass of the last frames by real FFT, and each pixel's dominant frequency bin."""
    stack = np.asarray(frames, float)[-last:]
    spectrum = np.fft.rfft(stack, axis=0)
    f = np.fft.rfftfreq(len(stack)) * 2
    spectrum[(f < low) | (f > high)] = 0
    return np.fft.irfft(spectrum, n=len(stack), axis=0), np.abs(spectrum).argmax(axis=0)
