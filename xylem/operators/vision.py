"""The image algorithms: each takes one image and a centre, and returns its payload, a rendered image and maybe a mask."""

from __future__ import annotations

import hashlib
import math
import sys
import threading
import time
import types
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

from xylem.functions import image as I  # noqa: N812


@dataclass
class Outcome:
    payload: dict
    visual: np.ndarray | None = None
    mask: np.ndarray | None = None


class Algorithm(Protocol):
    """What a plug-in offers. Heavy resources belong in __init__, which runs once per partition."""

    def process(self, image: np.ndarray, centre: tuple[float, float], job: str = "") -> Outcome: ...


def name_of(algorithm: Algorithm) -> str:
    return type(algorithm).__name__


def key_of(algorithm: Algorithm) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name_of(algorithm)).lstrip("_")


def _unit(seed: str, salt: str) -> float:
    """A number in [0, 1) that hangs on the seed alone."""
    return int.from_bytes(hashlib.blake2b(f"{salt}/{seed}".encode(), digest_size=8).digest(), "big") / 2**64


def _ints(values) -> list[int]:
    return [int(v) for v in values]


def _overlay(image: np.ndarray, cx: int, cy: int, radii, thickness: int = 2) -> np.ndarray:
    out = I.colour(image)
    for r in radii:
        I.draw_circle(out, cx, cy, r, thickness=thickness)
    I.draw_marker(out, cx, cy)
    return out


@dataclass
class RingDetection:
    """Stands in for a detector: a count and a confidence drawn from the job's name."""

    low: int = 20
    high: int = 35

    def process(self, image, centre, job=""):
        h, w = image.shape[:2]
        count = self.low + int(_unit(job, "rings") * (self.high - self.low + 1))
        confidence = round(0.85 + 0.13 * _unit(job, "confidence"), 3)
        radii = [int((i + 1) * min(w, h) / (count * 2.5)) for i in range(count)]
        details = {"confidence": confidence, "method": "mock_detection", "processing_time_ms": 50}
        return Outcome({"count": count, "details": details}, _overlay(image, w // 2, h // 2, radii))


@dataclass
class UnsharpMasking:
    kernel_size: int = 5
    sigma: float = 1.0
    amount: float = 1.5

    def process(self, image, centre, job=""):
        parameters = {"kernel_size": self.kernel_size, "sigma": self.sigma, "amount": self.amount}
        return Outcome({"status": "success", "parameters": parameters}, I.unsharp(image, self.kernel_size, self.sigma, self.amount))


def vote(detections: list[tuple[int, int]], tolerance: int, least_votes: int) -> tuple[list[int], list[int]]:
    """Radii and votes of the groups of (radius, sector) that enough sectors are in; a group starts where the last one ends."""
    rows, radii, votes, i = sorted(detections, key=lambda d: d[0]), [], [], 0
    while i < len(rows):
        group = [d for d in rows[i:] if d[0] - rows[i][0] <= tolerance]
        i += len(group)
        if (sectors := len({s for _, s in group})) >= least_votes:
            radii.append(int(np.median([r for r, _ in group])))
            votes.append(sectors)
    return radii, votes


@dataclass
class PolarRingDetection:
    angles: int = 360
    prominence: float = 1.0
    distance: int = 20
    sigma: float = 2.5
    sectors: int = 8
    least_votes: int = 4
    tolerance: int = 10
    least_radius: int = 50

    def process(self, image, centre, job=""):
        cx, cy = int(centre[0]), int(centre[1])
        flat = I.clahe(I.stretch(I.blue(image)), 2.0, 8)
        rows = I.median_rows(I.polar(flat, cx, cy, I.farthest_corner(cx, cy, flat.shape[1], flat.shape[0]), self.angles))
        width, found = self.angles // self.sectors, []
        for s in range(self.sectors):
            part = rows[s * width : (s + 1) * width if s < self.sectors - 1 else self.angles]
            dark = I.peaks(-I.smooth(part.mean(axis=0), self.sigma), self.distance, self.prominence)
            found += [(int(r), s) for r in dark if r >= self.least_radius]
        radii, votes = vote(found, self.tolerance, self.least_votes)
        metrics = {"total_sector_detections": len(found), "confirmed_rings": len(radii), "average_votes_per_ring": float(np.mean(votes)) if votes else 0.0}
        return Outcome({"ring_count": len(radii), "radii": radii, "metrics": metrics}, _overlay(image, cx, cy, radii))


@dataclass
class SobelRingDetection:
    least_radius: int = 20
    threshold: float = 0.5
    distance: int = 35

    def process(self, image, centre, job=""):
        cx, cy = int(centre[0]), int(centre[1])
        light = I.grey(image).astype(np.float64)
        top = I.nearest_edge(cx, cy, light.shape[1], light.shape[0])
        radii: list[int] = []
        if top > self.least_radius:
            taps = np.array([1.0, 2.0, 1.0]) / 4
            edges = I.gradient(I.separable(light, taps, taps, "edge"), "edge")
            p = I.ray_profile(edges, cx, cy, np.arange(self.least_radius, top))
            p = p / p.max() if p.max() > 0 else p
            high = [i for i in range(1, len(p) - 1) if p[i - 1] < p[i] > p[i + 1] and p[i] >= self.threshold]
            radii = [self.least_radius + i for i in I.greedy(high, self.distance)]
        payload = {"ring_count": len(radii), "radii": radii, "method": "sobel_radial_gradient", "metrics": {"max_radius": int(top)}}
        return Outcome(payload, _overlay(image, cx, cy, radii))


@dataclass
class SecondDerivativeRingDetection:
    least_radius: int = 20
    distance: int = 35

    def process(self, image, centre, job=""):
        cx, cy = int(centre[0]), int(centre[1])
        light = I.grey(image)
        top = I.nearest_edge(cx, cy, light.shape[1], light.shape[0])
        at = np.arange(self.least_radius, max(top, self.least_radius))
        method = "second_derivative"
        if len(at) < 3:
            return Outcome({"ring_count": 0, "radii": [], "method": method, "metrics": {"max_radius": int(top), "profile_length": len(at)}, "error": "Perfil radial muy corto"}, _overlay(image, cx, cy, []))
        p = I.ray_profile(light, cx, cy, at)
        twice = np.convolve(np.convolve(p, [0.5, 0, -0.5], "valid"), [0.5, 0, -0.5], "valid") if len(p) > 4 else np.zeros(0)
        high = [i for i in range(1, len(twice) - 1) if twice[i - 1] < twice[i] > twice[i + 1] and twice[i] > 0]
        radii = _ints(at[1:-1][i] for i in I.greedy(high, self.distance))  # one below the centre of the difference, for parity
        payload = {"ring_count": len(radii), "radii": radii, "method": method, "metrics": {"max_radius": int(top), "profile_length": len(p)}}
        return Outcome(payload, _overlay(image, cx, cy, radii))


@dataclass
class AutocorrelationPeriodicity:
    sigma: float = 1.5
    least_radius: int = 40
    prominence: float = 0.02
    least_rings: int = 12
    most_rings: int = 30
    ring_scale: float = 1.4

    def period(self, profile: np.ndarray) -> tuple[float | None, dict]:
        """Spacing of the rings: the lag whose count is nearest to the middle of what is expected, or else the strongest frequency."""
        x = np.nan_to_num(profile - profile.mean(), nan=0.0, posinf=0.0, neginf=0.0)
        n, middle = len(x), (self.least_rings + self.most_rings) / 2
        low = max(1, int(n / self.most_rings))
        high = min(max(low + 1, int(n / self.least_rings)), n - 1)
        m: dict = {"lag_window": [low, high], "autocorr_length": n, "autocorr_used": False, "fft_used": False, "first_peak_lag": None, "best_peak_lag": None, "fft_best_k": None, "fft_spacing_raw": None}
        if n < 10 or not x.any():
            return None, m
        auto = np.correlate(x, x, "full")[n - 1 :]
        auto = auto / auto[0] if auto[0] else auto
        lags = [int(k) for k in I.peaks(auto, prominence=self.prominence) if low <= k <= high]
        if lags:
            cost = [abs(n / k - middle) + (0 if self.least_rings <= n / k <= self.most_rings else 10) for k in lags]
            best = lags[int(np.argmin(cost))]
            return float(best), m | {"autocorr_used": True, "first_peak_lag": lags[0], "best_peak_lag": best}
        power = np.abs(np.fft.rfft(x)) ** 2
        ks = np.arange(self.least_rings, min(self.most_rings, len(power) - 1) + 1)
        if not len(ks):
            return None, m
        k = int(ks[np.argmax(power[ks])])
        return float(round(n / k)), m | {"fft_used": True, "fft_best_k": k, "fft_spacing_raw": n / k}

    def process(self, image, centre, job=""):
        cx, cy = int(centre[0]), int(centre[1])
        flat = I.blur(I.clahe(I.stretch(I.blue(image)), 2.0, 8), 5)
        edges = I.stretch(I.gradient(flat))
        corner = I.farthest_corner(cx, cy, edges.shape[1], edges.shape[0])
        along = I.polar(edges, cx, cy, corner).mean(axis=0) if corner > 0 else np.zeros(0)
        last = min(corner, len(along) - 1)
        if last <= self.least_radius + 5:
            return Outcome({"ring_count": 0, "radii": [], "metrics": {"reason": "radius too small", "max_radius": int(last)}})
        reach = last - self.least_radius
        spacing, m = self.period(I.smooth(along[self.least_radius : last], self.sigma))
        if not spacing or spacing <= 0:
            return Outcome({"ring_count": 0, "radii": [], "metrics": m | {"reason": "no period"}})
        raw = reach / spacing
        scaled = int(round(self.ring_scale * raw))
        radii = [r for k in range(1, scaled + 1) if (r := int(self.least_radius + spacing * k)) <= last]
        m |= {"spacing": spacing, "raw_rings": raw, "scaled_rings": scaled, "effective_range": int(reach), "max_radius": int(last)}
        return Outcome({"ring_count": len(radii), "radii": radii, "metrics": m}, _overlay(image, cx, cy, radii) if radii else None)


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 200) -> np.ndarray:
    """Centroids by Lloyd's steps from a distance-squared start; an empty cluster keeps its centroid."""
    rng = np.random.RandomState(seed)
    centres = [x[rng.randint(len(x))]]
    nearest = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = nearest.sum()
        centres.append(x[rng.choice(len(x), p=nearest / total if total > 0 else None)])
        nearest = np.minimum(nearest, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        of = ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)  # the nearest: |x|^2 is the same for all
        counts = np.bincount(of, minlength=k)
        sums = np.stack([np.bincount(of, x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        if np.allclose(c, new, rtol=1e-4):
            break
        c = new
    return c


def read_centres(rows) -> dict[str, tuple[int, int]]:
    """{image: (x, y)} of rows (codigo_imagen, x, y)."""
    return {r["codigo_imagen"]: (int(r["x"]), int(r["y"])) for r in rows}


@dataclass
class KMeansRingCounter:
    most_pixels: int = 8000
    separation: float = 0.006
    radius_weight: float = 6.0
    expected: int = 22
    centres: dict = field(default_factory=dict)
    candidates: tuple[int, ...] = (25, 28, 31, 35, 38, 41, 45, 48, 51, 55)

    def mask(self, light: np.ndarray) -> np.ndarray:
        even = I.blur(I.equalise(light), 7)
        high = even > int(0.4 * even.max())
        return I.erode(I.largest_filled(high), I.ellipse_offsets(11), 2) if high.any() else high

    def centre(self, given, job: str, mask: np.ndarray) -> tuple[int, int]:
        """Given coordinates, or else those on file for the image, or else the mask's centre of mass."""
        if given is not None and None not in given:
            return int(given[0]), int(given[1])
        if job in self.centres:
            return self.centres[job]
        y, x = np.nonzero(mask)
        return (int(x.mean()), int(y.mean())) if len(x) else (mask.shape[1] // 2, mask.shape[0] // 2)

    def rings(self, centroids: np.ndarray, widest: float, valid: float) -> list[float]:
        radii = np.sort(centroids[:, 0] / self.radius_weight * widest)
        return [float(r) for r in I.greedy([r for r in radii if r <= valid], self.separation * widest)]

    def best(self, x: np.ndarray, widest: float, valid: float, known: int | None = None) -> tuple[int, list[float]]:
        """The number of clusters whose count of rings is nearest to what is expected, fewer clusters by preference."""
        tried = [(k, self.rings(kmeans(x, k), widest, valid)) for k in self.candidates]
        return min(tried, key=lambda t: 3 * abs(len(t[1]) - (known or self.expected)) + 0.005 * t[0])

    def process(self, image, centre, job=""):
        light = I.grey(image)
        mask = self.mask(light)
        cx, cy = self.centre(centre, job, mask)
        y, x = np.nonzero(mask)
        step = max(1, len(x) // self.most_pixels)
        distance = np.hypot(x - cx, y - cy)
        valid = float(np.percentile(distance, 87)) if len(x) else 0.0
        y, x, r = y[::step], x[::step], distance[::step]
        if len(r) < 100:
            return Outcome({"num_anillos": 0, "k_optimo": 0, "centro": [cx, cy], "radios_anillos": [], "radio_max_usado": valid, "error": "too few pixels"})
        widest = float(r.max())
        features = np.stack([r / (widest + 1e-6) * self.radius_weight, light[y, x] / 255.0], axis=1)
        k, radii = self.best(features, widest, valid)
        visual = I.colour(image)
        for i, radius in enumerate(radii):
            t = i / max(1, len(radii) - 1)
            I.draw_circle(visual, cx, cy, radius, (int(255 * (1 - t)), 64, int(255 * t)))
        return Outcome({"num_anillos": len(radii), "k_optimo": k, "centro": [cx, cy], "radios_anillos": radii, "radio_max_usado": valid}, visual)


Predictor = Callable[[np.ndarray], np.ndarray]


def dark_predictor(batch: np.ndarray) -> np.ndarray:
    """Stands in for a network: the darker a pixel, the likelier; (n, h, w, 3) in 0..1 to (n, h, w)."""
    return 1.0 - batch.mean(axis=3)


def cached_model(path: str, load: Callable[[str], Predictor]) -> Predictor:
    """A model loaded once per Python worker process, whichever thread asks first.

    The cache stands in a module of its own: functions are shipped by value, so a global of this one would be new in each task.
    """
    home = sys.modules.setdefault("_xylem_models", types.ModuleType("_xylem_models")).__dict__
    with home.setdefault("lock", threading.Lock()):
        models = home.setdefault("models", {})
        if path not in models:
            models[path] = load(path)
        return models[path]


def download(url: str, path: str, piece: int = 8192) -> str:
    """A model file, streamed to path in pieces unless it is there; an error without a URL."""
    import os
    import uuid
    from urllib.request import urlopen

    if not os.path.exists(path):
        if not url:
            raise ValueError(f"no model at {path} and no URL to load it from")
        partial = f"{path}.{uuid.uuid4().hex}.part"  # several workers of a host may load at once
        with urlopen(url) as answer, open(partial, "wb") as f:  # noqa: S310
            while part := answer.read(piece):
                f.write(part)
        os.replace(partial, path)
    return path


@dataclass
class CNNSegmentation:
    """Segmentation in patches by any predictor of (n, h, w, 3) in 0..1, red first, to (n, h, w) or (n, h, w, 1).

    No trained network comes with the engine.
    """

    predictor: Predictor = dark_predictor
    patch: int = 800
    longest: int = 8000

    def process(self, image, centre, job=""):
        began = time.time()
        rgb = I.colour(image)[..., ::-1]
        h, w = rgb.shape[:2]
        shrink = min(1.0, self.longest / max(h, w))
        small = rgb if shrink == 1 else I.resize(rgb, max(1, int(h * shrink)), max(1, int(w * shrink)))
        sh, sw = small.shape[:2]
        rows, columns = math.ceil(sh / self.patch), math.ceil(sw / self.patch)
        likely = np.zeros((sh, sw))
        for i in range(rows):
            for j in range(columns):
                y, x = i * self.patch, j * self.patch
                part = small[y : y + self.patch, x : x + self.patch]
                tile = np.zeros((1, self.patch, self.patch, 3))
                tile[0, : part.shape[0], : part.shape[1]] = part / 255.0
                got = np.asarray(self.predictor(tile)).reshape(self.patch, self.patch)
                likely[y : y + part.shape[0], x : x + part.shape[1]] = got[: part.shape[0], : part.shape[1]]
        mask = (likely > 0.5).astype(np.uint8) * 255
        if shrink < 1:
            mask = (I.resize(mask, h, w) > 127).astype(np.uint8) * 255
        wide = I.dilate(mask > 127, 2)
        tint = np.zeros((h, w, 3))
        tint[wide] = (0, 255, 0)
        visual = I.saturate(I.colour(image) * 0.7 + tint * 0.3)
        payload = {"num_patches": rows * columns, "image_size": [h, w], "processed_size": [sh, sw], "mask_coverage": float((mask > 0).mean()), "processing_time_seconds": round(time.time() - began, 3)}
        return Outcome(payload, visual, mask)


def mock_result(job: str, url: str, client: str, x: float, y: float, now: str) -> dict:
    """The result of a processor that only goes through the motions."""
    data = {"originalUrl": url, "processedUrl": f"{url}?processed=1", "ringsCount": 10 + int(_unit(job, "mock") * 41), "metadata": {"coordinatesX": x, "coordinatesY": y, "processingTimeMs": 100}}
    return {"jobId": job, "clientId": client, "status": "COMPLETED", "timestamp": now, "data": data, "error": None}


#: All that give the same result each time, in order; CNNSegmentation runs with its stand-in unless a predictor is given.
DEFAULT = (RingDetection, UnsharpMasking, PolarRingDetection, SobelRingDetection, AutocorrelationPeriodicity, SecondDerivativeRingDetection, KMeansRingCounter, CNNSegmentation)
