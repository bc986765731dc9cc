"""Numerical kernels without an SQL form, in numpy and the standard library."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out, x = out - 1 / x, x + 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out, x = out + 1 / (x * x), x + 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def gamma_shape(mean: float, mean_log: float, steps: int = 60) -> float:
    """The maximum-likelihood shape: log k - digamma(k) = log(mean) - mean_log, by Newton's method."""
    s = math.log(mean) - mean_log
    if s <= 0:
        return 1e6  # no spread
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(steps):
        new = k - (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        new = new if new > 0 else k / 2
        if abs(new - k) < 1e-12 * k:
            break
        k = new
    return k


def gamma_cdf_of(x: np.ndarray, shape: float, rate: float = 1.0) -> np.ndarray:
    """The regularised lower incomplete gamma function of all values: a series below shape + 1, else a continued fraction."""
    z = np.asarray(x, float) * rate
    out = np.where(np.isnan(z), np.nan, np.where(np.isposinf(z), 1.0, 0.0))
    low, high = (z > 0) & (z < shape + 1), (z >= shape + 1) & np.isfinite(z)
    front = lambda v: np.exp(shape * np.log(v) - v - math.lgamma(shape))
    if low.any():
        v, k = z[low], shape
        term = np.full(len(v), 1 / shape)
        total = term.copy()
        while (term > total * 1e-16).any():
            k += 1
            term = term * v / k
            total += term
        out[low] = np.minimum(1.0, total * front(v))
    if high.any():
        v = z[high]
        tiny = lambda q: np.where(q == 0, 1e-300, q)
        b, c = v + 1 - shape, np.full(len(v), 1e300)
        d = 1 / tiny(b)
        h = d.copy()
        for i in range(1, 500):
            a = -i * (i - shape)
            b = b + 2
            d, c = 1 / tiny(a * d + b), tiny(b + a / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = np.maximum(0.0, 1 - front(v) * h)
    return out


def gamma_cdf(x: float, shape: float, rate: float = 1.0) -> float:
    return float(gamma_cdf_of(np.array([x]), shape, rate)[0])


def gamma_ppf(p: float, shape: float, rate: float = 1.0) -> float:
    """The quantile, by bisection."""
    low, high = 0.0, max(1.0, shape)
    while gamma_cdf(high, shape) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_cdf(mid, shape) < p else (low, mid)
    return (low + high) / 2 / rate


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    """The quantile of Student's distribution for p > 0.5, by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def correlation_p(r: float, n: int) -> float:
    """The two-sided p-value of a correlation of n pairs."""
    if r is None or math.isnan(r) or n < 3:
        return float("nan")
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def kolmogorov_p(d: float, n: int) -> float:
    """The two-sided p-value of a Kolmogorov-Smirnov statistic, by the limit law with Stephens' correction."""
    if d is None or math.isnan(d) or n < 1:
        return float("nan")
    z = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


def normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


def geodesic_km(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Distances on the WGS-84 ellipsoid by Vincenty's inverse formula; nearly antipodal points fall back to a sphere."""
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    lon1, lat1, lon2, lat2 = (np.radians(np.atleast_1d(np.asarray(v, float))) for v in (lon1, lat1, lon2, lat2))
    u1, u2, l = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2)), lon2 - lon1
    lam = l.copy()
    with np.errstate(all="ignore"):
        for _ in range(200):
            sin_s = np.sqrt((np.cos(u2) * np.sin(lam)) ** 2 + (np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)) ** 2)
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s, 0)
            cos2 = 1 - sin_a**2
            cos_m = np.where(cos2 > 1e-15, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2, 0)
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = l + (1 - c) * f * sin_a * (s + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
            done = np.abs(new - lam) < 1e-13
            lam = new
            if done.all():
                break
        k = cos2 * (a * a - b * b) / (b * b)
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        delta = big_b * sin_s * (cos_m + big_b / 4 * (cos_s * (2 * cos_m**2 - 1) - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
        out = b * big_a * (s - delta)
        h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(l / 2) ** 2
        sphere = 2 * 6371.009 * np.arcsin(np.sqrt(np.minimum(1, h)))
    return np.where(done & np.isfinite(out), out, sphere)


def jenks(values: np.ndarray, weights: np.ndarray, classes: int) -> list[float]:
    """Fisher-Jenks breaks of sorted different values with weights: lowest value and the upper ends of the classes."""
    v, w = np.asarray(values, float), np.asarray(weights, float)
    n, k = len(v), min(classes, len(values))
    z = v - np.average(v, weights=w)
    cw, cs, cq = (np.concatenate([[0], np.cumsum(x)]) for x in (w, w * z, w * z * z))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        return cq[j] - cq[i] - (cs[j] - cs[i]) ** 2 / (cw[j] - cw[i])

    best, cut = np.full(n + 1, np.inf), np.zeros((k + 1, n + 1), int)
    best[0] = 0
    for c in range(1, k + 1):
        new, todo = np.full(n + 1, np.inf), [(c, n, c - 1, n - 1)]
        while todo:  # cuts grow with j, so the cut of the middle j bounds those of both halves
            low, high, first, last = todo.pop()
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            t = best[i] + cost(i, j)
            at = int(t.argmin())
            new[j], cut[c, j] = t[at], i[at]
            if low < j:
                todo.append((low, j - 1, first, i[at]))
            if j < high:
                todo.append((j + 1, high, i[at], last))
        best = new
    ends, j = [], n
    for c in range(k, 0, -1):
        ends.append(float(v[j - 1]))
        j = cut[c, j]
    return [float(v[0]), *ends[::-1]]


def knee(x: np.ndarray, y: np.ndarray) -> int:
    """The index of the knee of a concave increasing curve: the largest difference of the normalised curve and the diagonal."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    xn = (x - x.min()) / (np.ptp(x) or 1)
    yn = (y - y.min()) / (np.ptp(y) or 1)
    return int((yn - xn).argmax())


def _krige_parts(points: np.ndarray, targets: np.ndarray, sill: float, range_km: float, nugget: float) -> tuple[np.ndarray, np.ndarray]:
    """The systems and right sides of ordinary kriging; leading dimensions are stacks of neighbourhoods."""

    def dist(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        p, q = np.radians(p)[..., :, None, :], np.radians(q)[..., None, :, :]
        h = np.sin((p[..., 1] - q[..., 1]) / 2) ** 2 + np.cos(p[..., 1]) * np.cos(q[..., 1]) * np.sin((p[..., 0] - q[..., 0]) / 2) ** 2
        return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, h)))

    def gamma(d: np.ndarray) -> np.ndarray:
        return np.where(d > 0, nugget + (sill - nugget) * (1 - np.exp(-((d / (range_km * 4 / 7)) ** 2))), 0)

    n = points.shape[-2]
    left = np.ones((*points.shape[:-2], n + 1, n + 1))
    left[..., :n, :n], left[..., n, n] = gamma(dist(points, points)), 0
    right = np.ones((*points.shape[:-2], n + 1, targets.shape[-2]))
    right[..., :n, :] = gamma(dist(points, targets))
    return left, right


def krige(points: np.ndarray, values: np.ndarray, targets: np.ndarray, sill: float, range_km: float, nugget: float) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary kriging with a gaussian variogram on great-circle distances: estimates and variances at the targets.

    With leading dimensions (values: ... x n, points: ... x n x 2, targets: ... x m x 2) all neighbourhoods are solved at once.
    """
    left, right = _krige_parts(points, targets, sill, range_km, nugget)
    w = np.linalg.pinv(left, hermitian=True) @ right
    return (values[..., None, :] @ w[..., :-1, :])[..., 0, :], (w * right).sum(-2)


def _scaled_erfc(x: float) -> float:
    """exp(x^2) erfc(x) for x >= 0; far out by its asymptotic series."""
    if x <= 12:
        return math.exp(x * x) * math.erfc(x)
    total = term = 1.0
    for k in range(1, 7):
        term *= -(2 * k - 1) / (2 * x * x)
        total += term
    return total / (x * math.sqrt(math.pi))


def scaled_erfc_polynomial(degree: int = 20) -> list[float]:
    """Coefficients, lowest first, in s = 4 / (2 + x) - 1, of a polynomial that is within 1e-14 of exp(x^2) erfc(x) for x >= 0."""
    at = lambda s: np.array([_scaled_erfc(4 / (v + 1) - 2) if v > -1 else 0.0 for v in np.atleast_1d(s)])
    return [float(c) for c in np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebinterpolate(at, degree))]


def leading(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, width: int, tolerance: float, passes: int, most: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and vectors of a symmetric matrix of n rows that only multiplies blocks of `width` vectors.

    Block Krylov passes with full orthogonalisation, restarted when the basis is beyond `most` blocks. They end when the residuals
    are below `tolerance` times the largest value; RuntimeError if `passes` don't do.
    """
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(n, width)))[0]
    basis, image = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(passes):
        basis, image = np.hstack([basis, q]), np.hstack([image, product(q)])
        h = basis.T @ image
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        vectors = basis @ u[:, :k]
        rest = np.linalg.norm(image @ u[:, :k] - vectors * values[:k], axis=0)
        if basis.shape[1] >= n or rest.max() <= tolerance * max(values[0], 1e-12):
            return values[:k], vectors
        q = image[:, -q.shape[1] :]
        if basis.shape[1] + width > most * width:  # go on with the best vectors, and the residuals of the first of them
            held = max(3, most // 3) * width
            q = image @ u[:, :width] - basis @ u[:, :width] * values[:width]
            basis, image = basis @ u[:, :held], image @ u[:, :held]
        for _ in range(2):
            q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        q = q[:, : n - basis.shape[1]]
    raise RuntimeError(f"residual {rest.max():.1e} after {passes} passes")
