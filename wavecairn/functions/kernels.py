"""Array kernels of one block of samples; no Spark in here.

A window is valid if its first sample is not the sentinel, and its population deviation is over TINY.
Sentinels elsewhere count as 0. Statistics are two-pass for every window; nothing is differenced, so quiet
stretches after loud ones keep their digits.
"""

from __future__ import annotations

from functools import cache
from statistics import NormalDist

import numpy as np

# The mark of a missing sample, and the deviation up to which a window is constant.
SENTINEL, TINY = -100000.0, 1e-12
#: Samples that are compared before a window may be given up.
STRIDE = 32
#: Doubles that a kernel holds at once for centred windows.
ROOM = 1 << 21
SYMBOLS = 256
#: Samples of a run that is summed once; runs are counted from the start of the series.
RUN = 16


def windows(samples: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows as a view, sentinels as 0, and whether each may start a match."""
    x = np.asarray(samples, np.float64)
    if len(x) < m:
        return np.zeros((0, m)), np.zeros(0, bool)
    start = x[: len(x) - m + 1] != SENTINEL
    return np.lib.stride_tricks.sliding_window_view(np.where(x == SENTINEL, 0.0, x), m), start


def statistics(view: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each window."""
    step = max(1, ROOM // max(1, view.shape[1]))
    mu, sd = np.empty(len(view)), np.empty(len(view))
    for lo in range(0, len(view), step):
        part = view[lo : lo + step]
        mu[lo : lo + step] = part.mean(1)
        sd[lo : lo + step] = np.sqrt(((part - mu[lo : lo + step, None]) ** 2).mean(1))
    return mu, sd


def znorm(values: np.ndarray) -> np.ndarray:
    """z-normalised by population deviation; a constant gives NaN, since its correlation is undefined."""
    x = np.asarray(values, np.float64)
    c = x - x.mean()
    sd = np.sqrt((c**2).mean())
    return c / sd if sd > TINY else np.full(len(x), np.nan)


def cc_to_ed(corr, m: int):
    return 2 * m * (1 - corr)


def ed_to_cc(ed, m: int):
    return 1 - ed / (2 * m)


def correlations(view: np.ndarray, z: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Correlation of each window with each template, in [-1, 1]; -inf where it is undefined."""
    m = view.shape[1]
    out = np.full((len(view), len(z)), -np.inf)
    step = max(1, ROOM // m)
    fine = sd > TINY
    for lo in range(0, len(view), step):
        s = slice(lo, lo + step)
        good = np.flatnonzero(fine[s]) + lo
        if len(good):
            out[good] = np.clip((view[good] - mu[good, None]) @ z.T / (m * sd[good, None]), -1, 1)
    out[:, np.isnan(z).any(1)] = -np.inf
    return out


# ---- summaries -----------------------------------------------------------------------------------


@cache
def breakpoints(symbols: int = SYMBOLS) -> np.ndarray:
    """Quantiles of the standard normal that cut it into equally likely symbols."""
    return np.array([NormalDist().inv_cdf(i / symbols) for i in range(1, symbols)])


def paa(z: np.ndarray, segments: int) -> np.ndarray:
    return z.reshape(len(z), segments, z.shape[1] // segments).mean(2)


def ordered_paa(values: np.ndarray, segments: int) -> np.ndarray:
    """PAA means of one template, z-normalised, with every sum from left to right and a running deviation, as SQL aggregates rows; infinite or NaN for a constant."""
    x = np.asarray(values, np.float64)
    mean, squares = np.float64(0), np.float64(0)
    for n, v in enumerate(x, 1):
        before, mean = mean, mean + (v - mean) / n
        squares += (v - before) * (v - mean)
    with np.errstate(all="ignore"):
        z = (x - np.cumsum(x)[-1] / len(x)) / np.sqrt(squares / len(x))
        return np.cumsum(z.reshape(segments, -1), 1)[:, -1] / (len(x) // segments)


def sax(means: np.ndarray) -> np.ndarray:
    """The number of breakpoints under each value."""
    return np.searchsorted(breakpoints(), means, "left").astype(np.uint8)


def lower_bound(means: np.ndarray, words: np.ndarray, m: int, bits: int = 8) -> np.ndarray:
    """Least squared distance that a template (PAA means) can have to windows with these SAX words of `bits` bits a symbol. Segments are added in order."""
    edges = np.concatenate([[-2e6], breakpoints(), [2e6]])  # finite, for infinite means of constant templates
    width = 1 << (8 - bits)
    low, high = edges[words.astype(int) * width], edges[(words.astype(int) + 1) * width]
    gap = np.maximum(np.maximum(low - means, means - high), 0)
    return m / words.shape[-1] * np.cumsum(gap**2, -1)[..., -1]


def words(view: np.ndarray, mu: np.ndarray, sd: np.ndarray, segments: int) -> np.ndarray:
    """SAX words of windows; of undefined ones, those of zeros."""
    with np.errstate(all="ignore"):
        means = (view.reshape(len(view), segments, -1).mean(2) - mu[:, None]) / sd[:, None]
    return sax(np.where(sd[:, None] > TINY, means, 0.0))


def sums(samples: np.ndarray, start: int, width: int) -> np.ndarray:
    """Sum of all `width` neighbouring samples; samples[0] has position `start`.

    Terms are added from left to right, whole runs as one term, as window frames in SQL are. So rounding depends on a
    window's position only, not on the block that holds it.
    """
    x = np.asarray(samples, np.float64)
    n, head = max(0, len(x) - width + 1), -start % RUN
    whole = x[head : head + max(0, len(x) - head) // RUN * RUN].reshape(-1, RUN)
    runs = np.zeros(len(whole))
    for column in whole.T:
        runs += column
    out = np.zeros(n)
    for r in range(RUN):  # windows that begin r samples after the start of a run
        at = np.arange((r - start) % RUN, n, RUN)
        left = min(width, -r % RUN)
        inner, right = divmod(width - left, RUN)
        total = np.zeros(len(at))
        for j in range(left):
            total += x[at + j]
        for j in range(inner):
            total += runs[(at + left - head) // RUN + j]
        for j in range(width - right, width):
            total += x[at + j]
        out[at] = total
    return out


def placed_words(samples: np.ndarray, start: int, m: int, sd: np.ndarray, segments: int) -> np.ndarray:
    """SAX words of all windows of m samples as in `words`, with sums in the order of `sums`: a segment whose mean is the window's gets the symbol that SQL gives it."""
    if m % segments:
        raise ValueError("the window length must be a multiple of the segments")
    x, w = np.where(samples == SENTINEL, 0.0, samples), m // segments
    mu, means = sums(x, start, m) / m, sums(x, start, w) / w
    each = np.stack([means[k * w : k * w + len(mu)] for k in range(segments)], 1)
    with np.errstate(all="ignore"):
        return sax(np.where(sd[:, None] > TINY, (each - mu[:, None]) / sd[:, None], 0.0))


# ---- FFT -----------------------------------------------------------------------------------------


def smooth_length(n: int) -> int:
    """The least product of 2, 3, 5 and 7 that is n at least."""
    while True:
        x = n
        for p in (2, 3, 5, 7):
            while x % p == 0:
                x //= p
        if x == 1:
            return n
        n += 1


def sliding_dots(samples: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Dot product of every window with each template through one spectrum of the block."""
    n, m = len(samples), z.shape[1]
    size = smooth_length(n + m - 1)
    spectrum = np.fft.rfft(samples, size)
    return np.fft.irfft(spectrum[:, None] * np.fft.rfft(z[:, ::-1], size, axis=1).T, size, axis=0)[m - 1 : n]


def fft_error(samples: np.ndarray, z: np.ndarray) -> float:
    """A bound of the error of sliding_dots: machine precision times the norms, with room to spare."""
    return 64 * np.finfo(float).eps * np.log2(len(samples) + 2) * float(np.linalg.norm(samples)) * float(np.linalg.norm(z, axis=1).max(initial=0))


def matches(samples: np.ndarray, z: np.ndarray, bound: np.ndarray, strategy: str = "scan", segments: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, template and correlation of all pairs with squared distance of `bound` (one a template) at most.

    scan compares everything; sax drops pairs by lower bounds first; fft filters by the spectrum, with its error
    bound, and verifies. All return the same pairs, since survivors are worked out alike.
    """
    m = z.shape[1]
    view, start = windows(samples, m)
    if not len(view) or not len(z):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    least = ed_to_cc(np.asarray(bound, float), m)
    mu, sd = statistics(view)
    valid = start & (sd > TINY)
    if strategy == "scan":
        corr = correlations(view, z, mu, sd)
        i, j = np.nonzero(valid[:, None] & (corr >= least))
        return i, j, corr[i, j]
    if strategy == "sax":
        own = words(view, mu, sd, segments)
        means = paa(z, segments)
        close = np.stack([lower_bound(q, own, m) <= b * (1 + 1e-9) + 1e-6 for q, b in zip(means, bound, strict=True)], 1)
    elif strategy == "fft":
        filled = np.where(np.asarray(samples, float) == SENTINEL, 0.0, samples)
        centre = filled.mean()
        known = np.nan_to_num(z)
        dots = sliding_dots(filled - centre, known)
        slack = fft_error(filled - centre, known)
        with np.errstate(all="ignore"):
            close = (dots + slack + 1e-12) / (m * sd[:, None]) >= least - 1e-9
    else:
        raise ValueError(f"no such strategy: {strategy}")
    close &= valid[:, None] & ~np.isnan(z).any(1)
    found = []
    for k in range(len(z)):
        at = np.flatnonzero(close[:, k])
        place, corr = verified(view, at, mu[at], sd[at], z[k], float(np.asarray(bound)[k]))
        found.append((place, np.full(len(place), k), corr))
    i, j, corr = (np.concatenate(c) for c in zip(*found, strict=True))
    return i, j, corr


def energy_order(z: np.ndarray, stride: int = STRIDE) -> list[np.ndarray]:
    """The samples of a template in runs of `stride`, the runs with most energy first."""
    runs = [np.arange(lo, min(len(z), lo + stride)) for lo in range(0, len(z), stride)]
    return sorted(runs, key=lambda r: (-float((z[r] ** 2).sum()), int(r[0])))


def unabandoned(view: np.ndarray, at: np.ndarray, mu: np.ndarray, sd: np.ndarray, z: np.ndarray, bound: float) -> np.ndarray:
    """Which windows stay within the bound while their distance is summed run by run; the others are given up early."""
    live = np.arange(len(at))
    total = np.zeros(len(at))
    for run in energy_order(z):
        lo, hi = int(run[0]), int(run[-1]) + 1
        part = (view[at[live], lo:hi] - mu[live, None]) / sd[live, None] - z[lo:hi]
        total[live] += (part**2).sum(1)
        live = live[total[live] <= bound * (1 + 1e-9) + 1e-6]
        if not len(live):
            break
    return live


def verified(view: np.ndarray, at: np.ndarray, mu: np.ndarray, sd: np.ndarray, z: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at these places (with their statistics) those within the bound, and their correlations."""
    m = view.shape[1]
    places, corrs = [], []
    for lo in range(0, len(at), max(1, ROOM // m)):
        part = slice(lo, lo + max(1, ROOM // m))
        live = unabandoned(view, at[part], mu[part], sd[part], z, bound) + lo
        if len(live):
            corr = np.clip((view[at[live]] - mu[live, None]) @ z / (m * sd[live]), -1, 1)
            keep = corr >= ed_to_cc(bound, m)
            places.append(at[live][keep])
            corrs.append(corr[keep])
    return (np.concatenate(places), np.concatenate(corrs)) if places else (np.zeros(0, np.int64), np.zeros(0))


def separated(order: np.ndarray, k: int, offset: int) -> list[int]:
    """Walks positions in order and keeps those that are `offset` away from all kept ones, k at most."""
    kept: list[int] = []
    for p in order.tolist():
        if all(abs(p - q) >= offset for q in kept):
            kept.append(p)
            if len(kept) == k:
                break
    return kept
