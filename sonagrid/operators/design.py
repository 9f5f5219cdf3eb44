"""Filter designs beyond the audio sections: small maths whose results are taps
or second-order sections for the operators of filters and kernels."""

from __future__ import annotations

from math import pi

import numpy as np


def window(kind: str, length: int, parameter: float | None = None, periodic: bool = False) -> np.ndarray:
    """Samples of a window; parameter: beta (kaiser), share of the flanks (tukey), deviation in samples (gaussian)."""
    n = length + 1 if periodic else length
    if n == 1:
        return np.ones(length)
    m = np.arange(n)
    x = 2 * m / (n - 1) - 1
    if kind == "boxcar":
        w = np.ones(n)
    elif kind == "triangle":
        w = 1 - np.abs((m - (n - 1) / 2) / ((n if n % 2 == 0 else n + 1) / 2))
    elif kind == "bartlett":
        w = 1 - np.abs(x)
    elif kind == "kaiser":
        w = np.kaiser(n, parameter if parameter is not None else 8.6)
    elif kind == "gaussian":
        w = np.exp(-0.5 * ((m - (n - 1) / 2) / (parameter or n / 8)) ** 2)
    elif kind == "cosine":
        w = np.sin(pi * (m + 0.5) / n)
    elif kind == "tukey":
        a = 0.5 if parameter is None else parameter
        edge = np.minimum(m, n - 1 - m) / (a * (n - 1) / 2) if a > 0 else np.ones(n)
        w = np.where(edge < 1, 0.5 - 0.5 * np.cos(pi * np.minimum(edge, 1)), 1.0)
    else:
        # fixed values: coefficients of the cosine-sum windows
        a = {
            "hann": [0.5, 0.5],
            "hamming": [0.54, 0.46],
            "blackman": [0.42, 0.5, 0.08],
            "nuttall": [0.3635819, 0.4891775, 0.1365995, 0.0106411],
            "blackmanharris": [0.35875, 0.48829, 0.14128, 0.01168],
            "flattop": [0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368],
        }[kind]
        w = sum((-1) ** k * c * np.cos(2 * pi * k * m / (n - 1)) for k, c in enumerate(a))
    return w[:length]


def analogue_to_sections(zeros, poles, gain: float, rate_hz: int) -> np.ndarray:
    """Bilinear transform of analogue roots (rad/s) and pairing in sections."""
    t = 2.0 * rate_hz
    z, p = np.asarray(zeros, dtype=complex), np.asarray(poles, dtype=complex)
    k = gain * np.real(np.prod(t - z) / np.prod(t - p))
    z = np.concatenate([(t + z) / (t - z), -np.ones(len(p) - len(z))])
    return roots_to_sections(z, (t + p) / (t - p), k)


def roots_to_sections(zeros, poles, gain: float) -> np.ndarray:
    """Sections of roots in conjugate pairs; poles nearest to the unit circle last, with their nearest zeros."""

    def pairs(roots):
        roots = np.asarray(roots, dtype=complex)
        top = sorted((r for r in roots if r.imag > 1e-10), key=lambda r: -abs(r))
        real = sorted((r.real for r in roots if abs(r.imag) <= 1e-10), key=lambda r: -abs(r))
        out = [np.array([1, -2 * r.real, abs(r) ** 2]) for r in top]
        out += [np.poly(real[i : i + 2]) for i in range(0, len(real), 2)]
        return [np.pad(c, (0, 3 - len(c))) for c in out]

    a, b = pairs(poles), pairs(zeros)
    n = max(len(a), len(b), 1)
    a += [np.array([1.0, 0, 0])] * (n - len(a))
    b += [np.array([1.0, 0, 0])] * (n - len(b))
    out = np.array([np.concatenate([x, y]) for x, y in zip(b, a)])
    out[0, :3] *= gain
    return out[::-1].copy()


def prototype(family: str, order: int, ripple_db: float = 1.0, stop_db: float = 40.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(zeros, poles, gain) of an analogue low-pass with its edge at 1 rad/s."""
    theta = pi * (2 * np.arange(order) + 1) / (2 * order)
    if family == "butterworth":
        p = -np.sin(theta) + 1j * np.cos(theta)
        return np.zeros(0), p, 1.0
    if family == "chebyshev1":
        mu = np.arcsinh(1 / np.sqrt(10 ** (ripple_db / 10) - 1)) / order
        p = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
        gain = np.real(np.prod(-p))
        return np.zeros(0), p, gain / (np.sqrt(10 ** (ripple_db / 10)) if order % 2 == 0 else 1.0)
    if family == "chebyshev2":
        mu = np.arcsinh(np.sqrt(10 ** (stop_db / 10) - 1)) / order
        p = 1 / (-np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta))
        c = np.cos(theta)
        z = 1j / c[np.abs(c) > 1e-12]
        return z, p, float(np.real(np.prod(-p) / np.prod(-z)))
    if family == "bessel":
        # roots of the reverse Bessel polynomial, scaled to unit delay asymptote
        from math import factorial

        c = [factorial(2 * order - k) / (2.0 ** (order - k) * factorial(k) * factorial(order - k)) for k in range(order + 1)]
        p = np.roots(c[::-1]) / c[0] ** (1 / order)
        return np.zeros(0), p, float(np.real(np.prod(-p)))
    raise ValueError(family)


def iir(family: str, order: int, frequency, kind: str, rate_hz: int, ripple_db: float = 1.0, stop_db: float = 40.0) -> np.ndarray:
    """Sections of a classic design; kind: lowpass, highpass, bandpass or bandstop (frequency is then a pair)."""
    z, p, k = prototype(family, order, ripple_db, stop_db)
    warp = lambda f: 2 * rate_hz * np.tan(pi * f / rate_hz)
    degree = len(p) - len(z)
    if kind == "lowpass":
        w = warp(frequency)
        return analogue_to_sections(z * w, p * w, k * w**degree, rate_hz)
    if kind == "highpass":
        w = warp(frequency)
        gain = k * np.real(np.prod(-z) / np.prod(-p))
        return analogue_to_sections(np.concatenate([w / z, np.zeros(degree)]), w / p, gain, rate_hz)
    w1, w2 = (warp(f) for f in frequency)
    band, w0 = w2 - w1, np.sqrt(w1 * w2)
    both = lambda r: np.concatenate([r + np.sqrt(r**2 - w0**2 + 0j), r - np.sqrt(r**2 - w0**2 + 0j)])
    if kind == "bandpass":
        return analogue_to_sections(np.concatenate([both(z * band / 2), np.zeros(degree)]), both(p * band / 2), k * band**degree, rate_hz)
    gain = k * np.real(np.prod(-z) / np.prod(-p))
    zeros = np.concatenate([both(band / 2 / z), np.full(degree, 1j * w0), np.full(degree, -1j * w0)])
    return analogue_to_sections(zeros, both(band / 2 / p), gain, rate_hz)


def weighting(kind: str, rate_hz: int) -> np.ndarray:
    """A or C weighting, 0 dB at 1 kHz."""
    # fixed values: pole frequencies of the weighting curves in Hz
    f1, f2, f3, f4 = 20.598997, 107.65265, 737.86223, 12194.217
    w = -2 * pi * np.array([f1, f1, f4, f4] + ([f2, f3] if kind == "A" else []))
    s = analogue_to_sections(np.zeros(4 if kind == "A" else 2), w, 1.0, rate_hz)
    from sonagrid.operators.kernels import response

    s[0, :3] /= abs(response(s, np.array([1000.0]), rate_hz)[0])
    return s


def weighting_db(f_hz, kind: str = "A") -> np.ndarray:
    """The weighting curve itself, in dB."""
    f2 = np.asarray(f_hz, dtype=float) ** 2
    r = 12194.217**2 * f2 / ((f2 + 20.598997**2) * (f2 + 12194.217**2))
    if kind == "A":
        r = r * f2 / np.sqrt((f2 + 107.65265**2) * (f2 + 737.86223**2))
    one = {"A": 2.0, "C": 0.0619}[kind]
    return 20 * np.log10(np.maximum(r, 1e-300)) + one


def pinking(rate_hz: int, low_hz: float = 10.0) -> np.ndarray:
    """About -3 dB for each octave: poles and zeros alternating at half decades."""
    f = low_hz * 10 ** (0.5 * np.arange(2 * int(np.log10(rate_hz / 2 / low_hz) * 2) // 2 + 1))
    p, z = -2 * pi * f, -2 * pi * f * 10**0.25
    return analogue_to_sections(z[: len(p)], p, 1.0, rate_hz)


def thiran(delay: float, order: int) -> np.ndarray:
    """[b, a] of an allpass whose delay is flat at low frequencies."""
    from math import comb

    a = np.array([(-1) ** k * comb(order, k) * np.prod([(delay - order + n) / (delay - order + k + n) for n in range(order + 1)]) for k in range(order + 1)])
    return np.array([a[::-1], a])


def quadrature_mirror(taps) -> dict[str, np.ndarray]:
    """Analysis and synthesis taps of a two-band bank without aliasing."""
    h = np.asarray(taps, dtype=float)
    sign = (-1.0) ** np.arange(len(h))
    return {"low": h, "high": h * sign, "low_back": 2 * h, "high_back": -2 * h * sign}


def complementary(taps) -> np.ndarray:
    """Unit impulse at the middle less a symmetric odd-length response."""
    h = -np.asarray(taps, dtype=float)
    if len(h) % 2 == 0:
        raise ValueError("the length must be odd")
    h[len(h) // 2] += 1
    return h


def gammatone_sections(f_hz: float, rate_hz: int, order: int = 4) -> list[complex]:
    """Poles of the complex one-pole cascade of a gammatone band: all the same."""
    width = 24.7 * (1 + 4.37 * f_hz / 1000)
    # equivalent rectangular bandwidth of the cascade over its decay
    from math import factorial

    factor = pi * factorial(2 * order - 2) * 2.0 ** -(2 * order - 2) / factorial(order - 1) ** 2
    decay = np.exp(-2 * pi * width / factor / rate_hz)
    return [decay * np.exp(2j * pi * f_hz / rate_hz)] * order


def gammatone_synthesis(frequencies: list[float], rate_hz: int, delay_s: float = 0.004, order: int = 4) -> list[tuple[int, complex]]:
    """(delay, factor) of each band, so that the real parts of the factors times the delayed
    bands add up to the signal, delay_s later (Hohmann 2002, section 4).

    A band is delayed so that its envelope's maximum (up to delay_s) comes at
    delay_s, and turned so that its fine structure has one there: its slope is
    then the imaginary unit's. Gains are found by rounds: each is divided by the
    size of the sum of all bands at its own centre.
    """
    late = round(delay_s * rate_hz)
    n = np.arange(late + 2)
    grow = np.prod([(n + k) / k for k in range(1, order)], axis=0)  # of equal poles in a row
    poles = np.array([gammatone_sections(f, rate_hz, order)[0] for f in frequencies])
    size = 2 * (1 - np.abs(poles)) ** order
    delays, turns = [], []
    for p, level in zip(poles, size):
        h = level * grow * p**n
        top = max(1, int(np.argmax(np.abs(h[: late + 1]))))
        slope = h[top + 1] - h[top - 1]
        delays.append(late - top)
        turns.append(1j * abs(slope) / slope)
    delays, turns = np.array(delays), np.array(turns)

    def seen(z: np.ndarray) -> np.ndarray:
        """Each band (column) at each point of the plane (row)."""
        return size * (1 - poles / z[:, None]) ** -order * turns * z[:, None] ** -delays

    z = np.exp(2j * np.pi * np.asarray(frequencies, dtype=float) / rate_hz)
    both, gains = (seen(z) + seen(z.conj()).conj()) / 2, np.ones(len(poles))
    for _ in range(100):
        gains = gains / np.abs(both @ gains)
    return [(int(d), complex(g * t * s)) for d, g, t, s in zip(delays, gains, turns, size)]


def fractional_octave_edges(centres, fraction: int = 1) -> list[tuple[float, float]]:
    h = 2 ** (0.5 / fraction)
    return [(f / h, f * h) for f in centres]


def kaiser_beta(suppression_db: float) -> float:
    if suppression_db > 50:
        return 0.1102 * (suppression_db - 8.7)
    if suppression_db > 21:
        return 0.5842 * (suppression_db - 21) ** 0.4 + 0.07886 * (suppression_db - 21)
    return 0.0


def group_delay_fir(target_samples, length: int) -> np.ndarray:
    """Taps of an allpass-like response whose group delay follows targets on the
    one-sided bins of ``length``: delays are summed to a phase by trapezoids."""
    d = np.asarray(target_samples, dtype=float)
    step = 2 * pi / length
    phase = -np.concatenate([[0], np.cumsum((d[1:] + d[:-1]) / 2)]) * step
    phase -= (phase[-1] - pi * np.round(phase[-1] / pi)) * np.arange(len(d)) / (len(d) - 1)
    return np.fft.irfft(np.exp(1j * phase), length)


def reflection_from_taps(taps) -> list[float]:
    """Coefficients of the lattice with the same response, for a minimum-phase one of first tap 1."""
    a = np.asarray(taps, dtype=float)
    a = a / a[0]
    ks = []
    while len(a) > 1:
        k = a[-1]
        ks.append(float(k))
        if abs(k) >= 1:
            raise ValueError("not minimum phase")
        a = ((a - k * a[::-1]) / (1 - k * k))[:-1]
    return ks[::-1]


def matched(kind: str, f_hz: float, rate_hz: int, q: float = 2**-0.5, gain_db: float = 0.0) -> np.ndarray:
    """[b0 b1 b2 1 a1 a2] of a section whose magnitude follows the analogue one up to half the rate.

    Poles are those of the sampled analogue response; the numerator is solved
    for the squared magnitude at chosen frequencies (Vicanek, "Matched second
    order digital filters", 2016). kind: lowpass, highpass, bandpass or peaking.
    """
    w, gain = 2 * pi * f_hz / rate_hz, 10 ** (gain_db / 20)
    damping = 1 / (2 * q * (np.sqrt(gain) if kind == "peaking" else 1.0))
    turn = np.cos(np.sqrt(1 - damping**2) * w) if damping <= 1 else np.cosh(np.sqrt(damping**2 - 1) * w)
    a1, a2 = -2 * np.exp(-damping * w) * turn, np.exp(-2 * damping * w)
    p1 = np.sin(w / 2) ** 2
    p0 = 1 - p1
    # squared magnitude of the denominator: at 0, at half the rate, and the rest, as sums over p0, p1 and 4 p0 p1
    d0, d1, d2 = (1 + a1 + a2) ** 2, (1 - a1 + a2) ** 2, -4 * a2
    here, slope = d0 * p0 + d1 * p1 + d2 * 4 * p0 * p1, -d0 + d1 + 4 * (p0 - p1) * d2
    if kind == "lowpass":
        top = max(0.0, (here * q * q - d0 * p0) / p1)
        b0 = (np.sqrt(d0) + np.sqrt(top)) / 2
        b = [b0, np.sqrt(d0) - b0, 0.0]
    elif kind == "highpass":
        b0 = q * np.sqrt(here) / (4 * p1)
        b = [b0, -2 * b0, b0]
    elif kind == "bandpass":
        n2 = (here - slope * p1) / (4 * p1 * p1)
        n1 = max(0.0, slope + 4 * (p1 - p0) * n2)
        b1 = -np.sqrt(n1) / 2
        b0 = (np.sqrt(n2 + b1 * b1) - b1) / 2
        b = [b0, b1, -b0 - b1]
    elif kind == "peaking":
        here, slope = here * gain**2, slope * gain**2
        n2 = (here - slope * p1 - d0) / (4 * p1 * p1)
        n1 = max(0.0, slope + d0 + 4 * (p1 - p0) * n2)
        half = (np.sqrt(d0) + np.sqrt(n1)) / 2
        b0 = (half + np.sqrt(max(0.0, half * half + n2))) / 2
        b = [b0, (np.sqrt(d0) - np.sqrt(n1)) / 2, -n2 / (4 * b0)]
    else:
        raise ValueError(kind)
    return np.array([*b, 1.0, a1, a2], dtype=float)
