"""Strain in array columns: filters, spectra and images; NumPy on one row at a time inside Arrow tasks.

All filters are zero-phase and work on the spectrum: a band-pass is a mask with raised
cosine edges, a notch the squared response of a second-order section, so that it equals
forward and backward filtering away from the ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of a spectrum's segments and of their overlap.
SEGMENT, OVERLAP = 4.0, 2.0
#: Power lines and their harmonics, in Hz, and the quality of their notches.
LINES, QUALITY = (60.0, 120.0, 180.0, 240.0, 300.0, 360.0), 30.0


def resample(x: np.ndarray, rate: float, to: float) -> np.ndarray:
    """By truncating or padding the spectrum; nothing where the rates agree."""
    if abs(rate - to) <= 1e-6:
        return x
    n = max(int(round(len(x) * to / rate)), 1)
    spectrum = np.fft.rfft(x)
    kept = np.zeros(n // 2 + 1, complex)
    m = min(len(kept), len(spectrum))
    kept[:m] = spectrum[:m]
    return np.fft.irfft(kept, n) * (n / len(x))


def band_pass(x: np.ndarray, rate: float, low: float, high: float, edge: float = 0.1) -> np.ndarray:
    f = np.fft.rfftfreq(len(x), 1 / rate)
    rise = np.clip((f - low * (1 - edge)) / (low * edge), 0, 1)
    fall = np.clip((high * (1 + edge) - f) / (high * edge), 0, 1)
    return np.fft.irfft(np.fft.rfft(x) * np.sin(rise * np.pi / 2) ** 2 * np.sin(fall * np.pi / 2) ** 2, len(x))


def density(x: np.ndarray, rate: float, seconds: float = SEGMENT, overlap: float = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided power density): the median over Hann segments."""
    n = min(int(seconds * rate), len(x))
    window = np.hanning(n + 1)[:-1]
    step = max(n - int(overlap * rate), 1) if n < len(x) else n
    parts = np.stack([x[k : k + n] for k in range(0, len(x) - n + 1, step)])
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    return np.fft.rfftfreq(n, 1 / rate), np.median(power, axis=0) * 2 / (rate * (window**2).sum())


def whiten(x: np.ndarray, rate: float) -> np.ndarray:
    """Each frequency divided by its amplitude density; white noise comes out with variance 1."""
    f, power = density(x, rate)
    amplitude = np.sqrt(np.interp(np.fft.rfftfreq(len(x), 1 / rate), f, power))
    least = amplitude.max() * 1e-12 if amplitude.max() > 0 else 1.0
    return np.fft.irfft(np.fft.rfft(x) / np.maximum(amplitude, least), len(x)) * np.sqrt(2 / rate)


def notch(x: np.ndarray, rate: float, lines: tuple[float, ...] = LINES, quality: float = QUALITY) -> np.ndarray:
    """Lines at or above half the rate are left alone."""
    z = np.exp(2j * np.pi * np.fft.rfftfreq(len(x), 1 / rate) / rate)
    spectrum = np.fft.rfft(x)
    for line in lines:
        if 0 < line < rate / 2:
            w = 2 * np.pi * line / rate
            gain = 1 / (1 + np.tan(w / quality / 2))
            response = gain * (1 - 2 * np.cos(w) / z + z**-2) / (1 - 2 * gain * np.cos(w) / z + (2 * gain - 1) * z**-2)
            spectrum = spectrum * np.abs(response) ** 2
    return np.fft.irfft(spectrum, len(x))


def conditioned(x: np.ndarray, rate: float, to: float = 4096.0, low: float = 20.0, high: float = 1291.0, lines: tuple[float, ...] = LINES) -> np.ndarray:
    """Resampled, then band-passed, whitened, and notched last: notches before would bend the density that whitening divides by."""
    return notch(whiten(band_pass(resample(x, rate, to), to, low, high), to), to, lines)


def resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Bilinear, corners on corners."""
    across = np.stack([np.interp(np.linspace(0, image.shape[1] - 1, columns), np.arange(image.shape[1]), r) for r in image])
    return np.stack([np.interp(np.linspace(0, image.shape[0] - 1, rows), np.arange(image.shape[0]), c) for c in across.T], axis=1)


def q_transform(x: np.ndarray, rate: float, span: tuple[float, float], band: tuple[float, float], qs: tuple[float, float], mismatch: float = 0.2, shape: tuple[int, int] = (128, 128)) -> np.ndarray:
    """Energy in tiles of constant Q over its median, on logarithmic frequencies and even times of the span (seconds from the start); of the Qs, the one with the loudest tile."""
    spectrum, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / rate)
    steps = max(int(np.ceil(np.log(qs[1] / qs[0]) / np.sqrt(2) / (2 * np.sqrt(mismatch / 3)))), 1)
    times = np.linspace(span[0], span[1], shape[1], endpoint=False)
    best = None
    for q in np.exp(np.linspace(np.log(qs[0]), np.log(qs[1]), steps)):
        rows = []
        for centre in np.geomspace(band[0], min(band[1], rate / 2 / (1 + np.sqrt(11) / q)), shape[0]):
            inside = np.abs(f - centre) < centre * np.sqrt(11) / q
            window = np.where(inside, (1 - ((f - centre) / (centre * np.sqrt(11) / q)) ** 2) ** 2, 0)
            full = np.zeros(len(x), complex)
            full[: len(f)] = spectrum * window
            energy = np.abs(np.fft.ifft(full)) ** 2
            middle = np.median(energy)
            rows.append(np.interp(times, np.arange(len(x)) / rate, energy / middle if middle > 0 else energy))
        image = np.stack(rows)
        if best is None or image.max() > best.max():
            best = image
    return best


def image(x: np.ndarray, rate: float, span: tuple[float, float], band: tuple[float, float], qs: tuple[float, float] = (8.0, 64.0), shape: tuple[int, int] = (128, 128), raw: bool = False) -> tuple[np.ndarray, float]:
    """(image, log energy). raw: energies as they are; else their logarithms over the 99th percentile, clipped to [0, 1]."""
    z = np.maximum(np.nan_to_num(q_transform(x, rate, span, band, qs, shape=shape), nan=0.0, posinf=0.0, neginf=0.0), 0)
    if raw:
        return z.astype(np.float32), float(np.log1p(np.percentile(z, 90)))
    z = np.log1p(z)
    return np.clip(z / (np.percentile(z, 99) + 1e-6), 0, 1).astype(np.float32), float(np.percentile(z, 90))


def edge(duration: float) -> float:
    """Seconds to leave out at either end of a stretch of data: a fifth, half a second at most."""
    return max(0.0, min(0.5, 0.2 * duration, duration / 2 - 1e-3))


def mapped(df: DataFrame, column: str, work: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """df with out array<double>, ok and err: a row whose work fails has ok false and the reason, and spoils no other. Null arrays fail."""
    at, own = df.columns.index(column), df.drop(out, "ok", "err")
    names, kept = own.columns, [k for k, c in enumerate(df.columns) if c in own.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, errors = [], []
            for x in batch.column(at):
                try:
                    if not x.is_valid:
                        raise ValueError("no samples")
                    values = np.asarray(x.values.to_numpy(zero_copy_only=False), float)
                    if not np.isfinite(values).all():
                        raise ValueError("samples that are no numbers")
                    made.append(np.ravel(work(values)))
                    errors.append(None)
                except (ValueError, ArithmeticError, IndexError) as error:
                    made.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(made, pa.list_(pa.float64())), pa.array([e is None for e in errors]), pa.array(errors, pa.string())], [*names, out, "ok", "err"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return df.mapInArrow(run, f"{fields}, `{out}` array<double>, ok boolean, err string")


def spans(windows: DataFrame, blocks: DataFrame, rate: int) -> DataFrame:
    """windows(block, start, seconds, ...) with samples: cut out of blocks(block, block_start, samples), each of which is read once for all its windows; a span that leaves its block is null."""
    wanted = windows.groupBy("block").agg(F.collect_list(F.struct(*[c for c in windows.columns if c != "block"])).alias("_windows"))  # a block's windows
    first = lambda w: F.round((w["start"] - F.col("block_start")) * rate).cast("int") + 1
    n = lambda w: F.round(w["seconds"] * rate).cast("int")
    cut = lambda w: F.struct(w.alias("w"), F.when((first(w) >= 1) & (first(w) + n(w) - 1 <= F.size("samples")), F.slice("samples", first(w), n(w))).alias("samples"))
    rows = wanted.join(blocks, "block").select("block", F.explode(F.transform("_windows", cut)).alias("x"))
    return rows.select("block", "x.w.*", "x.samples")
