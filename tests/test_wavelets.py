"""Wavelets, ties and filters against numpy on whole traces."""

import numpy as np
import pytest

from terrane.operators import wavelets

RICKER = np.array([(1 - 2 * (np.pi * 0.08 * t) ** 2) * np.exp(-((np.pi * 0.08 * t) ** 2)) for t in range(-20, 21)])


def frame(spark, kind, rows):
    return spark.createDataFrame(rows, kind).repartition(3)


def lists(x):
    return [None if np.isnan(v) else float(v) for v in x]


def test_a_known_wavelet_is_found(spark):
    rng = np.random.default_rng(1)
    spikes = [np.where(rng.random(400) < 0.15, rng.normal(size=400), 0.0) for _ in range(60)]
    seen = [np.convolve(r, RICKER, "same") for r in spikes]
    pairs = frame(spark, "well int, reflectivity array<double>, samples array<double>", [(k, lists(r), lists(s)) for k, (r, s) in enumerate(zip(spikes, seen))])
    w = np.array([r.amplitude for r in wavelets.extract_wavelet(pairs, 50).orderBy("t").collect()])
    assert np.corrcoef(w, np.pad(RICKER, 30))[0, 1] > 0.98
    turned = np.array([r.amplitude for r in wavelets.extract_wavelet(pairs, 50, 180).orderBy("t").collect()])
    assert np.corrcoef(turned, -np.pad(RICKER, 30))[0, 1] > 0.95
    assert np.abs(wavelets.matching_wavelet(pairs, 20, 1e-9) - RICKER).max() < 0.01


def test_correlations(spark):
    rows = [(1, [1.0, 2.0, None, 4.0], [1.0, 1.0]), (2, None, [3.0]), (3, [], []), (4, [5.0], [0.5, -1.0, 2.0])]
    got = wavelets.correlations(frame(spark, "k int, a array<double>, b array<double>", rows), "a", "b", 3)
    assert got.tolist() == [1 + 2 + 2.5, 1 - 5.0, 10.0, 0.0]
    none = frame(spark, "samples array<double>", [(None,)])
    assert [r.amplitude for r in wavelets.extract_wavelet(none, 2).collect()] == [0.0] * 5


def test_tie_finds_planted_shifts(spark):
    rng, rows = np.random.default_rng(2), []
    for k, (shift, stretch) in enumerate([(0, 1.0), (7, 1.0), (-5, 1.1), (3, 0.9)]):
        r = np.where(rng.random(300) < 0.2, rng.normal(size=300), 0.0)
        synthetic = np.convolve(r, RICKER, "same")
        rows.append((k, lists(r), lists(np.interp((np.arange(280) - shift) / stretch, np.arange(300), synthetic, 0, 0) + rng.normal(size=280) * 0.02)))
    rows += [(4, [0.0] * 9, [1.0, 2.0]), (5, None, [1.0]), (6, [1.0], [])]
    got = wavelets.tie(frame(spark, "well int, reflectivity array<double>, samples array<double>", rows), RICKER, 10, [0.9, 1.0, 1.1])
    got = {r.well: (r.shift, r.stretch, r.correlation) for r in got.collect()}
    assert [got[k][:2] for k in range(4)] == [(0, 1.0), (7, 1.0), (-5, 1.1), (3, 0.9)] and min(got[k][2] for k in range(4)) > 0.98
    assert [got[k] for k in (4, 5, 6)] == [(None, None, None)] * 3


def test_filters(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=n).tolist()) for k, n in enumerate([50, 51, 1, 2, 200])] + [(9, None), (10, []), (11, [1.0, None, 2.0])]
    table, want = frame(spark, "trace int, samples array<double>", rows), {k: None if s is None else np.array([v or 0.0 for v in s]) for k, s in rows}
    for r in wavelets.fft_filter(table, [0.05, 0.1, 0.3, 0.4]).collect():
        x = want[r.trace]
        if x is None or not len(x):
            assert r.filtered == (None if x is None else [])
            continue
        f, t = np.abs(np.fft.fftfreq(len(x))), np.arange(len(x))
        weight = np.where(f < 0.05, 0, np.where(f < 0.1, 0.5 - 0.5 * np.cos(np.pi * (f - 0.05) / 0.05), np.where(f <= 0.3, 1, np.where(f < 0.4, 0.5 + 0.5 * np.cos(np.pi * (f - 0.3) / 0.1), 0))))
        waves = np.exp(-2j * np.pi * np.outer(t, t) / len(x))
        assert np.allclose(r.filtered, (waves.conj() @ (weight * (waves @ x)) / len(x)).real, atol=1e-9)
    for r in wavelets.interpolate_spectrum(table, 4).collect():
        if want[r.trace] is not None and len(want[r.trace]):
            assert np.allclose(r.samples[::4], want[r.trace], atol=1e-9) and len(r.samples) == 4 * len(want[r.trace])
    t = np.arange(200)
    wave = frame(spark, "trace int, samples array<double>", [(0, np.cos(2 * np.pi * 5 * t / 200).tolist())])
    assert np.allclose(wavelets.interpolate_spectrum(wave, 3).first().samples, np.cos(2 * np.pi * 5 * np.arange(600) / 600), atol=1e-9)


@pytest.mark.parametrize("high", [False, True])
def test_butterworth(spark, high):
    impulse = np.zeros(4001)
    impulse[2000] = 1.0
    got = wavelets.butterworth(frame(spark, "trace int, samples array<double>", [(1, impulse.tolist())]), 4, 0.1, high).first().filtered
    f = np.fft.rfftfreq(4001)
    warped = np.tan(np.pi * f) / np.tan(np.pi * 0.1)
    with np.errstate(divide="ignore"):
        want = 1 / (1 + (1 / warped if high else warped) ** 8)  # the square of the Butterworth amplitude
    assert np.abs(np.abs(np.fft.rfft(got)) - want).max() < 1e-9 and np.allclose(got, got[::-1], atol=1e-12)
    with pytest.raises(ValueError):
        wavelets.sections(3, 0.1)


@pytest.mark.parametrize(("size", "block"), [(9, 16), (8, 16), (41, 16), (1, 100)])
def test_convolve_blocks(spark, size, block):
    rng = np.random.default_rng(4)
    kernel, traces = rng.normal(size=size), {k: rng.normal(size=n) for k, n in enumerate([1, 15, 16, 17, 130])}
    rows = [(k, z, float(v)) for k, x in traces.items() for z, v in enumerate(x)] + [(7, 0, None), (7, 1, 1.0)]
    got = wavelets.convolve_blocks(frame(spark, "trace int, z_idx int, val double", rows), kernel, block)
    got = {(r.trace, r.z_idx): r.filtered for r in got.collect()}
    assert len(got) == len(rows)
    for k, x in [*traces.items(), (7, np.array([0.0, 1.0]))]:
        assert np.allclose([got[k, z] for z in range(len(x))], np.convolve(x, kernel)[size // 2 : size // 2 + len(x)], atol=1e-9)
