"""Signal features against direct numpy computation on whole epochs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import signal as sg

N = 30


def epochs(seed=3, n=4):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(n):
        x = np.cumsum(rng.normal(size=N)) + rng.normal(size=N)
        ibi = np.repeat(rng.uniform(0.5, 1.2, N // 2), 2)
        ibi[4:6] = 5.0
        for p in range(N):
            rows.append((1, e, p, x[p], ibi[p], rng.uniform(60, 90), rng.uniform(0, 1), *rng.normal(size=3)))
    return pd.DataFrame(rows, columns="subject epoch_idx pos bvp ibi hr eda acc_x acc_y acc_z".split())


@pytest.fixture(scope="module")
def table(spark):
    pdf = epochs()
    df = spark.createDataFrame(pdf)
    fams = [
        sg.statistical(), sg.temporal(), sg.poincare_hjorth(), sg.higuchi(), sg.katz(), sg.sample_entropy(), sg.band_power(),
        sg.beat_intervals(), sg.heart_rate(), sg.motion(), sg.skin_conductance(),
    ]
    return pdf, sg.build(df, fams).toPandas().set_index("epoch_idx")


def each(table):
    pdf, got = table
    for e, g in pdf.groupby("epoch_idx"):
        yield g.sort_values("pos"), got.loc[e]


def test_statistics(table):
    for g, r in each(table):
        x = g["bvp"].to_numpy()
        assert r["MAD"] == pytest.approx(np.mean(np.abs(x - x.mean())))
        assert r["MABD"] == pytest.approx(np.median(np.abs(x - np.median(x))))
        assert r["ACL"] == pytest.approx(np.abs(np.diff(x)).sum())
        assert r["Trimmed_Mean_25"] == pytest.approx(np.sort(x)[7:-7].mean())
        assert r["Kurtosis"] == pytest.approx(np.mean((x - x.mean()) ** 4) / x.var() ** 2 - 3)
        assert r["Skewness"] == pytest.approx(np.mean((x - x.mean()) ** 3) / x.std() ** 3)


def test_hand_values(spark):
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5])], "subject int, epoch_idx int, pos int, bvp double")
    r = sg.build(df, [sg.statistical()]).first()
    assert (r["MAD"], r["IQR"]) == (1.2, 2.0) and r["RMS"] == pytest.approx(3.3166, abs=1e-4)


def higuchi_direct(x, kmax=10):
    n, ys, xs = len(x), [], []
    for k in range(1, kmax + 1):
        lens = []
        for m in range(k):
            part = x[m::k]
            if len(part) > 1:
                steps = len(part) - 1
                lens.append(np.abs(np.diff(part)).sum() * (n - 1) / (steps * k))
        if lens:
            ys.append(math.log(np.mean(lens) + 1e-10))
            xs.append(math.log(1 / k))
        else:
            ys.append(0.0)
            xs.append(0.0)
    return np.polyfit(xs, ys, 1)[0]


def entropy_direct(x):
    r, n = 0.2 * np.std(x, ddof=1), len(x)

    def count(m):
        t = [x[i : i + m] for i in range(n - m)]
        return sum(np.max(np.abs(t[i] - t[j])) < r for i in range(len(t)) for j in range(i + 1, len(t)))

    a, b = count(3), count(2)
    return -math.log(a / b) if a and b else 0.0


def test_nonlinear(table):
    for g, r in each(table):
        x = g["bvp"].to_numpy()
        d = np.diff(x)
        assert r["Poincare_SD1"] == pytest.approx(np.sqrt(np.var(d) / 2))
        assert r["Hjorth_Mobility"] == pytest.approx(np.sqrt(np.var(d) / np.var(x)))
        assert r["Higuchi_FD"] == pytest.approx(higuchi_direct(x))
        assert r["SampEn"] == pytest.approx(entropy_direct(x))
        reach, length = np.abs(x - x[0]).max(), np.abs(d).sum()
        assert r["Katz_FD"] == pytest.approx(math.log10(29) / (math.log10(reach / length) + math.log10(29)))


@pytest.mark.parametrize("n", [3, 6, 11])
def test_higuchi_short_series(spark, n):
    x = np.cumsum(np.random.default_rng(n).normal(size=n))
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(x)], "subject int, epoch_idx int, pos int, bvp double")
    assert sg.build(df, [sg.higuchi()]).first()["Higuchi_FD"] == pytest.approx(higuchi_direct(x))


def test_entropy_is_exact_unless_thinning_is_asked_for(spark):
    x = np.sin(np.arange(1200) / 7.0) + np.random.default_rng(0).normal(size=1200) / 5
    df = spark.createDataFrame([(x.tolist(), [1.0, 2.0], [3.0] * 20)], "a array<double>, b array<double>, c array<double>")
    thinned = sg.entropy_of(F.col("a"), most=500).alias("thinned")
    r = df.select(thinned, *[sg.entropy_of(F.col(c)).alias(c) for c in "abc"]).first()
    assert r["thinned"] == pytest.approx(entropy_direct(x[np.linspace(0, 1199, 500, dtype=int)]))
    assert r["a"] == pytest.approx(entropy_direct(x))
    assert (r["b"], r["c"]) == (0.0, 0.0)


def welch(x, fs, nperseg):
    step = nperseg - nperseg // 2
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    specs = []
    for s in range(0, len(x) - nperseg + 1, step):
        seg = x[s : s + nperseg]
        p = np.abs(np.fft.rfft((seg - seg.mean()) * win)) ** 2 / (fs * (win**2).sum())
        p[1:-1] *= 2
        specs.append(p)
    return np.arange(nperseg // 2 + 1) * fs / nperseg, np.mean(specs, axis=0)


def band(f, p, lo, hi):
    m = (f >= lo) & (f < hi)
    return float(np.trapezoid(p[m], f[m])) if m.any() else 0.0


def test_band_power(table):
    for g, r in each(table):
        f, p = welch(g["bvp"].to_numpy(), 1.0, N)
        assert r["BVP_LF_Power"] == pytest.approx(band(f, p, 0.04, 0.15))
        assert r["BVP_HF_Power"] == pytest.approx(band(f, p, 0.15, 0.4))
        assert r["BVP_VLF_Power"] == 0.0


def kept_beats(ibi):
    keep = np.concatenate([[True], ibi[1:] != ibi[:-1]])
    b = ibi[keep]
    return b[(b > 0.05) & (b < 3.0)]


def test_beat_intervals(table):
    for g, r in each(table):
        b = kept_beats(g["ibi"].to_numpy())
        d = np.diff(b)
        assert r["Mean_IBI"] == pytest.approx(b.mean())
        assert r["SDNN_IBI"] == pytest.approx(b.std(ddof=1))
        assert r["RMSSD_IBI"] == pytest.approx(np.sqrt(np.mean(d**2)))
        assert r["pNN50_IBI"] == pytest.approx(np.mean(np.abs(d) > 0.05))


def test_interval_spectrum(spark):
    pdf = epochs(5)
    got = sg.interval_spectrum(spark.createDataFrame(pdf)).toPandas().set_index("epoch_idx")
    for e, g in pdf.groupby("epoch_idx"):
        b = kept_beats(g.sort_values("pos")["ibi"].to_numpy())
        t = np.cumsum(b) - b[0]
        grid = np.arange(0, t[-1], 0.25)
        f, p = welch(np.interp(grid, t, b), 4.0, min(len(grid), 64))
        assert got.loc[e, "IBI_LF"] == pytest.approx(band(f, p, 0.04, 0.15), abs=1e-12)
        assert got.loc[e, "IBI_HF"] == pytest.approx(band(f, p, 0.15, 0.4), abs=1e-12)


def test_motion_and_skin(table):
    for g, r in each(table):
        mag = np.sqrt((g[["acc_x", "acc_y", "acc_z"]] ** 2).sum(axis=1)).to_numpy()
        d = np.abs(np.diff(mag))
        assert r["ACC_Movement_Count"] == (d > max(1e-6, 0.5 * (np.median(d) + 1e-9))).sum()
        assert r["Range_EDA"] == pytest.approx(g["eda"].max() - g["eda"].min())


def test_smoothing_matches_polynomial_fits(spark):
    x = np.random.default_rng(2).normal(size=N)
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(x)], "subject int, epoch_idx int, pos int, dt double")
    near, value = sg.savgol("dt", N)
    got = [r["y"] for r in df.withColumns(near).select("pos", value.alias("y")).orderBy("pos").collect()]
    for p in range(N):
        s = min(max(p - 7, 0), N - 15)
        c = np.polyfit(np.arange(s, s + 15), x[s : s + 15], 3)
        assert got[p] == pytest.approx(np.polyval(c, p), abs=1e-8)


def test_flat_epoch_z_score_is_zero(spark):
    df = spark.createDataFrame([(1, 0, i, 4.0) for i in range(N)], "subject int, epoch_idx int, pos int, bvp double")
    got = df.withColumn("z", sg.z_scored(F.col("bvp"))).agg(F.max("z"), F.min("z")).first()
    assert tuple(got) == (0.0, 0.0)


def test_pulse_morphology_of_known_pulses(spark):
    x = [0, 1, 0, 3, 1, 2, -1, 4, 0, 5, -2, 1, 0.5] + [0.4 - 0.01 * i for i in range(17)]
    df = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(x)], "subject int, epoch_idx int, pos int, bvp double")
    r = sg.morphology_features(df).first()
    # peaks at 1,3,5,7,9,11; troughs at 2,4,6,8,10; only 3,5,7,9 lie between troughs
    assert r["Morph_ValidPulses"] == 4
    assert r["Morph_SysAmp_Mean"] == pytest.approx((3 + 2 + 4 + 5) / 4)
    assert r["Morph_RiseTime_Mean"] == 1.0 and r["Morph_PulseWidth_Std"] == 0.0


def test_prominence(spark):
    df = spark.createDataFrame([([0.0, 3.0, 1.0, 2.0, 0.5, 5.0, 0.0],)], "xs array<double>")
    xs = F.col("xs")
    r = df.select(*[sg.prominence(xs, F.lit(i)).alias(f"p{i}") for i in (1, 3, 5)], sg.peak_positions(xs, 1, F.lit(2.0)).alias("big")).first()
    assert (r["p1"], r["p3"], r["p5"]) == (2.5, 1.0, 5.0) and r["big"] == [1, 5]
