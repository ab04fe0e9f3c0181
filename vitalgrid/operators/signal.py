"""Signal features of an epoch as window columns plus one grouped aggregate.

Every family lists window columns by level, aggregates and a final projection. Families that are
built together share one shuffle on (subject, epoch) and one sort, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.operators.epochs import EPOCH_KEYS


def by_pos():
    return Window.partitionBy(*EPOCH_KEYS).orderBy("pos")


def whole_epoch():
    return Window.partitionBy(*EPOCH_KEYS)


def before():
    return by_pos().rowsBetween(Window.unboundedPreceding, -1)



@dataclass
class Family:
    names: list[str]
    levels: list[dict[str, Column]] = field(default_factory=list)
    aggs: dict[str, Column] = field(default_factory=dict)
    finish: dict[str, Column] = field(default_factory=dict)


def build(epochs: DataFrame, families: Sequence[Family], keep: Sequence[str] = ()) -> DataFrame:
    """One row per epoch with the features of all families."""
    df = epochs
    for level in range(max((len(f.levels) for f in families), default=0)):
        cols = {}
        for f in families:
            if level < len(f.levels):
                cols |= f.levels[level]
        df = df.withColumns(cols)
    aggs = {}
    for f in families:
        aggs |= f.aggs
    out = df.groupBy(*EPOCH_KEYS).agg(
        *[F.first(c).alias(c) for c in keep], *[a.alias(n) for n, a in aggs.items()]
    )
    last = {}
    for f in families:
        last |= f.finish
    return out.select(
        *EPOCH_KEYS, *keep, *[last.get(n, F.col(n)).alias(n) for f in families for n in f.names]
    )


def ratio(a, b, default=0.0):
    return F.coalesce(F.when(b != 0, a / b), F.lit(default))


def statistical(x: str = "bvp") -> Family:
    v = F.col(x)
    names = (
        "MAD MABD IQR 3rd_NCM ACL Shape_Factor Mean Std_Dev RMS Trimmed_Mean_25 Trimmed_Mean_50 Geometric_Mean "
        "Max_Val Min_Val Skewness Kurtosis"
    ).split()
    rank = F.row_number().over(Window.partitionBy(*EPOCH_KEYS).orderBy(x, "pos"))
    cut = F.floor(F.col("__n") * 0.25)
    mean, rms = F.avg(v), F.sqrt(F.avg(v * v))
    return Family(
        names,
        [
            {
                "__m": F.avg(v).over(whole_epoch()),
                "__med": F.percentile(v, 0.5).over(whole_epoch()),
                "__n": F.count(v).over(whole_epoch()),
                "__rk": rank,
                "__d1": v - F.lag(v).over(by_pos()),
            }
        ],
        {
            "MAD": F.avg(F.abs(v - F.col("__m"))),
            "MABD": F.percentile(F.abs(v - F.col("__med")), 0.5),
            "IQR": F.percentile(v, 0.75) - F.percentile(v, 0.25),
            "3rd_NCM": F.avg(F.pow(v - F.col("__m"), F.lit(3.0))),
            "ACL": F.sum(F.abs("__d1")),
            "Shape_Factor": ratio(rms, mean),
            "Mean": mean,
            "Std_Dev": F.stddev_pop(v),
            "RMS": rms,
            "Trimmed_Mean_25": F.avg(F.when((F.col("__rk") > cut) & (F.col("__rk") <= F.col("__n") - cut), v)),
            "Trimmed_Mean_50": F.percentile(v, 0.5),
            "Geometric_Mean": F.exp(F.avg(F.log(F.least(F.greatest(F.abs(v) + 1e-10, F.lit(1e-10)), F.lit(1e10))))),
            "Max_Val": F.max(v),
            "Min_Val": F.min(v),
            "Skewness": F.skewness(v),
            "Kurtosis": F.kurtosis(v),
        },
    )


def peak_flag(x: Column, distance: int) -> Column:
    """Strict local maximum that is also the maximum of its +-distance neighbourhood."""
    near = by_pos().rowsBetween(-distance, distance)
    return (x > F.lag(x).over(by_pos())) & (x > F.lead(x).over(by_pos())) & (x >= F.max(x).over(near))


def min_distance(rate: float) -> int:
    return int(rate * 0.4) if rate * 0.4 > 1 else 1


def temporal(x: str = "bvp", rate: int = 1) -> Family:
    v = F.col(x)
    d = min_distance(rate)
    pos = F.col("pos")
    flat = F.stddev_pop(v) < 1e-6
    n_peaks = F.count(F.when(F.col("__pk"), 1))
    peak_pos = F.when(F.col("__pk"), pos)
    zero = lambda c: F.when(flat, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return Family(
        ["ZCR", "Peak_Count", "IPI", "Rise_Time"],
        [
            {
                "__pk": peak_flag(v, d),
                "__tr": peak_flag(-v, d),
                "__zc": F.signum(v) != F.signum(F.lag(v).over(by_pos())),
            },
            {"__onset": F.last(F.when(F.col("__tr"), pos), True).over(before())},
        ],
        {
            "ZCR": zero(F.count(F.when(F.col("__zc"), 1)) / F.count(F.lit(1))),
            "Peak_Count": zero(n_peaks / (F.count(F.lit(1)) / F.lit(float(rate)))),
            "IPI": zero(F.when(n_peaks > 1, (F.max(peak_pos) - F.min(peak_pos)) / (n_peaks - 1) / rate)),
            "Rise_Time": zero(F.avg(F.when(F.col("__pk"), pos - F.col("__onset"))) / rate),
        },
    )


def poincare_hjorth(x: str = "bvp") -> Family:
    v = F.col(x)
    zero, first, second = F.var_pop(v), F.var_pop("__nd"), F.var_pop("__nd2")
    sd1, sd2 = F.sqrt(F.var_pop(v - F.col("__nx")) / 2), F.sqrt(F.var_pop(v + F.col("__nx")) / 2)
    mob = F.when(zero != 0, F.sqrt(first / zero)).otherwise(0.0)
    return Family(
        ["Poincare_SD1", "Poincare_SD2", "SD1_to_SD2_Ratio", "Hjorth_Mobility", "Hjorth_Complexity"],
        [
            {"__nx": F.lead(v).over(by_pos()), "__nd": F.lead(v).over(by_pos()) - v},
            {"__nd2": F.lead("__nd").over(by_pos()) - F.col("__nd")},
        ],
        {
            "Poincare_SD1": sd1,
            "Poincare_SD2": sd2,
            "SD1_to_SD2_Ratio": ratio(sd1, sd2),
            "Hjorth_Mobility": mob,
            "Hjorth_Complexity": F.when(mob != 0, F.sqrt(second / first) / mob).otherwise(0.0),
        },
    )


def _higuchi_block(x: np.ndarray, kmax: int) -> np.ndarray:
    """Higuchi dimension of equally long rows; missing values take part in no step."""
    n, total = x.shape[1], np.count_nonzero(~np.isnan(x), axis=1)
    xs, ys = np.zeros((len(x), kmax)), np.zeros((len(x), kmax))
    pos = np.arange(n)
    for k in range(1, kmax + 1):
        used = np.minimum(k, total - k)
        ok = used > 0
        xs[ok, k - 1] = math.log(1.0 / k)
        if k >= n or not ok.any():
            continue
        # the per-offset normalisation is a weight of the step
        steps = np.floor((total[:, None] - 1 - pos[: n - k] % k) / k)
        weight = np.divide((total - 1)[:, None], steps * k, out=np.zeros_like(steps), where=steps > 0)
        length = np.nansum(np.abs(x[:, k:] - x[:, : n - k]) * weight, axis=1)
        ys[ok, k - 1] = np.log(length[ok] / used[ok] + 1e-10)
    sx, sy = xs.sum(axis=1), ys.sum(axis=1)
    den = kmax * (xs * xs).sum(axis=1) - sx * sx
    ok = (total > 1) & (den != 0)
    return np.divide(kmax * (xs * ys).sum(axis=1) - sx * sy, den, out=np.zeros(len(x)), where=ok)


def _by_length(block, **kw):
    """A pandas function of an array column: ``block`` works on all arrays of one length together."""

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        sizes = np.array([0 if a is None else len(a) for a in batch], dtype=np.int64)
        out = np.zeros(len(batch))
        for n in np.unique(sizes[sizes > 0]):
            where = np.flatnonzero(sizes == n)
            out[where] = block(np.stack([np.asarray(batch.iloc[i], dtype=float) for i in where]), **kw)
        return pd.Series(out)

    return run


def higuchi(x: str = "bvp", kmax: int = 10, prefix: str = "Higuchi_FD") -> Family:
    """Higuchi dimension: slope of log mean curve length on log(1/k), over the epoch's own array.

    Unfilled k keep the point (0, 0).
    """
    return Family([prefix], [], {"__hx": _ordered(x)}, {prefix: higuchi_of(F.col("__hx"), kmax)})


def higuchi_of(xs: Column, kmax: int = 10) -> Column:
    return _by_length(_higuchi_block, kmax=kmax)(xs)


def katz(x: str = "bvp") -> Family:
    v = F.col(x)
    length, reach, n = F.sum(F.abs("__kd")), F.max(F.abs(v - F.col("__k0"))), F.count(v) - 1
    fd = F.log10(n) / (F.log10(reach / length) + F.log10(n))
    return Family(
        ["Katz_FD"],
        [{"__kd": v - F.lag(v).over(by_pos()), "__k0": F.first(v).over(by_pos())}],
        {"Katz_FD": F.when((n >= 1) & (length != 0) & (reach != 0), fd).otherwise(0.0)},
    )


def _ordered(x: str) -> Column:
    """Samples of the epoch in order; bounded by the epoch's sample count."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(x).alias("v")))), lambda s: s["v"])


def _entropy_block(x, factor: float):
    """Sample entropy (m = 2) of equally long rows, by comparing each row with its own shifts."""
    rows, n = x.shape
    if n < 4:
        return np.zeros(rows)
    r = factor * x.std(axis=1, ddof=1)
    out = np.zeros(rows)
    step = max(1, 2_000_000 // (n * n))
    for lo in range(0, rows, step):
        part, lim = x[lo : lo + step], r[lo : lo + step]
        near = np.abs(part[:, :, None] - part[:, None, :]) < lim[:, None, None]
        two = near[:, :-1, :-1] & near[:, 1:, 1:]
        three = two[:, :-1, :-1] & near[:, 2:, 2:]
        # templates stop one short of the last possible start; i < j counts each pair once
        b = np.triu(np.ones((n - 2, n - 2), bool), 1)
        hits2 = (two[:, : n - 2, : n - 2] & b).sum(axis=(1, 2))
        hits3 = (three[:, : n - 3, : n - 3] & b[: n - 3, : n - 3]).sum(axis=(1, 2))
        ok = (hits2 > 0) & (hits3 > 0) & (lim >= 1e-12)
        out[lo : lo + step][ok] = -np.log(hits3[ok] / hits2[ok])
    return out


def entropy_of(xs: Column, factor: float = 0.2, most: int | None = None) -> Column:
    """Sample entropy of an array column, computed in Arrow batches; longer arrays than ``most`` are thinned evenly."""

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        arrays = []
        for a in batch:
            a = np.asarray(a if a is not None else [], dtype=float)
            arrays.append(a[np.linspace(0, len(a) - 1, most, dtype=int)] if most and len(a) > most else a)
        sizes = np.array([len(a) for a in arrays])
        out = np.zeros(len(arrays))
        for n in np.unique(sizes):
            where = np.flatnonzero(sizes == n)
            out[where] = _entropy_block(np.stack([arrays[i] for i in where]), factor)
        return pd.Series(out)

    return run(xs)


def sample_entropy(x: str = "bvp", factor: float = 0.2, name: str = "SampEn") -> Family:
    """Sample entropy counted inside the epoch's own array; no pair rows are produced."""
    return Family([name], [], {"__sx": _ordered(x)}, {name: entropy_of(F.col("__sx"), factor)})


def _hann(pos: Column, n) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * pos / n)


def band_power(x: str = "bvp", rate: int = 1, seconds: int = 30) -> Family:
    """Band power of one Hann segment as sums over the epoch, trapezoid over the band's bins."""
    v, pos, n = F.col(x), F.col("pos"), seconds * rate
    df = 1.0 / seconds
    # Band edges in Hz.
    bands = {"VLF": (0.003, 0.04), "LF": (0.04, 0.15), "HF": (0.15, 0.4)}
    bins = {b: [i for i in range(1, n // 2) if lo <= i * df < hi] for b, (lo, hi) in bands.items()}
    wx = _hann(pos, n) * (v - F.col("__fm"))
    aggs = {"__fstd": F.stddev_pop(v), "__fw": F.sum(F.pow(_hann(pos, n), F.lit(2.0)))}
    for i in sorted({i for b in bins.values() for i in b}):
        aggs[f"__re{i}"] = F.sum(wx * F.cos(2 * math.pi * i * pos / n))
        aggs[f"__im{i}"] = F.sum(wx * F.sin(2 * math.pi * i * pos / n))
    psd = lambda i: 2.0 * (F.col(f"__re{i}") ** 2 + F.col(f"__im{i}") ** 2) / (rate * F.col("__fw"))

    def power(b):
        ids = bins[b]
        out = F.lit(0.0)
        for i, j in zip(ids, ids[1:]):
            out = out + (psd(i) + psd(j)) / 2.0 * df
        return F.when(F.col("__fstd") < 1e-6, 0.0).otherwise(out)

    names = ["BVP_VLF_Power", "BVP_LF_Power", "BVP_HF_Power", "BVP_LF_HF_Ratio"]
    finish = dict(zip(names, [power("VLF"), power("LF"), power("HF")]))
    finish[names[3]] = F.when(power("HF") > 0, power("LF") / power("HF")).otherwise(0.0)
    return Family(names, [{"__fm": F.avg(v).over(whole_epoch())}], aggs, finish)


def plausible(x: Column) -> Column:
    # Limits of a plausible inter-beat interval in seconds.
    return ~F.isnan(x) & (x > 0.05) & (x < 3.0)


def changed(x: Column) -> Column:
    """True where a held value changes; the first sample counts."""
    return ~x.eqNullSafe(F.lag(x).over(by_pos())) | (F.col("pos") == 0)


def beat_intervals(x: str = "ibi") -> Family:
    v = F.col(x)
    kept = F.col("__ib")
    d = kept - F.col("__ibp")
    n, mean = F.count(kept), F.avg(kept)
    rmssd = F.sqrt(F.avg(d * d))
    ok = lambda c: F.when(n < 2, 0.0).otherwise(c)
    return Family(
        ["Mean_IBI", "SDNN_IBI", "RMSSD_IBI", "pNN50_IBI", "CVSD_IBI", "Mean_HR_from_IBI"],
        [
            {"__ib": F.when(changed(v) & plausible(v), v)},
            {"__ibp": F.last("__ib", True).over(before())},
        ],
        {
            "Mean_IBI": ok(mean),
            "SDNN_IBI": ok(F.stddev_samp(kept)),
            "RMSSD_IBI": ok(rmssd),
            "pNN50_IBI": ok(F.avg(F.when(d.isNotNull(), F.when(F.abs(d) > 0.05, 1.0).otherwise(0.0)))),
            "CVSD_IBI": ok(rmssd / mean),
            "Mean_HR_from_IBI": ok(60.0 / mean),
        },
    )


def heart_rate(x: str = "hr") -> Family:
    v = F.col(x)
    return Family(
        ["Mean_HR", "Std_HR", "Range_HR", "HR_Trend"],
        [],
        {
            "Mean_HR": F.coalesce(F.avg(v), F.lit(0.0)),
            "Std_HR": F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0),
            "Range_HR": F.coalesce(F.max(v) - F.min(v), F.lit(0.0)),
            "HR_Trend": F.when(F.count(v) > 1, F.regr_slope(v, F.col("pos"))).otherwise(0.0),
        },
    )


def motion(x: str = "acc_x", y: str = "acc_y", z: str = "acc_z") -> Family:
    a, b, c = F.col(x), F.col(y), F.col(z)
    mag = F.sqrt(a * a + b * b + c * c)
    thr = F.greatest(F.lit(1e-6), 0.5 * (F.percentile("__dmag", 0.5).over(whole_epoch()) + 1e-9))
    sd = lambda v: F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0)
    return Family(
        ["ACC_Mag_Mean", "ACC_Mag_Std", "ACC_X_Std", "ACC_Y_Std", "ACC_Z_Std", "ACC_Movement_Count", "ACC_SMA"],
        [
            {"__mag": mag},
            {"__dmag": F.abs(F.col("__mag") - F.lag("__mag").over(by_pos()))},
            {"__moved": F.col("__dmag") > thr},
        ],
        {
            "ACC_Mag_Mean": F.avg("__mag"),
            "ACC_Mag_Std": sd(F.col("__mag")),
            "ACC_X_Std": sd(a),
            "ACC_Y_Std": sd(b),
            "ACC_Z_Std": sd(c),
            "ACC_Movement_Count": F.count_if(F.col("__moved")).cast("double"),
            "ACC_SMA": F.avg(F.abs(a) + F.abs(b) + F.abs(c)),
        },
    )


def prominence(xs: Column, i: Column) -> Column:
    """Height of peak i over the higher of its two bases, each base ending at the next higher sample."""
    h = F.get(xs, i)
    low = lambda acc, v: F.when(v > h, h).otherwise(F.least(acc, v))
    left = F.aggregate(F.slice(xs, F.lit(1), i), h, low)
    right = F.aggregate(F.reverse(F.slice(xs, i + 2, F.size(xs))), h, low)
    return h - F.greatest(left, right)


def peak_positions(
    xs: Column, distance: int, limit: Column | None = None, floor: Column | None = None, troughs: bool = False
) -> Column:
    """0-based positions of peaks (or troughs) in an epoch array, optionally with a least prominence and height."""
    n = F.size(xs)

    def above(a, b):
        return a < b if troughs else a > b

    def ok(i):
        v = F.get(xs, i)
        cond = above(v, F.get(xs, i - 1)) & above(v, F.get(xs, i + 1))
        if distance > 1:
            start = F.greatest(i - distance, F.lit(0))
            near = F.slice(xs, start + 1, i + distance - start + 1)
            cond = cond & (v == (F.array_min(near) if troughs else F.array_max(near)))
        if floor is not None:
            cond = cond & (v > floor)
        if limit is not None:
            cond = cond & (prominence(xs, i) >= limit)
        return cond

    return F.when(n < 3, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), ok)
    )


def skin_conductance(x: str = "eda", samples: int = 30) -> Family:
    v = F.col(x)
    limit = F.greatest(F.lit(1e-6), 0.05 * (F.col("__e90") - F.col("__e10") + 1e-9))
    found = peak_positions(F.col("__ex"), max(1, samples // 200), limit, F.col("__e50"))
    return Family(
        ["Mean_EDA", "Std_EDA", "Range_EDA", "EDA_SCR_Peaks"],
        [],
        {
            "Mean_EDA": F.avg(v),
            "Std_EDA": F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0),
            "Range_EDA": F.max(v) - F.min(v),
            "__ex": _ordered(x),
            "__e90": F.percentile(v, 0.9),
            "__e50": F.percentile(v, 0.5),
            "__e10": F.percentile(v, 0.1),
        },
        {"EDA_SCR_Peaks": F.when(F.size("__ex") < 5, 0.0).otherwise(F.size(found).cast("double"))},
    )


MORPHOLOGY = [
    f"Morph_{p}_{s}"
    for p in ("SysAmp", "DiaAmp", "PulseAmp", "RiseTime", "FallTime", "PulseWidth")
    for s in ("Mean", "Std")
] + ["Morph_APG_AB_Ratio", "Morph_ValidPulses"]


def _mean_std(values: Column) -> tuple[Column, Column]:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return F.when(n > 0, mean).otherwise(0.0), F.when(n > 0, F.sqrt(var)).otherwise(0.0)


def morphology_inputs(x: str = "bvp") -> dict[str, Column]:
    v = F.col(x)
    return {
        "__mx": _ordered(x),
        "__m95": F.percentile(v, 0.95),
        "__m05": F.percentile(v, 0.05),
        "__msd": F.stddev_pop(v),
    }


def finish_morphology(df: DataFrame, rate: int = 1) -> DataFrame:
    """Pulse amplitudes and timings between the troughs around each prominent peak.

    Each intermediate array is its own column, so it is computed once per epoch.
    """
    d = max(1, int(rate * 0.4))
    xs, span, sec = F.col("__mx"), F.col("__m95") - F.col("__m05"), F.col("__ms")
    second = F.when(
        F.size(xs) > 2,
        F.transform(F.sequence(F.lit(0), F.size(xs) - 3), lambda i: F.get(xs, i + 2) - 2 * F.get(xs, i + 1) + F.get(xs, i)),
    ).otherwise(F.array().cast("array<double>"))
    df = df.withColumns({"__mp": peak_positions(xs, d, 0.1 * span), "__mt": peak_positions(xs, d, troughs=True), "__ms": second})
    df = df.withColumns({"__mu": peak_positions(sec, d), "__md": peak_positions(sec, d, troughs=True)})
    usable = (
        (F.size(xs) >= int(rate))
        & (F.col("__msd") >= 1e-6)
        & (span >= 1e-8)
        & (F.size("__mp") >= 2)
        & (F.size("__mt") >= 1)
    )

    def pulse(p):
        return F.struct(
            p.alias("p"),
            F.array_max(F.filter("__mt", lambda t: t < p)).alias("on"),
            F.array_min(F.filter("__mt", lambda t: t > p)).alias("off"),
        )

    found = F.filter(F.transform("__mp", pulse), lambda s: s["on"].isNotNull() & s["off"].isNotNull())
    df = df.withColumn("__mv", F.when(usable, found))
    s, per = F.col("__mv"), float(rate)
    series = [
        F.transform(s, lambda p: F.get(xs, p["p"])),
        F.transform(s, lambda p: F.get(xs, p["on"])),
        F.transform(s, lambda p: F.get(xs, p["p"]) - F.get(xs, p["on"])),
        F.transform(s, lambda p: (p["p"] - p["on"]) / per),
        F.transform(s, lambda p: (p["off"] - p["p"]) / per),
        F.transform(s, lambda p: (p["off"] - p["on"]) / per),
    ]
    df = df.withColumns({f"__y{i}": a for i, a in enumerate(series)})
    out = {}
    for i in range(len(series)):
        m, sd = _mean_std(F.col(f"__y{i}"))
        out[MORPHOLOGY[2 * i]] = F.coalesce(F.when(s.isNotNull(), m), F.lit(0.0))
        out[MORPHOLOGY[2 * i + 1]] = F.coalesce(F.when(s.isNotNull(), sd), F.lit(0.0))

    def mean_abs(pos):
        return F.aggregate(pos, F.lit(0.0), lambda acc, i: acc + F.abs(F.get(sec, i))) / F.size(pos)

    a, b = mean_abs(F.col("__mu")), mean_abs(F.col("__md"))
    ratio_ok = (
        s.isNotNull() & (F.size(sec) > int(rate * 0.5)) & (F.size("__mu") > 0) & (F.size("__md") > 0) & (a > 1e-12)
    )
    out["Morph_APG_AB_Ratio"] = F.when(ratio_ok, b / a).otherwise(0.0)
    out["Morph_ValidPulses"] = F.when(s.isNotNull(), F.size(s).cast("double")).otherwise(0.0)
    drop = ["__mx", "__m95", "__m05", "__msd", "__ms", "__mp", "__mt", "__mu", "__md", "__mv"]
    return df.withColumns(out).drop(*drop, *[f"__y{i}" for i in range(len(series))])


def morphology_features(epochs: DataFrame, x: str = "bvp", rate: int = 1) -> DataFrame:
    aggs = [a.alias(n) for n, a in morphology_inputs(x).items()]
    return finish_morphology(epochs.groupBy(*EPOCH_KEYS).agg(*aggs), rate).select(*EPOCH_KEYS, *MORPHOLOGY)


IBI_SPECTRUM = ["IBI_VLF", "IBI_LF", "IBI_HF", "IBI_LF_HF", "IBI_nHF", "IBI_TP"]


def resampled_beats(epochs: DataFrame, x: str = "ibi", rate: float = 4.0, usable=None) -> DataFrame:
    """Beat intervals of each epoch on a uniform grid: kept beats, beat times, linear interpolation.

    Each beat expands to the grid points before the next beat, so no join is needed.
    """
    v = F.col(x)
    beats = (
        epochs.withColumn("__ok", changed(v) & plausible(v) if usable is None else usable(v))
        .where("__ok")
        .withColumn("__t", F.sum(v).over(by_pos().rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns({"__t": F.col("__t") - F.first("__t").over(by_pos()), "__n": F.count(F.lit(1)).over(whole_epoch())})
        .withColumns({"__t2": F.lead("__t").over(by_pos()), "__v2": F.lead(v).over(by_pos())})
        .where(F.col("__t2").isNotNull())
    )
    first = F.ceil(F.col("__t") * rate).cast("bigint")
    last = (F.ceil(F.col("__t2") * rate) - 1).cast("bigint")
    t = F.col("g") / F.lit(rate)
    return (
        beats.where(last >= first)
        .select(*EPOCH_KEYS, "__n", "__t", "__t2", v.alias("__v"), "__v2", F.explode(F.sequence(first, last)).alias("g"))
        .select(
            *EPOCH_KEYS,
            F.col("__n").alias("n_beats"),
            "g",
            (F.col("__v") + (F.col("__v2") - F.col("__v")) * (t - F.col("__t")) / (F.col("__t2") - F.col("__t"))).alias("v"),
        )
    )


def _resampled(x: np.ndarray, sizes: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Beat intervals (a row each, filled up with zeros) on a uniform grid: all rows' values, and how many a row has."""
    t = np.cumsum(x, axis=1) - x[:, :1]
    edge = np.ceil(t * rate).astype(np.int64)
    pair = np.arange(x.shape[1] - 1) < (sizes - 1)[:, None]
    counts = np.where(pair, np.diff(edge, axis=1), 0)
    of = np.repeat(np.arange(counts.size), counts.ravel())
    row, i = np.divmod(of, counts.shape[1])
    points = counts.sum(axis=1)
    g = np.arange(len(of)) - np.repeat(np.cumsum(points) - points, points)
    v, gap = x[row, i], t[row, i + 1] - t[row, i]
    return v + (x[row, i + 1] - v) * (g / rate - t[row, i]) / gap, points


def _welch_bands(x: np.ndarray, rate: float, bands: Sequence[tuple[float, float]]) -> np.ndarray:
    """Power per band of equally long rows: half-overlapping Hann segments of at most 64 points, bins 1 to 6."""
    n = x.shape[1]
    size = min(n, 64)
    step = size - size // 2
    p = np.arange(size)
    win = 0.5 - 0.5 * np.cos(2 * math.pi * p / size)
    arg = 2 * math.pi * p[:, None] * np.arange(1, 7) / size
    psd = np.zeros((len(x), 6))
    starts = range(0, n - size + 1, step)
    for at in starts:
        part = x[:, at : at + size]
        part = (part - part.mean(axis=1, keepdims=True)) * win
        psd += 2.0 * ((part @ np.cos(arg)) ** 2 + (part @ np.sin(arg)) ** 2) / (rate * (win * win).sum())
    psd /= len(starts)
    f = np.arange(1, 7) * rate / size
    out = np.zeros((len(x), len(bands)))
    for j, (lo, hi) in enumerate(bands):
        for b in range(5):
            if f[b] >= lo and f[b + 1] < hi:
                out[:, j] += (psd[:, b] + psd[:, b + 1]) / 2.0 * rate / size
    return out


def bands_of(xs: Column, rate: float = 4.0) -> Column:
    """Welch band powers of arrays of beat intervals, in Arrow batches; null below 5 beats or 16 grid points."""
    # Band edges in Hz.
    bands = [(0.003, 0.04), (0.04, 0.15), (0.15, 0.4)]

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        sizes = np.array([0 if a is None else len(a) for a in batch], dtype=np.int64)
        out = np.full(len(batch), None, dtype=object)
        enough = np.flatnonzero(sizes >= 5)
        if len(enough):
            x = np.zeros((len(enough), sizes.max()))
            x[np.arange(sizes.max()) < sizes[enough][:, None]] = np.concatenate([batch.iloc[i] for i in enough])
            values, points = _resampled(x, sizes[enough], rate)
            starts = np.cumsum(points) - points
            for n in np.unique(points[points >= 16]):
                where = np.flatnonzero(points == n)
                for i, row in zip(enough[where], _welch_bands(values[starts[where][:, None] + np.arange(n)], rate, bands), strict=True):
                    out[i] = row
        return pd.Series(out)

    return run(xs)


def spectrum_columns(powers: Column) -> dict[str, Column]:
    """The columns of ``IBI_SPECTRUM`` from an array of band powers."""
    v, l, h = (F.get(powers, F.lit(i)) for i in range(3))  # noqa: E741
    tp = v + l + h
    ratios = [F.when(h > 1e-12, l / h).otherwise(0.0), F.when(tp > 1e-12, h / tp).otherwise(0.0)]
    return dict(zip(IBI_SPECTRUM, [v, l, h, *ratios, tp]))


def interval_spectrum(epochs: DataFrame, x: str = "ibi", rate: float = 4.0, usable=None) -> DataFrame:
    """Welch band powers of the resampled intervals; epochs with too few beats are absent.

    An epoch's beats are one bounded array; grid points and segments are never rows.
    """
    v = F.col(x)
    beats = epochs.withColumn("__ok", changed(v) & plausible(v) if usable is None else usable(v)).where("__ok")
    arrays = beats.groupBy(*EPOCH_KEYS).agg(_ordered(x).alias("__beats")).where(F.size("__beats") >= 5)
    powers = arrays.select(*EPOCH_KEYS, bands_of(F.col("__beats"), rate).alias("__p")).where(F.col("__p").isNotNull())
    return powers.select(*EPOCH_KEYS, *[c.alias(n) for n, c in spectrum_columns(F.col("__p")).items()])


# ------------------------------------------------------------ preprocessing


def detrended(x: Column) -> Column:
    slope, icept = F.regr_slope(x, F.col("pos")).over(whole_epoch()), F.regr_intercept(x, F.col("pos")).over(whole_epoch())
    return x - (icept + slope * F.col("pos"))


def z_scored(x: Column, centre_if_flat: bool = True) -> Column:
    mean, sd = F.avg(x).over(whole_epoch()), F.stddev_pop(x).over(whole_epoch())
    return F.when(sd != 0, (x - mean) / sd).otherwise(x - mean if centre_if_flat else F.lit(0.0))


def savgol_weights(taps: int = 15, order: int = 3) -> list[list[float]]:
    """Least-squares polynomial smoothing weights; row r evaluates the fit at position r of the window."""
    half = taps // 2
    a = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    return (a @ np.linalg.pinv(a)).tolist()


def savgol(x: str, n: int, taps: int = 15, order: int = 3) -> tuple[dict[str, Column], Column]:
    """Neighbour columns and the smoothed value: fixed weights inside, edge fits at both ends."""
    half = taps // 2
    h = savgol_weights(taps, order)
    pos = F.col("pos")
    # window start: clipped so that edge samples read the end windows
    offs = range(-(taps - 1), taps)
    near = {f"__s{o + taps}": (F.lag(x, -o).over(by_pos()) if o < 0 else F.lead(x, o).over(by_pos())) if o else F.col(x) for o in offs}

    def fit(row):
        # sample at window position `row` sees window offsets -row .. taps-1-row
        out = F.lit(0.0)
        for j in range(taps):
            out = out + F.lit(h[row][j]) * F.col(f"__s{j - row + taps}")
        return out

    value = fit(half)
    for r in range(half):
        value = F.when(pos == r, fit(r)).when(pos == n - 1 - r, fit(taps - 1 - r)).otherwise(value)
    return near, value


def preprocess(epochs: DataFrame, x: str = "bvp", n: int = 30, name: str = "clean") -> DataFrame:
    """Detrend, smooth and standardize each epoch inside one shuffle."""
    df = epochs.withColumn("__dt", detrended(F.col(x)))
    near, value = savgol("__dt", n)
    df = df.withColumns(near).withColumn("__sg", value).withColumn(name, z_scored(F.col("__sg"), centre_if_flat=False))
    return df.drop("__dt", "__sg", *near)
