"""Queries over the samples of an epoch: preprocessing, peaks, spectra and feature families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalgrid.operators import epochs as ep
from vitalgrid.operators import signal as sg
from vitalgrid.operators.ordering import exact_quantiles
from vitalgrid.plans.epochs import EPOCH_SQL, epoched
from vitalgrid.plans.registry import query
from vitalgrid.plans.waves import rounded
from vitalgrid.session import materialize

W = "w AS (PARTITION BY subject, epoch_idx ORDER BY pos)"
P = "PARTITION BY subject, epoch_idx"


def r6(e, name):
    return f"round({e}, 6) + 0.0 AS {name}"


def r8(e, name):
    return f"round({e}, 8) + 0.0 AS {name}"


DETREND_SQL = f"""fit AS (SELECT subject, epoch_idx, regr_slope(bvp, pos) AS b, regr_intercept(bvp, pos) AS a FROM e GROUP BY ALL),
dt AS (SELECT e.subject, e.epoch_idx, pos, stage, bvp - (a + b * pos) AS x FROM e JOIN fit USING (subject, epoch_idx))"""


@query("linear_detrend", "W9", f"WITH {EPOCH_SQL}, {DETREND_SQL} SELECT subject, epoch_idx, pos, {r6('x', 'x')} FROM dt")
def linear_detrend(spark, d):
    return rounded(epoched(spark, d).select("subject", "epoch_idx", "pos", sg.detrended(F.col("bvp")).alias("x")))


def _savgol_sql():
    h = sg.savgol_weights()
    rows = ", ".join(f"({r}, {j}, {h[r][j]!r}::DOUBLE)" for r in range(15) for j in range(15))
    return f"""h(r, j, wt) AS (VALUES {rows}),
sgf AS (SELECT q.subject, q.epoch_idx, q.pos, sum(wt * dt.x) AS x FROM (SELECT subject, epoch_idx, pos, least(greatest(pos - 7, 0), 15) AS s FROM dt) q
  JOIN h ON h.r = q.pos - q.s JOIN dt ON dt.subject = q.subject AND dt.epoch_idx = q.epoch_idx AND dt.pos = q.s + h.j GROUP BY ALL)"""


SAVGOL_SQL = _savgol_sql()


@query("savgol_smoothing", "W10", f"WITH {EPOCH_SQL}, {DETREND_SQL}, {SAVGOL_SQL} SELECT subject, epoch_idx, pos, {r6('x', 'x')} FROM sgf")
def savgol_smoothing(spark, d):
    t = epoched(spark, d).withColumn("dt", sg.detrended(F.col("bvp")))
    near, value = sg.savgol("dt", 30)
    return rounded(t.withColumns(near).select("subject", "epoch_idx", "pos", value.alias("x")))


CLEAN_SQL = f"""{DETREND_SQL}, {SAVGOL_SQL},
zs AS (SELECT subject, epoch_idx, avg(x) AS m, stddev_pop(x) AS s FROM sgf GROUP BY ALL),
clean AS (SELECT sgf.subject, sgf.epoch_idx, pos, CASE WHEN s <> 0 THEN (x - m) / s ELSE 0 END AS x FROM sgf JOIN zs USING (subject, epoch_idx))"""


@query("epoch_preprocessing", "W19 W8 W9 W10", f"WITH {EPOCH_SQL}, {CLEAN_SQL} SELECT subject, epoch_idx, pos, {r6('x', 'x')} FROM clean")
def epoch_preprocessing(spark, d):
    return rounded(sg.preprocess(epoched(spark, d)).select("subject", "epoch_idx", "pos", F.col("clean").alias("x")))


BEAT_SQL = f"""chg AS (SELECT subject, epoch_idx, pos, ibi FROM (SELECT *, lag(ibi) OVER w AS p FROM e WINDOW {W})
   WHERE (pos = 0 OR ibi <> p) AND ibi > 0.05 AND ibi < 3.0),
beat AS (SELECT *, sum(ibi) OVER (PARTITION BY subject, epoch_idx ORDER BY pos ROWS UNBOUNDED PRECEDING) AS t, count(*) OVER ({P}) AS n_beats FROM chg),
beat0 AS (SELECT subject, epoch_idx, pos, ibi, n_beats, t - first_value(t) OVER (PARTITION BY subject, epoch_idx ORDER BY pos) AS t FROM beat)"""


@query("beat_times", "W11 F3", f"WITH {EPOCH_SQL}, {BEAT_SQL} SELECT subject, epoch_idx, pos, {r6('t', 't')} FROM beat0")
def beat_times(spark, d):
    v = F.col("ibi")
    t = epoched(spark, d).withColumn("ok", sg.changed(v) & sg.plausible(v)).where("ok")
    by = Window.partitionBy("subject", "epoch_idx").orderBy("pos")
    t = t.withColumn("t", F.sum(v).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rounded(t.withColumn("t", F.col("t") - F.first("t").over(by)).select("subject", "epoch_idx", "pos", "t"))


GRID_SQL = f"""{BEAT_SQL},
br AS (SELECT *, lead(t) OVER w AS t2, lead(ibi) OVER w AS v2 FROM beat0 WINDOW {W}),
span AS (SELECT subject, epoch_idx, max(t) AS tmax FROM beat0 GROUP BY ALL),
gg AS (SELECT subject, epoch_idx, unnest(range(0, CAST(ceil(tmax * 4) AS BIGINT))) AS g FROM span),
grid AS (SELECT gg.subject, gg.epoch_idx, g, n_beats, ibi + (v2 - ibi) * (g / 4.0::DOUBLE - t) / (t2 - t) AS v
  FROM gg JOIN br ON gg.subject = br.subject AND gg.epoch_idx = br.epoch_idx AND g / 4.0::DOUBLE >= t AND g / 4.0::DOUBLE < t2)"""


@query("uniform_resample", "W12", f"WITH {EPOCH_SQL}, {GRID_SQL} SELECT subject, epoch_idx, g, {r6('v', 'v')} FROM grid")
def uniform_resample(spark, d):
    return rounded(sg.resampled_beats(epoched(spark, d)).select("subject", "epoch_idx", "g", "v"))


def _peak_sql(x, dist, sign="", out="pk"):
    v = f"({sign}{x})"
    return f"coalesce({v} > lag({v}) OVER w AND {v} > lead({v}) OVER w AND {v} >= max({v}) OVER (PARTITION BY subject, epoch_idx ORDER BY pos ROWS BETWEEN {dist} PRECEDING AND {dist} FOLLOWING), false) AS {out}"


def _prom_sql(base, x, cond):
    return f"""pkc AS (SELECT subject, epoch_idx, pos AS pp, {x} AS h FROM {base} WHERE {cond}),
bnd AS (SELECT p.subject, p.epoch_idx, pp, h, coalesce(max(CASE WHEN q.{x} > h AND q.pos < pp THEN q.pos END), -1) AS lb, coalesce(min(CASE WHEN q.{x} > h AND q.pos > pp THEN q.pos END), 999) AS rb
  FROM pkc p JOIN {base} q ON p.subject = q.subject AND p.epoch_idx = q.epoch_idx GROUP BY p.subject, p.epoch_idx, pp, h),
prom AS (SELECT b.subject, b.epoch_idx, pp, h, h - greatest(min(CASE WHEN q.pos > lb AND q.pos <= pp THEN q.{x} END), min(CASE WHEN q.pos < rb AND q.pos >= pp THEN q.{x} END)) AS prom
  FROM bnd b JOIN {base} q ON b.subject = q.subject AND b.epoch_idx = q.epoch_idx GROUP BY b.subject, b.epoch_idx, pp, h)"""


@query(
    "local_peaks",
    "W13",
    f"""WITH {EPOCH_SQL}, f AS (SELECT subject, epoch_idx, pos, bvp, {_peak_sql('bvp', 2)} FROM e WINDOW {W}), {_prom_sql('f', 'bvp', 'pk')}
    SELECT subject, epoch_idx, pp AS pos, {r6('h', 'height')}, {r6('prom', 'prominence')} FROM prom WHERE prom >= 20""",
)
def local_peaks(spark, d):
    t = epoched(spark, d).groupBy("subject", "epoch_idx").agg(sg._ordered("bvp").alias("xs"))
    xs = F.col("xs")
    t = t.withColumn("i", F.explode(sg.peak_positions(xs, 2, F.lit(20.0))))
    i = F.col("i")
    return rounded(t.select("subject", "epoch_idx", i.cast("bigint").alias("pos"), F.get(xs, i).alias("height"), sg.prominence(xs, i).alias("prominence")))


@query(
    "pulse_timing",
    "W14",
    f"""WITH {EPOCH_SQL}, f AS (SELECT subject, epoch_idx, pos, bvp, {_peak_sql('bvp', 1)}, {_peak_sql('bvp', 1, '-', 'tr')} FROM e WINDOW {W}),
    g AS (SELECT *, max(CASE WHEN tr THEN pos END) OVER (PARTITION BY subject, epoch_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS onset,
      min(CASE WHEN tr THEN pos END) OVER (PARTITION BY subject, epoch_idx ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS off FROM f)
    SELECT subject, epoch_idx, pos, pos - lag(pos) OVER (PARTITION BY subject, epoch_idx ORDER BY pos) AS ipi, pos - onset AS rise, off - pos AS fall, off - onset AS width FROM g WHERE pk""",
)
def pulse_timing(spark, d):
    by = Window.partitionBy("subject", "epoch_idx").orderBy("pos")
    v, pos = F.col("bvp"), F.col("pos")
    t = epoched(spark, d).withColumns({"pk": sg.peak_flag(v, 1), "tr": sg.peak_flag(-v, 1)})
    trough = F.when(F.col("tr"), pos)
    t = t.withColumns(
        {
            "onset": F.last(trough, True).over(by.rowsBetween(Window.unboundedPreceding, -1)),
            "off": F.first(trough, True).over(by.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).where("pk")
    return t.select(
        "subject",
        "epoch_idx",
        "pos",
        (pos - F.lag("pos").over(by)).alias("ipi"),
        (pos - F.col("onset")).alias("rise"),
        (F.col("off") - pos).alias("fall"),
        (F.col("off") - F.col("onset")).alias("width"),
    )


# ---------------------------------------------------------------- feature families


def features(spark, d, *families, keep=()):
    return rounded(sg.build(epoched(spark, d), families, keep))


STAT_SQL = f"""st AS (SELECT *, avg(bvp) OVER ({P}) AS m, median(bvp) OVER ({P}) AS med, count(*) OVER ({P}) AS n,
    row_number() OVER ({P} ORDER BY bvp, pos) AS rk, bvp - lag(bvp) OVER w AS d1 FROM e WINDOW {W})"""
STAT_COLS = ", ".join(
    r6(e, f'"{n}"')
    for n, e in {
        "MAD": "avg(abs(bvp - m))",
        "MABD": "median(abs(bvp - med))",
        "IQR": "quantile_cont(bvp, 0.75) - quantile_cont(bvp, 0.25)",
        "3rd_NCM": "avg((bvp - m) ** 3)",
        "ACL": "sum(abs(d1))",
        "Shape_Factor": "CASE WHEN avg(bvp) <> 0 THEN sqrt(avg(bvp * bvp)) / avg(bvp) ELSE 0 END",
        "Mean": "avg(bvp)",
        "Std_Dev": "stddev_pop(bvp)",
        "RMS": "sqrt(avg(bvp * bvp))",
        "Trimmed_Mean_25": "avg(CASE WHEN rk > floor(n * 0.25) AND rk <= n - floor(n * 0.25) THEN bvp END)",
        "Trimmed_Mean_50": "median(bvp)",
        "Geometric_Mean": "exp(avg(ln(least(greatest(abs(bvp) + 1e-10, 1e-10), 1e10))))",
        "Max_Val": "max(bvp)",
        "Min_Val": "min(bvp)",
        "Skewness": "avg((bvp - m) ** 3) / (avg((bvp - m) ** 2) ** 1.5)",
        "Kurtosis": "avg((bvp - m) ** 4) / (avg((bvp - m) ** 2) ** 2) - 3",
    }.items()
)


@query("statistical_features", "G1 W7", f"WITH {EPOCH_SQL}, {STAT_SQL} SELECT subject, epoch_idx, {STAT_COLS} FROM st GROUP BY ALL")
def statistical_features(spark, d):
    return features(spark, d, sg.statistical())


@query(
    "temporal_features",
    "G2 W13 W14",
    f"""WITH {EPOCH_SQL}, f AS (SELECT subject, epoch_idx, pos, bvp, {_peak_sql('bvp', 1)}, {_peak_sql('bvp', 1, '-', 'tr')}, sign(bvp) <> sign(lag(bvp) OVER w) AS zc FROM e WINDOW {W}),
    g AS (SELECT *, max(CASE WHEN tr THEN pos END) OVER (PARTITION BY subject, epoch_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS onset FROM f)
    SELECT subject, epoch_idx, {r6("count(CASE WHEN zc THEN 1 END) / count(*)", '"ZCR"')}, {r6("count(CASE WHEN pk THEN 1 END) / count(*)", '"Peak_Count"')},
    {r6("coalesce(CASE WHEN count(CASE WHEN pk THEN 1 END) > 1 THEN (max(CASE WHEN pk THEN pos END) - min(CASE WHEN pk THEN pos END)) / (count(CASE WHEN pk THEN 1 END) - 1) END, 0)", '"IPI"')},
    {r6("coalesce(avg(CASE WHEN pk THEN pos - onset END), 0)", '"Rise_Time"')} FROM g GROUP BY ALL""",
)
def temporal_features(spark, d):
    return features(spark, d, sg.temporal())


@query(
    "poincare_hjorth_features",
    "G3",
    f"""WITH {EPOCH_SQL}, l AS (SELECT subject, epoch_idx, pos, bvp, lead(bvp) OVER w AS nx, lead(bvp) OVER w - bvp AS nd FROM e WINDOW {W}),
    l2 AS (SELECT *, lead(nd) OVER w - nd AS nd2 FROM l WINDOW {W}),
    a AS (SELECT subject, epoch_idx, sqrt(var_pop(bvp - nx) / 2) AS s1, sqrt(var_pop(bvp + nx) / 2) AS s2, var_pop(bvp) AS v0, var_pop(nd) AS v1, var_pop(nd2) AS v2 FROM l2 GROUP BY ALL)
    SELECT subject, epoch_idx, {r6('s1', '"Poincare_SD1"')}, {r6('s2', '"Poincare_SD2"')}, {r6('s1 / s2', '"SD1_to_SD2_Ratio"')}, {r6('sqrt(v1 / v0)', '"Hjorth_Mobility"')},
    {r6('sqrt(v2 / v1) / sqrt(v1 / v0)', '"Hjorth_Complexity"')} FROM a""",
)
def poincare_hjorth_features(spark, d):
    return features(spark, d, sg.poincare_hjorth())


@query(
    "higuchi_dimension",
    "G4",
    f"""WITH {EPOCH_SQL}, k AS (SELECT a.subject, a.epoch_idx, k, a.pos % k AS m, sum(abs(b.bvp - a.bvp)) * 29.0 / (count(*) * k) AS lm
      FROM e a, range(1, 11) r(k), e b WHERE a.subject = b.subject AND a.epoch_idx = b.epoch_idx AND b.pos = a.pos + k GROUP BY a.subject, a.epoch_idx, k, a.pos % k),
    l AS (SELECT subject, epoch_idx, k, ln(avg(lm) + 1e-10) AS y, ln(1.0::DOUBLE / k) AS x FROM k GROUP BY ALL)
    SELECT subject, epoch_idx, {r6('regr_slope(y, x)', '"Higuchi_FD"')} FROM l GROUP BY ALL""",
)
def higuchi_dimension(spark, d):
    return features(spark, d, sg.higuchi())


@query(
    "katz_dimension",
    "G5",
    f"""WITH {EPOCH_SQL}, l AS (SELECT subject, epoch_idx, bvp, bvp - lag(bvp) OVER w AS dx, first_value(bvp) OVER w AS x0 FROM e WINDOW {W}),
    a AS (SELECT subject, epoch_idx, sum(abs(dx)) AS len, max(abs(bvp - x0)) AS reach, count(*) - 1 AS n FROM l GROUP BY ALL)
    SELECT subject, epoch_idx, {r6('CASE WHEN len <> 0 AND reach <> 0 THEN log10(n) / (log10(reach / len) + log10(n)) ELSE 0 END', '"Katz_FD"')} FROM a""",
)
def katz_dimension(spark, d):
    return features(spark, d, sg.katz())


def entropy_sql(x):
    return f"""sx AS (SELECT subject, epoch_idx, pos AS i, {x} AS v0, lead({x}, 1) OVER w AS v1, lead({x}, 2) OVER w AS v2, 0.2 * stddev_samp({x}) OVER ({P}) AS r, count(*) OVER ({P}) AS n FROM e WINDOW {W}),
cnt AS (SELECT a.subject, a.epoch_idx,
   count(CASE WHEN b.i <= a.n - 3 AND greatest(abs(a.v0 - b.v0), abs(a.v1 - b.v1)) < a.r THEN 1 END) AS bb,
   count(CASE WHEN b.i <= a.n - 4 AND greatest(abs(a.v0 - b.v0), abs(a.v1 - b.v1), abs(a.v2 - b.v2)) < a.r THEN 1 END) AS aa
   FROM sx a JOIN sx b ON a.subject = b.subject AND a.epoch_idx = b.epoch_idx AND a.i < b.i GROUP BY ALL)"""


@query(
    "sample_entropy",
    "G6 J12",
    f"WITH {EPOCH_SQL}, {entropy_sql('hr')} SELECT subject, epoch_idx, {r6('CASE WHEN aa > 0 AND bb > 0 THEN -ln(aa / bb) ELSE 0 END', '\"SampEn\"')} FROM cnt",
)
def sample_entropy(spark, d):
    return features(spark, d, sg.sample_entropy("hr"))


def _hann_sql(p, n):
    return f"(0.5 - 0.5 * cos(2 * pi() * {p} / {n}))"


@query(
    "band_power_features",
    "G7",
    f"""WITH {EPOCH_SQL}, c AS (SELECT subject, epoch_idx, pos, bvp - avg(bvp) OVER ({P}) AS x FROM e),
    sp AS (SELECT subject, epoch_idx, b, 2 * (sum({_hann_sql('pos', 30)} * x * cos(2 * pi() * b * pos / 30)) ** 2 + sum({_hann_sql('pos', 30)} * x * sin(2 * pi() * b * pos / 30)) ** 2) / sum({_hann_sql('pos', 30)} ** 2) AS p
      FROM c, range(2, 12) r(b) GROUP BY ALL),
    tz AS (SELECT a.subject, a.epoch_idx, sum(CASE WHEN a.b BETWEEN 2 AND 3 THEN (a.p + z.p) / 60 END) AS lf, sum(CASE WHEN a.b BETWEEN 5 AND 10 THEN (a.p + z.p) / 60 END) AS hf
      FROM sp a JOIN sp z ON a.subject = z.subject AND a.epoch_idx = z.epoch_idx AND z.b = a.b + 1 GROUP BY ALL)
    SELECT subject, epoch_idx, 0.0::DOUBLE AS "BVP_VLF_Power", {r6('lf', '"BVP_LF_Power"')}, {r6('hf', '"BVP_HF_Power"')}, {r6('lf / hf', '"BVP_LF_HF_Ratio"')} FROM tz""",
)
def band_power_features(spark, d):
    return features(spark, d, sg.band_power())


@query(
    "interval_spectrum",
    "G8 W2 W11 W12",
    f"""WITH {EPOCH_SQL}, {GRID_SQL}, g1 AS (SELECT *, count(*) OVER ({P}) AS n FROM grid), g2 AS (SELECT *, least(n, 64) AS sz, least(n, 64) - least(n, 64) // 2 AS st FROM g1 WHERE n_beats >= 5 AND n >= 16),
    sg AS (SELECT subject, epoch_idx, s, sz, g - s * st AS p, v FROM g2, range(0, 40) r(s) WHERE g >= s * st AND g < s * st + sz AND s * st + sz <= n),
    sc AS (SELECT *, v - avg(v) OVER (PARTITION BY subject, epoch_idx, s) AS x FROM sg),
    sp AS (SELECT subject, epoch_idx, s, sz, b, 2 * (sum({_hann_sql('p', 'sz')} * x * cos(2 * pi() * b * p / sz)) ** 2 + sum({_hann_sql('p', 'sz')} * x * sin(2 * pi() * b * p / sz)) ** 2) / (4.0 * sum({_hann_sql('p', 'sz')} ** 2)) AS p
      FROM sc, range(1, 7) q(b) GROUP BY ALL),
    av AS (SELECT subject, epoch_idx, sz, b, b * 4.0::DOUBLE / sz AS f, avg(p) AS p FROM sp GROUP BY ALL),
    bp AS (SELECT a.subject, a.epoch_idx, coalesce(sum(CASE WHEN a.f >= 0.003 AND z.f < 0.04 THEN (a.p + z.p) / 2 * 4.0::DOUBLE / a.sz END), 0) AS vlf,
      coalesce(sum(CASE WHEN a.f >= 0.04 AND z.f < 0.15 THEN (a.p + z.p) / 2 * 4.0::DOUBLE / a.sz END), 0) AS lf, coalesce(sum(CASE WHEN a.f >= 0.15 AND z.f < 0.4 THEN (a.p + z.p) / 2 * 4.0::DOUBLE / a.sz END), 0) AS hf
      FROM av a JOIN av z ON a.subject = z.subject AND a.epoch_idx = z.epoch_idx AND z.b = a.b + 1 GROUP BY ALL)
    SELECT subject, epoch_idx, {r6('vlf', '"IBI_VLF"')}, {r6('lf', '"IBI_LF"')}, {r6('hf', '"IBI_HF"')}, {r6('CASE WHEN hf > 1e-12 THEN lf / hf ELSE 0 END', '"IBI_LF_HF"')},
    {r6('CASE WHEN vlf + lf + hf > 1e-12 THEN hf / (vlf + lf + hf) ELSE 0 END', '"IBI_nHF"')}, {r6('vlf + lf + hf', '"IBI_TP"')} FROM bp""",
)
def interval_spectrum(spark, d):
    return rounded(sg.interval_spectrum(epoched(spark, d)))


@query(
    "interval_features",
    "G9 W2 W7 F3",
    f"""WITH {EPOCH_SQL}, {BEAT_SQL}, dd AS (SELECT *, ibi - lag(ibi) OVER w AS dx FROM beat0 WINDOW {W}), ids AS (SELECT DISTINCT subject, epoch_idx FROM e),
    a AS (SELECT subject, epoch_idx, count(*) AS n, avg(ibi) AS m, stddev_samp(ibi) AS sd, sqrt(avg(dx * dx)) AS r, avg(CASE WHEN abs(dx) > 0.05 THEN 1.0 WHEN dx IS NOT NULL THEN 0.0 END) AS p FROM dd GROUP BY ALL)
    SELECT subject, epoch_idx, {r6('CASE WHEN n >= 2 THEN m ELSE 0 END', '"Mean_IBI"')}, {r6('CASE WHEN n >= 2 THEN sd ELSE 0 END', '"SDNN_IBI"')}, {r6('CASE WHEN n >= 2 THEN r ELSE 0 END', '"RMSSD_IBI"')},
    {r6('CASE WHEN n >= 2 THEN p ELSE 0 END', '"pNN50_IBI"')}, {r6('CASE WHEN n >= 2 THEN r / m ELSE 0 END', '"CVSD_IBI"')}, {r6('CASE WHEN n >= 2 THEN 60.0 / m ELSE 0 END', '"Mean_HR_from_IBI"')} FROM ids LEFT JOIN a USING (subject, epoch_idx)""",
)
def interval_features(spark, d):
    return features(spark, d, sg.beat_intervals())


@query(
    "heart_rate_features",
    "G10",
    f"""WITH {EPOCH_SQL} SELECT subject, epoch_idx, {r6('avg(hr)', '"Mean_HR"')}, {r6('stddev_samp(hr)', '"Std_HR"')}, {r6('max(hr) - min(hr)', '"Range_HR"')}, {r6('regr_slope(hr, pos)', '"HR_Trend"')} FROM e GROUP BY ALL""",
)
def heart_rate_features(spark, d):
    return features(spark, d, sg.heart_rate())


@query(
    "motion_features",
    "G11",
    f"""WITH {EPOCH_SQL}, m AS (SELECT *, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS mag FROM e), dm AS (SELECT *, abs(mag - lag(mag) OVER w) AS dx FROM m WINDOW {W}),
    th AS (SELECT *, greatest(1e-6, 0.5 * (median(dx) OVER ({P}) + 1e-9)) AS thr FROM dm)
    SELECT subject, epoch_idx, {r6('avg(mag)', '"ACC_Mag_Mean"')}, {r6('stddev_samp(mag)', '"ACC_Mag_Std"')}, {r6('stddev_samp(acc_x)', '"ACC_X_Std"')}, {r6('stddev_samp(acc_y)', '"ACC_Y_Std"')}, {r6('stddev_samp(acc_z)', '"ACC_Z_Std"')},
    CAST(count(CASE WHEN dx > thr THEN 1 END) AS DOUBLE) AS "ACC_Movement_Count", {r6('avg(abs(acc_x) + abs(acc_y) + abs(acc_z))', '"ACC_SMA"')} FROM th GROUP BY ALL""",
)
def motion_features(spark, d):
    return features(spark, d, sg.motion())


@query(
    "skin_conductance_features",
    "G12 W13",
    f"""WITH {EPOCH_SQL}, f AS (SELECT subject, epoch_idx, pos, eda, {_peak_sql('eda', 1)} FROM e WINDOW {W}), {_prom_sql('f', 'eda', 'pk')},
    q AS (SELECT subject, epoch_idx, avg(eda) AS m, stddev_samp(eda) AS s, max(eda) - min(eda) AS rg, median(eda) AS med, greatest(1e-6, 0.05 * (quantile_cont(eda, 0.9) - quantile_cont(eda, 0.1) + 1e-9)) AS thr FROM e GROUP BY ALL)
    SELECT q.subject, q.epoch_idx, {r6('m', '"Mean_EDA"')}, {r6('s', '"Std_EDA"')}, {r6('rg', '"Range_EDA"')}, CAST(count(CASE WHEN prom >= thr AND h > med THEN 1 END) AS DOUBLE) AS "EDA_SCR_Peaks"
    FROM q LEFT JOIN prom ON q.subject = prom.subject AND q.epoch_idx = prom.epoch_idx GROUP BY q.subject, q.epoch_idx, m, s, rg""",
)
def skin_conductance_features(spark, d):
    return features(spark, d, sg.skin_conductance())


def _morph_sql():
    pair = ["h", "on_v", "h - on_v", "pp - onp", "offp - pp", "offp - onp"]
    names = sg.MORPHOLOGY
    cols = []
    for i, e in enumerate(pair):
        cols.append(r6(f"coalesce(CASE WHEN ok THEN avg({e}) END, 0)", f'"{names[2 * i]}"'))
        cols.append(r6(f"coalesce(CASE WHEN ok THEN stddev_pop({e}) END, 0)", f'"{names[2 * i + 1]}"'))
    cols.append(r6("CASE WHEN ok AND pa > 1e-12 THEN coalesce(pb / pa, 0) ELSE 0 END", '"Morph_APG_AB_Ratio"'))
    cols.append('CAST(CASE WHEN ok THEN count(onp) ELSE 0 END AS DOUBLE) AS "Morph_ValidPulses"')
    return f"""WITH {EPOCH_SQL}, f AS (SELECT subject, epoch_idx, pos, bvp, {_peak_sql('bvp', 1)}, {_peak_sql('bvp', 1, '-', 'tr')}, lead(bvp, 2) OVER w - 2 * lead(bvp) OVER w + bvp AS s2 FROM e WINDOW {W}),
    {_prom_sql('f', 'bvp', 'pk')},
    sp AS (SELECT subject, epoch_idx, 0.1 * (quantile_cont(bvp, 0.95) - quantile_cont(bvp, 0.05)) AS lim, count(CASE WHEN tr THEN 1 END) AS n_tr FROM f GROUP BY ALL),
    ap AS (SELECT subject, epoch_idx, avg(CASE WHEN up THEN abs(s2) END) AS pa, avg(CASE WHEN dn THEN abs(s2) END) AS pb FROM
      (SELECT subject, epoch_idx, s2, {_peak_sql('s2', 1, '', 'up')}, {_peak_sql('s2', 1, '-', 'dn')} FROM f WHERE s2 IS NOT NULL WINDOW {W}) GROUP BY ALL),
    sy AS (SELECT prom.*, count(*) OVER (PARTITION BY prom.subject, prom.epoch_idx) AS n_pk FROM prom JOIN sp USING (subject, epoch_idx) WHERE prom >= lim),
    pu AS (SELECT y.subject, y.epoch_idx, pp, h, n_pk, max(CASE WHEN q.tr AND q.pos < pp THEN q.pos END) AS onp0, min(CASE WHEN q.tr AND q.pos > pp THEN q.pos END) AS offp0 FROM sy y JOIN f q ON y.subject = q.subject AND y.epoch_idx = q.epoch_idx GROUP BY ALL),
    pv AS (SELECT pu.subject, pu.epoch_idx, pp, h, n_pk, onp0 AS onp, offp0 AS offp, f.bvp AS on_v FROM pu JOIN f ON f.subject = pu.subject AND f.epoch_idx = pu.epoch_idx AND f.pos = onp0 WHERE onp0 IS NOT NULL AND offp0 IS NOT NULL),
    allp AS (SELECT sp.subject, sp.epoch_idx, n_tr, pa, pb, coalesce((SELECT max(n_pk) FROM sy WHERE sy.subject = sp.subject AND sy.epoch_idx = sp.epoch_idx), 0) >= 2 AND n_tr >= 1 AS ok FROM sp LEFT JOIN ap USING (subject, epoch_idx))
    SELECT allp.subject, allp.epoch_idx, {", ".join(cols)} FROM allp LEFT JOIN pv ON pv.subject = allp.subject AND pv.epoch_idx = allp.epoch_idx GROUP BY allp.subject, allp.epoch_idx, ok, pa, pb"""


@query("pulse_morphology", "G13 W13 W14", _morph_sql())
def pulse_morphology(spark, d):
    return rounded(sg.morphology_features(epoched(spark, d)))


AUDIT = ["Mean", "IQR", "ACL"]


@query(
    "audit_subset",
    "P21",
    f"WITH {EPOCH_SQL}, {STAT_SQL}, a AS (SELECT subject, epoch_idx, max(stage) AS stage, {STAT_COLS} FROM st GROUP BY ALL) SELECT subject, epoch_idx, stage, \"Mean\", \"IQR\", \"ACL\" FROM a WHERE \"ACL\" IS NOT NULL",
)
def audit_subset(spark, d):
    return features(spark, d, sg.statistical(), keep=("stage",)).select("subject", "epoch_idx", "stage", *AUDIT).na.drop()


LONG_SQL = f"""au AS (SELECT subject, epoch_idx, max(stage) AS stage, {STAT_COLS} FROM st GROUP BY ALL),
lg AS (SELECT stage, subject, 'Mean' AS feature, "Mean" AS v FROM au UNION ALL SELECT stage, subject, 'IQR', "IQR" FROM au UNION ALL SELECT stage, subject, 'ACL', "ACL" FROM au)"""


def audit_long(spark, d):
    t = audit_subset(spark, d)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in AUDIT])
    return t.select("subject", "stage", F.explode(pairs).alias("p")).select("subject", "stage", "p.feature", "p.v")


@query(
    "stage_medians",
    "A10",
    f"""WITH {EPOCH_SQL}, {STAT_SQL}, {LONG_SQL}, m AS (SELECT feature, median(CASE WHEN stage = 0 THEN v END) AS wake, median(CASE WHEN stage = 3 THEN v END) AS deep FROM lg GROUP BY feature)
    SELECT feature, {r8('wake', 'wake')}, {r8('deep', 'deep')}, {r8('abs(wake - deep) / (abs(wake) + 1e-9) * 100', 'diff_pct')}, abs(wake - deep) / (abs(wake) + 1e-9) * 100 > 5 AS flagged FROM m""",
)
def stage_medians(spark, d):
    q = exact_quantiles(audit_long(spark, d).where("stage IN (0, 3)"), ["feature", "stage"], "v", {"med": 0.5})
    m = q.groupBy("feature").agg(
        F.max(F.when(F.col("stage") == 0, F.col("med"))).alias("wake"), F.max(F.when(F.col("stage") == 3, F.col("med"))).alias("deep")
    )
    diff = F.abs(F.col("wake") - F.col("deep")) / (F.abs("wake") + 1e-9) * 100
    return rounded(m.select("feature", "wake", "deep", diff.alias("diff_pct"), (diff > 5).alias("flagged")), places=8)


@query(
    "stage_five_numbers",
    "A11",
    f"""WITH {EPOCH_SQL}, {STAT_SQL}, {LONG_SQL} SELECT feature, stage, {", ".join(r8(f'quantile_cont(v, {p})', f'q{int(p * 100)}') for p in (0.0, 0.25, 0.5, 0.75, 1.0))} FROM lg GROUP BY feature, stage""",
)
def stage_five_numbers(spark, d):
    probs = {f"q{int(p * 100)}": p for p in (0.0, 0.25, 0.5, 0.75, 1.0)}
    return rounded(exact_quantiles(audit_long(spark, d), ["feature", "stage"], "v", probs), places=8)


@query(
    "normalization_audit",
    "A12 W8",
    f"""WITH {EPOCH_SQL}, {STAT_SQL}, {LONG_SQL}, z AS (SELECT subject, feature, CASE WHEN stddev_pop(v) OVER k <> 0 THEN (v - avg(v) OVER k) / stddev_pop(v) OVER k ELSE 0 END AS z FROM lg WINDOW k AS (PARTITION BY subject, feature)),
    a AS (SELECT subject, feature, abs(avg(z)) AS m, abs(stddev_pop(z) - 1) AS s FROM z GROUP BY ALL)
    SELECT subject, {r6('avg(m)', 'mean_err')}, {r6('avg(s)', 'std_err')}, avg(m) < 0.05 AND avg(s) < 0.05 AS passed FROM a GROUP BY subject""",
)
def normalization_audit(spark, d):
    t = audit_long(spark, d)
    m = t.groupBy("subject", "feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = t.join(m, ["subject", "feature"]).withColumn("z", F.when(F.col("s") != 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0))
    a = z.groupBy("subject", "feature").agg(F.abs(F.avg("z")).alias("m"), F.abs(F.stddev_pop("z") - 1).alias("s"))
    return rounded(
        a.groupBy("subject").agg(F.avg("m").alias("mean_err"), F.avg("s").alias("std_err"), ((F.avg("m") < 0.05) & (F.avg("s") < 0.05)).alias("passed"))
    )


# ---------------------------------------------------------------- assembled rows


def base_features(spark, d):
    """73 base columns per epoch from one pass over stored epochs, plus the interval spectrum."""
    e = materialize(epoched(spark, d), "epochs")
    fams = [
        sg.statistical(),
        sg.temporal(),
        sg.poincare_hjorth(),
        sg.higuchi(),
        sg.katz(),
        sg.sample_entropy(),
        sg.band_power(),
        sg.beat_intervals(),
        sg.heart_rate(),
        sg.motion(),
        sg.skin_conductance(),
    ]
    pulse = sg.Family(list(sg.morphology_inputs()), [], sg.morphology_inputs())
    main = sg.finish_morphology(sg.build(e, [*fams, pulse], keep=("stage",)))
    spec = sg.interval_spectrum(e)
    joined = main.join(spec, ["subject", "epoch_idx"], "left").na.fill(0.0, sg.IBI_SPECTRUM)
    names = [n for f in fams[:7] for n in f.names] + sg.MORPHOLOGY + fams[7].names + sg.IBI_SPECTRUM + [n for f in fams[8:] for n in f.names]
    return joined.select("subject", "epoch_idx", "stage", *names), names


# Columns that get a rolling context.
CONTEXT_MEANS = ["ACC_Mag_Mean", "ACC_Movement_Count", "ACC_SMA", "Mean_HR", "RMSSD_IBI", "Mean_EDA", "EDA_SCR_Peaks"]
CONTEXT_STDS = ["Mean_HR", "RMSSD_IBI"]


def feature_matrix(spark, d):
    """Base, delta and context columns: 73 + 73 + 10."""
    base, names = base_features(spark, d)
    numbered = ep.dense_epochs(materialize(base, "base_features"))
    ctx = ep.rolling_context(numbered, CONTEXT_MEANS, CONTEXT_STDS, 5, "epoch_no")
    full = ep.deltas(ctx, names, "epoch_no").withColumn("Ctx_EpochPos", ep.relative_position())
    feats = (
        names
        + [f"Delta_{n}" for n in names]
        + [f"Ctx_RMean_{n}" for n in CONTEXT_MEANS]
        + [f"Ctx_RStd_{n}" for n in CONTEXT_STDS]
        + ["Ctx_EpochPos"]
    )
    from vitalgrid.functions.scalar import nan_to_zero

    return full.select("subject", "epoch_idx", "stage", *[nan_to_zero(F.col(n)).alias(n) for n in feats]), feats


@query("epoch_feature_matrix", "G14 W3 W4 W5 P15")
def epoch_feature_matrix(spark, d):
    return rounded(feature_matrix(spark, d)[0])


STRESS_FEATURES = ["MEAN_RR", "MEDIAN_RR", "SDRR", "HR", "LF_NU", "HF", "HF_PCT", "TP", "LF_HF", "sampen", "higuci"]


def stress_features(epochs, rate=1):
    """Eleven interval features per window from the peaks of the cleaned signal; zeros below three peaks.

    The intervals between a window's peaks become one array, and all features come from one aggregate.
    """
    clean = sg.preprocess(epochs).withColumn("pk", sg.peak_flag(F.col("clean"), sg.min_distance(rate)))
    last = F.last(F.when(F.col("pk"), F.col("pos")), True).over(sg.before())
    rr = clean.withColumn("rr", F.when(F.col("pk"), (F.col("pos") - last) / F.lit(float(rate))))
    ms = F.col("rr") * 1000.0
    intervals = F.array_sort(F.collect_list(F.when(F.col("rr").isNotNull(), F.struct("pos", "rr"))))
    rows = rr.groupBy("subject", "epoch_idx").agg(
        F.max("stage").alias("stage"),
        F.avg(ms).alias("MEAN_RR"),
        F.percentile(ms, 0.5).alias("MEDIAN_RR"),
        F.stddev_samp(ms).alias("SDRR"),
        (60.0 / F.avg("rr")).alias("HR"),
        F.transform(intervals, lambda s: s["rr"]).alias("__rr"),
    )
    xs = F.col("__rr")
    rows = rows.withColumns({"sampen": sg.entropy_of(xs), "higuci": sg.higuchi_of(xs), "__p": sg.bands_of(xs)})
    spec = sg.spectrum_columns(F.col("__p"))
    low, high = spec["IBI_LF"], spec["IBI_HF"]
    rows = rows.withColumns(
        {
            "LF_NU": low / F.nullif(low + high, F.lit(0.0)),
            "HF": high,
            "HF_PCT": spec["IBI_nHF"] * 100,
            "TP": spec["IBI_TP"],
            "LF_HF": spec["IBI_LF_HF"],
        }
    )
    enough = [F.when(F.size(xs) >= 2, F.col(c)).alias(c) for c in STRESS_FEATURES]
    return rows.select("subject", "epoch_idx", "stage", *enough).na.fill(0.0)


@query("stress_window_features", "G15 W13 G4 G6 G8 G9")
def stress_window_features(spark, d):
    return rounded(stress_features(epoched(spark, d)))
