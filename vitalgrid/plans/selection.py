"""Queries that inspect and select feature columns and assign folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.operators import selection as sel
from vitalgrid.plans.registry import query
from vitalgrid.plans.waves import rounded
from vitalgrid.sources import tables as src

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "q2", "d2", "const"]
WIDE_SQL = """f AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2 + l_tax AS q2, l_discount * 3 - l_linenumber / 1000.0::DOUBLE AS d2, 1.0::DOUBLE AS const,
  CASE WHEN l_partkey % 3 = 0 THEN l_tax END AS sparse, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity END AS gappy, l_quantity + 3 * l_discount + l_linenumber AS target FROM lineitem)"""


def wide(spark, d):
    p = F.col("l_partkey")
    return src.table(spark, d, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("q2"),
        (F.col("l_discount") * 3 - F.col("l_linenumber") / 1000.0).alias("d2"),
        F.lit(1.0).alias("const"),
        F.when(F.pmod(p, F.lit(3)) == 0, F.col("l_tax")).alias("sparse"),
        F.when(F.pmod(p, F.lit(3)) == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("gappy"),
        (F.col("l_quantity") + 3 * F.col("l_discount") + F.col("l_linenumber")).alias("target"),
    )


def _quality_sql():
    parts = [
        f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 AS mostly_missing, round(stddev_pop({c}), 5) AS std, coalesce(stddev_pop({c}), 0) < 1e-12 AS constant FROM f"
        for c in (*COLS, "sparse", "gappy")
    ]
    return f"WITH {WIDE_SQL} " + " UNION ALL ".join(parts)


@query("column_quality", "A9", _quality_sql())
def column_quality(spark, d):
    t = sel.column_quality(wide(spark, d), [*COLS, "sparse", "gappy"])
    return rounded(t.withColumn("std", F.round("std", 5)))


@query(
    "usable_interval_share",
    "A9 F3",
    "SELECT l_suppkey AS subject, round(avg(CASE WHEN l_discount * 34.7 / 3.142 > 0.05 AND l_discount * 34.7 / 3.142 < 3.0 THEN 1.0 ELSE 0.0 END), 6) AS usable FROM lineitem GROUP BY 1",
)
def usable_interval_share(spark, d):
    from vitalgrid.operators.signal import plausible

    return rounded(src.samples(spark, d).groupBy("subject").agg(F.avg(F.when(plausible(F.col("ibi")), 1.0).otherwise(0.0)).alias("usable")))


def _corr_sql(cols, extra=""):
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM f" for a, b in pairs)


@query("correlation_matrix", "A19", f"WITH {WIDE_SQL} {_corr_sql(COLS[:6])}")
def correlation_matrix(spark, d):
    return rounded(sel.correlations(wide(spark, d), COLS[:6]))


@query(
    "target_correlations",
    "A19",
    f"WITH {WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, target), 6) + 0.0 AS r FROM f" for c in COLS[:6]),
)
def target_correlations(spark, d):
    row = wide(spark, d).agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.corr(c, "target").alias("r")) for c in COLS[:6]]).alias("x"))
    return rounded(row.select(F.explode("x").alias("p")).select("p.*"))


@query(
    "column_variances",
    "A20",
    f"WITH {WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_samp({c}), {2 if c == 'l_extendedprice' else 6}) AS variance FROM f" for c in COLS),
)
def column_variances(spark, d):
    t = sel.variances(wide(spark, d), COLS)
    return t.select("feature", F.when(F.col("feature") == "l_extendedprice", F.round("variance", 2)).otherwise(F.round("variance", 6)).alias("variance"))


@query(
    "low_variance_prune",
    "M1 A20 U2",
    f"WITH {WIDE_SQL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS feature, count(*) AS n FROM f HAVING var_samp({c}) >= 1e-10" for i, c in enumerate(COLS)) + ")",
)
def low_variance_prune(spark, d):
    t = wide(spark, d)
    keep = sel.low_variance_kept(t, COLS)
    row = t.select(*keep).agg(F.array(*[F.struct(F.lit(COLS.index(c)).alias("pos"), F.lit(c).alias("feature"), F.count(c).alias("n")) for c in keep]).alias("a"))
    return row.select(F.explode("a").alias("q")).select("q.*")


@query(
    "correlation_prune",
    "M2 A19",
    f"""WITH {WIDE_SQL}, r AS ({_corr_sql(COLS[:6])}), y AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, abs(corr({c}, target)) AS r FROM f" for c in COLS[:6])}),
    dr AS (SELECT CASE WHEN ya.r < yb.r THEN a ELSE b END AS c FROM r JOIN y ya ON ya.c = a JOIN y yb ON yb.c = b WHERE abs(r.r) > 0.85) SELECT c AS feature FROM y WHERE c NOT IN (SELECT c FROM dr)""",
)
def correlation_prune(spark, d):
    t = wide(spark, d)
    keep = sel.correlation_kept(t, COLS[:6], "target")
    return t.agg(F.array(*[F.lit(c) for c in keep]).alias("a")).select(F.explode("a").alias("feature"))


@query(
    "imputed_columns",
    "P14",
    f"WITH {WIDE_SQL}, m AS (SELECT median(sparse) AS ms, median(gappy) AS mg FROM f) SELECT round(sum(coalesce(sparse, ms)), 4) AS sparse_sum, round(sum(coalesce(gappy, mg)), 4) AS gappy_sum, count(*) AS n FROM f, m",
)
def imputed_columns(spark, d):
    t = sel.impute_median(wide(spark, d), ["sparse", "gappy"])
    return t.agg(F.round(F.sum("sparse"), 4).alias("sparse_sum"), F.round(F.sum("gappy"), 4).alias("gappy_sum"), F.count(F.lit(1)).alias("n"))


@query(
    "group_folds_by_size",
    "M5",
    "SELECT o_custkey, n, (row_number() OVER (ORDER BY n DESC, o_custkey) - 1) % 5 AS fold FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)",
)
def group_folds_by_size(spark, d):
    return sel.folds_by_size(src.table(spark, d, "orders"), "o_custkey", 5)


@query(
    "group_folds_greedy",
    "M5",
    """WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS place FROM orders GROUP BY 1),
    r AS (SELECT 0::BIGINT AS place, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0::BIGINT AS o_custkey, 0::BIGINT AS n, 0 AS fold
      UNION ALL
      SELECT g.place, list_transform(range(1, 6), lambda i: r.loads[i] + CASE WHEN i = list_position(r.loads, list_min(r.loads)) THEN g.n ELSE 0 END),
        g.o_custkey, g.n, list_position(r.loads, list_min(r.loads)) - 1
      FROM r JOIN g ON g.place = r.place + 1)
    SELECT o_custkey, n, fold FROM r WHERE place > 0""",
)
def group_folds_greedy(spark, d):
    return sel.folds_greedy(src.table(spark, d, "orders"), "o_custkey", 5)


@query(
    "balanced_class_weights",
    "M9 A8",
    "WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey, o_orderstatus, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM orders JOIN c USING (o_orderstatus)",
)
def balanced_class_weights(spark, d):
    return rounded(sel.class_weight(src.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus"))


@query(
    "hashed_split",
    "M15",
    "SELECT conv_id, turn, CAST(floor(((conv_id * 1000 + turn) % 2147483648 * 2654435761 % 4294967296) / 65536.0::DOUBLE) AS BIGINT) % 10 < 9 AS is_train FROM conversations",
)
def hashed_split(spark, d):
    t = src.table(spark, d, "conversations")
    return t.select("conv_id", "turn", (sel.hash_part(F.col("conv_id") * 1000 + F.col("turn")) < 9).alias("is_train"))
