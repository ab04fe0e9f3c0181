"""Ordered operators that stay parallel when one key holds most of the rows.

A plain window over a subject sends every row of that subject to one task. The helpers here
split a key's ordered rows into blocks along a monotone bucket, work inside blocks and stitch
the blocks together with per-block totals, so the unit of work is a block and not a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__bucket"
#: Buckets that are ordered together (as a power of two), rows of close values per bucket, and steps of one at most.
RANGE_BITS = 12
CLOSE_ROWS = 4096
STEPS = 1 << 20
#: Samples that one task sorts and groups at most.
ROWS_PER_TASK = 1 << 19


def dealt(df: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    """Dealt by keys over one partition per ``ROWS_PER_TASK`` rows, where the session's partitions would hold more.

    ``rows`` is the number of rows, null if it is not known. What a task holds then stays the same however many there are.
    """
    parts = -(-rows // ROWS_PER_TASK) if rows else 0
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate as a scalar subquery: no join, evaluated once."""
    cols = one_row.columns
    out = df.withColumn("__one", one_row.select(F.struct(*cols)).scalar())
    return out.withColumns({c: F.col(f"__one.{c}") for c in cols}).drop("__one")


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: str, ways: int = 8) -> DataFrame:
    """Inner join of rows with one row per key, so that a hot key meets its row in several tasks.

    ``spread`` is a column that varies inside a key; only it is read for the salt.
    """
    keys = list(keys)
    left = rows.withColumn("__way", F.pmod(F.xxhash64(spread), F.lit(ways)).cast("int"))
    right = per_key.withColumn("__way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return left.join(right, [*keys, "__way"]).drop("__way")


def size_bucket(n: Column | str, sub: Column, width: int) -> Column:
    """Bucket for the order (n descending, tie-break ascending).

    ``sub`` is a monotone bucket of the tie-break in [0, width): many keys with one size spread over
    it. Sizes beyond 65536 are rare by nature and share value buckets.
    """
    n = F.col(n) if isinstance(n, str) else n
    exact = 65536
    return F.when(n < exact, -n * width + sub).otherwise(-F.lit(exact * width) - value_bucket(n)).cast("bigint")


def value_bucket(value: Column | str, per_octave: int = 256) -> Column:
    """Monotone integer bucket of a double: equal-width steps inside each power of two.

    The number of buckets is bounded by the double format (about 4000 octaves), whatever the data.
    """
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    inside = F.least(F.greatest(size / F.pow(F.lit(2.0), octave) - 1, F.lit(0.0)), F.lit(0.999999))
    step = ((octave + 1100) * per_octave + F.floor(inside * per_octave)).cast("bigint")
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, step).otherwise(-step)


def time_bucket(ts: Column | str, seconds: int = 3600) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / (seconds * 1_000_000)).cast("bigint")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    measures: Mapping[str, Column],
    count: int | None = None,
) -> DataFrame:
    """Inclusive running sums per key in the given full order.

    ``bucket`` must be non-decreasing along ``order``. Rows shuffle on (keys, bucket); only the
    per-bucket totals are ever ordered per key. With the ``count`` of rows, a task's share does not grow with it.
    """
    keys = list(keys)
    rows = df.withColumn(_B, bucket)
    part = {f"__m_{n}": c.cast("double") for n, c in measures.items()}
    rows = rows.withColumns(part)
    totals = rows.groupBy(*keys, _B).agg(*[F.sum(m).alias(f"__t{m}") for m in part])
    offsets = _bucket_offsets(totals, keys, part) if keys else _two_level_offsets(totals, part)
    inside = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt(rows, [*keys, _B], count).withColumns({f"__l{m}": F.sum(m).over(inside) for m in part})
    joined = local.join(offsets, [*keys, _B])
    out = joined.withColumns({n: F.col(f"__l__m_{n}") + F.col(f"__o__m_{n}") for n in measures})
    extra = [c for m in part for c in (m, f"__l{m}", f"__o{m}")]
    return out.drop(_B, *extra)


def _bucket_offsets(totals: DataFrame, keys: Sequence[str], measures: Sequence[str], order: str = _B) -> DataFrame:
    """Sums of the buckets before each, per key."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(f"__t{m}").over(before), F.lit(0.0)).alias(f"__o{m}") for m in measures]
    return totals.select(*keys, order, *sums)


def _two_level_offsets(totals: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Sums of the buckets before each, of a whole table: ranges of buckets are summed and ordered first.

    The buckets of a range are ordered together, and the ranges, of which there are as many fewer as they are wide; no
    task orders all buckets.
    """
    ranged = totals.withColumn("__range", F.shiftright(_B, RANGE_BITS))
    ranges = ranged.groupBy("__range").agg(*[F.sum(f"__t{m}").alias(f"__t{m}") for m in measures])
    ahead = _bucket_offsets(ranges.withColumn("__all", F.lit(0)), ["__all"], measures, "__range").drop("__all")
    ahead = ahead.withColumnsRenamed({f"__o{m}": f"__a{m}" for m in measures})
    inside = _bucket_offsets(ranged, ["__range"], measures).join(ahead, "__range")
    return inside.select(_B, *[(F.col(f"__o{m}") + F.col(f"__a{m}")).alias(f"__o{m}") for m in measures])


def fine_buckets(df: DataFrame, keys: Sequence[str], value: str, name: str, per_octave: int = 256, most: int | None = None) -> DataFrame:
    """Adds a monotone bucket of a value that splits wherever the values lie close together.

    Buckets of equal steps per power of two come first. Where one holds more than ``most`` rows of a key, its own least
    and largest value span as many equal steps as it takes; only such buckets get a second histogram.
    """
    keys, most = list(keys), most or CLOSE_ROWS
    v = F.col(value).cast("double")
    rows = df.withColumn("__coarse", value_bucket(v, per_octave))
    heavy = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, "__coarse")
        .agg(F.count(F.lit(1)).alias("__n"), F.min(v).alias("__low"), F.max(v).alias("__high"))
        .where((F.col("__n") > most) & (F.col("__low") < F.col("__high")))
    )
    return rows.join(heavy, [*keys, "__coarse"], "left").withColumn(
        name, F.col("__coarse") * STEPS + F.coalesce(_step(v, "__low", "__high", "__n", most), F.lit(0))
    ).drop("__coarse", "__n", "__low", "__high")


def _step(v: Column, low: str, high: str, n: str, most: int) -> Column:
    """Equal steps between a bucket's least and largest value, one for each ``most`` rows; null for null bounds."""
    steps = F.least(F.ceil(F.col(n) / most), F.lit(STEPS - 1)).cast("bigint")
    share = (v - F.col(low)) / (F.col(high) - F.col(low))
    at = F.when(F.col(high) > F.col(low), F.least(F.floor(share * steps).cast("bigint"), steps - 1)).when(F.col(low).isNotNull(), 0)
    return F.greatest(at, F.when(at.isNotNull(), 0)).cast("bigint")


def row_index(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "idx", count: int | None = None
) -> DataFrame:
    """0-based position of every row inside its key."""
    out = running_totals(df, keys, bucket, order, {name: F.lit(1)}, count)
    return out.withColumn(name, (F.col(name) - 1).cast("bigint"))


def blocks_with_halo(df: DataFrame, keys: Sequence[str], idx: str, reach: int, size: int = 4096) -> DataFrame:
    """Copies rows near a block edge into the neighbouring block.

    Windows of at most ``reach`` rows either way over ``halo_window`` are then exact on rows with
    ``__home``; drop the rest with ``home_rows``.
    """
    if size <= reach:
        raise ValueError("block size must exceed the window reach")
    i = F.col(idx)
    wanted = F.array_distinct(
        F.array(F.floor((i - reach) / size), F.floor(i / size), F.floor((i + reach) / size))
    )
    return df.withColumn("__block", F.explode(F.filter(wanted, lambda b: b >= 0))).withColumn(
        "__home", F.floor(i / size) == F.col("__block")
    )


def halo_window(keys: Sequence[str], idx: str):
    return Window.partitionBy(*keys, "__block").orderBy(idx)


def home_rows(df: DataFrame) -> DataFrame:
    return df.where("__home").drop("__block", "__home")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], per_octave: int = 256
) -> DataFrame:
    """Linear-interpolated quantiles per key without gathering a key in one place.

    Rows shrink to counts per distinct value first, so a repeated value cannot pile up. Counts per
    value bucket name the buckets that hold the wanted ranks. These get a second histogram, of equal
    steps between their own least and largest value, and the ranks are found inside its steps: values
    that lie close together are still dealt over many tasks.
    """
    keys = list(keys)
    group = keys or ["__all"]
    rows = df.where(F.col(value).isNotNull())
    if not keys:
        rows = rows.withColumn("__all", F.lit(0))
    rows = rows.select(*group, F.col(value).cast("double").alias("__v")).withColumn(
        _B, value_bucket("__v", per_octave)
    )
    counts = rows.groupBy(*group, _B, "__v").agg(F.count(F.lit(1)).alias("__k"))
    hist = counts.groupBy(*group, _B).agg(
        F.sum("__k").alias("__c"),
        F.count(F.lit(1)).alias("__d"),
        F.min("__v").alias("__low"),
        F.max("__v").alias("__high"),
    )
    upto = Window.partitionBy(*group).orderBy(_B).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns(
        {"__hi": F.sum("__c").over(upto), "__n": F.sum("__c").over(Window.partitionBy(*group))}
    ).withColumn("__lo", F.col("__hi") - F.col("__c"))
    ranks = []
    for p in probs.values():
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        ranks += [F.floor(pos), F.ceil(pos)]
    hist = hist.withColumn(
        "__want",
        F.filter(
            F.array_distinct(F.array(*ranks)), lambda r: (r >= F.col("__lo")) & (r < F.col("__hi"))
        ),
    ).where(F.size("__want") > 0)
    near = counts.join(hist.select(*group, _B, "__lo", "__n", "__d", "__low", "__high", "__want"), [*group, _B])
    near = near.withColumn("__step", _step(F.col("__v"), "__low", "__high", "__d", CLOSE_ROWS)).drop("__low", "__high", "__d")
    steps = near.groupBy(*group, _B, "__step").agg(F.sum("__k").alias("__c"))
    until = Window.partitionBy(*group, _B).orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*group, _B, "__step", F.coalesce(F.sum("__c").over(until), F.lit(0)).alias("__before"), "__c")
    near = near.join(steps, [*group, _B, "__step"]).withColumn("__first", F.col("__lo") + F.col("__before"))
    near = near.where(F.exists("__want", lambda r: (r >= F.col("__first")) & (r < F.col("__first") + F.col("__c"))))
    inside = Window.partitionBy(*group, _B, "__step").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__to", F.col("__first") + F.sum("__k").over(inside)).withColumn(
        "__from", F.col("__to") - F.col("__k")
    )
    hits = near.select(
        *group,
        "__v",
        "__n",
        F.explode(
            F.filter("__want", lambda r: (r >= F.col("__from")) & (r < F.col("__to")))
        ).alias("__r"),
    )
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        low = F.max(F.when(F.col("__r") == F.floor(pos), F.col("__v")))
        high = F.max(F.when(F.col("__r") == F.ceil(pos), F.col("__v")))
        part = F.max(pos - F.floor(pos))
        out.append((low + (high - low) * part).alias(name))
    res = hits.groupBy(*group).agg(*out)
    return res if keys else res.drop("__all")


def tied_ranks(
    df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column] | None = None
) -> DataFrame:
    """Average rank of every distinct value per key, with counts.

    Returns one row per (keys, value): ``n`` rows, ``rank`` (1-based, ties averaged), ``below``
    (rows with a smaller value) and the summed measures.
    """
    keys = list(keys)
    measures = dict(measures or {})
    counts = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(m) for m, c in measures.items()]
    )
    counts = fine_buckets(counts, keys, value, "__fine")
    run = running_totals(counts, keys, F.col("__fine"), [F.col(value)], {"__upto": F.col("n")}).drop("__fine")
    return run.withColumns(
        {
            "below": (F.col("__upto") - F.col("n")).cast("bigint"),
            "rank": F.col("__upto") - (F.col("n") - 1) / 2.0,
        }
    ).drop("__upto")
