"""Small helpers shared by the operators: ordering, paging, stored tables,
running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def page(df: DataFrame, order: list, page_no: int = 0, size: int = 20) -> DataFrame:
    """SRT-1: zero-based page of ``size`` rows in ``order``.

    Planned as ``TakeOrderedAndProject``: every partition keeps its best
    ``(page_no + 1) * size`` rows, so no full sort or shuffle of the input.
    Callers add a unique key to ``order`` so ties are deterministic.
    """
    if page_no < 0 or size <= 0:
        raise ValueError("page must be >= 0 and size > 0")
    ordered = df.orderBy(*order)
    if page_no:
        ordered = ordered.offset(page_no * size)
    return ordered.limit(size)


def page_after(df: DataFrame, keys: list[str], last: tuple, size: int = 20,
               descending: bool = True) -> DataFrame:
    """SRT-1 keyset variant for deep pages: rows strictly after ``last`` in
    ``keys`` order (row-value comparison), then the first ``size``."""
    cond = None
    for i in range(len(keys) - 1, -1, -1):
        k = F.col(keys[i])
        step = (k < F.lit(last[i])) if descending else (k > F.lit(last[i]))
        cond = step if cond is None else (step | ((k == F.lit(last[i])) & cond))
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    return df.where(cond).orderBy(*order).limit(size)


# Rows that one task may sort to cut a deep page, and the cuts a pass makes.
PAGE_ROWS, PAGE_CUTS, PAGE_SAMPLE = 100_000, 31, 2_048


def deep_page(df: DataFrame, keys: list[tuple], page_no: int, size: int = 20,
              most: int = PAGE_ROWS) -> DataFrame:
    """SRT-1 for any page number: zero-based page of ``size`` rows in the order
    of ``keys``, (column, descending) pairs that together make a row unique.
    Nulls rank above every value, as in PostgreSQL.

    Order statistics instead of a sort: a sample of ``PAGE_SAMPLE`` keys gives
    cuts, one aggregate counts the rows between them, and only the range with
    the page is cut again, until it holds at most ``most`` rows besides the
    page (rows with equal keys stay together). Its bounds are plain predicates on the
    scan; no row is shuffled before the last range is sorted, and no task skips
    more than that range. Needs two small jobs a pass, and about
    log(rows / ``most``) / log(``PAGE_CUTS``) passes. A page past the end is
    empty."""
    if page_no < 0 or size <= 0:
        raise ValueError("page must be >= 0 and size > 0")
    order = [F.col(k).desc_nulls_first() if down else F.col(k).asc_nulls_last() for k, down in keys]
    names = [k for k, _ in keys]
    skip, part, total = page_no * size, df, None
    while True:
        text = [F.col(k).cast("string").alias(k) if _clock(df, k) else F.col(k) for k in names]
        sample = part.select(*names).orderBy(F.xxhash64(*names), *names).limit(PAGE_SAMPLE)
        sample = sample.orderBy(*order).select(*text).collect()
        at = [len(sample) * i // (PAGE_CUTS + 1) for i in range(1, PAGE_CUTS + 1)] if sample else []
        cuts = list(dict.fromkeys(tuple(sample[i]) for i in at))
        # a row lies in the range numbered by the cuts it does not precede
        number = sum((F.when(_before(df, keys, c), 0).otherwise(1) for c in cuts), F.lit(0))
        counts = dict(part.groupBy(number.alias("_range")).count().collect())
        if total is None and skip >= sum(counts.values()):
            return df.limit(0)
        total = sum(counts.values())
        first, passed = 0, 0
        while passed + counts.get(first, 0) <= skip:
            passed += counts.get(first, 0)
            first += 1
        last, held = first, counts.get(first, 0)
        while passed + held < skip + size and last < len(cuts):
            last += 1
            held += counts.get(last, 0)
        skip -= passed
        if first:
            part = part.where(~_before(df, keys, cuts[first - 1]) & _leading(df, keys, cuts[first - 1], False))
        if last < len(cuts):
            part = part.where(_before(df, keys, cuts[last]) & _leading(df, keys, cuts[last], True))
        if held <= most + size or held == total:
            break
    return part.orderBy(*order).offset(skip).limit(size)


def _clock(df: DataFrame, key: str) -> bool:
    return df.schema[key].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")


def _before(df: DataFrame, keys: list[tuple], cut: tuple) -> Column:
    """Rows that come before ``cut`` in the order of ``keys`` (nulls highest)."""
    out = F.lit(False)
    for (k, down), value in reversed(list(zip(keys, cut))):
        c, v = F.col(k), F.lit(value).cast(df.schema[k].dataType)
        if value is None:
            less = F.lit(False) if down else c.isNotNull()
        else:
            less = F.coalesce(c > v, F.lit(True)) if down else F.coalesce(c < v, F.lit(False))
        out = less | (c.eqNullSafe(v) & out)
    return out


def _leading(df: DataFrame, keys: list[tuple], cut: tuple, upper: bool) -> Column:
    """What a bound says of the leading key alone; a scan can prune by it."""
    (k, down), value = keys[0], cut[0]
    if value is None:
        return F.lit(True)
    c, v = F.col(k), F.lit(value).cast(df.schema[k].dataType)
    return (c <= v if upper else (c >= v) | c.isNull()) if not down else \
        ((c >= v) | c.isNull() if upper else c <= v)


def first_n(df: DataFrame, order: list, n: int = 10) -> DataFrame:
    """LIM-1: the first ``n`` rows in ``order``."""
    return df.orderBy(*order).limit(n)


def stack_rows(*dfs: DataFrame) -> DataFrame:
    """SET-1: UNION ALL by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def ts_lit(value) -> Column:
    """A ``timestamp_ntz`` literal from text or a ``datetime`` (the clock of a
    job is always an argument, never the wall clock)."""
    if isinstance(value, Column):
        return value
    return F.to_timestamp_ntz(F.lit(str(value)))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the session's shared checkpoint folder
    and read it back: cuts the lineage (a lost executor re-reads files
    instead of recomputing) and later reads are columnar with pruning. The
    files go with :func:`drop_stash`, or when the driver ends."""
    import uuid

    from cartograph.session import checkpoint_dir, temporary
    path = temporary(df.sparkSession, f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stash/{name}-{uuid.uuid4().hex}") + "/rows"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._stash_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`stash` returned, once
    nothing reads them any more."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cumulative_sum(df: DataFrame, keys: list[str], order: list[str], value, out: str,
                   partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in ``order`` (inclusive), without
    putting a hot key into one task: rows are range-partitioned by
    (keys, order), so one key's rows spread over consecutive partitions; the
    window runs per (partition, key), and each (partition, key) adds the
    totals of the same key in earlier partitions (a small table of
    partition x key totals). The partitioned rows are stored once (see
    :func:`stash`). ``order`` must make rows unique within a key."""
    return cumulative_sums(df, keys, order, {out: value}, partitions)


def cumulative_sums(df: DataFrame, keys: list[str], order: list[str], outputs: dict,
                    partitions: int | None = None) -> DataFrame:
    """Several running sums in one pass: ``outputs`` maps an output column to
    its value (column name or Column). See :func:`cumulative_sum`."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vals = {f"_v{i}": (v if isinstance(v, Column) else F.col(v)) for i, v in enumerate(outputs.values())}
    outs = dict(zip(outputs.keys(), vals.keys()))
    x = df
    for name, col in vals.items():
        x = x.withColumn(name, col)
    # range bounds come from sampling, so the partition of every row is fixed
    # once (stored) before the two passes below read it
    x = stash(x.repartitionByRange(n, *[F.col(c) for c in keys + order])
              .withColumn("_pid", F.spark_partition_id()), "cumsum")
    w = Window.partitionBy("_pid", *keys).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name in vals:
        x = x.withColumn(f"{name}_l", F.sum(name).over(w))
    totals = x.groupBy("_pid", *keys).agg(*[F.sum(name).alias(f"{name}_t") for name in vals])
    before = Window.partitionBy(*keys).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *keys, *[F.coalesce(F.sum(f"{name}_t").over(before), F.lit(0))
                                             .alias(f"{name}_o") for name in vals])
    x = x.join(offsets, ["_pid", *keys])
    for out, name in outs.items():
        x = x.withColumn(out, F.col(f"{name}_o") + F.col(f"{name}_l"))
    drop = ["_pid"] + [c for name in vals for c in (name, f"{name}_l", f"{name}_o")]
    return x.drop(*drop)
