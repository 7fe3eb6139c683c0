"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the corpus's characters; its repetition rate is
the target over what it has.  A document's number of copies is a Poisson variable
with that mean, found by inverting the distribution at a number hashed from seed and
document id, so a repeated run or a recomputed partition gives the same copies.  The
copies are then put in one global random order.  Built-in expressions only.

Defined results: a null source is a source of its own; a null text has no characters;
a source without characters keeps each document about once (rate 1), as does one that
the given weights leave out when ``others`` is 1; rows that repeat a doc_id get equal
counts; an empty table gives an empty result.  Columns of the input stay as they are;
``copy`` and ``shuffle_key`` get an underscore appended where the input has that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellwatch.llm.shared import own_column, stored

SEED = "mix-1"
#: Exponent of the default targets: a source's target share is its share to this power, rescaled.
SMOOTHING = 0.5
#: 13 hexadecimal digits of a hash, as a fraction.
_HASH_RANGE = float(1 << 52)


def hashed_fraction(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the given parts alone."""
    text = F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_HASH_RANGE)


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, smoothing: float = SMOOTHING,
                     others: float = 0.0) -> DataFrame:
    """``(source, rate)``; ``weights`` gives target shares, else shares to the power of ``smoothing``."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    sizes = stored(sizes, "mix-sizes")  # a row per source, read twice
    totals = sizes.agg(F.sum("size").alias("size"), F.sum(F.pow(F.col("size"), F.lit(smoothing))).alias("smooth")).collect()[0]
    total = F.lit(totals["size"] or 0.0)
    if weights is None:
        target = F.pow(F.col("size"), F.lit(smoothing)) / F.lit(totals["smooth"] or 1.0) * total
        rate = target / F.col("size")
    else:
        whole = float(sum(weights.values()))
        rate = F.lit(others)
        for name, weight in weights.items():
            rate = F.when(F.col("source") == name, F.lit(weight / whole) * total / F.col("size")).otherwise(rate)
    return sizes.select("source", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``(source, cumulative)``: the distribution function at 0, 1, 2, ... up to where double precision ends.

    Its length grows with the rate, as the copies of each document do.  Probabilities
    are summed logarithms, so that a large rate doesn't underflow.
    """
    steps = rates.select(
        "source", "rate",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int"))).alias("k"))
    order = Window.partitionBy("source").orderBy("k")
    log_ratio = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.log(F.col("rate") / F.col("k")))
    summed = steps.where("rate > 0").withColumn("p", F.exp(F.sum(log_ratio).over(order) - F.col("rate")))
    summed = summed.withColumn("c", F.sum("p").over(order))
    return summed.groupBy("source").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cumulative"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, smoothing: float = SMOOTHING,
        others: float = 0.0, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` with ``copy`` (from 0) and ``shuffle_key``, in the order of the key."""
    # A small table of known size, so that Spark decides on a broadcast before it reads texts.
    tables = stored(poisson_tables(repetition_rates(docs, weights, smoothing, others)), "mix-rates")
    copy, key, cumulative = (own_column(docs, n) for n in ("copy", "shuffle_key", "cumulative"))
    source = own_column(docs, "mix_source")
    tables = tables.select(F.col("source").alias(source), F.col("cumulative").alias(cumulative))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    u, count = own_column(docs, "u"), own_column(docs, "copies")
    counted = (
        docs.join(tables, F.col("source").eqNullSafe(F.col(source)))
        .withColumn(u, hashed_fraction(seed, "count", name))
        .withColumn(count, F.expr(f"size(filter(`{cumulative}`, c -> c <= `{u}`))"))
        .where(F.col(count) > 0)
    )
    copies = counted.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(copy))
    keyed = copies.withColumn(key, F.md5(F.concat_ws("/", F.lit(seed), F.lit("order"), name, F.col(copy).cast("string"))))
    return keyed.orderBy(key)


def oracle_sql(smoothing: float = SMOOTHING, seed: str = SEED) -> str:
    return f"""
    with sizes as (select source, sum(coalesce(length(text), 0))::double as size from documents group by source),
    rates as (
      select source, case when size > 0
        then pow(size, {smoothing}) / sum(pow(size, {smoothing})) over () * sum(size) over () / size else 1.0 end as rate
      from sizes),
    steps as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::bigint + 1)) as k from rates where rate > 0),
    p as (select source, k, exp(sum(case when k = 0 then 0.0 else ln(rate / k) end)
      over (partition by source order by k) - rate) as p from steps),
    tables as (select source, k, sum(p) over (partition by source order by k) as c from p),
    cumulatives as (select source, list(c order by k) as cumulative from tables group by source),
    counted as (
      select d.*, len(list_filter(t.cumulative, lambda c: c <=
        ('0x' || substr(md5('{seed}/count/' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::ubigint::double / {_HASH_RANGE:.1f})) as copies
      from documents d join cumulatives t on d.source is not distinct from t.source),
    copies as (select * exclude (copies), unnest(range(0, copies))::int as copy from counted where copies > 0)
    select *, md5('{seed}/order/' || coalesce(doc_id::varchar, 'null') || '/' || copy::varchar) as shuffle_key from copies
    """
