"""Mixing sources to target weights by capped water-filling, then seeded repetition."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, fresh, others, q

#: Relative weights of sources; a source that isn't listed has DEFAULT_WEIGHT.
WEIGHTS = {"src0": 4, "src1": 8, "src2": 8, "src3": 3, "src4": 2}
DEFAULT_WEIGHT = 1
#: No document is used more often than this.
MAX_EPOCHS = 4
SEED = 17
#: Bytes of the table of sources up to which it is broadcast; a larger one is joined by a shuffle, whose hot sources are split.
BROADCAST_BYTES = 8 << 20


def plan(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """Repetitions of each source: (source, size, weight, epochs), of the sources that hold any text.

    Size is characters of text. The budget (the size of the whole table, unless given) goes to the
    sources in proportion to their weights, any positive numbers; a source that would be read more than ``max_epochs``
    times is clamped there and the excess goes to the rest in proportion, until none exceeds its
    cap. That level is found at once: in the order of cap / weight the clamped sources come first.

    Sources are ordered by ranges of size / weight, and summed within each range and before it, so that they needn't fit
    one task.
    """
    listed = F.create_map([F.lit(x) for s, w in weights.items() for x in (s, float(w))]) if weights else None
    weight = F.coalesce(F.try_element_at(listed, F.col("source")), F.lit(float(default_weight))) if weights else F.lit(float(default_weight))
    sizes = docs.groupBy(q("source").cast("string").alias("source")).agg(F.sum(F.length(q("text")).cast("long")).alias("size")).where("size > 0")
    sizes = sizes.withColumn("weight", F.when(F.col("source").isNull(), F.lit(float(default_weight))).otherwise(weight)).where("weight > 0 and not isnan(weight)")
    place = (F.col("size") / F.col("weight"), F.col("source").asc_nulls_first())
    parts = cut(sizes.repartitionByRange(*place).withColumn("part", F.spark_partition_id()))
    # One row for each range.
    ranges = parts.groupBy("part").agg(F.sum("size").alias("of_size"), F.sum("weight").alias("of_weight"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.select(
        "part",
        F.coalesce(F.sum("of_size").over(earlier), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("of_weight").over(earlier), F.lit(0.0)).alias("weight_before"),
        F.sum("of_size").over(Window.partitionBy()).alias("whole_size"),
        F.sum("of_weight").over(Window.partitionBy()).alias("whole_weight"),
    )
    lower = Window.partitionBy("part").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    before = (F.col("size_before") + F.coalesce(F.sum("size").over(lower), F.lit(0))) * max_epochs
    after = F.col("whole_weight") - (F.col("weight_before") + F.coalesce(F.sum("weight").over(lower), F.lit(0.0)))
    total = F.col("whole_size") if budget is None else F.lit(budget).cast("long")
    got = parts.join(sums, "part").withColumn("level", (total - before).cast("double") / after)
    fits = got.where(F.col("level") * F.col("weight") <= F.col("size") * max_epochs)
    # Of no row where all are clamped; one row at most otherwise.
    level = fits.agg(F.min_by("level", F.struct(place[0], F.col("source").isNotNull(), "source")).alias("level"))
    most = F.lit(float(max_epochs))
    share = F.greatest(F.lit(0.0), F.least(F.col("level") * F.col("weight") / F.col("size"), most))
    return parts.crossJoin(level).select("source", "size", "weight", F.coalesce(share, most).alias("epochs"))


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, max_epochs: int = MAX_EPOCHS, budget: int | None = None, seed: int = SEED, copy: str | None = "copy") -> DataFrame:
    """The documents, each as often as its source's epochs say, with ``copy`` counting from 1.

    The whole part of the epochs gives that many copies; one more goes to those documents whose
    number in [0, 1), made of the seed and the doc_id (of the text where that is null), is below the
    fraction. Rows that repeat a doc_id share that number.

    A null source is a source of its own, with the default weight. Sources without any text, and
    those whose weight isn't above 0, give no rows; a null or empty text in another source counts 0 and is repeated
    as its source is. An empty table stays empty. Other columns are kept; one named as ``copy`` is replaced. Where
    that is None, copies aren't numbered.
    """
    keep = others(docs, copy) if copy else docs.columns
    docs = docs.select([q(c) for c in keep])
    source, epochs, draw = fresh(docs, "mix_source", "epochs", "draw")
    epochs_of = cut(plan(docs, weights, default_weight, max_epochs, budget).select(F.col("source").alias(source), F.col("epochs").alias(epochs)))
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(q("doc_id").cast("string"), F.md5(q("text").cast("binary")), F.lit("")))
    number = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = (F.floor(q(epochs)) + F.when(number < q(epochs) - F.floor(q(epochs)), 1).otherwise(0)).cast("int")
    numbers = F.explode(F.sequence(F.lit(1), q(draw)))
    size = epochs_of.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(q(source)), F.lit(0)) + 32), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:  # or a shuffle would move all texts
        epochs_of = F.broadcast(epochs_of)
    got = docs.join(epochs_of, q("source").cast("string").eqNullSafe(q(source))).withColumn(draw, copies).where(q(draw) > 0)
    return got.select(*[q(c) for c in keep], numbers.alias(copy or source)).select(*[q(c) for c in keep], *([q(copy)] if copy else []))


def sql(weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, docs: str = "documents") -> str:
    """The same in DuckDB SQL, over a table of documents."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    case = "case source " + " ".join(f"when {text(s)} then {float(w)!r}" for s, w in weights.items()) + f" else {float(default_weight)!r} end" if weights else repr(float(default_weight))
    return f"""
with sizes as (
  select source, cast(sum(length(text)) as bigint) as size, cast({case} as double) as weight
  from {docs} group by source having sum(length(text)) > 0
), ordered as (
  select *, row_number() over o as nth, sum(size) over () as total,
         coalesce(sum(size) over (o rows between unbounded preceding and 1 preceding), 0) * {max_epochs} as before,
         sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) as after
  from sizes where weight > 0
  window o as (order by size / weight, source nulls first)
), levels as (
  select *, cast(total - before as double) / after as level,
         cast(total - before as double) / after * weight <= size * {max_epochs} as fits
  from ordered
), epochs as (
  select source, case when bool_or(fits) over ()
    then greatest(0.0::double, least(min_by(level, case when fits then nth end) over () * weight / size, {max_epochs}.0::double))
    else {max_epochs}.0::double end as epochs
  from levels
), drawn as (
  select d.*, cast(floor(epochs) as bigint) + case when
      cast('0x' || substr(md5('{seed}|' || coalesce(cast(doc_id as varchar), md5(text), '')), 1, 13) as bigint)::double / 4503599627370496.0::double
      < epochs - floor(epochs) then 1 else 0 end as copies
  from {docs} d join epochs e on d.source is not distinct from e.source
)
select doc_id, text, lang, source, n_chars, cast(unnest(range(1, copies + 1)) as int) as copy from drawn where copies > 0
"""
