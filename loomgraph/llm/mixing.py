"""Mixing sources to target weights.

Token (here: word) totals per source give each source a repetition rate; every document is
emitted floor(rate) times plus one more time with probability rate - floor(rate), decided by
a seeded hash of its id, so reruns agree and no state is shared between tasks. Of a few
seeds, each source uses the one whose draws bring its total nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, own_name, own_names, plain_names, quoted, word_count

_DRAW_HEX = 8  # hexadecimal digits of a draw; an MD5 has four draws
_SEEDS = 8
_BROADCAST_BYTES = 8_000_000


def source_targets(
    sized: DataFrame,
    source_col: str = "source",
    size_col: str = "size",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """(source, source_size, target) for each source, null being a source of its own.

    Sources in code-point order (null last) weigh `weights`, repeating. They share
    share * (all sizes) by weight; no target exceeds cap * its source's size, and what a
    capped source leaves is shared by weight among the others until none is above. That
    fixed point is target = min(cap * size, level * weight) for one level, found here in
    closed form: with sources ordered by cap * size / weight, the level is the first one at
    which the source itself isn't capped. Works on one row per source only.
    """
    per_source = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % F.lit(len(weights)) + 1)
    ranked = (
        per_source.withColumn("rank", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("pool", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.withColumn(
        "level",
        (F.col("pool") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    first_free = F.min(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct("ratio", "rank", "level"))).over(everything)
    return levels.select(
        "source",
        "source_size",
        F.least(F.col("most"), F.coalesce(first_free["level"] * F.col("weight"), F.col("most"))).alias("target"),
    )


def _draw(key: str, seed: str, number: int) -> Column:
    """Draw `number` of a key, in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{number // 4}:"), F.col(key)).cast("binary"))
    return F.conv(F.substring(digest, number % 4 * _DRAW_HEX + 1, _DRAW_HEX), 16, 10).cast("double") / F.lit(float(16**_DRAW_HEX))


def _keys(df: DataFrame, id_col: str, text_col: str) -> Column:
    """What a row's draws depend on: its id, or for a null id its text."""
    return F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")), F.lit(""))


def mixing_rates(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...], share: float, cap: float, seed: str) -> DataFrame:
    """(__name, __source_size, __target, __whole, __fraction, __pick) for each source of (__source, __size, __key) rows."""
    targets = source_targets(sizes, "__source", "__size", weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long")).withColumn("fraction", F.col("rate") - F.floor("rate"))
    targets = _broadcast_if_small(scratch.write(targets.withColumnRenamed("source", "__name"), "targets"))
    drawn = sizes.join(targets, F.col("__source").eqNullSafe(F.col("__name")))
    sums = drawn.groupBy("__name", "source_size", "target", "rate", "whole", "fraction").agg(
        *[F.sum(F.col("__size") * (F.col("whole") + F.when(_draw("__key", seed, k) < F.col("fraction"), 1).otherwise(0))).alias(f"__sum_{k}") for k in range(_SEEDS)]
    )
    nearest = F.least(*[F.struct(F.abs(F.col(f"__sum_{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(_SEEDS)])["k"]
    return _broadcast_if_small(scratch.write(sums.select("__name", *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "whole", "fraction")], nearest.alias("__pick")), "rates"))


def _broadcast_if_small(sources: DataFrame) -> DataFrame:
    """Sources measured: up to _BROADCAST_BYTES they are broadcast, so that no document moves; beyond, adaptive execution splits hot ones."""
    size = sources.agg(F.coalesce(F.sum(F.octet_length(F.coalesce(F.col("__name").cast("string"), F.lit(""))) + 64), F.lit(0))).first()[0]
    return F.broadcast(sources) if size <= _BROADCAST_BYTES else sources


def with_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix-2024",
    keep: list[str] | None = None,
) -> DataFrame:
    """mix_size, mix_source_size, mix_target and mix_copies of every row, with its id or, if given, the columns `keep`.

    Null texts and texts without words have size 0; a source whose sizes are all 0 has target
    0 and no copies; an empty table gives an empty result. Repeated ids draw alike, and texts of
    any length are counted whole. A source may hold any share of the rows: texts are read once for sizes, which are pre-aggregated.
    """
    scratch = Scratch(df.sparkSession, "mix")
    slim = df.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"), _keys(df, id_col, text_col).alias("__key"))
    sizes = scratch.write(slim, "sizes")
    rates = mixing_rates(sizes, scratch, weights, share, cap, seed)
    rows, extra = (sizes, [F.col("__id").alias(id_col)]) if keep is None else (df.withColumns({"__source": F.col(source_col), "__size": word_count(F.col(text_col)), "__key": _keys(df, id_col, text_col)}), [F.col(quoted(c)) for c in keep])
    draw = F.element_at(F.array(*[_draw("__key", seed, k) for k in range(_SEEDS)]), F.col("__pick") + 1)
    joined = rows.join(rates, F.col("__source").eqNullSafe(F.col("__name")))
    copies = F.col("__whole") + F.when(draw < F.col("__fraction"), 1).otherwise(0)
    return joined.select(
        *extra,
        F.col("__size").alias("mix_size"),
        F.col("__source_size").alias("mix_source_size"),
        F.col("__target").alias("mix_target"),
        F.least(copies, F.lit(int(cap))).cast("long").alias("mix_copies"),
    )


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: each row of df as often as the mix takes it, columns unchanged."""
    held = own_names(df)
    names = {k: own_name(options.pop(k, default)) for k, default in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    taken = with_copies(held, keep=held.columns, **names, **options).where("mix_copies > 0")
    copied = taken.withColumn("__copy", F.explode(F.expr("array_repeat(0, int(mix_copies))")))
    return copied.select(*plain_names(df.columns))
