"""Mix sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / size of the source`` times. The
whole part is given; the fractions are rounded in pairs, one word of mass moving
up for each that moves down until one of the two is whole, up or down by chance
so that every fraction is kept in expectation. A fold rounds a chunk of
documents down to one fractional survivor; the survivors of many chunks are
folded again, which is a reduction tree whose root leaves at most one document
a source to be rounded alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import numbered, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one fold takes, on average, and what a level divides by.
CHUNK = 48


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    ``share`` times all sizes is dealt out by weight, the weights repeating
    over the sources by code point, null last. A target stops at ``most`` times
    its source's size and the rest goes to the others by weight. In order of
    cap over weight the capped sources come first, so one pass of running sums
    finds the level at which all shares fit. One row a source goes through one
    task; documents don't.
    """
    ranked = sizes.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", "n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    caps = caps.withColumn("all_w", F.sum("w").over(every)).withColumn("all_size", F.sum("source_size").over(every))
    left = F.col("all_size") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    caps = caps.withColumn("level", left / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    caps = caps.withColumn("open", F.col("level") <= F.col("ratio"))
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("ratio", "n"))).over(every)
    return caps.withColumn("at", level).select("source", "source_size", F.when(F.col("open"), F.least(F.col("at") * F.col("w"), F.col("cap"))).otherwise(F.col("cap")).alias("target"))


_STEP = """
transform(array(named_struct(
    'p', s.cur, 'q', e,
    'up', least(1 - s.cur.x, e.x * e.size / s.cur.size),
    'down', least(s.cur.x, (1 - e.x) * e.size / s.cur.size),
    'u', pmod(xxhash64(s.cur.id, s.cur.size, e.id, e.size, {level}, {seed}), 9007199254740992) / 9007199254740992D
)), t -> transform(array(named_struct(
    'p', t.p, 'q', t.q,
    'rise', t.u * (t.up + t.down) < t.down,
    'first', if(t.u * (t.up + t.down) < t.down, 1 - t.p.x <= t.q.x * t.q.size / t.p.size, t.p.x <= (1 - t.q.x) * t.q.size / t.p.size)
)), v -> named_struct(
    'cur', if(v.first,
        named_struct('size', v.q.size, 'id', v.q.id, 'm', v.q.m, 'whole', v.q.whole, 'x', greatest(0D, least(1D, if(v.rise, v.q.x - (1 - v.p.x) * v.p.size / v.q.size, v.q.x + v.p.x * v.p.size / v.q.size)))),
        named_struct('size', v.p.size, 'id', v.p.id, 'm', v.p.m, 'whole', v.p.whole, 'x', greatest(0D, least(1D, if(v.rise, v.p.x + v.q.x * v.q.size / v.p.size, v.p.x - (1 - v.q.x) * v.q.size / v.p.size))))),
    'done', concat(s.done, array(if(v.first,
        named_struct('size', v.p.size, 'id', v.p.id, 'm', v.p.m, 'whole', v.p.whole, 'x', if(v.rise, 1D, 0D)),
        named_struct('size', v.q.size, 'id', v.q.id, 'm', v.q.m, 'whole', v.q.whole, 'x', if(v.rise, 0D, 1D)))))
))[0])[0]
"""


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(id, source, size, rows, copies, source_size, target): how many copies in
    all the mix takes of the ``rows`` rows of ``docs`` with that id, source and
    size, each getting ``copies / rows`` rounded down or up.

    ``size`` is the number of words (null text: 0). Decisions hang on id, size
    and ``seed`` only, so reruns agree on any cluster. Rows alike in all three
    are one unit, which keeps a much repeated id from gathering in one chunk.
    Documents without words are taken floor(target / size) times; a source
    without words has target 0. An empty input gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    units = written(sized.groupBy("id", "source", "size").agg(F.count("*").alias("m")))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("units"))
    dealt = targets(sources.select("source", "source_size"), weights, share, most)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    dealt = dealt.join(sources.select(F.col("source").alias("s"), "units"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = written(dealt.withColumn("rate", rate))

    mass = F.col("m") * (F.col("rate") - F.floor("rate"))
    start = units.alias("u").join(dealt.select(F.col("source").alias("s"), "rate", "units"), F.col("u.source").eqNullSafe(F.col("s"))).drop("s")
    start = start.withColumn("whole", (F.col("m") * F.floor("rate") + F.floor(mass)).cast("bigint")).withColumn("x", mass - F.floor(mass))
    start = start.select("source", "size", "id", "m", "whole", F.when(F.col("size") == 0, 0.0).otherwise(F.col("x")).alias("x"), F.col("units").alias("n"))
    edge = (F.col("x") < 1e-12) | (F.col("x") > 1 - 1e-12)
    settled = [start.where(edge).select("source", "size", "id", "m", F.col("whole") + F.round("x").cast("bigint"))]
    alive = start.where(~edge)

    largest = dealt.agg(F.max("units")).first()[0] or 0
    level = 0
    while largest > 1:
        # Rows are dealt to the chunks of their source by hash; each chunk's
        # largest come first, so that what survives is mostly small.
        chunks = F.ceil(F.col("n") / CHUNK)
        chunk = F.pmod(F.xxhash64("id", "size", F.lit(seed), F.lit(level)), chunks)
        grouped = alive.groupBy("source", chunk.alias("chunk"), chunks.alias("n")).agg(
            F.sort_array(F.collect_list(F.struct("size", "id", "m", "whole", "x")), asc=False).alias("us")
        )
        fold = f"""aggregate(slice(us, 2, greatest(size(us) - 1, 0)), named_struct('cur', us[0], 'done', slice(us, 1, 0)), (s, e) -> {_STEP.format(level=level, seed=seed)})"""
        folded = grouped.withColumn("f", F.expr(fold))
        both = F.concat(F.transform("f.done", lambda d: F.struct(F.lit(False).alias("alive"), d.alias("d"))), F.array(F.struct(F.lit(True).alias("alive"), F.col("f.cur").alias("d"))))
        step = written(folded.select("source", F.col("n").cast("bigint").alias("n"), F.explode(both).alias("r")).select("source", "n", "r.alive", "r.d.*"))
        settled.append(step.where("not alive").select("source", "size", "id", "m", F.col("whole") + F.col("x").cast("bigint")))
        alive = step.where("alive").select("source", "size", "id", "m", "whole", "x", "n")
        largest = -(-largest // CHUNK)
        level += 1
    # The root: one document a source at most, rounded to the nearer side.
    settled.append(alive.select("source", "size", "id", "m", F.col("whole") + F.when(F.col("x") >= 0.5, 1).otherwise(0).cast("bigint")))

    out = settled[0].toDF("source", "size", "id", "rows", "copies")
    for part in settled[1:]:
        out = out.union(part.toDF("source", "size", "id", "rows", "copies"))
    told = dealt.select(F.col("source").alias("s"), "source_size", "target")
    return out.join(told, F.col("source").eqNullSafe(F.col("s"))).select("id", "source", "size", "rows", "copies", "source_size", "target")


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it."""
    sized = docs.withColumn("_mix_size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint"))
    told = mixed.where("copies > 0").select(F.col("id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_words"), F.col("rows").alias("_mix_rows"), F.col("copies").alias("_mix_copies"))
    out = sized.join(told, F.col(id_col).eqNullSafe(F.col("_mix_id")) & F.col(source_col).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_size") == F.col("_mix_words")))
    one = out.where("_mix_rows = 1").withColumn("_mix_take", F.col("_mix_copies"))
    many = out.where("_mix_rows > 1").withColumns({"_mix_text": F.xxhash64(text_col), "_mix_part": F.spark_partition_id()})
    many = numbered(written(many), ["_mix_id", "_mix_source", "_mix_words"], ["_mix_text", "_mix_part"], "_mix_n").withColumn("_mix_n", F.col("_mix_n") + 1)
    more = F.when(F.col("_mix_n") <= F.col("_mix_copies") % F.col("_mix_rows"), 1).otherwise(0)
    many = many.withColumn("_mix_take", F.floor(F.col("_mix_copies") / F.col("_mix_rows")) + more).drop("_mix_n", "_mix_text", "_mix_part")
    out = one.unionByName(many).where("_mix_take > 0").withColumn("_mix_each", F.explode(F.sequence(F.lit(1), F.col("_mix_take").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
