"""Raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm.decontaminate import leaks
from tideloom.llm.minhash import near_duplicates
from tideloom.llm.mixing import mix, repeated
from tideloom.llm.sharding import with_shards
from tideloom.llm.shared import written
from tideloom.llm.toxicity import fit_toxicity

#: Documents at least this likely to be toxic go.
TOXIC = 0.3
#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20
#: Keys of rejected rows, of about 80 bytes each, that are broadcast at most.
BROADCAST_KEYS = 200_000


def _with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with what tells its rows apart, ``_row``: id and text digest,
    in a total order in which rows without an id come last. Rows that agree in
    it have the same text, so that every stage judges them alike."""
    return docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.md5("text").alias("digest")))


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """``keyed`` less the rows whose key is in ``rejected(id)``."""
    gone = written(rejected.select(F.col("id").alias("_gone")).distinct())
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return keyed.join(gone, keyed["_row"] == gone["_gone"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Score every text with models learned from the labels; reject by row."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keyed = _with_key(docs)
    return _without(keyed, model.score(keyed, "_row").where(F.col("score") >= TOXIC)).drop("_row")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays, the least by id,
    rows without an id last, then by text digest. Of rows that repeat id and
    text one stays; only those that have neither an id nor words, which are
    copies of nothing, stay all."""
    keyed = _with_key(docs)
    found = written(near_duplicates(keyed, "_row", shingle=5, percent=80).select("id", "kept", F.col("set_id").isNull().alias("wordless")))
    rest = _without(keyed, found.where(~F.col("kept")).select("id"))
    again = found.where(F.col("kept") & ~(F.col("wordless") & F.col("id.unnamed"))).groupBy("id").count().where("count > 1")
    again = written(again.select(F.col("id").alias("_again")))
    once = rest.join(again, rest["_row"] == again["_again"], "left_anti")
    more = rest.join(again, rest["_row"] == again["_again"], "left_semi").dropDuplicates(["_row"])
    return once.unionByName(more).drop("_row")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, within its edit budget, go."""
    keyed = _with_key(docs)
    return _without(keyed, leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_row")).drop("_row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return repeated(docs, mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the shard that it goes to."""
    return with_shards(docs, SHARD_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

#: Learned models and random rounding aren't SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
