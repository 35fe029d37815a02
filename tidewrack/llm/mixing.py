"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source gets an integer quota of equal blocks, by highest quotients of its
target; every source's quota is split the same way over its shards (a seeded
hash of doc_id), and in each shard a run of blocks is taken, in a seeded order
of the documents and from a seeded place. All of it is DataFrame code; the text
is read once, and only (doc_id, source, size) rows are shuffled.

A hot source is no single group: the shards grow as the square root of the
number of documents, so a window holds about as many rows as there are shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, staged

BLOCK_WORDS = 8
SEED = 17
MAX_REPEAT = 3


def seeded(seed: object, col: Column) -> Column:
    """A number of 32 bits from the md5 of seed and col."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds rank, weight and target to (source, source_size), one row a source.

    Weights are 1, 2, 3, repeating, by the sources' code points, null last. The
    targets share the whole size by weight; none is above max_repeat times its
    source's size, and what is cut off goes to the others by weight. With the
    sources in the order of cap by weight, the first that its share doesn't
    fill decides the share of all after it.
    """
    everything = Window.partitionBy()
    before = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
        .withColumn("weight", (F.col("rank") - 1) % 3 + 1)
        .withColumn("cap", max_repeat * F.col("source_size"))
        .withColumn("fill", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("open", F.col("fill") > F.col("rest").cast("double") / F.col("rest_weight"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("fill", "rank", "rest", "rest_weight"))).over(everything))
        .withColumn(
            "target",
            F.when(
                F.struct("fill", "rank") >= F.struct("level.fill", "level.rank"),
                (F.col("weight") * F.col("level.rest")).cast("double") / F.col("level.rest_weight"),
            ).otherwise(F.col("cap").cast("double")),
        )
        .select("source", "source_size", "rank", "weight", "target")
    )


def apportion(parties: DataFrame, votes: str, seats: str, by: list[str], tie: str, to: str) -> DataFrame:
    """Adds the seats of each party by the Sainte-Laguë method, exactly, within the groups of by.

    The highest quotients votes/1, votes/3, ... get the seats; ties go by tie.
    No more than about four quotients a party are listed: with n parties, a
    divisor of all/(seats - n/2) gives at most seats and at least seats - n of
    them, so only the quotients next below it have to be ranked.
    """
    group = Window.partitionBy(*by)
    n, everything = F.count(F.lit(1)).over(group), F.sum(votes).over(group)
    sized = (
        parties.withColumn("_n", n)
        .withColumn("_all", everything.cast("double"))
        .withColumn("_share", F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0))
        .withColumn("_base", F.floor(F.greatest(F.lit(0.0), F.col(seats) - F.col("_n") / 2) * F.col("_share") + F.when(F.col(seats) > F.col("_n") / 2, 0.5).otherwise(0.0)).cast("long"))
        .withColumn("_more", (F.floor(F.least(F.col("_n").cast("double"), F.col(seats) + F.col("_n") / 2) * F.col("_share")) + 2).cast("int"))
        .withColumn("_left", F.col(seats) - F.sum("_base").over(group))
    )
    ranked = sized.withColumn("_k", F.explode(F.sequence(F.col("_base"), F.col("_base") + F.col("_more") - 1)))
    order = Window.partitionBy(*by).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(tie).asc_nulls_last(), F.col("_k"))
    ranked = ranked.withColumn("_won", ((F.row_number().over(order) <= F.col("_left")) & (F.col(votes) > 0)).cast("long"))
    keys = [c for c in parties.columns]
    return ranked.groupBy(*keys).agg((F.max("_base") + F.sum("_won")).alias(to))


def mix(docs: DataFrame, *, block_words: int = BLOCK_WORDS, seed: int = SEED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix of docs (doc_id, text, source; other columns are left out).

    Returns a row for each document: doc_id, source, size, source_size, target,
    shard, blocks and quota (of its source in its shard), taken.

    Nulls: a null text has size 0, a null source is a source of its own and the
    last, a null doc_id is hashed as the empty string. Documents without words
    take nothing; no documents, no rows. Rows that repeat are documents of their
    own. Equal rows get the same result up to which of them is which.
    """
    sizes = staged(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "mix-sizes",
    )
    count = sizes.count()
    shards = max(1, math.ceil(math.sqrt(count) / 8))
    order = seeded(seed, F.col("doc_id"))
    placed = sizes.withColumn("order", order).withColumn("shard", F.col("order") % shards)
    cells = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    cells = cells.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))

    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), max_repeat)
    sources = sources.withColumn("_seats", F.floor(F.sum("source_size").over(Window.partitionBy()) / block_words + 0.5).cast("long"))
    sources = apportion(sources, "target", "_seats", [], "rank", "source_quota").drop("_seats")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    cells = cells.join(sources, same(cells, sources)).drop(sources["source"])
    # the rank stands for the source from here on: it is never null
    cells = apportion(cells, "words", "source_quota", ["rank"], "shard", "quota").withColumn("quota", F.least("quota", max_repeat * F.col("blocks")))
    quotas = cells.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "source_size", "target", "words", "blocks", "quota")

    run = Window.partitionBy("source", "shard").orderBy("order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("hi", F.sum("size").over(run)).withColumn("lo", F.col("hi") - F.col("size"))
    full = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.greatest(F.col("blocks"), F.lit(1)))).otherwise(0).cast("long")
    joined = (
        lined.join(quotas, lined["source"].eqNullSafe(quotas["_source"]) & (lined["shard"] == quotas["_shard"]))
        .withColumn("full", full)
        .withColumn("part", F.col("quota") - F.col("full") * F.col("blocks"))
        .withColumn("from", seeded(f"{seed}:run", F.concat_ws(":", F.coalesce("source", F.lit("")), F.col("shard").cast("string"))) % F.greatest(F.col("blocks"), F.lit(1)))
    )

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.least(F.col("hi"), b) - F.greatest(F.col("lo"), a), F.lit(0))

    end = F.col("from") + F.col("part")
    first = overlap(F.col("from") * block_words, F.least(end * block_words, F.col("words")))
    around = overlap(F.lit(0), F.greatest(end - F.col("blocks"), F.lit(0)) * block_words)
    return joined.select("doc_id", "source", "size", "source_size", "target", "shard", "blocks", "quota", (F.col("full") * F.col("size") + first + around).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, seed: int = SEED, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them: a document that is taken
    k and a fraction times comes k times, or once more by a seeded draw at that
    fraction, so that each source's words come near its target. Rows that share
    a doc_id share their mean; documents without words don't come."""
    key, copies, number = (fresh(docs.columns, c) for c in ("mixed_id", "copies", "copy_number"))
    draw = seeded(f"{seed}:copy", F.col("doc_id")) / F.lit(float(2**32))
    times = (
        mix(docs, seed=seed, **options)
        .groupBy("doc_id")
        .agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
        .where("size > 0")
        .select(F.col("doc_id").alias(key), F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias(copies))
        .where(F.col(copies) > 0)
    )
    joined = docs.join(times, docs["doc_id"].eqNullSafe(F.col(key)))
    return joined.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def oracle_sql(block_words: int = BLOCK_WORDS, seed: int = SEED, max_repeat: int = MAX_REPEAT) -> str:
    """The same mix in DuckDB SQL, with every quotient of the apportionments listed."""
    hashed = lambda salt, x: f"('0x' || substr(md5('{salt}:' || {x}), 1, 8))::BIGINT"
    return f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         {hashed(seed, "coalesce(doc_id::VARCHAR, '')")} AS ord
  FROM documents),
shards AS (SELECT greatest(1, ceil(sqrt(count(*)) / 8))::BIGINT AS n FROM sizes),
placed AS (SELECT s.*, ord % n AS shard FROM sizes s, shards),
cells AS (SELECT source, shard, sum(size)::BIGINT AS words, ceil(sum(size) / {block_words})::BIGINT AS blocks FROM placed GROUP BY ALL),
sources AS (SELECT source, sum(words)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM cells GROUP BY source),
weighed AS (SELECT *, (rnk - 1) % 3 + 1 AS weight, {max_repeat} * source_size AS cap FROM sources),
filled AS (
  SELECT *, cap::DOUBLE / weight AS fill,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM weighed),
level AS (SELECT * FROM filled WHERE fill > rest::DOUBLE / rest_weight ORDER BY fill, rnk LIMIT 1),
targeted AS (
  SELECT f.*, CASE WHEN l.rnk IS NOT NULL AND (f.fill > l.fill OR f.fill = l.fill AND f.rnk >= l.rnk)
                   THEN (f.weight * l.rest)::DOUBLE / l.rest_weight ELSE f.cap::DOUBLE END AS target
  FROM filled f LEFT JOIN level l ON true),
seats AS (SELECT floor(sum(source_size) / {block_words} + 0.5)::BIGINT AS n FROM sources),
quotients AS (SELECT rnk, target / (2 * k + 1) AS q, k FROM targeted, seats, LATERAL (SELECT unnest(range(0, ceil(target / {block_words})::BIGINT + 3)) AS k) WHERE target > 0),
won AS (SELECT rnk, count(*) AS source_quota FROM (SELECT *, row_number() OVER (ORDER BY q DESC, rnk, k) AS place FROM quotients), seats WHERE place <= n GROUP BY rnk),
cells2 AS (SELECT c.*, t.rnk, t.source_size, t.target, coalesce(w.source_quota, 0) AS source_quota
  FROM cells c JOIN targeted t ON c.source IS NOT DISTINCT FROM t.source LEFT JOIN won w ON w.rnk = t.rnk),
quotients2 AS (SELECT rnk, shard, source_quota, words / (2 * k + 1) AS q, k FROM cells2, LATERAL (SELECT unnest(range(0, ceil(words * source_quota / greatest(source_size, 1))::BIGINT + 3)) AS k) WHERE words > 0),
won2 AS (SELECT rnk, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY rnk ORDER BY q DESC, shard, k) AS place FROM quotients2) WHERE place <= source_quota GROUP BY ALL),
quotas AS (SELECT c.*, least(coalesce(w.quota, 0), {max_repeat} * blocks) AS quota FROM cells2 c LEFT JOIN won2 w USING (rnk, shard)),
lined AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY ord, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS hi FROM placed),
joined AS (
  SELECT l.doc_id, l.size, q.source_size, q.target, hi, hi - size AS lo, words, blocks,
    CASE WHEN blocks > 0 THEN quota // greatest(blocks, 1) ELSE 0 END AS full_,
    CASE WHEN blocks > 0 THEN quota % greatest(blocks, 1) ELSE 0 END AS part,
    {hashed(f"{seed}:run", "coalesce(l.source, '') || ':' || l.shard::VARCHAR")} % greatest(blocks, 1) AS frm
  FROM lined l JOIN quotas q ON l.source IS NOT DISTINCT FROM q.source AND l.shard = q.shard)
SELECT doc_id, size, source_size, target,
  (full_ * size
   + greatest(least(hi, least((frm + part) * {block_words}, words)) - greatest(lo, frm * {block_words}), 0)
   + greatest(least(hi, greatest(frm + part - blocks, 0) * {block_words}) - lo, 0))::BIGINT AS taken
FROM joined"""
