"""Mixing sources to target weights by systematic sampling.

Sources in order of code point (NULL last) weigh 1, 2, 3, repeating. Together they take as many words as there are;
a target above ``most`` times its source's size stops there and the excess is shared again by weight, until none is above.
A document's expected copies are its source's target over its source's size. Along a fixed order of the
source's documents the expected copies are summed, one random offset is added, and a document is emitted once for
each whole number that its part of the sum crosses.

The order goes by size class, then by a hash, so each source takes words of all sizes alike. Its prefix sums come from
segments (source, class, hash byte): counts per segment are aggregated before the shuffle, a window runs over the
few thousand segments of a source, and row numbers are given within segments only. A hot source is thus spread over
thousands of groups. The offset and the order are hashes of a seed, so reruns agree.

A NULL text has size 0; documents of size 0 count in the order but carry no words. Repeated rows are documents of
their own. Without documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketops.llm.common import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
NEW = ("size", "source_size", "target", "copies", "taken")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """Per source (``source``, ``source_size``) its ``target``. One row per source: windows over all of them are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("bigint"))
    full = weighed.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    # Those that stop first have the smallest cap per weight.
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shared = full.withColumn("level", rest.cast("double") / F.sum("weight").over(after).cast("double"))
    # Past the first that does not stop the level only falls, so the largest of the rest is theirs.
    stopped = F.col("level") >= F.col("ratio")
    level = F.max(F.when(~stopped, F.col("level"))).over(everything)
    return shared.withColumn("target", F.when(stopped, F.col("cap").cast("double")).otherwise(level * F.col("weight"))).select("source", "source_size", "target")


def mix(docs: DataFrame, seed: str = "mix", most: int = 3, text: str = "text") -> DataFrame:
    """The documents with size, source_size, target, copies (how often it is emitted) and taken (its words in the mix).

    ``doc_id`` and ``source`` must exist; input columns that clash with the new ones are left out.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW]
    spark = docs.sparkSession
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))
    sized = docs.select(*kept, F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"))
    hashed = sized.withColumns({"__key": key, "__hash": F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))})
    classed = hashed.withColumn("__shift", F.greatest(F.length(F.bin("size")) - 4, F.lit(0))).withColumns(
        {"__class": F.expr("__shift * 16 + shiftright(size, __shift)"), "__part": F.substring("__hash", 1, 2)}
    )
    segment = ["__key", "__class", "__part"]
    # Counted once, read twice.
    counts = Scratch(spark).store(classed.groupBy(source.alias("source"), *segment).agg(F.count("*").alias("__n"), F.sum("size").alias("__words")))
    goals = targets(counts.groupBy("source").agg(F.sum("__words").alias("source_size")), most)
    first = Window.partitionBy("__key").orderBy("__class", "__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__base", F.coalesce(F.sum("__n").over(first), F.lit(0)))
    goals = goals.select(key.alias("__key"), "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("__key"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    bases = bases.join(goals, "__key").select(*segment, "__base", "source_size", "target", offset.alias("__offset"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    inside = Window.partitionBy(*segment).orderBy("__hash", "doc_id", "size")

    columns = [F.col(f"`{c}`") for c in sized.columns if c != "size"]
    numbered = classed.withColumn("__row", F.row_number().over(inside)).join(bases, segment)
    place = F.col("__base") + F.col("__row")
    crossed = F.floor(rate * place + F.col("__offset")) - F.floor(rate * (place - 1) + F.col("__offset"))
    return numbered.withColumn("copies", crossed).select(*columns, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy, without the columns of ``mix``."""
    rows = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return rows.drop("__copy", *NEW)


#: The same result in DuckDB, over the table ``documents``.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), 'none')) AS h FROM documents),
shifted AS (SELECT *, greatest(length(bin(size)) - 4, 0) AS shift FROM sized),
classed AS (SELECT *, shift * 16 + (size >> shift) AS class, substr(h, 1, 2) AS part FROM shifted),
weighed AS (
  SELECT k, sum(size) AS source_size, any_value(source) AS source, (row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3 + 1 AS weight
  FROM classed GROUP BY k),
capped AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM weighed),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM capped),
goals AS (
  SELECT k, CAST(source_size AS BIGINT) AS source_size, CASE WHEN level >= ratio THEN CAST(cap AS DOUBLE) ELSE max(CASE WHEN level < ratio THEN level END) OVER () * weight END AS target,
    CAST(CAST('0x' || substr(md5('mix-' || k), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS offs FROM levels),
placed AS (
  SELECT c.doc_id, c.size, g.source_size, g.target, g.offs, CASE WHEN g.source_size > 0 THEN g.target / CAST(g.source_size AS DOUBLE) ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY c.k ORDER BY class, part, h, doc_id, size) AS place
  FROM classed c JOIN goals g USING (k))
SELECT doc_id, size, source_size, round(target, 4) AS target, CAST(floor(rate * place + offs) - floor(rate * (place - 1) + offs) AS BIGINT) * size AS taken FROM placed
"""
