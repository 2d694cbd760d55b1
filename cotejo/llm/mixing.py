"""Mixing sources to target weights by Pareto order sampling."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm.shared import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Cuts of the scale of ranks; only documents in the cut where a source's quota ends are sorted.
CUTS = 65536


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, size) rows -> a row per source: source_size, target and the parts that sampling needs.

    Sources by code point, null last, take the weights in turn. Filled like vessels: what
    exceeds `most` times a source's size is shared again by weight, until none is above.
    """
    # Longer documents are up to twice as likely: 1000 to 2000 thousandths, in whole numbers so that sums don't depend on order.
    lean = F.expr("1000 + (1000 * size) div (size + 1000)")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(lean * F.col("size")).alias("leaned"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", turn.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("open", F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level")))
    first_open = F.first("open", ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("most"), F.coalesce(first_open, F.lit(float("inf"))) * F.col("weight"))
    per = per.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return per.withColumn("whole", whole.cast("long")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")).select("source", "source_size", "leaned", "target", "whole", "extra")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Returns doc_id, size (words), source_size, target (of its source), taken (words, repeats counted), and the columns in `carry`, whose
    names must not be among the operator's own.

    Each source gets whole copies of all its documents as often as its target allows. The
    rest is a Pareto order sample: a document's inclusion probability p leans to longer
    documents so that the expected words fill the rest; its rank is the odds of a random
    number u, drawn from its id and the seed, divided by the odds of p. Documents enter in
    order of rank until the words are taken; the one at the border enters if more
    than half of it fits. No document is taken beyond `most` times.

    A histogram of ranks finds the cut of the scale where each source ends, so no source is
    sorted whole, however large. Null text has size 0; null is a source of its own. Rows of equal id
    draw the same number and stand each for itself. A null id draws as the empty string. Other columns are not looked at.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = durable(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *carry), "sizes")
    # Tables of a row per source are written: Spark then knows how small they are before it deals out the documents, a third of which can be of one source.
    targets = durable(source_targets(sizes, weights, share, most).withColumnRenamed("source", "name"), "targets")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    u = (drawn + 0.5) / F.lit(2.0**48)
    lean = F.expr("cast(1000 + (1000 * size) div (size + 1000) as double)")
    p = F.when(F.col("leaned") > 0, F.least(F.col("extra") * lean / F.col("leaned"), F.lit(0.999999))).otherwise(0.0)
    ranked = (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("p", p)
        .withColumn("u", u)
        .withColumn("rank", F.when(F.col("p") > 0, F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p"))))
        .withColumn("cut", F.floor(F.col("rank") / (1 + F.col("rank")) * CUTS))
    )
    ranked = durable(ranked.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", "rank", "cut", *carry), "ranked")
    heap = ranked.where("rank is not null").groupBy("source", "cut").agg(F.sum("size").alias("words"), F.max("extra").alias("extra"))
    upto = Window.partitionBy("source").orderBy("cut")
    border = heap.withColumn("upto", F.sum("words").over(upto)).where("upto > extra").groupBy("source").agg(F.min_by(F.struct("cut", (F.col("upto") - F.col("words")).alias("before")), "cut").alias("b"))
    border = durable(border.select(F.col("source").alias("name"), F.col("b.cut").alias("last_cut"), F.col("b.before").alias("before")), "border")
    cut = ranked.join(border, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    inside = F.col("cut") == F.col("last_cut")
    entering = Window.partitionBy("source").orderBy("rank", "doc_id", *carry).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_border = cut.where(inside).withColumn("upto", F.col("before") + F.sum("size").over(entering)).withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("extra")).cast("long"))
    clear = cut.where(~F.coalesce(inside, F.lit(False))).withColumn("more", F.coalesce((F.col("cut") < F.col("last_cut")) | F.col("last_cut").isNull() & F.col("cut").isNotNull(), F.lit(False)).cast("long"))
    names = ["doc_id", "size", "source_size", "target", *carry, (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken")]
    return clear.select(*names).unionByName(at_border.select(*names))


#: The same in SQL, over the ranks themselves.
ORACLE = r"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, CAST(sum((1000 + (1000 * size) // (size + 1000)) * size) AS DOUBLE) AS leaned FROM sizes GROUP BY source),
turns AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w FROM per),
fill AS (SELECT *, (sum(s) OVER () * 1.5e0 - coalesce(sum(s * 2.0e0) OVER e, 0.0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER e, 0.0e0)) AS level
  FROM turns WINDOW e AS (ORDER BY s * 2.0e0 / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT min_by(level, struct_pack(a := s * 2.0e0 / w, b := source IS NULL, c := source)) FILTER (level <= s * 2.0e0 / w) AS level FROM fill),
targets AS (SELECT source, s, leaned, least(s * 2.0e0, coalesce(lev.level, 'inf'::DOUBLE) * w) AS target FROM turns, lev),
wholes AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole, target - (CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END) * s AS extra FROM targets),
drawn AS (SELECT d.*, t.s, t.target, t.whole, t.extra,
  (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5e0) / 281474976710656.0e0 AS u,
  CASE WHEN t.leaned > 0 THEN least(t.extra * CAST(1000 + (1000 * d.size) // (d.size + 1000) AS DOUBLE) / t.leaned, 0.999999e0) ELSE 0e0 END AS p
  FROM sizes d JOIN wholes t ON d.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / ((1 - u) * p) END AS r FROM drawn),
taken AS (SELECT *, sum(size) OVER (PARTITION BY source, r IS NULL ORDER BY r, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN r IS NOT NULL AND upto - size / 2.0e0 <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM taken
"""
