"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is an ordered stream of its shuffled documents, cut into blocks of equally
many tokens.  Slots ``j = 0, 1, ...`` of the mix carry the points of the golden-ratio
sequence; a point falls into the interval of one source, whose length is the slots that the
source's target needs.  The r-th slot of a source takes its block ``r mod blocks``, so the
passes over a source stay balanced and the mix keeps its proportions in every prefix.

Built from DataFrame operations only.  Order within a source and the rank of its slots are
running sums in two levels (within chunks, then over chunk totals), so a source that holds
a third of all rows is spread over many tasks.  Single-task windows see one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinfold.runtime import materialise

#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source stops at so many passes over itself.
MOST_PASSES = 3
#: The golden ratio and a second odd multiplier, as fractions of 2**32.
GOLDEN, SCATTER = 2654435769, 2654435761
#: Tokens a block holds at least; about so many slots in all; blocks a source has at least.
LEAST_BLOCK, SLOTS, LEAST_BLOCKS = 16, 1 << 20, 64
#: Intervals are held in sixteenths of a slot; ranks and offsets run in chunks.
FINE, SLOT_CHUNK, DOC_CHUNKS = 16, 1 << 16, 1 << 10
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Water-filling of targets over ``sizes(source, source_size)``, one row a source.

    Returns ``rn, source, source_size, target``.  ``rn`` ranks sources by code point, null
    last.  Targets share the total size by weight, stop at ``most`` times a source's size,
    and what is left goes to the others by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    lcm = 1
    for x in weights:
        lcm *= x
    listed = (
        sizes.withColumn("rn", F.row_number().over(by_name))
        .withColumn("w", w.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("fills", F.col("cap") * (F.lit(lcm) / F.col("w")).cast("long"))
    )
    earlier = Window.orderBy("fills", "rn").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    placed = (
        listed.withColumn("cap0", F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn("w0", F.coalesce(F.sum("w").over(earlier), F.lit(0)))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("full", ((F.col("all_size") - F.col("cap0")) * F.col("w")).cast("double") >= F.col("cap").cast("double") * (F.col("all_w") - F.col("w0")))
        .withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("full_w", F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(everything), F.lit(0)))
    )
    share = (F.col("w") * (F.col("all_size") - F.col("full_cap"))).cast("double") / (F.col("all_w") - F.col("full_w")).cast("double")
    return placed.select("rn", "source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def slot_schedule(sources: DataFrame) -> DataFrame:
    """Slots ``(slot, rn, turn, block)`` of the mix for ``sources`` with ``rn, blocks, need``.

    ``need`` is the slots a source should get, in sixteenths.  ``turn`` is the rank of the
    slot among its source's, from 0; turns beyond ``MOST_PASSES`` passes are left out.
    """
    spark = sources.sparkSession
    total, n = sources.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    cells = 1024 + 4 * n
    width = max(1, -(-total // cells))
    ends = sources.select("rn", "blocks", "need", F.sum("need").over(Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)).alias("hi"))
    spans = ends.where("need > 0").select("rn", "blocks", (F.col("hi") - F.col("need")).alias("lo"), "hi")
    spans = spans.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    # a slot's point of 30 bits, scaled to the length of all intervals
    point = F.shiftright((F.col("id") % (1 << 31)) * F.lit(GOLDEN) % (1 << 32), 2)
    slots = spark.range(-(-total // FINE)).select(F.col("id").alias("slot"), F.shiftright(point * F.lit(total), 30).alias("p"))
    slots = slots.withColumn("cell", F.expr(f"p div {width}"))
    owned = slots.join(spans, "cell").where("p >= lo and p < hi").select("slot", "rn", "blocks", F.expr(f"slot div {SLOT_CHUNK}").alias("chunk"))
    counts = owned.groupBy("rn", "chunk").agg(F.count("*").alias("c"))
    before = counts.select("rn", "chunk", (F.sum("c").over(Window.partitionBy("rn").orderBy("chunk")) - F.col("c")).alias("before"))
    turn = F.row_number().over(Window.partitionBy("rn", "chunk").orderBy("slot")) - 1 + F.col("before")
    ranked = owned.join(before, ["rn", "chunk"]).withColumn("turn", turn)
    return ranked.where(F.col("turn") < MOST_PASSES * F.col("blocks")).select("slot", "rn", "turn", (F.col("turn") % F.col("blocks")).alias("block"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    A null text has size 0 and is taken 0 times; a null source is a source of its own, last
    in order.  Repeated rows stay repeated, each with its own place in the stream.  Null ids
    are ordered by size.  An empty table gives an empty result.  Other columns are ignored.
    """
    sized = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")),
        "mix-sizes",
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    most = max(LEAST_BLOCK, total // SLOTS)
    block = F.greatest(F.lit(1), F.least(F.lit(most), F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("long")
    sources = materialise(
        targets.withColumn("len", block)
        .withColumn("blocks", F.expr("(source_size + len - 1) div len"))
        .withColumn("need", F.floor(F.col("target") * FINE / F.col("len")).cast("long")),
        "mix-sources",
    )
    times = slot_schedule(sources).groupBy("rn", "block").agg(F.count("*").alias("times"))

    key = F.pmod(F.coalesce("doc_id", "size"), F.lit(1 << 31)) * F.lit(SCATTER) % (1 << 32)
    placed = _with_source(sized, sources)
    placed = placed.withColumn("key", key).withColumn("chunk", F.shiftright("key", 32 - (DOC_CHUNKS - 1).bit_length()))
    sums = placed.groupBy("rn", "chunk").agg(F.sum("size").alias("c"))
    before = sums.select("rn", "chunk", (F.sum("c").over(Window.partitionBy("rn").orderBy("chunk")) - F.col("c")).alias("before"))
    inside = Window.partitionBy("rn", "chunk").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    streamed = placed.where("size > 0").join(before, ["rn", "chunk"]).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    pieces = streamed.select(
        "rn", "start", "doc_id", "size", "len", F.explode(F.sequence(F.expr("start div len"), F.expr("(start + size - 1) div len"))).alias("block")
    ).withColumn("part", F.least(F.expr("start + size"), F.expr("(block + 1) * len")) - F.greatest(F.col("start"), F.expr("block * len")))
    # a stream position is one document, so it also tells repeated rows apart
    taken = (
        pieces.join(times, ["rn", "block"], "left")
        .groupBy("rn", "start", "doc_id", "size")
        .agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
        .select("rn", "doc_id", "size", "taken")
    )
    empty = placed.where("size = 0").select("rn", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).join(sources.select("rn", "source_size", "target"), "rn").select("doc_id", "size", "source_size", "target", "taken")


def _with_source(sized: DataFrame, sources: DataFrame) -> DataFrame:
    known = sources.select(F.col("source").alias("own"), "rn", "len")
    return sized.join(known, F.col("source").eqNullSafe(F.col("own"))).select("doc_id", "size", "rn", "len")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
ranked AS (
  SELECT source, source_size, rn, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS rn FROM sized GROUP BY source)),
filled AS (
  SELECT *, coalesce(sum(cap) OVER e, 0)::BIGINT AS cap0, coalesce(sum(w) OVER e, 0)::BIGINT AS w0,
         sum(source_size) OVER ()::BIGINT AS all_size, sum(w) OVER ()::BIGINT AS all_w
  FROM ranked WINDOW e AS (ORDER BY cap * (10 // w), rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, ((all_size - cap0) * w)::DOUBLE >= cap::DOUBLE * (all_w - w0) AS is_full FROM filled),
targets AS (
  SELECT rn, source, source_size, all_size,
         CASE WHEN is_full THEN cap::DOUBLE ELSE (w * (all_size - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)::BIGINT))::DOUBLE
              / (all_w - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0)::BIGINT)::DOUBLE END AS target
  FROM flagged),
blocked AS (SELECT *, greatest(1, least(greatest(16, all_size // 1048576), source_size // 64))::BIGINT AS len FROM targets),
sources AS (
  SELECT *, (source_size + len - 1) // len AS blocks, floor(target * 16 / len)::BIGINT AS need,
         sum(floor(target * 16 / len)::BIGINT) OVER (ORDER BY rn)::BIGINT AS hi FROM blocked),
total AS (SELECT sum(need)::BIGINT AS t FROM sources),
slots AS (
  SELECT j AS slot, ((((j % 2147483648) * 2654435769 % 4294967296) >> 2) * (SELECT t FROM total)) >> 30 AS p
  FROM (SELECT unnest(range(0, (SELECT (t + 15) // 16 FROM total)))::BIGINT AS j)),
turns AS (
  SELECT rn, blocks, row_number() OVER (PARTITION BY rn ORDER BY slot) - 1 AS turn FROM slots JOIN sources ON p >= hi - need AND p < hi),
times AS (SELECT rn, turn % blocks AS block, count(*) AS times FROM turns WHERE turn < 3 * blocks GROUP BY ALL),
streamed AS (
  SELECT doc_id, size, s.rn, s.len, s.source_size, s.target,
         sum(size) OVER (PARTITION BY s.rn ORDER BY (coalesce(doc_id, size) % 2147483648) * 2654435761 % 4294967296, doc_id, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT *, unnest(range(start // len, (start + size - 1) // len + 1)) AS block FROM streamed WHERE size > 0),
parts AS (
  SELECT p.rn, start, doc_id, size, source_size, target,
         sum((least(start + size, (p.block + 1) * len) - greatest(start, p.block * len)) * coalesce(times, 0))::BIGINT AS taken
  FROM pieces p LEFT JOIN times t ON p.rn = t.rn AND p.block = t.block GROUP BY ALL)
SELECT doc_id, size, source_size, target, taken FROM parts
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM streamed WHERE size = 0
"""
