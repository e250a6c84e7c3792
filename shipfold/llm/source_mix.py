"""Mixing sources to target weights over fixed-length blocks.

The words of a source, in a fixed order of its documents, form one stream that
is cut into blocks of ``block_words``. Output shards have ``shard_slots`` slots
of one block each. Each slot draws its source by the inverse cumulative weight
of a pseudorandom uniform; the counts per shard and source are that multinomial
draw. Shards draw in ``WAVES`` waves, each of half the shards that are left: a wave's
weights are what the waves before have left of each source's target, so the totals
differ from their targets only by the last wave's chance. With ``stratified`` slot j of
n draws from the j-th n-th of the unit interval instead: the same expected counts, less
variance, and no multinomial draw. Counts are numbered per source across
shards; slot i of a source reads block ``permute(i mod M)`` of pass ``i div M``,
where each pass has its own pseudorandom permutation of the source's M blocks.
Every pass reads each block at most once, so three passes bound the repeats.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share
the corpus; no target exceeds ``max_repeat`` times its source, and the excess is
shared again by weight. That is the level L with sum(min(L*w, cap)) = total,
found from running sums over sources ordered by cap / weight.

Everything is a DataFrame expression. A hot source is spread over (source, salt)
groups for its running word counts, and over blocks for the join.

Defined cases: a null text has no words; a document of no words is taken zero
times; repeated rows count each on their own; an empty table or one without
words gives targets and takes of zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipfold.llm.common import column, fresh, once, with_row_id, write_scratch

BLOCK_WORDS = 64
SHARD_SLOTS = 16384
MIN_SHARDS, WAVES = 64, 7
MAX_REPEAT = 3
SEED = 20240229
#: Rows of one (source, salt) group when running word counts are taken.
GROUP_ROWS = 4000
#: The unit interval is cut into so many cells to look a draw's source up by join.
CELLS = 4096
ROUNDS = 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _unit(*cols) -> Column:
    """Pseudorandom double in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def permute(index: Column, size: Column, *key) -> Column:
    """A pseudorandom permutation of 0..size-1 for each key: swap-or-not.

    Each round pairs x with (k - x) mod size and swaps both or neither by a
    hash of the larger one, so that every round is its own inverse.
    """
    def one(x: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(F.lit(SEED), r, *key), size)
        other = F.pmod(k - x, size)
        flip = F.xxhash64(F.lit(SEED + 1), r, F.greatest(x, other), *key).bitwiseAND(F.lit(1)) == 1
        return F.when(flip, other).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), one)


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, sid, weight, source_size, target) from rows (source, size)."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    s = s.withColumn("weight", F.pmod(F.col("sid") - 1, F.lit(3)) + 1)
    s = s.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("weight_left", F.sum("weight").over(everything)
                     - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = (F.col("total") - F.col("capped_before")) / F.col("weight_left")
    s = s.withColumn("here", F.when(level * F.col("weight") <= F.col("cap"), level))
    # The first source in this order that its share does not overfill sets the level.
    s = s.withColumn("level", F.first("here", ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "sid", "weight", "source_size",
                    F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _draw(slots: DataFrame, shares: DataFrame) -> DataFrame:
    """(shard, sid, n): how many of the slots (shard, u) fall to each source (sid, share)."""
    by_sid = Window.orderBy("sid")
    up_to = by_sid.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = (shares.where("share > 0")
             .withColumn("hi", F.sum("share").over(up_to) / F.sum("share").over(Window.partitionBy()))
             .withColumn("lo", F.coalesce(F.lag("hi").over(by_sid), F.lit(0.0)))
             .withColumn("hi", F.when(F.lead("sid").over(by_sid).isNull(), 1.0).otherwise(F.col("hi")))
             .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS),
                                                      F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
             .select("cell", "lo", "hi", "sid"))
    return (slots.withColumn("cell", F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1))).join(cells, "cell")
            .where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
            .groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n")))


def _plan(d: DataFrame, block_words: int, shard_slots: int, max_repeat: int, stratified: bool):
    """(rows with sid and first word, sources, draws of blocks) of rows (rid, id, source, size)."""
    spark = d.sparkSession
    sources = write_scratch(
        source_targets(d, max_repeat)
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size"))
                    .otherwise(0.0)), "mix-sources")
    rows, slots = d.count(), sources.agg(F.sum("slots")).first()[0] or 0.0
    slots = int(round(slots))

    # Where each document's words start in its source's stream.
    salts = max(1, math.ceil(rows / GROUP_ROWS))
    d = (d.join(sources.select(F.col("source").alias("s"), "sid"), d["source"].eqNullSafe(F.col("s"))).drop("s")
         .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))))
    base = (d.groupBy("sid", "salt").agg(F.sum("size").alias("n"))
            .withColumn("base", F.coalesce(F.sum("n").over(
                Window.partitionBy("sid").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .drop("n"))
    within = Window.partitionBy("sid", "salt").orderBy("id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    d = (d.withColumn("first", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["sid", "salt"])
         .withColumn("first", F.col("first") + F.col("base")).drop("salt", "base"))

    # Draws: shard slots -> source -> counts per shard -> numbered slots -> blocks.
    shards = max(MIN_SHARDS, math.ceil(slots / shard_slots))
    per = F.floor((F.col("shard") + 1) * F.lit(slots) / shards) - F.floor(F.col("shard") * F.lit(slots) / shards)
    drawn = (spark.range(shards).withColumnRenamed("id", "shard").withColumn("n", per).where("n > 0")
             .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))))
    u = _unit(F.lit(SEED + 2), F.col("shard"), F.col("slot"))
    drawn = drawn.withColumn("u", (F.col("slot") + u) / F.col("n") if stratified else u)
    wanted = sources.select("sid", F.col("slots").alias("share"))
    if stratified:
        counts = _draw(drawn, wanted)
    else:
        counts, left = None, wanted
        edges = [*(shards - (shards >> w) for w in range(WAVES)), shards]
        for lo, hi in zip(edges, edges[1:], strict=False):
            wave = write_scratch(_draw(drawn.where((F.col("shard") >= lo) & (F.col("shard") < hi)), left), "mix-counts")
            counts = wave if counts is None else counts.unionByName(wave)
            left = (wanted.join(counts.groupBy("sid").agg(F.sum("n").alias("have")), "sid", "left")
                    .select("sid", F.greatest(F.col("share") - F.coalesce("have", F.lit(0)), F.lit(0.0)).alias("share")))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("shard")
                                       .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Numbered, they go apart again: a hot source's slots are not one task's work.
    taken = (counts.withColumn("start", start).repartition(math.ceil(shards / 4), "shard", "sid")
             .withColumn("i", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
             .join(sources.select("sid", "blocks"), "sid")
             .where(F.col("i") < F.col("blocks") * max_repeat)
             .withColumn("pass", F.floor(F.col("i") / F.col("blocks")))
             .withColumn("block", permute(F.pmod(F.col("i"), F.col("blocks")), F.col("blocks"),
                                          F.col("sid"), F.col("pass")))
             .select("sid", "block", "pass", "shard"))
    return d, sources, taken


def _overlaps(d: DataFrame, block_words: int) -> DataFrame:
    """(rid, sid, block, lo, hi): which of a document's words lie in which block."""
    end = F.col("first") + F.col("size")
    return (d.where("size > 0")
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block_words),
                                                      F.floor((end - 1) / block_words))))
            .select("rid", "sid", "block",
                    (F.greatest(F.col("first"), F.col("block") * block_words) - F.col("first")).alias("lo"),
                    (F.least(end, (F.col("block") + 1) * block_words) - F.col("first")).alias("hi")))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, rid: Column) -> DataFrame:
    return docs.select(rid.alias("rid"), column(docs, id_col).alias("id"), column(docs, source_col).alias("source"),
                       word_count(column(docs, text_col)).alias("size"))


def source_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_repeat: int = MAX_REPEAT,
               stratified: bool = False) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words the mix takes)."""
    d = write_scratch(_rows(docs, id_col, text_col, source_col, F.monotonically_increasing_id()), "mix-sizes")
    at, sources, draws = _plan(d, block_words, shard_slots, max_repeat, stratified)
    times = draws.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    took = (_overlaps(at, block_words).join(times, ["sid", "block"])
            .groupBy("rid").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken")))
    s = sources.select(F.col("source").alias("s"), "source_size", "target")
    return (d.join(took, "rid", "left").join(s, d["source"].eqNullSafe(F.col("s")))
            .select(F.col("id").alias(id_col), "size", F.col("source_size"), "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    length_col: str = "n_chars", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
                    max_repeat: int = MAX_REPEAT, stratified: bool = False) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per document and pass.

    A pass that takes the whole document returns its text unchanged; one that
    takes some of its blocks returns their words, in order, joined by spaces,
    and a ``length_col`` that fits. Documents that no pass takes go.
    """
    held, rid = with_row_id(docs, "mix-documents")
    d = write_scratch(_rows(held, id_col, text_col, source_col, F.col(rid)), "mix-sizes")
    at, _, draws = _plan(d, block_words, shard_slots, max_repeat, stratified)
    pieces = (_overlaps(at, block_words).join(draws, ["sid", "block"])
              .groupBy("rid", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts"),
                                          F.sum(F.col("hi") - F.col("lo")).alias("taken")))
    pieces = pieces.join(d.select("rid", "size"), "rid")
    r, parts, whole = fresh(held, "piece_rid", "piece_parts", "piece_whole")
    pieces = pieces.select(F.col("rid").alias(r), F.col("parts").alias(parts),
                           (F.col("taken") == F.col("size")).alias(whole))
    joined = held.join(pieces, F.col(rid) == F.col(r))
    text = column(joined, text_col)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    part = once(words, lambda ws: F.array_join(F.flatten(F.transform(F.col(parts), lambda p: F.slice(
        ws, p["lo"].cast("int") + 1, (p["hi"] - p["lo"]).cast("int")))), " "))
    new = F.when(F.col(whole), text).otherwise(part)
    out = joined.withColumn(text_col, new)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(whole), column(out, length_col))
                             .otherwise(F.length(column(out, text_col)).cast(dict(docs.dtypes)[length_col])))
    return out.select(*[column(out, c) for c in docs.columns])
