"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot i of the schedule is the point frac(i x golden ratio), mapped through the cumulative targets to
a source; so every stretch of the schedule holds the sources close to their shares. A source's documents are
shuffled, laid end to end and cut into blocks of equal words (the last may be shorter). The slots of a source
are ranked, and rank r meets block r mod blocks, round after round; the last slot takes as much of its block
as the target leaves. Sources that the schedule gives a slot too few get it at its end, so every source's
words are its target, rounded. A document's share is what lies of it in the blocks that slots have met; its place in
the mix is the first of these slots, and the mix is written in the order of the slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, split_count, whole_row, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
MOST_SOURCES = 10_000  # a plan of so few rows, counted, is broadcast
PLACE = ("_number", "_blocks", "_block", "_start")  # of a document in its source
GOLDEN = 0.6180339887498949  # frac of the golden ratio
GOLDEN_20 = 0.3147292543901131  # frac of 2^20 times it


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row a source.

    Shares by weight are cut at `most` times a source's size and the excess goes to the others by
    weight, until none is above. That level is where sources sorted by size over weight stop being
    cut, found with running sums."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    by_cap = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    cut_size = F.coalesce(F.sum("source_size").over(by_cap), F.lit(0)) * most
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))
    level = (total - cut_size) / left  # a unit of weight's share if all sources before are cut
    w = sizes.withColumn("weight", weight).withColumns({"level": level, "turn": F.row_number().over(order)})
    w = w.withColumn("cut", most * F.col("source_size") <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("cut"), F.struct("turn", "level")))  # the first that is not cut, also among ties
    final = F.coalesce(first.over(everything).getField("level"), F.lit(0.0))
    target = F.when(F.col("cut"), (most * F.col("source_size")).cast("double")).otherwise(final * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def slot_point(i) -> F.Column:
    """frac(i x golden ratio), exact enough for 2^40 slots: the upper bits go by their own factor."""
    high, low = F.floor(i / 1048576), i % 1048576
    x = high * GOLDEN_20 + low * GOLDEN
    return x - F.floor(x)


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)


def row_key(docs: DataFrame) -> F.Column:
    """A hash of all of a row but its doc_id and source."""
    plain = lambda c: F.to_json(F.struct(F.col(f"`{c}`"))) if has_map(docs.schema[c].dataType) else F.col(f"`{c}`")
    return F.xxhash64("text", *(plain(c) for c in docs.columns if c not in ("doc_id", "source", "text")))


def schedule(plan: DataFrame, slots: int, cells: int = 1024, chunk: int = 65_536) -> DataFrame:
    """(number, rank, slot): plan has a source's number, from, to and need, the slots that it takes. A source's
    slots are those of the points that fall to it, by rank; beyond its need it leaves them out, and what it
    lacks comes behind the last point.

    Points and sources meet by cells of the unit interval. Ranks are counted within chunks of slots and shifted
    by the chunks before, so no task holds all slots of a source."""
    spark = plan.sparkSession
    points = spark.range(0, slots, 1, max(1, min(4096, slots // chunk + 1))).select("id", slot_point(F.col("id")).alias("point"))
    points = points.withColumns({"cell": F.floor(F.col("point") * cells).cast("int"), "chunk": F.floor(F.col("id") / chunk)})
    covers = F.sequence(F.floor(F.col("from") * cells).cast("int"), F.least(F.floor(F.col("to") * cells), F.lit(cells - 1)).cast("int"))
    # sources go by number, as null is one of them
    hits = points.join(plan.select("number", "from", "to", F.explode(covers).alias("cell")), "cell").where("point >= `from` and point < `to`").select("number", "chunk", "id")
    counts = hits.groupBy("number", "chunk").count()
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("number", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("id")) - 1
    ranked = hits.withColumn("nth", within).join(shift, ["number", "chunk"]).select("number", (F.col("nth") + F.col("before")).alias("rank"), F.col("id").alias("slot"))
    needs = plan.select(F.col("number").alias("of"), "need")
    if needs.count() <= MOST_SOURCES:
        needs = F.broadcast(needs)
    found = ranked.join(needs, F.col("number") == F.col("of")).where("rank < need").select("number", "rank", "slot")
    got = counts.groupBy("number").agg(F.sum("count").alias("got"))
    short = plan.join(got, "number", "left").select("number", F.coalesce("got", F.lit(0)).alias("got"), "need").where("got < need")
    end = F.coalesce(F.sum(F.col("need") - F.col("got")).over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + slots  # a row per source that lacks slots
    late = short.withColumn("end", end).select("number", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"), "got", "end")
    return found.unionByName(late.select("number", "rank", (F.col("end") + F.col("rank") - F.col("got")).alias("slot")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = 512, seed: str = "mix", piece_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size, source_size, target, taken and first_slot (null: not taken) of every row, with keys of our own, and the slots.

    Size is the number of words between ASCII white space (null: 0). Null is a source of its own, the
    last. Documents of no words are never taken; very long ones lie in many blocks. Sources that tie in
    size over weight are cut by name. Repeated rows are laid out once each; among rows alike in doc_id and
    text which one is cut by the last block's end is open, their shares as a set are not. Within a source the
    order is a hash of doc_id with `seed` (of the text for rows without one), so reruns agree. An empty
    table gives no rows; other columns, of whatever name, are left out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.xxhash64("text").cast("string")))
    order = F.md5(F.concat_ws(":", F.lit(seed), name))
    sized = docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"), order.alias("_order"), row_key(docs).alias("_key"))
    slim = scratch.save(sized, "sized")
    pieces = split_count(slim.count(), piece_rows, 64)
    share = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * pieces
    slim = slim.withColumn("_piece", F.floor(share / F.lit(1 << 32)).cast("int"))  # pieces follow the order
    per_piece = scratch.save(slim.groupBy("source", "_piece").agg(F.sum("size").alias("n")), "pieces")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    plan = targets(per_piece.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    plan = plan.withColumns({
        "number": F.row_number().over(by_name), "upper": F.sum("target").over(by_name), "total": F.sum("target").over(Window.partitionBy()),
        "words": F.least(F.round("target").cast("long"), F.col("source_size") * most), "blocks": F.ceil(F.col("source_size") / block), "whole": F.greatest("source_size", F.lit(1)),
    })
    rest = F.col("words") % F.col("whole")
    need = F.floor(F.col("words") / F.col("whole")) * F.col("blocks") + F.ceil(rest / block)
    plan = plan.withColumns({"need": need.cast("long"), "rest": rest, "from": F.try_divide(F.col("upper") - F.col("target"), "total"), "to": F.try_divide("upper", "total")})
    plan = scratch.save(plan, "plan")
    wanted = plan.where("need > 0")
    slots = schedule(wanted, int(wanted.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]))
    # what the slots take of each block: all of it some times, and at the source's last slot perhaps its front
    facts = wanted.select("number", "blocks", "need", "rest")
    few = facts.count() <= MOST_SOURCES
    slots = scratch.save(slots.join(F.broadcast(facts) if few else facts, "number"), "slots")
    cut = (F.col("rank") == F.col("need") - 1) & (F.col("rest") % block > 0)
    met = slots.groupBy("number", (F.col("rank") % F.col("blocks")).alias("block")).agg(
        F.count(F.when(~cut, 1)).alias("times"), F.coalesce(F.max(F.when(cut, F.col("rest") % block)), F.lit(0)).alias("front"),
        F.min(F.when(~cut, F.col("slot"))).alias("first"), F.max(F.when(cut, F.col("slot"))).alias("last"),
    )
    met = scratch.save(met, "met")
    # documents, where they lie in their source
    before = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_piece.select(F.col("source").alias("_source"), F.col("_piece").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_piece").orderBy("_order", "doc_id", "_key").rowsBetween(Window.unboundedPreceding, -1)
    laid = slim.withColumn("_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    laid = laid.join(shift, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_piece") == F.col("_p"))).withColumn("start", F.col("_start") + F.col("_before"))
    info = plan.select(F.col("source").alias("_named"), "number", "source_size", "target", "blocks")
    few = info.count() <= MOST_SOURCES
    laid = laid.join(F.broadcast(info) if few else info, F.col("source").eqNullSafe(F.col("_named")))
    laid = laid.select("doc_id", "source", "number", "blocks", "size", "source_size", "target", "start", "_order", "_key")
    laid = scratch.save(laid.withColumn("_row", F.monotonically_increasing_id()), "laid")
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    lies = laid.where("size > 0").select("_row", "number", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    at, end = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    front = F.greatest(F.lit(0), F.least(end, F.col("block") * block + F.col("front")) - at)
    slot = F.least(F.when(F.col("times") > 0, F.col("first")), F.when(front > 0, F.col("last")))
    taken = lies.join(met, ["number", "block"]).groupBy("_row").agg(F.sum(F.col("times") * (end - at) + front).alias("taken"), F.min(slot).alias("first_slot"), F.min_by("block", slot).alias("_block"))
    out = laid.join(taken, "_row", "left")
    own = ("doc_id", "source", "_key", "_order", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target")
    made = out.select(*own, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.col("number").alias("_number"), F.col("blocks").alias("_blocks"), "_block", F.col("start").alias("_start"))
    return made, slots


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first_slot."""
    return mix(docs, **options)[0].drop("_key", "_order", *PLACE)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """`docs` as the mix has them, in the order of the schedule: a row for each time (rounded) that its words are
    taken, at the slot that takes it then, none for documents left out. Only a source's document at the end of
    its last round is taken in part. Nulls, ties, repeated rows and empty tables as in `mix`; all columns stay as
    they are."""
    rows, slots = mix(docs, **options)
    rows = rows.groupBy("doc_id", "_key").agg(F.sum("size").alias("_size"), F.sum("taken").alias("_taken"), F.min("first_slot").alias("_slot"), *(F.min_by(c, "first_slot").alias(c) for c in PLACE))
    rows = rows.select(F.col("doc_id").alias("_doc"), "_key", "_slot", *PLACE, F.round(F.col("_taken") / F.greatest("_size", F.lit(1))).cast("int").alias("_times"))
    turns = rows.where("_times > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("_turn"))
    turns = turns.withColumn("_rank", F.col("_block") + F.col("_turn") * F.col("_blocks"))
    hit = (F.col("_number") == slots["number"]) & (F.col("_rank") == slots["rank"])
    turns = turns.join(slots.select("number", "rank", "slot"), hit, "left")  # copies beyond the last round go with the first
    turns = turns.select("_doc", "_key", F.coalesce("slot", "_slot").alias("_at"), "_start")
    keyed = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").alias("_id"), row_key(docs).alias("_own"))  # no name of docs' own clashes
    same = keyed["_id"].eqNullSafe(turns["_doc"]) & (keyed["_own"] == turns["_key"])
    return keyed.join(turns, same).orderBy("_at", "_start").select("_row.*")


#: The words of a source lie in shuffled order, in blocks of 512; the points of the schedule fall to sources, and the
#: r-th of a source takes its block r mod blocks, the last one perhaps only the block's front.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || doc_id::VARCHAR) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source ASC NULLS LAST) AS turn,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER c, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER c, 0)) AS level
  FROM w WINDOW c AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, 3 * source_size <= level * weight AS cut FROM l),
t AS (SELECT source, source_size, CASE WHEN cut THEN (3 * source_size)::DOUBLE ELSE weight * coalesce((SELECT arg_min(level, turn) FROM k WHERE NOT cut), 0) END AS target FROM k),
n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS number, sum(target) OVER (ORDER BY source ASC NULLS LAST) AS upper, sum(target) OVER () AS total,
    least(round(target)::BIGINT, 3 * source_size) AS words, (source_size + 511) // 512 AS blocks, greatest(source_size, 1) AS whole FROM t),
p AS (SELECT *, words % whole AS rest, words // whole * blocks + (words % whole + 511) // 512 AS need, (upper - target) / total AS low, upper / total AS high FROM n),
points AS (SELECT id, x - floor(x) AS point FROM (SELECT id, (id // 1048576) * 0.3147292543901131::DOUBLE + (id % 1048576) * 0.6180339887498949::DOUBLE AS x
    FROM (SELECT unnest(range((SELECT coalesce(sum(need), 0)::BIGINT FROM p))) AS id))),
hits AS (SELECT number, id AS slot, row_number() OVER (PARTITION BY number ORDER BY id) - 1 AS rank FROM points JOIN p ON point >= low AND point < high WHERE need > 0),
short AS (SELECT number, got, need, coalesce(sum(need - got) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT number, need, coalesce(got, 0) AS got FROM p LEFT JOIN (SELECT number, count(*) AS got FROM hits GROUP BY 1) USING (number)) WHERE got < need),
slots AS (SELECT number, rank, slot FROM hits JOIN p USING (number) WHERE rank < need UNION ALL
  SELECT number, rank, (SELECT sum(need) FROM p) + before + rank - got FROM (SELECT *, unnest(range(got, need)) AS rank FROM short)),
met AS (SELECT number, rank % blocks AS block, slot, CASE WHEN rank = need - 1 AND rest % 512 > 0 THEN rest % 512 ELSE 512 END AS front FROM slots JOIN p USING (number)),
laid AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
d AS (SELECT laid.doc_id, laid.source, size, start, p.source_size, p.target, number FROM laid JOIN p ON laid.source IS NOT DISTINCT FROM p.source),
b AS (SELECT doc_id, number, start, size, unnest(range(start // 512, (start + size + 511) // 512)) AS block FROM d WHERE size > 0),
m AS (SELECT doc_id, slot, least(start + size, b.block * 512 + front) - greatest(start, b.block * 512) AS part FROM b JOIN met ON b.number = met.number AND b.block = met.block),
g AS (SELECT doc_id, sum(part)::BIGINT AS taken, min(slot)::BIGINT AS first_slot FROM m WHERE part > 0 GROUP BY 1)
SELECT d.doc_id, d.source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
