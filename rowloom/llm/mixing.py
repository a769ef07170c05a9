"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share a multiple of all words; a
target stops at `most` times its source's words and the excess is shared again by weight among the others, until none
is above; each round is one aggregate over the table of sources.

Quotas: a source's words are cut into equal blocks of about `block_words` words (more where the mix would have over
MOST_BLOCKS of them; its last block may be shorter), and the mix has as many blocks, in all, as its targets are worth.
They are granted one after the other to the source of the highest quotient, the worth of its target in blocks over 2j - 1
for its j-th, and fill shards of `shard_blocks` blocks each in that order. The seats of all sources after each shard are
found at once: a divisor on either side of the right one brackets them to about two blocks a source, and those are ranked
by quotient. A source never gets more than `most` times its blocks.

Selection: a source's documents stand in a seeded order (MD5 of seed and id), and its blocks are numbered along that
stream. If its seats are several times its blocks, all blocks are taken so often; for the seats that are left, each shard
chooses its share among a run of blocks in proportion to it: every m/r-th from a seeded start, so that exactly r of m are
chosen, and how many of those before a block are chosen is a formula. What the mix takes of a document is what the chosen
blocks hold of it. A document's start in the stream is the sum of the words before it, from the sums of hash buckets
(pre-aggregated, as many as the number of documents asks for) and a running sum inside its own bucket,
so no task holds a whole source. Buckets of more than HOT_ROWS rows (of one id, or without one) are split by size,
by text and at last by input partition.

Edge cases: a null text counts 0 words and is never taken; null is a source of its own; repeated rows are documents
of their own (rows of equal id and size may swap their shares); with no words at all every target is 0; an empty
table gives an empty one; columns named like the results are replaced. The input must be a repeatable scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.llm._arrow import col, set_aside, without
from rowloom.llm._skew import parted_join
from rowloom.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE, MOST, BLOCK_WORDS, SEED = 1.5, 2, 16, "mix-1"
#: Blocks of a shard, and of the mix at most; documents that a bucket should have, and from which it is split.
SHARD_BLOCKS, MOST_BLOCKS, BUCKET_ROWS, HOT_ROWS = 4096, 1 << 20, 2000, 50_000
#: Sources whose seats (a few kilobytes each) are sent to every executor at most.
SENT = 2000

RESULT = ("size", "source_size", "target", "taken", "shards")

_SPACE = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of other characters than space and the ASCII controls 9 to 13; null has none."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(F.size(F.split(trimmed, _SPACE))).cast("long")


def _places(totals: DataFrame) -> DataFrame:
    """totals with place, the number of sources before it in code-point order (null last)."""
    order = F.col("source").asc_nulls_last()
    spread = cut_lineage(totals.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "sources")
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).withColumn("__from", F.sum("n").over(before) - F.col("n")).drop("n")
    number = F.row_number().over(W.partitionBy("__part").orderBy(order)) - 1
    return spread.withColumn("__number", number).join(parts, "__part").withColumn("place", F.col("__from") + F.col("__number")).drop("__part", "__from", "__number")


def targets(totals: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (source, source_size), one row a source: place, weight and target."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    t = cut_lineage(_places(totals).select("source", "source_size", "place", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "weights")
    every, weights = t.agg(F.sum("source_size"), F.sum("weight")).first()
    room = whole = share * (every or 0)
    rest, stopped = weights or 1, 0
    while True:
        above = room * F.col("weight") > F.col("cap") * rest
        n, words, theirs = t.where(above).agg(F.count(F.lit(1)), F.sum("cap"), F.sum("weight")).first()
        if n == stopped or theirs == weights:
            break
        room, rest, stopped = whole - words, weights - theirs, n
    target = F.when(above, F.col("cap").cast("double")).otherwise(F.lit(room / rest) * F.col("weight"))
    return t.withColumn("target", target).select("source", "source_size", "place", "weight", "target")


def in_blocks(sources: DataFrame, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """sources with blocks, their number, block_words, the words of each, worth, its target in blocks, and cap, the most
    that it may get."""
    n = F.ceil(F.col("source_size") / block_words)
    own = sources.withColumn("block_words", F.greatest(F.lit(1), F.when(n > 0, F.ceil(F.col("source_size") / n)).otherwise(1)).cast("long"))
    own = own.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    return own.withColumns({"worth": F.col("target") / F.col("block_words"), "cap": F.col("blocks") * most})


def seats(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(source columns, shard, upto): the blocks of each source (worth, cap, place) in the shards up to each, from 1. Each
    shard has shard_blocks of them, the last one what is left."""
    worth, n, caps = sources.agg(F.sum("worth"), F.count(F.lit(1)), F.sum("cap")).first()
    house = min(math.floor((worth or 0.0) + 0.5), caps or 0)
    shards = max(1, math.ceil(house / shard_blocks))
    filled = F.least(F.col("shard") * shard_blocks, F.lit(house)).cast("long")
    at = sources.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("filled", filled)
    by = lambda divisor: F.least(F.col("cap"), F.floor(F.col("worth") / divisor + 0.5).cast("long"))
    below, above = F.col("filled") - F.lit(n / 2 + 1), F.col("filled") + F.lit(1.5 * n + 1)
    low = F.when(below > 0, by(F.lit(worth or 0.0) / below)).otherwise(F.lit(0).cast("long"))
    at = at.withColumns({"low": low, "high": F.greatest(low, by(F.lit(worth or 0.0) / above)) if worth else low})
    sums = at.groupBy("shard").agg(F.sum("low").alias("lows"), F.sum("high").alias("highs"))
    at = cut_lineage(at.join(F.broadcast(sums), "shard").withColumn("high", F.when(F.col("highs") < F.col("filled"), F.col("cap")).otherwise(F.col("high"))), "mix-seats")
    asked = at.where("high > low").select("shard", "place", "filled", "lows", "worth", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("j"))
    rank = F.row_number().over(W.partitionBy("shard").orderBy(F.desc("quotient"), "place", "j"))
    granted = asked.withColumn("quotient", F.col("worth") / (2 * F.col("j") - 1)).withColumn("rank", rank).where("rank <= filled - lows")
    more = granted.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("more"))
    upto = (F.col("low") + F.coalesce("more", F.lit(0))).alias("upto")
    return at.join(more, ["shard", "place"], "left").select(*sources.columns, "shard", upto)


def _runs(sources: DataFrame, shard_blocks: int, seed: str) -> DataFrame:
    """For each source: copies, how often all its blocks are taken; left, the seats beyond; and its runs of blocks, one a
    shard: first and last block (end exclusive), seats chosen before and up to it, the start of the choice, and the blocks
    of whole copies before and up to it."""
    every = seats(sources, shard_blocks)
    names = [c for c in sources.columns if c != "__source"]
    one = every.groupBy("__source").agg(*(F.first(c).alias(c) for c in names), F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("at"))
    whole = one.withColumn("seats", F.element_at("at", -1)["upto"])
    n = F.greatest(F.col("blocks"), F.lit(1))
    whole = whole.withColumns({"copies": F.expr("seats div greatest(blocks, 1)"), "left": F.col("seats") % n})
    before = lambda i: F.when(i > 0, F.col("at")[i - 1]["upto"]).otherwise(F.lit(0).cast("long"))
    chosen = lambda u: F.floor(u * F.col("left") / F.greatest(F.col("seats"), F.lit(1))).cast("long")
    edge = lambda c: F.when(F.col("left") > 0, F.ceil(F.col("blocks") * c / F.greatest(F.col("left"), F.lit(1)))).otherwise(0).cast("long")

    def run(x, i):
        a, b = chosen(before(i)), chosen(x["upto"])
        first, end = edge(a), edge(b)
        digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("__source"), x["shard"].cast("string")).cast("binary")), 1, 12)
        start = F.conv(digits, 16, 10).cast("long") % F.greatest(end - first, F.lit(1))
        return F.struct(x["shard"].alias("shard"), first.alias("first"), end.alias("end"), a.alias("a"), b.alias("b"), start.alias("start"), (before(i) - a).alias("f"), (x["upto"] - b).alias("g"))

    whole = whole.withColumn("runs", F.transform("at", run)).withColumn("ends", F.transform("runs", lambda r: r["end"]))
    tops = F.filter("ends", lambda e, i: i % STRIDE == STRIDE - 1)
    return whole.select("__source", "source_size", "target", "blocks", "block_words", "copies", "left", "runs", "ends", tops.alias("tops"))


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


#: Runs are found among every STRIDE-th first, then among so many.
STRIDE = 16


def _chosen_words(x: Column) -> Column:
    """Words of the chosen blocks among the first x of a source's stream."""
    width = F.col("block_words")

    def behind(j: Column) -> Column:
        """How many runs end at block j or before."""
        full = F.size(F.filter("tops", lambda e: e <= j)) * STRIDE
        return _let(full, lambda n: n + F.size(F.filter(F.slice("ends", n + 1, F.lit(STRIDE)), lambda e: e <= j)))

    def words(j: Column) -> Column:
        def of(r: Column) -> Column:
            share, m = r["b"] - r["a"], F.greatest(r["end"] - r["first"], F.lit(1))
            upto = lambda k: F.floor((k - r["first"] + r["start"]) * share / m)
            base = F.floor(r["start"] * share / m)
            counted = F.struct(upto(j).alias("now"), upto(j + 1).alias("then"))
            return _let(counted, lambda c: ((r["a"] + c["now"] - base) * width + (c["then"] - c["now"]) * (x - j * width)).cast("long"))

        # Behind the last run, which ends with the blocks, all have been counted.
        return F.coalesce(_let(F.get("runs", behind(j)), of), F.least(F.col("left") * width, x))

    return _let(F.floor(x / width).cast("long"), words)


def _selected(start: Column, words: Column) -> Column:
    """(shard, words) of each shard that takes some of the words from start of a source's stream."""
    stop, width, n = start + words, F.col("block_words"), F.greatest(F.col("blocks"), F.lit(1))
    of = lambda k: (F.floor(k / n) * F.col("source_size") + F.least((k % n) * width, F.col("source_size"))).cast("long")

    def taken(r):
        a, b = F.greatest(start, r["first"] * width), F.least(stop, r["end"] * width)
        rest = F.when(b > a, F.aggregate(F.array(_part(b, r), -_part(a, r)), F.lit(0).cast("long"), lambda t, v: t + v)).otherwise(0)
        cycle = lambda i: F.greatest(F.lit(0), F.least(stop + i * F.col("source_size"), of(r["g"])) - F.greatest(start + i * F.col("source_size"), of(r["f"])))
        cycles = F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda t, i: t + cycle(i).cast("long"))
        return F.struct(r["shard"].cast("long").alias("shard"), (rest + F.when(F.col("copies") > 0, cycles).otherwise(0)).cast("long").alias("words"))

    def _part(x, r):
        j = F.floor(x / width).cast("long")
        share, m = r["b"] - r["a"], F.greatest(r["end"] - r["first"], F.lit(1))
        upto = lambda k: F.floor((k - r["first"] + r["start"]) * share / m)
        return ((upto(j) - upto(r["first"])) * width + (upto(j + 1) - upto(j)) * (x - j * width)).cast("long")

    return F.filter(F.transform("runs", taken), lambda x: x["words"] > 0)


def _starts(docs: DataFrame, levels: list[list[str]]) -> DataFrame:
    """The words of a source before each group of the last level; a level's columns order the groups within one of the level before."""
    keys = [c for level in levels for c in level]
    sums = cut_lineage(docs.groupBy(*keys).agg(F.sum("size").alias("words")), "mix-groups")
    out = sums.select(*keys)
    for k in range(1, len(levels)):
        above, here = [c for level in levels[:k] for c in level], levels[k]
        ahead = W.partitionBy(*above).orderBy(*here).rowsBetween(W.unboundedPreceding, W.currentRow)
        level = sums.groupBy(*above, *here).agg(F.sum("words").alias("words")).withColumn(f"__from{k}", F.sum("words").over(ahead) - F.col("words")).drop("words")
        out = out.join(level, [*above, *here])
    return out.withColumn("__start", sum((F.col(f"__from{k}") for k in range(2, len(levels))), F.col("__from1"))).drop(*(f"__from{k}" for k in range(1, len(levels))))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, seed: str = SEED,
    shard_blocks: int = SHARD_BLOCKS, bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All columns of df and size, source_size, target (both of the document's source), taken, the words the mix takes,
    and shards, an array of (shard, words) that take them."""
    kept = without(df.columns, RESULT)
    own = [f"k{i}" for i in range(len(kept))]
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(col(id_col).cast("string"), F.lit(""))).cast("binary"))
    source = F.coalesce(F.concat(F.lit("="), col(source_col)), F.lit("null"))
    docs = df.select(*(col(c).alias(k) for c, k in zip(kept, own, strict=True)), word_count(col(text_col)).alias("size"), source.alias("__source"), order.alias("__order"), F.md5(F.coalesce(col(text_col), F.lit("")).cast("binary")).alias("__text"))
    digits = max(1, math.ceil(math.log(max(1, df.count() / bucket_rows), 16)))
    docs = docs.withColumn("__bucket", F.substring("__order", 1, digits))
    buckets = cut_lineage(docs.groupBy("__source", "__bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "mix-buckets")
    totals = buckets.groupBy("__source").agg(F.sum("size").alias("source_size"))
    totals = totals.select(F.when(F.col("__source") != "null", F.substr("__source", F.lit(2))).alias("source"), "source_size")
    named = targets(totals, share, most).withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).drop("source", "weight")
    words = named.agg(F.sum("target")).first()[0] or 0
    sources = cut_lineage(in_blocks(named, most, max(block_words, math.ceil(words / MOST_BLOCKS))), "mix-sources")
    runs = cut_lineage(_runs(sources, shard_blocks, seed), "mix-runs")

    def placed(rows: DataFrame, starts: DataFrame, group: list[str]) -> DataFrame:
        within = W.partitionBy(*group).orderBy("__order", "size", "__text").rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.join(starts, group).withColumn("__at", F.col("__start") + F.sum("size").over(within) - F.col("size")).select(*own, "size", "__source", "__at")

    plain = ["__source", "__bucket"]
    starts = _starts(buckets, [["__source"], ["__bucket"]])
    hot = buckets.where(F.col("rows") > hot_rows).select(*plain)
    if hot.isEmpty():
        out = placed(docs, starts, plain)
    else:
        levels = [["__source", "__bucket"], ["__order", "size"], ["__text"], ["__part"]]
        # Written once, as partitions must be the same wherever they are read.
        many = cut_lineage(docs.withColumn("__part", F.spark_partition_id()).join(hot, plain, "left_semi"), "mix-hot")
        finer = _starts(many, levels).withColumnRenamed("__start", "__inner").join(starts, plain).withColumn("__start", F.col("__start") + F.col("__inner")).drop("__inner")
        out = placed(docs.join(hot, plain, "left_anti"), starts, plain).unionByName(placed(many, finer, [c for level in levels for c in level]))
    few = runs.limit(SENT + 1).count() <= SENT
    out = out.join(F.broadcast(runs), "__source") if few else parted_join(cut_lineage(out, "mix-placed"), runs, ["__source"])
    taken = F.col("copies") * F.col("size") + _chosen_words(F.col("__at") + F.col("size")) - _chosen_words(F.col("__at"))
    # A document without words stands between others and takes nothing.
    taken = F.when(F.col("size") > 0, taken).otherwise(0).cast("long")
    return out.select(*own, "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, _selected(F.col("__at"), F.col("size"))).otherwise(F.array().cast("array<struct<shard:bigint,words:bigint>>")).alias("shards")).toDF(*kept, *RESULT)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: df's columns, each document as often as the mix takes it, to the nearest whole copy."""
    aside, names = set_aside(df, RESULT)
    place = dict(zip(df.columns, names, strict=True))
    mixed = mix(aside, place[id_col], place[text_col], place[source_col], **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    copy = F.explode(F.sequence(F.lit(1), copies.cast("int")))
    return mixed.where(copies > 0).select(*map(col, names), copy.alias("__copy")).drop("__copy").toDF(*df.columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o, md5(coalesce(text, '')) AS tm FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER o AS k, 1.5 * sum(source_size) OVER () - (sum(2 * source_size) OVER o - 2 * source_size) AS room,
    sum(w) OVER () - (sum(w) OVER o - w) AS rest
  FROM s WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min(k) AS k, min_by(CAST(room AS DOUBLE) / rest, k) AS level FROM r WHERE room * w <= 2 * source_size * rest),
t AS (
  SELECT source, source_size, CASE WHEN r.k < l.k THEN CAST(2 * source_size AS DOUBLE) ELSE level * w END AS target FROM r, l),
z AS (SELECT greatest(16, ceil(sum(target) / 1048576))::BIGINT AS w FROM t),
n AS (SELECT t.*, ceil(source_size / z.w) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM t, z),
q0 AS (SELECT *, greatest(1, CASE WHEN n > 0 THEN ceil(source_size / n) ELSE 1 END)::BIGINT AS bw FROM n),
q AS (SELECT *, ceil(source_size / bw)::BIGINT AS nb, target / bw AS worth, 2 * ceil(source_size / bw)::BIGINT AS cap FROM q0),
h AS (SELECT sum(worth) AS worths, count(*) AS sources, least(floor(sum(worth) + 0.5), sum(cap))::BIGINT AS house FROM q),
k AS (SELECT unnest(range(1, greatest(1, ceil(house / 4096))::BIGINT + 1)) AS shard FROM h),
-- Each shard's seats: every quotient that could matter, ranked.
g AS (SELECT shard, least(shard * 4096, house) AS filled, place, worth, cap, unnest(range(1, least(cap, floor(worth * least(shard * 4096, house) / worths + 2 * sources + 3)::BIGINT) + 1)) AS j FROM k, h, q),
v AS (SELECT shard, place, max(j) AS upto FROM (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY worth / (2 * j - 1) DESC, place, j) AS rank FROM g) WHERE rank <= filled GROUP BY ALL),
u AS (SELECT shard, q.*, coalesce(upto, 0) AS upto FROM k CROSS JOIN q LEFT JOIN v USING (shard, place)),
x AS (SELECT *, max(upto) OVER (PARTITION BY place) AS seats, coalesce(lag(upto) OVER (PARTITION BY place ORDER BY shard), 0) AS was FROM u),
y AS (SELECT *, seats // greatest(nb, 1) AS copies, seats % greatest(nb, 1) AS rest FROM x),
c AS (SELECT *, was * rest // greatest(seats, 1) AS a, upto * rest // greatest(seats, 1) AS b FROM y),
e AS (SELECT *, CASE WHEN rest > 0 THEN (nb * a + rest - 1) // rest ELSE 0 END AS lo, CASE WHEN rest > 0 THEN (nb * b + rest - 1) // rest ELSE 0 END AS hi FROM c),
f AS (
  SELECT *, CAST('0x' || substr(md5('mix-1:' || coalesce('=' || source, 'null') || ':' || shard), 1, 12) AS BIGINT) % greatest(hi - lo, 1) AS o FROM e),
-- The blocks that each shard chooses of each source.
i AS (SELECT place, bw, unnest(range(lo, hi)) AS blk, lo, hi, a, b, o FROM f WHERE hi > lo),
w AS (SELECT place, blk, bw FROM i WHERE (blk - lo + o + 1) * (b - a) // (hi - lo) > (blk - lo + o) * (b - a) // (hi - lo)),
m AS (SELECT DISTINCT place, source, source_size, target, copies FROM f),
p AS (
  SELECT rn, doc_id, size, m.*, sum(size) OVER (PARTITION BY m.place ORDER BY o, size, tm ROWS UNBOUNDED PRECEDING) - size AS pos
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
l2 AS (SELECT rn, sum(least(pos + size, (blk + 1) * bw) - greatest(pos, blk * bw)) AS words FROM p JOIN w ON p.place = w.place AND blk * bw < pos + size AND (blk + 1) * bw > pos WHERE size > 0 GROUP BY rn)
SELECT doc_id, size, source_size, target, CAST(copies * size + coalesce(words, 0) AS BIGINT) AS taken FROM p LEFT JOIN l2 USING (rn)
"""
