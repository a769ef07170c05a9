"""Audit of how document filters interact, with duplicates found by partition refinement.

Every text is read once: its failing conditions become a string of filter letters, its code-point length and the
hashes of its successive blocks (ends at BLOCK_ENDS, then the rest) go along. Duplicates are refined on these slim
rows: classes by length first, then by one more block hash a round, and rows alone in their class drop out of all
further rounds. Full texts are compared only for the classes that are left; all but the smallest id of each text are
marked. The marks complete the masks, which are counted by part and mask before any order of filters is looked at:
every figure of every order follows from at most 2^filters counts a part.

Skew: class counts and full-text groups are pre-aggregated; the COMMON largest classes (so many rows at most) are
broadcast and their members bypass the shuffle that settles all others, so that no class gathers in one task. Marks
are joined by id and class.

Edge cases: a null text is an empty one (no words; it fails A, and E beside a smaller id's); equal ids with equal
texts are no copies of each other; a null id is neither smaller nor larger than another, so it never fails E nor makes
others fail, and it has no labels; an id with several labels counts as good or toxic if any of them says so; a null
part is the empty string; an empty table gives no rows; only id, text, part and label columns are read, so extra
columns may have any name. Two different texts of one repeated id that agree in length and in all block hashes would
share a mark.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm._arrow import col
from rowloom.session import cut_lineage, discard

#: Ends of the text blocks in code points; one more block holds the rest.
BLOCK_ENDS = (256, 4096)
#: Largest classes whose members bypass the shuffle, and classes that are sent to every executor at most (40 bytes each).
COMMON, SENT = 1000, 200_000

DUPLICATE = "E"

_HASHES = tuple(f"h{i}" for i in range(len(BLOCK_ENDS) + 1))
_CLASS = ("n_chars", *_HASHES)


def text_conditions(text: Column) -> dict[str, Column]:
    """When a text fails: A, few words; B, repeated words; C, capital letters; D, marks of markup."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(80).cast("long"),
        "C": (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) * F.lit(100).cast("long") > F.length(text) * F.lit(10).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _classed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id, text, class columns, and more columns."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    starts, ends = (0, *BLOCK_ENDS), (*BLOCK_ENDS, 1 << 31)
    hashes = [F.xxhash64(F.substring(text, a + 1, min(b - a, (1 << 31) - 1))).alias(h) for h, a, b in zip(_HASHES, starts, ends, strict=True)]
    return df.select(col(id_col).alias("id"), text.alias("text"), F.length(text).alias("n_chars"), *hashes, *more)


def _members(rows: DataFrame, classes: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """rows of the given classes (key and count): by a broadcast of the classes where those are few; otherwise members
    of the most common ones stay where they are, dealt out by hash, and the others meet their class in a shuffle."""
    few = classes.orderBy(F.desc("count")).limit(COMMON)
    if classes.limit(SENT + 1).count() <= SENT:
        return rows.join(F.broadcast(classes.select(*key)), list(key), "left_semi")
    spread = F.when(F.col("__common"), F.xxhash64("id", *key).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
    told = rows.join(F.broadcast(few.select(*key, F.lit(True).alias("__common"))), list(key), "left").withColumn("__spread", spread)
    met = told.join(classes.select(*key, F.lit(0).cast("long").alias("__spread"), F.lit(True).alias("__met")), [*key, "__spread"], "left")
    return met.where("__common OR __met").select(*rows.columns)


def _refined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that share length and all block hashes with another row, and their classes."""
    classes = None
    for n in range(1, len(_CLASS) + 1):
        key = _CLASS[:n]
        before = (rows, classes) if classes is not None else ()
        classes = cut_lineage(rows.groupBy(*key).count().where("count > 1"), "audit-classes")
        rows = cut_lineage(_members(rows, classes, key), "audit-members")
        discard(*before)
    return rows, classes


def later_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", profile: DataFrame | None = None) -> DataFrame:
    """Distinct id and class columns of the rows whose whole text is also that of a smaller id.

    profile holds id and class columns of all rows, where they are already at hand.
    """
    slim = (_classed(df, id_col, text_col) if profile is None else profile).where("id IS NOT NULL").select("id", *_CLASS)
    members, classes = _refined(slim)
    whole = _members(_classed(df.where(col(id_col).isNotNull()), id_col, text_col), classes, _CLASS)
    least = whole.groupBy(*_CLASS, "text").agg(F.min("id").alias("id"))
    marks = cut_lineage(members.distinct().join(least.select("id", *_CLASS), ["id", *_CLASS], "left_anti"), "audit-marks")
    discard(members, classes)
    return marks


def failure_counts(df: DataFrame, labels: DataFrame, conditions=text_conditions, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, failed (the letters of the failing filters), n rows, and good and toxic rows among them.

    conditions makes a dict of letters and failing conditions from the text column; DUPLICATE is added to them.
    """
    made: Mapping[str, Column] = conditions(F.col("text"))
    part = F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part")
    failed = F.concat(*(F.when(c, F.lit(k)).otherwise("") for k, c in made.items())).alias("failed")
    profile = cut_lineage(_classed(df, id_col, text_col, part).select("id", "part", *_CLASS, failed), "audit-profile")
    marks = later_copies(df, id_col, text_col, profile)
    judged = labels.groupBy(col(id_col).alias("id")).agg(*(F.max(F.coalesce(col(c) == 1, F.lit(False))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    known = (
        profile.where("id IS NOT NULL")
        .join(judged, "id", "left")
        .join(marks.withColumn("copy", F.lit(True)), ["id", *_CLASS], "left")
        .select("part", F.concat("failed", F.when(F.col("copy"), F.lit(DUPLICATE)).otherwise("")).alias("failed"), "good", "toxic")
    )
    unknown = profile.where("id IS NULL").select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    return known.unionByName(unknown).groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic"))


def interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter keeps, removes and loses."""
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    own = F.expr("substr(filter_order, step, 1)")
    untouched = lambda upto: F.expr(f"length(translate(failed, substr(filter_order, 1, {upto}), '')) = length(failed)")
    fails, reached = F.expr("contains(failed, substr(filter_order, step, 1))"), untouched("step - 1")
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    share = F.expr(f"n * {_factorial(len(letters))} DIV length(failed)")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(untouched("step")).alias("kept"), total(fails & reached).alias("removed"), total(fails & ~reached).alias("redundant"),
        total(F.col("failed") == own).alias("unique_fails"), total(fails & reached, "good").alias("good_lost"), total(fails & reached, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )


def _factorial(n: int) -> int:
    return n * _factorial(n - 1) if n > 1 else 1


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
m AS (SELECT *, contains(failed, own) AS fails, translate(failed, earlier, '') = failed AS reached FROM c, s),
g AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE reached AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE reached AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE fails AND NOT reached), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failed = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE reached AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE reached AND fails), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g
"""
