"""Text search in files and tables: a scan, or a lookup of trigrams before it, and answers out of frames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.functions.transforms import java_pattern
from rowloom.session import cut_lineage, discard

MOST_RESULTS = 200
#: Files that a lookup leaves, up to which they are sent to every executor.
SENT = 100_000


def _pattern(needle: str, is_regex: bool, ignore_case: bool) -> str:
    if is_regex:
        try:
            re.compile(needle)
        except re.error as error:
            raise ValueError(f"not a valid pattern: {error}") from error
    return ("(?i)" if ignore_case else "") + (java_pattern(needle) if is_regex else re.sub(r"([^0-9A-Za-z_])", r"\\\1", needle))


def lines_of(files: DataFrame, file: str = "file", text: str = "value") -> DataFrame:
    """file, line_no from 1, and text of each line."""
    return files.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\r?\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line_no"), "text")


def matching_lines(files: DataFrame, needle: str, is_regex: bool = False, ignore_case: bool = True, file: str = "file", text: str = "value") -> DataFrame:
    """file, line_no and text of every line that matches, by a scan of all files."""
    return lines_of(files, file, text).where(F.rlike("text", F.lit(_pattern(needle, is_regex, ignore_case))))


def search_text(spark: SparkSession, path: str, needle: str, is_regex: bool = False, ignore_case: bool = True, file_filter: str | None = None, most: int = MOST_RESULTS) -> DataFrame:
    """file, line_no and text of the lines that match, the first `most` by file and line."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path"))
    if file_filter:
        files = files.where(F.contains("file", F.lit(file_filter)))
    return matching_lines(files, needle, is_regex, ignore_case).orderBy("file", "line_no").limit(most)


# ---- trigrams -------------------------------------------------------------------------------------------------------


def _folded(c: Column) -> Column:
    """ASCII letters in lower case: what postings and their lookups have in common, whatever the case that is asked for."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(files: DataFrame, file: str = "file", text: str = "value") -> DataFrame:
    """(gram, file), each once: the trigrams of every file's lines. To be written, by gram, for many searches."""
    return _each_gram(files, file, text).distinct()


def _each_gram(files: DataFrame, file: str, text: str) -> DataFrame:
    """(gram, file), each once for a row of files."""
    chars = F.split(_folded(F.coalesce(F.col(text), F.lit(""))), "")
    with_chars = files.select(F.col(file).alias("file"), F.filter(chars, lambda c: c != "").alias("c")).where(F.size("c") > 2)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("c") - 3), lambda i: F.concat(F.col("c")[i], F.col("c")[i + 1], F.col("c")[i + 2])))
    each = with_chars.select(F.explode(grams).alias("gram"), "file")
    return each.where(~F.rlike("gram", F.lit("[\r\n]")))


def write_postings(files: DataFrame, path: str, file: str = "file", text: str = "value") -> None:
    """Postings as Parquet, dealt by gram and sorted, so that a lookup reads the row groups of its own. One exchange serves
    the sorting and the removal of repeated rows; ranges would take two, and a pass to find their bounds."""
    each = _each_gram(files, file, text).repartition("gram").dropDuplicates(["gram", "file"])
    each.sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def required_texts(needle: str, is_regex: bool = False) -> list[str]:
    """Texts of three or more ASCII characters that every match holds: the needle itself, or the runs of plain characters
    at the top level of a pattern."""
    if not is_regex:
        runs = re.split(r"[^\x00-\x7f]+", needle)
    else:
        parsed = re._parser.parse(needle)
        if parsed.state.flags & re.VERBOSE or re.search(r"\(\?[a-z]*[ux]", needle):
            return []
        runs, run = [], ""
        for op, value in parsed:
            if op is re._constants.LITERAL and value < 128:
                run += chr(value)
            elif op is not re._constants.AT:
                runs, run = [*runs, run], ""
        runs.append(run)
    folded = (r.translate({i: i + 32 for i in range(65, 91)}) for r in runs)
    parts = (p for r in folded for p in re.split("[\r\n]", r))
    return [p for p in parts if len(p) > 2]


def candidate_files(index: DataFrame, needle: str, is_regex: bool = False) -> DataFrame | None:
    """The files that hold all trigrams that a match needs, from postings; None where it needs none."""
    grams = sorted({t[i : i + 3] for t in required_texts(needle, is_regex) for i in range(len(t) - 2)})
    if not grams:
        return None
    return index.where(F.col("gram").isin(*grams)).groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("file")


def search_indexed(files: DataFrame, index: DataFrame, needle: str, is_regex: bool = False, ignore_case: bool = True, file: str = "file", text: str = "value") -> DataFrame:
    """The same lines as matching_lines: postings first, then a scan of the files that they leave. A needle without three
    plain characters in a row is looked for in all files."""
    pattern = _pattern(needle, is_regex, ignore_case)
    found = candidate_files(index, needle, is_regex)
    named = files.select(F.col(file).alias("file"), F.col(text).alias("value"))
    if found is not None:
        found = cut_lineage(found, "candidates")
        few = found.limit(SENT + 1).count() <= SENT
        named = named.join(F.broadcast(found) if few else found, "file", "left_semi")
    return lines_of(named).where(F.rlike("text", F.lit(pattern)))


# ---- frames ---------------------------------------------------------------------------------------------------------


def looks_empty(columns: list[str]) -> Column:
    """Whether a row's values are all null or the empty text."""
    return reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == "") for c in columns), F.lit(True))


def frames_first(df: DataFrame, page: str, frame: str, answer: list[str] | str) -> DataFrame:
    """Of a page's frames, the first (the top one before others) whose answer is not empty; the top one where all are.
    answer: the columns that hold it, or a boolean column that tells."""
    empty = ~F.col(answer) if isinstance(answer, str) else looks_empty(answer)
    best = F.row_number().over(W.partitionBy(page).orderBy(empty.cast("int"), frame))
    return df.withColumn("__n", best).where("__n = 1").drop("__n")


def frame_tree(frames: DataFrame, frame: str = "frame", parent: str = "parent") -> DataFrame:
    """frames with `page`, the top frame above each, and `nesting`, the number of frames between: a frame without a parent,
    or whose parent is not there, is a page of its own; frames that only hold each other have no page and are left out.

    By doubling: after k rounds each frame knows the one 2^k above it, so nesting of any depth takes its logarithm in joins.
    What makes the frames runs twice, for the names (which are written) and for the result.
    """
    known = cut_lineage(frames.select(F.col(frame).alias("frame"), F.col(parent).alias("up")), "frame-names")
    there = known.select(F.col("frame").alias("up")).distinct().withColumn("__there", F.lit(True))
    tops = known.join(there, "up", "left")
    start = tops.select("frame", F.when(F.col("__there") & (F.col("up") != F.col("frame")), F.col("up")).otherwise(F.col("frame")).alias("at"))
    start = start.select("frame", "at", (F.col("at") != F.col("frame")).cast("long").alias("steps"))
    # A frame that holds itself stays where it is, and is no page.
    itself = known.where("up = frame").select("frame").distinct()
    jumps = cut_lineage(start.dropDuplicates(["frame"]), "frames")
    left, rounds = jumps.where("at <> frame").count(), 0
    while left and 1 << rounds <= left + 1:
        above = jumps.select(F.col("frame").alias("at"), F.col("at").alias("__at"), F.col("steps").alias("__steps"))
        further = cut_lineage(jumps.join(above, "at").select("frame", F.col("__at").alias("at"), (F.col("steps") + F.col("__steps")).alias("steps")), "frames")
        moved = further.join(jumps.select("frame", F.col("at").alias("__was")), "frame").where("at <> __was").limit(1).count()
        discard(jumps)
        jumps, rounds = further, rounds + 1
        if not moved:
            break
    pages = start.where("at = frame").select(F.col("frame").alias("at")).join(itself.select(F.col("frame").alias("at")), "at", "left_anti")
    placed = jumps.join(pages.distinct(), "at", "left_semi").select(F.col("frame").alias("__frame"), F.col("at").alias("page"), F.col("steps").alias("nesting"))
    return frames.join(placed, frames[frame] == placed["__frame"]).drop("__frame")


def lifted(frames: DataFrame, answer: list[str] | str, frame: str = "frame", parent: str = "parent", place: str | None = None) -> DataFrame:
    """A row a page: the answer of its first frame, from the top down and then by place (or frame), that has one."""
    return lifted_of(frame_tree(frames, frame, parent), answer, place or frame)


def lifted_of(tree: DataFrame, answer: list[str] | str, place: str = "frame") -> DataFrame:
    """The same from a frame_tree."""
    return frames_first(tree.withColumn("__order", F.struct(F.col("nesting"), F.col(place))), "page", "__order", answer).drop("__order")
