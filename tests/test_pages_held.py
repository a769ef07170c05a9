"""A task that parses pages holds the values of a few of them at once, however many a batch has."""

import pyarrow as pa
from pyspark.sql import functions as F

from rowloom.sources import pages


def test_few_pages_are_held_at_once(spark):
    class Held(dict):
        alive = 0

        def __init__(self):
            Held.alive += 1
            super().__init__(held=Held.alive)

        def __del__(self):
            Held.alive -= 1

    rows = spark.range(0, 600, 1, 1).select("id", F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.col("id").cast("string"), F.lit("</p>")).alias("html"))
    made = pages._per_page(rows, lambda document, url: Held(), "v", pa.struct([("held", pa.int32())]), "struct<held:int>", "url", "html")
    got = made.select("id", "v.held").collect()
    assert sorted(r.id for r in got) == list(range(600))
    assert max(r.held for r in got) <= 2 * 64
