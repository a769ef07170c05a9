"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Words are runs of digits, letters and non-ASCII characters, with A-Z lower-cased. Each benchmark item gives its
windows of WINDOW consecutive words, or one window of all its words if it has fewer. Their rolling hashes are a
sorted array in a broadcast; every document's windows are hashed the same way and looked up, and each hit is
verified against the window's words. Verified words can be cut out as spans, or their documents dropped.

The index is bounded. Items are cut into pieces of PIECE_WORDS words that overlap by a window, so no window is lost;
pieces are dealt by hash into blocks of about BLOCK_CHARS characters, whose true sizes are checked; an executor builds
each block's index, and what the driver collects and broadcasts is that index: the block's words, its pieces as word
numbers, and for each distinct window a hash, a place and the numbers of its items, about 12 bytes a character.
A further block is scanned in the same job by a further Python stage that adds to what was found so far. After CHAINED
blocks what was found is written and their broadcasts are given back, so that no more than so many are ever held at once
however large the benchmark is.

Edge cases: a null or empty text has no words, so it is never hit and, as an item, never found; benchmark rows with
the same id are one item, a null id is the empty string; repeated documents get equal results; an empty table on
either side gives no hits; texts of any length are scanned whole; columns named like the results are replaced.
"""

from __future__ import annotations

import math
import pickle
import re
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm._arrow import col, map_arrow, one_pass, set_aside, without
from rowloom.session import cut_lineage, discard

WINDOW = 10
#: Characters of benchmark text in one block, and words in a piece of an item. A block may hold MOST_OVER times as much.
BLOCK_CHARS, PIECE_WORDS, MOST_OVER = 8_000_000, 2000, 4
#: Blocks that are held at once.
CHAINED = 2

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().lower()) if text else []


def pieces(found: list[bytes], window: int, most: int) -> list[tuple[int, bytes]]:
    """(window length, words joined) of parts that together hold each window of an item once or more."""
    if not found:
        return []
    step = max(1, most - window + 1)
    starts = range(0, max(1, len(found) - window + 1), step)
    return [(min(window, len(found)), b" ".join(found[k : k + step + window - 1])) for k in starts]


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(ids) - length + 1, np.uint64)
    for k in range(length):
        out = out * _BASE + ids[k : k + len(out)]
    return out


class WindowIndex:
    """The distinct windows of one block: flat arrays, so that its size is proportional to the block's text."""

    def __init__(self, parts: list[tuple[str, int, bytes]]):
        """parts: (item, window length, words joined by spaces)."""
        number: dict[str, int] = {}
        known: dict[bytes, int] = {}
        rows: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, length, joined in parts:
            ids = np.array([known.setdefault(w, len(known) + 1) for w in joined.split(b" ")], np.uint32)
            rows.setdefault(length, []).append((number.setdefault(item, len(number)), ids))
        self.items, self.words, self.tables = list(number), b" ".join(known), {}
        for length, own in rows.items():
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, length) for _, ids in own])
            owner = np.repeat(np.array([k for k, _ in own], np.int32), [len(ids) - length + 1 for _, ids in own])
            distinct, of = np.unique(windows, axis=0, return_inverse=True)
            pairs = np.unique(of.ravel().astype(np.int64) << 32 | owner)
            hashes = _hashes_of_rows(distinct)
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at, owners = rank[pairs >> 32], (pairs & 0xFFFFFFFF).astype(np.int32)
            by = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[by], np.arange(len(order) + 1)).astype(np.int64)
            self.tables[length] = (hashes[order], distinct[order], starts, owners[by])

    @cached_property
    def vocabulary(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words.split(b" "), 1)} if self.words else {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "vocabulary"}

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (merged, end exclusive) and the items found, for the words of one document."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in found], np.uint64)
        spans, items = [], set()
        if not ids.any():
            return [], items
        for length, (known, distinct, starts, owners) in self.tables.items():
            if len(ids) < length:
                continue
            hashes = _hashes(ids, length)
            low = np.searchsorted(known, hashes)
            hits = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == hashes)
            met = set()
            for k in hits.tolist():
                row = int(low[k])
                while row < len(known) and known[row] == hashes[k]:
                    if (distinct[row] == ids[k : k + length]).all():
                        spans.append((k, k + length))
                        met.add(row)
                        break
                    row += 1
            for row in met:
                items.update(self.items[o] for o in owners[starts[row] : starts[row + 1]].tolist())
        return merged(spans), items


def _hashes_of_rows(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = out * _BASE + rows[:, k].astype(np.uint64)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its hit words: from the start of a span's first word to the end of its last."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : places[a][0]])
        done = places[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


RESULT = ("n_words", "hit_spans", "hit_items")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, window: int, block_chars: int, piece_words: int):
    """The WindowIndex of each block of the benchmark, one at a time."""

    def cut(batches):
        for batch in batches:
            rows = [(i, n, p) for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True) for n, p in pieces(words(t), window, piece_words)]
            for at in range(0, len(rows), 1000):
                item, n, piece = zip(*rows[at : at + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(n, pa.int32()), pa.array(piece, pa.binary())], names=["item", "n", "piece"])

    def build(batches):
        index = WindowIndex([row for b in batches for row in zip(b.column("item").to_pylist(), b.column("n").to_pylist(), b.column("piece").to_pylist(), strict=True)])
        if index.tables:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(index, 5)], pa.binary())], names=["index"])

    items = benchmark.select(F.coalesce(col(item_id).cast("string"), F.lit("")).alias("item"), col(item_text).alias("text"))
    parts = cut_lineage(map_arrow(items, cut, "item string, n int, piece binary").distinct(), "benchmark-pieces")
    total, longest = parts.agg(F.sum(F.length("piece")), F.max(F.length("piece"))).first()
    limit = MOST_OVER * block_chars
    if (longest or 0) > max(limit, MOST_OVER * BLOCK_CHARS):
        raise ValueError(f"{piece_words} words of a benchmark item have {longest} bytes, too many to send to every executor")
    blocks = max(1, math.ceil((total or 0) / block_chars))
    while True:
        block = F.pmod(F.xxhash64("item", "piece"), F.lit(blocks))
        largest = parts.groupBy(block.alias("block")).agg(F.sum(F.length("piece")).alias("chars")).agg(F.max("chars")).first()[0] or 0
        if largest <= max(limit, longest or 0):
            break
        blocks *= 2
    for k in range(blocks):
        for row in map_arrow(parts.where(block == k).coalesce(1), build, "index binary").collect():
            yield pickle.loads(row["index"])


def find_benchmark(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, piece_words: int = PIECE_WORDS
) -> DataFrame:
    """All columns of df, then n_words, hit_spans (in words) and hit_items (sorted as strings)."""
    kept = without(df.columns, RESULT)
    own = [f"k{i}" for i in range(len(kept))]
    fields = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for k, c in zip(own, kept, strict=True))
    out = df.select(*(col(c).alias(k) for c, k in zip(kept, own, strict=True)))
    # Without an index, documents are scanned for nothing, which counts their words.
    scanned, held, written = False, [], None
    for index in chain(_indexes(benchmark, item_id, item_text, window, block_chars, piece_words), [None]):
        if index is not None or not scanned:
            if len(held) == CHAINED:
                # Documents are scanned by these blocks now, and the next ones go on from the files.
                done = cut_lineage(out, "scanned")
                for sent in held:
                    sent.destroy()
                if written is not None:
                    discard(written)
                out = written = done
                held = []
            sent = df.sparkSession.sparkContext.broadcast(index or WindowIndex([]))
            held.append(sent)
            out = map_arrow(out, _scanner(sent, own, own[kept.index(text_col)]), f"{fields}n_words bigint, hit_spans array<struct<start:int,end:int>>, hit_items array<string>")
            scanned = True
    return out.toDF(*kept, *RESULT)


def _scanner(index, kept: list[str], text_col: str):
    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, spans, items = [], [], []
        before = "hit_spans" in batch.schema.names
        old = list(zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist(), strict=True)) if before else None
        for k, text in enumerate(batch.column(text_col).to_pylist()):
            found = words(text)
            new_spans, new_items = index.value.scan(found) if found else ([], set())
            if old:
                new_spans = merged(new_spans + [(s["start"], s["end"]) for s in old[k][0]])
                new_items = new_items | set(old[k][1])
            n.append(len(found))
            spans.append([{"start": a, "end": b} for a, b in new_spans])
            items.append(sorted(new_items))
        columns = [*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, *RESULT])

    return lambda batches: one_pass(batches, build)


def decontaminate(df: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """df without what the benchmark holds: mode "documents" drops hit documents, "spans" cuts hit words out of their texts."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}: documents or spans")
    aside, names = set_aside(df, RESULT)
    text = names[df.columns.index(text_col)]
    found = find_benchmark(aside, benchmark, text, **options)
    if mode == "documents":
        return found.where(F.size("hit_spans") == 0).select(*map(col, names)).toDF(*df.columns)
    own = [f"k{i}" for i in range(len(names))]
    fields = ", ".join(f"{k} {found.schema[c].dataType.simpleString()}" for k, c in zip(own, names, strict=True))
    place = own[names.index(text)]

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = batch.column("hit_spans").to_pylist()
        cut = [remove_words(t, [(s["start"], s["end"]) for s in sp]) if sp else t for t, sp in zip(batch.column(place).to_pylist(), spans, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cut, pa.string()) if c == place else batch.column(c) for c in own], names=own)

    renamed = found.select(*(col(c).alias(k) for c, k in zip(names, own, strict=True)), "hit_spans")
    return map_arrow(renamed, lambda batches: one_pass(batches, build), fields).toDF(*df.columns)


def decontamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from find_benchmark's."""
    n_hit = F.coalesce(F.aggregate("hit_spans", F.lit(0), lambda t, s: t + s["end"] - s["start"]), F.lit(0)).cast("long")
    return found.select(
        F.col(id_col).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM (SELECT item, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i
        FROM (SELECT item, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0))),
dw AS (
  SELECT rn, l, i, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM (SELECT rn, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i
        FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hits AS (SELECT rn, i, l, item FROM dw JOIN bw USING (l, k)),
places AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(generate_series(i, i + l - 1)) AS p FROM hits) GROUP BY rn),
items AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rn, item FROM hits) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rn) LEFT JOIN items USING (rn)
"""
