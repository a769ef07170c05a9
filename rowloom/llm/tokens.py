"""Exact token counts at every prefix, by dynamic programming.

A text is cut into special strings and pre-tokens as the tokenizer cuts it. Within a pre-token the encoding of
every prefix follows from shorter ones: the last token of a prefix is the one vocabulary suffix that byte-pair
merging would not join differently with the last token before it, so one pass over the bytes stores the token
count of each prefix. A text's table holds the count up to the end of each pre-token, and, where not every prefix of a
pre-token is one token, the counts of its prefixes character by character. So the table has the count of every prefix of
the text, cut as the whole text is cut, and answers truncation and budget questions without encoding anything again.
Where the prefix as a text of its own would be cut otherwise (in white space before a word), its own count may be smaller.

Edge cases: a null text is an empty one and has 0 tokens; every row is judged alone, so repeated rows give equal
results and an empty table an empty one; texts of any length are counted whole; only the id and text columns are
read, so extra columns may have any name.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowloom.llm._arrow import map_arrow, one_pass, texts

#: Pre-tokens of at most this many characters have their counts remembered, for at most CACHE of them at a time.
CACHED_LENGTH, CACHE = 40, 1_000_000

#: The byte-level pre-token pattern of the public tokenizer (a fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: itself if visible Latin-1, else the next free one from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Token counts of all prefixes under one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self._classed_alike: dict[str, bool] = {}
        self.vocabulary = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocabulary))
        self._pair: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[str, int] = {}
        self._inner: dict[str, bytes] = {}
        self._cleared = 0

    def _merge(self, piece: bytes) -> list[bytes]:
        """Byte-pair merging from single bytes, lowest rank first; only for pieces of at most two tokens' length."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _stands(self, left: bytes, right: bytes) -> bool:
        """Whether merging left + right gives back just these two tokens (or right alone after nothing)."""
        known = self._pair.get((left, right))
        if known is None:
            if len(self._pair) > CACHE:
                self._pair.clear()
            known = self._pair[left, right] = self._merge(left + right) == ([left, right] if left else [right])
        return known

    def prefix_counts(self, piece: bytes) -> list[int]:
        """counts[i]: the tokens of piece[:i], for a piece within one pre-token."""
        counts, last = [0], [b""]
        vocabulary, longest = self.vocabulary, self.longest
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - longest), i):
                token = piece[j:i]
                if token in vocabulary and self._stands(last[j], token):
                    counts.append(counts[j] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of {piece!r}")
        return counts

    def _alike(self, c: str) -> bool:
        """Whether the pattern and the tokenizer's own pre-tokenizer, whose Unicode tables are others, class a character alike."""
        same = self._classed_alike.get(c)
        if same is None:
            probe = f"a{c}1{c}!{c} {c}"
            theirs = [probe[a:b] for _, (a, b) in self.library.pre_tokenize_str(probe)]
            same = self._classed_alike[c] = theirs == self.pattern.findall(probe)
        return same

    def pre_tokens(self, part: str) -> list[str]:
        """A text without special strings, cut as the tokenizer cuts it."""
        try:
            part.encode("latin-1")
        except UnicodeEncodeError:
            if not all(map(self._alike, {c for c in part if c > "\u024f"})):
                return [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
        return self.pattern.findall(part)

    def _count(self, piece: str) -> tuple[int, bytes | np.ndarray | None]:
        """The tokens of one pre-token, and those of its prefixes by characters (of a long one as an array); None where all
        of them are one token."""
        raw = piece.encode("utf-8", "surrogatepass")
        counts = self.prefix_counts(raw)
        if len(raw) == len(piece):
            inner = counts[1:]
        else:
            inner, at = [], 0
            for c in piece:
                at += len(c.encode("utf-8", "surrogatepass"))
                inner.append(counts[at])
        n = counts[-1]
        if n == 1 and max(inner) == 1:
            return n, None
        return n, bytes(inner) if len(raw) < 256 else np.array(inner, np.uint32)  # no more tokens than bytes

    def whole(self, piece: str) -> int:
        """The tokens of one pre-token; what is known of its prefixes is kept with it."""
        n = self._whole.get(piece)
        if n is None:
            n, inner = self._count(piece)
            if len(piece) <= CACHED_LENGTH:
                if len(self._whole) > CACHE:
                    self._whole.clear()
                    self._inner.clear()
                    self._cleared += 1
                self._whole[piece] = n
                if inner is not None:
                    self._inner[piece] = inner
        return n

    def _prefixes(self, pieces: list[str], cleared: int) -> list[bytes | np.ndarray | None]:
        """For each pre-token, the counts of its prefixes (of long ones as an array), or None where each is one token."""
        known, whole = self._inner.get, self._whole
        own: list = list(map(known, pieces))
        # Long ones are never kept, and none can be relied on once what was known has been cleared in between.
        fresh = range(len(pieces)) if self._cleared != cleared else (i for i, p in enumerate(pieces) if len(p) > CACHED_LENGTH)
        for i in fresh:
            if own[i] is None and pieces[i] not in whole:
                own[i] = self._count(pieces[i])[1]
        return own

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends (in code points) of the pre-tokens of a text, the exact token count of the text up to each, the numbers of
        those pre-tokens with prefixes of more than one token, and the counts of these prefixes, one after the other."""
        pieces: list[str] = []
        counts: list[int] = []
        inner: list[bytes | np.ndarray | None] = []
        known, find = self._whole, self.pre_tokens
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                pieces.append(part)
                counts.append(1)
                inner.append(None)
            elif part:
                found, cleared = find(part), self._cleared
                pieces += found
                counts += [known.get(p) or self.whole(p) for p in found]
                inner += self._prefixes(found, cleared)
        n = len(pieces)
        ends, upto = np.cumsum(np.fromiter(map(len, pieces), np.uint32, n), dtype=np.uint32), np.cumsum(np.fromiter(counts, np.uint32, n), dtype=np.uint32)
        several = [i for i, own in enumerate(inner) if own is not None]
        parts = [inner[i] for i in several]
        if any(isinstance(p, np.ndarray) for p in parts):
            flat = np.concatenate([p if isinstance(p, np.ndarray) else np.frombuffer(p, np.uint8) for p in parts])
        else:
            flat = np.frombuffer(b"".join(parts), np.uint8)
        return ends, upto, np.array(several, np.uint32), flat

    def truncate(self, text: str, budget: int, table: tuple[np.ndarray, ...] | None = None) -> int:
        """The length in code points of the longest prefix that is whole characters and at most budget tokens; with a
        table, nothing is encoded."""
        table = table or self.table(text)
        ends, counts, several, inner = table
        k = int(np.searchsorted(counts, budget, "right"))
        start, used = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
        if k == len(ends):
            return start
        length = int(ends[k]) - start
        if self.special and self.special.fullmatch(text[start : start + length]):
            return start
        own = prefix_tokens(table, k)
        fits = np.flatnonzero(used + own <= budget)
        return start + (int(fits[-1]) + 1 if len(fits) else 0)


def prefix_tokens(table: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """The token counts of the prefixes, character by character, of the k-th pre-token of a table."""
    ends, _, several, inner = table
    length = int(ends[k]) - (int(ends[k - 1]) if k else 0)
    at = int(np.searchsorted(several, k))
    if at == len(several) or several[at] != k:
        return np.ones(length, np.int64)
    before = several[:at]
    begin = int((ends[before].astype(np.int64) - np.where(before > 0, ends[before - (before > 0)], 0)).sum())
    return inner[begin : begin + length].astype(np.int64)


def tokens_before(table: tuple[np.ndarray, ...], position: int) -> int:
    """The token count of the prefix of this many code points."""
    ends, counts, *_ = table
    k = int(np.searchsorted(ends, position, "left"))
    if position <= 0:
        return 0
    start, used = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
    return used + int(prefix_tokens(table, k)[position - start - 1])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_table(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """id, n_bytes, n_tokens, the table of the text's prefixes and, with a budget, cut_at: the code points kept within it.
    The table is BINARY: prefix_ends, prefix_tokens and prefix_several are little-endian uint32s, prefix_inner is their width
    in bytes (1 or 4) and unsigned numbers of it; read_table reads them.

    path is the vocabulary file; without one, every executor finds byte_bpe_50k.json in its own public_tokenizers.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_bytes bigint, n_tokens bigint, prefix_ends binary, prefix_tokens binary, prefix_several binary, prefix_inner binary" + ", cut_at bigint" * (budget is not None)

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path or vocabulary_path())
        all_texts = texts(batch, "text")
        tables = [c.table(t) for t in all_texts]
        columns = [
            batch.column("id"),
            pa.array([len(t.encode()) for t in all_texts], pa.int64()),
            pa.array([int(t[1][-1]) if len(t[1]) else 0 for t in tables], pa.int64()),
            *(pa.array([t[i].astype("<u4").tobytes() for t in tables], pa.binary()) for i in range(3)),
            pa.array([bytes([t[3].itemsize]) + t[3].tobytes() for t in tables], pa.binary()),
        ]
        if budget is not None:
            columns.append(pa.array([c.truncate(t, budget, x) for t, x in zip(all_texts, tables, strict=True)], pa.int64()))
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_tokens", "prefix_ends", "prefix_tokens", "prefix_several", "prefix_inner", "cut_at"][: len(columns)])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, lambda batches: one_pass(batches, build), schema)


def read_table(row) -> tuple[np.ndarray, ...]:
    """A text's table out of a row of token_table."""
    three = (np.frombuffer(row[c], "<u4") for c in ("prefix_ends", "prefix_tokens", "prefix_several"))
    return (*three, np.frombuffer(row["prefix_inner"], f"<u{row['prefix_inner'][0]}", offset=1))
