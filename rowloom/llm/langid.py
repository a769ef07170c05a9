"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and so the same on all machines. An n-gram
vector binds (multiplies) the vectors of its letters, each permuted (rotated) by its place. A text bundles (adds)
its n-gram vectors; a language prototype bundles those of all its training texts. A document gets the language
whose prototype has the highest cosine with its own bundle.

Training reads every labelled text; each task adds up integer bundles, and the cluster adds those by language and
coordinate, so what reaches the driver is one row for each language, however large the corpus.

Edge cases: a text that is null or holds no letter gets `und` and score 0; rows with a null language teach nothing;
with no training text at all every prediction is `und`, and has_letters tells which texts could have had one (no
document with letters is rejected then); a learned language may itself be named `und`; ties go to the first language
by code point; repeated rows get equal results; an empty table gives an empty one; texts of any length are read whole;
kept columns named like the results are replaced, others may have any name. More than MAX_LANGUAGES distinct languages raise an error, as prototypes
are sent to every executor.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm._arrow import col, map_arrow, one_pass, set_aside, texts, without

DIMENSIONS, N, MAX_LANGUAGES = 1024, 3, 4096
UNKNOWN = "und"

#: N-gram vectors kept by each worker: 64 MB at 1024 dimensions.
CACHED_GRAMS = 65_536


@lru_cache(maxsize=65_536)
def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(code)).integers(0, 2, dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters as one space, with a space at either end."""
    kept = "".join([c if c.isalpha() else " " for c in text.lower()]).split()
    return np.frombuffer(f" {' '.join(kept)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if kept else np.empty(0, np.uint64)


def gram_codes(codes: np.ndarray, n: int = N) -> np.ndarray:
    """Each n-gram of code points (21 bits each) as one integer; n is at most 3."""
    if len(codes) < n:
        return codes[:0]
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out = (out << np.uint64(21)) | codes[k : k + len(out)]
    return out


def gram_vector(gram: int, n: int = N, dimensions: int = DIMENSIONS) -> np.ndarray:
    out = np.ones(dimensions, np.int8)
    for place in range(n):
        out *= np.roll(letter_vector((gram >> (21 * (n - 1 - place))) & 0x1FFFFF, dimensions), place)
    return out


class Grams:
    """Rows of n-gram vectors, made as n-grams turn up."""

    def __init__(self, n: int, dimensions: int):
        self.n, self.dimensions = n, dimensions
        self.row: dict[int, int] = {}
        self.rows = np.empty((256, dimensions), np.int8)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors times their counts; exact, as all values are integers below 2**24 a step."""
        total = np.zeros(self.dimensions, np.int64)
        for at in range(0, len(grams), 4096):
            some, times = grams[at : at + 4096].tolist(), counts[at : at + 4096]
            if len(self.row) + len(some) > CACHED_GRAMS:
                self.row.clear()
            place = np.empty(len(some), np.int64)
            for i, g in enumerate(some):
                k = self.row.get(g)
                if k is None:
                    k = self.row[g] = len(self.row)
                    if k >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                    self.rows[k] = gram_vector(g, self.n, self.dimensions)
                place[i] = k
            picked = self.rows[place]
            if times.sum() < 1 << 24:
                total += (times.astype(np.float32) @ picked.astype(np.float32)).astype(np.int64)
            else:
                total += times.astype(np.int64) @ picked.astype(np.int64)
        return total


@lru_cache(maxsize=4)
def _grams(n: int, dimensions: int) -> Grams:
    return Grams(n, dimensions)


def bundle_text(text: str, n: int = N, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    grams = gram_codes(letter_codes(text), n)
    return _grams(n, dimensions).bundle(*np.unique(grams, return_counts=True)) if len(grams) else None


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = N, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype for each language of the labelled rows."""

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, "text"), strict=True):
                grams = gram_codes(letter_codes(text), n)
                if len(grams):
                    by.setdefault(lang, []).append(grams)
            for lang, parts in by.items():
                v = _grams(n, dimensions).bundle(*np.unique(np.concatenate(parts), return_counts=True))
                total[lang] = total[lang] + v if lang in total else v
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.int64()))], names=["lang", "v"])

    source = df.where(col(lang_col).isNotNull() & col(text_col).isNotNull()).select(col(lang_col).alias("lang"), col(text_col).alias("text"))
    parts = map_arrow(source, partial, "lang string, v array<bigint>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: their prototypes would not be small enough to send to every executor")
    return {r.lang: np.array(r.v, np.float64) for r in rows}


RESULT = ("lang_pred", "score", "has_letters")


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), n: int = N, dimensions: int = DIMENSIONS) -> DataFrame:
    """The kept columns (by default the id alone), then lang_pred, score (the cosine, at least 0) and has_letters."""
    names = sorted(prototypes)
    unit = np.array([prototypes[k] / (np.linalg.norm(prototypes[k]) or 1) for k in names])
    kept = without([id_col, *(c for c in keep if c != id_col)], RESULT)
    own = [f"k{i}" for i in range(len(kept))]
    fields = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for k, c in zip(own, kept, strict=True))

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, lettered = [], [], []
        for text in texts(batch, "text"):
            has = any(map(str.isalpha, text))
            v = bundle_text(text, n, dimensions) if names and has else None
            lettered.append(has)
            if v is None:
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                v = v.astype(np.float64)
                cosines = unit @ (v / (np.linalg.norm(v) or 1))
                k = int(np.argmax(cosines))
                langs.append(names[k])
                scores.append(min(1.0, max(0.0, float(cosines[k]))))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in own), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(lettered, pa.bool_())], names=[*own, *RESULT])

    source = df.select(*(col(c).alias(k) for c, k in zip(kept, own, strict=True)), col(text_col).alias("text"))
    done = map_arrow(source, lambda batches: one_pass(batches, build), f"{fields}lang_pred string, score double, has_letters boolean")
    return done.toDF(*kept, *RESULT)


def with_languages(df: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """df's columns without the rows that are in no language (null texts, and those without a letter); a null language
    becomes the predicted one, where any language can be learned from df."""
    aside, names = set_aside(df, RESULT)
    lang, text = (names[df.columns.index(c)] for c in (lang_col, text_col))
    model = train(aside, text, lang, **options)
    kept = predict(aside, model, names[0], text, keep=tuple(names), **options).where("has_letters")
    found = F.coalesce(col(lang), F.col("lang_pred")) if model else col(lang)
    return kept.select(*(found.alias(c) if c == lang else col(c) for c in names)).toDF(*df.columns)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 2 modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
