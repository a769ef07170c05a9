"""Secret scans with character Markov models, in DataFrame operations only.

Three base patterns find assignments of secrets, access keys and long hexadecimal runs. Every other run of at least
MIN_RUN key characters is judged by two first-order Markov models over characters, one of random strings and one of
ordinary words and identifiers: where the log-likelihood ratio says EVIDENCE or more for random, and EACH or more for a
character, the run is a secret of the kind "random". Both models are counted from labelled samples with add-one smoothing; a trained model
is a table of one whole number (thousandths of a nat) for each pair of characters, of fixed size, sent as a literal.

The labelled samples of the query are RANDOM_SAMPLES hashes of numbers in four alphabets, as random strings, and as
ordinary ones the words of a bounded sample of documents (the TRAINED_ON least hashes of ids, whole texts) without
what the base patterns match, once as they are, once as snake-case and once as camel-case identifiers, and lines of
one repeated character.

SQL functions tell the matches of a pattern but not their places; these follow from the lengths of matches and of the
pieces between them, by running sums in blocks (n matches take n * sqrt(n) steps).

Edge cases: a null text is an empty one and has no spans; each row is judged alone, so repeated rows give equal
results and an empty table an empty one; long texts are scanned whole; spans of one kind do not overlap, those of two
base kinds may, and a random run never holds a base span; runs in which both models are as likely are no secrets;
only the id and text columns are read, so extra columns may have any name; without any sample both models are even,
and nothing is added to the base spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm._arrow import col

#: Kinds in the order in which spans of equal start are listed. The first three are the base kinds.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")

# The base patterns and what makes a match of each count.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Characters of a run that is judged, at least; and the log-likelihood ratio, in thousandths of a nat, that makes it a secret, in all and a character.
MIN_RUN, EVIDENCE, EACH = 16, 10_000, 1000
#: Bounds of the labelled sample: documents, and random strings of each alphabet.
TRAINED_ON, RANDOM_SAMPLES = 2000, 4000
#: Length of the lines of one character among the ordinary samples.
LINE = 2000

_RUN = "[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN
_TOKEN = "[A-Za-z0-9+/_=-]{2,}"
# A run of MIN_HEX or more is found by asking for that many at once; so is an access key.
_LONG_HEX, _LONG_ACCESS = "[0-9a-f]{%d,}" % MIN_HEX, "AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4)
_SPANS = "array<struct<start:int,end:int,match:string>>"


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def _running(numbers: Column) -> Column:
    """Running sums, by sums of blocks of about the square root of the length."""

    def blocks(b: Column) -> Column:
        add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
        width, numbers = b["width"], b["numbers"]
        starts = F.sequence(F.lit(0), F.floor(F.size(numbers) / width).cast("int"))
        sums = F.transform(starts, lambda k: add(F.slice(numbers, k * width + 1, width)))
        before = lambda sums: F.transform(starts, lambda k: add(F.slice(sums, F.lit(1), k)))
        in_block = lambda i: F.floor(i / width).cast("int")
        return _let(_let(sums, before), lambda head: F.transform(numbers, lambda x, i: head[in_block(i)] + add(F.slice(numbers, in_block(i) * width + 1, i - in_block(i) * width)) + x))

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers))).cast("int"))
    return _let(F.struct(numbers.alias("numbers"), width.alias("width")), blocks)


def _cut(text: Column, pattern: str) -> Column:
    """The matches of a pattern, and the pieces around them, one more than matches."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))


def _placed(cut: Column) -> Column:
    """start, end (code points) and match of every match."""
    lengths = F.zip_with(F.slice(cut["pieces"], F.lit(1), F.size(cut["found"])), cut["found"], lambda p, m: F.length(p) + F.length(m))
    struct = lambda ends: F.transform(cut["found"], lambda m, i: F.struct((ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), m.alias("match")))
    return _let(_running(lengths), struct)


def _spans(text: Column, pattern: str, count=None) -> Column:
    """Leftmost non-overlapping matches of a pattern, without those that do not count."""
    every = _let(_cut(text, pattern), _placed)
    every = every if count is None else F.filter(every, lambda s: count(s["match"]))
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast(_SPANS))


def _assigns(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= MIN_VALUE


def _blanked(text: Column) -> Column:
    """The text with spaces in place of every assignment that counts, of the same length."""

    def blank(cut: Column) -> Column:
        gone = lambda m: F.when(_assigns(m), F.rpad(F.lit(""), F.length(m), F.lit(" "))).otherwise(m)
        return F.array_join(F.zip_with(cut["pieces"], cut["found"], lambda p, m: F.concat(p, F.coalesce(gone(m), F.lit("")))), "")

    return F.when(text.rlike(ASSIGN), _let(_cut(text, ASSIGN), blank)).otherwise(text)


def _evidence(run: Column, model: list[int]) -> Column:
    """The log-likelihood ratio of a run, in thousandths of a nat."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    places = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.get(table, a * len(ALPHABET) + b))
    return F.aggregate(_let(places, pairs), F.lit(0).cast("long"), lambda a, x: a + x)


def labelled_samples(df: DataFrame, documents: int = TRAINED_ON, strings: int = RANDOM_SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """value and secret: random strings made from numbers, and ordinary words and identifiers of so many documents."""
    least = df.select(col(id_col).alias("id")).where("id IS NOT NULL").orderBy(F.sha2(F.col("id").cast("string"), 256)).limit(documents)
    text = F.regexp_replace(F.coalesce(col(text_col), F.lit("")), f"{ASSIGN}|{_LONG_ACCESS}|{_LONG_HEX}", " ")
    texts = df.select(col(id_col).alias("id"), text.alias("text")).join(F.broadcast(least), "id", "left_semi")
    first = lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)
    camel = F.array_join(F.transform(F.split("text", " "), first), "")
    forms = texts.select(F.explode(F.array("text", F.translate("text", " ", "_"), camel)).alias("text"))
    ordinary = forms.select(F.explode(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))).alias("value"), F.lit(False).alias("secret"))
    digest = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256)
    plain = F.base64(F.unhex(digest))
    made = F.array(digest, plain, F.translate(plain, "+/", "-_"), F.upper(F.regexp_replace(plain, "[+/=]", "")))
    random = df.sparkSession.range(strings).select(F.explode(made).alias("value"), F.lit(True).alias("secret"))
    lines = df.sparkSession.range(len(ALPHABET)).select(F.repeat(F.substring(F.lit(ALPHABET), F.col("id").cast("int") + 1, F.lit(1)), LINE).alias("value"), F.lit(False).alias("secret"))
    return ordinary.unionByName(random).unionByName(lines)


def train(samples: DataFrame) -> list[int]:
    """For each pair of characters, row by row: thousandths of a nat that it speaks for a random string."""
    pairs = F.expr("transform(sequence(1, length(value) - 1), i -> concat(c[i - 1], c[i]))")
    seen = samples.where("length(value) > 1").withColumn("c", F.split("value", "")).select("secret", F.explode(pairs).alias("pair"))
    counts = {(r.secret, r.pair): r["count"] for r in seen.groupBy("secret", "pair").count().where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect()}  # two for each pair at most
    logs = {}
    for secret in (True, False):
        for a in ALPHABET:
            total = sum(counts.get((secret, a + b), 0) for b in ALPHABET) + len(ALPHABET)
            for b in ALPHABET:
                logs[secret, a + b] = math.log((counts.get((secret, a + b), 0) + 1) / total)
    return [round(1000 * (logs[True, a + b] - logs[False, a + b])) for a in ALPHABET for b in ALPHABET]


def secret_spans(df: DataFrame, model: list[int], id_col: str = "doc_id", text_col: str = "text", evidence: int = EVIDENCE) -> DataFrame:
    """id, and spans ARRAY<STRUCT<start,kind,end,match>> of every row, by start and then by kind."""
    rows = df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    found = rows.select("id", "text", _spans(text, ASSIGN, _assigns).alias("assign"), _spans(text, _LONG_ACCESS).alias("access"), _spans(text, _LONG_HEX).alias("hex"))
    judged = lambda m: ~m.rlike(f"{_LONG_ACCESS}|{_LONG_HEX}") & (_evidence(m, model) >= F.greatest(F.lit(evidence), F.length(m) * EACH))
    random = F.when(text.rlike(_RUN), _let(_blanked(text), lambda t: _spans(t, _RUN, judged))).otherwise(F.array().cast(_SPANS))
    named = lambda k, c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["match"].alias("match")))
    spans = F.array_sort(F.concat(*(named(i, F.col(k)) for i, k in enumerate(BASE_KINDS)), named(len(BASE_KINDS), random)))
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return found.select("id", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), kind(s).alias("kind"), s["end"].alias("end"), s["match"].alias("match"))).alias("spans"))


def secret_digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans."""
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The same in SQL: training counts, places of matches by window sums, and ratios by a join with the table of pairs."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    cut = lambda kind, text, pattern, where="true": f"""  -- matches of one kind with their places
  {kind}_parts AS (SELECT rn, unnest(regexp_extract_all({text}, {quote(pattern)})) AS m, unnest(string_split_regex({text}, {quote(pattern)})) AS p, generate_subscripts(string_split_regex({text}, {quote(pattern)}), 1) AS i FROM {"blanked" if text == "u" else "d"}),
  {kind}_at AS (SELECT rn, i, m, p, sum(length(p) + coalesce(length(m), 0)) OVER (PARTITION BY rn ORDER BY i)::INT AS e FROM {kind}_parts),
  {kind}_all AS (SELECT rn, e - length(m) AS s, e, m FROM {kind}_at WHERE m IS NOT NULL AND {where})"""  # noqa: E731
    long_value = f"length(regexp_extract(m, {quote(ASSIGN)}, 2)) >= {MIN_VALUE}"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
  least AS (SELECT doc_id FROM d WHERE doc_id IS NOT NULL ORDER BY sha256(doc_id::VARCHAR) LIMIT {TRAINED_ON}),
  plain AS (SELECT regexp_replace(t, {quote(f"{ASSIGN}|{_LONG_ACCESS}|{_LONG_HEX}")}, ' ', 'g') AS t FROM d WHERE doc_id IN (FROM least)),
  forms AS (SELECT unnest([t, replace(t, ' ', '_'), array_to_string(list_transform(string_split(t, ' '),
    lambda w: CASE WHEN regexp_matches(w, '^[a-z]') THEN upper(w[1]) || w[2:] ELSE w END), '')]) AS t FROM plain),
  hashes AS (SELECT sha256('random:' || i) AS h, to_base64(from_hex(sha256('random:' || i))) AS b FROM range({RANDOM_SAMPLES}) r(i)),
  al AS (SELECT unnest(range(1, {len(ALPHABET) + 1})) AS i, unnest(string_split('{ALPHABET}', '')) AS ch),
  samples AS (
    SELECT unnest(regexp_extract_all(t, {quote(_TOKEN)})) AS v, false AS secret FROM forms
    UNION ALL SELECT unnest([h, b, translate(b, '+/', '-_'), upper(regexp_replace(b, '[+/=]', '', 'g'))]), true FROM hashes
    UNION ALL SELECT repeat(ch, {LINE}), false FROM al),
  values AS (SELECT v, secret, count(*) AS n FROM samples GROUP BY ALL),
  pairs AS (SELECT secret, unnest(list_transform(range(1, length(v)), lambda i: v[i:i + 1])) AS ab, n FROM values),
  counts AS (SELECT secret, ab, sum(n) AS n FROM pairs GROUP BY ALL),
  every AS (SELECT a.ch AS a, a.ch || b.ch AS ab, secret FROM al a, al b, (VALUES (true), (false)) s(secret)),
  logs AS (
    SELECT secret, ab, ln((coalesce(n, 0) + 1)::DOUBLE / (sum(coalesce(n, 0)) OVER (PARTITION BY secret, a) + {len(ALPHABET)})) AS l
    FROM every LEFT JOIN counts USING (secret, ab)),
  model AS (SELECT ab, round(1000 * (max(l) FILTER (WHERE secret) - max(l) FILTER (WHERE NOT secret)))::BIGINT AS w FROM logs GROUP BY ab),
{cut("assign", "t", ASSIGN, long_value)},
{cut("access", "t", _LONG_ACCESS)},
{cut("hex", "t", _LONG_HEX)},
  blanked AS (SELECT rn, string_agg(p || CASE WHEN m IS NULL THEN '' WHEN {long_value} THEN repeat(' ', length(m)) ELSE m END, '' ORDER BY i) AS u FROM assign_at GROUP BY rn),
{cut("run", "u", _RUN, f"NOT regexp_matches(m, {quote(_LONG_ACCESS + '|' + _LONG_HEX)})")},
  run_pairs AS (SELECT rn, s, e, m, unnest(list_transform(range(1, length(m)), lambda i: m[i:i + 1])) AS ab FROM run_all),
  random_all AS (SELECT rn, s, e, m FROM run_pairs JOIN model USING (ab) GROUP BY ALL HAVING sum(w) >= greatest({EVIDENCE}, {EACH} * length(m))),
  spans AS (
    SELECT rn, s, e, 0 AS k FROM assign_all UNION ALL SELECT rn, s, e, 1 FROM access_all UNION ALL SELECT rn, s, e, 2 FROM hex_all UNION ALL SELECT rn, s, e, 3 FROM random_all),
  named AS (SELECT rn, s, k, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || s || ':' || e AS name FROM spans)
SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE k = 3) AS n_random,
  sha256(coalesce(string_agg(name, ',' ORDER BY s, k) FILTER (WHERE k < 3), '')) AS base_sha256, coalesce(string_agg(name, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN named USING (rn) GROUP BY rn, doc_id
"""
