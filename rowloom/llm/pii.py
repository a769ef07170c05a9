"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in one scan; at each
anchor a deterministic local parser grows the span outward, finds its boundaries and validates it. No regular
expression runs over the text, and no run of characters is read more than a fixed number of times, so the time is
linear in the text.

Cues count in any letter case, as whole words. Between a cue and its value there may be separators and words such as
"number" or "is". What follows an account cue is an IBAN (checked modulo 97) or an identifier of MIN_ACCOUNT letters
and digits, one of them a digit, with digits in groups; a social security number keeps to the ranges that are given
out; what follows a cue of secrets is a key of MIN_ACCOUNT characters with a digit. Schemes count where a valid
address follows: a mailbox, or the digits of a phone number.

Edge cases: a null text is an empty one and has no spans; each row is judged alone, so repeated rows give equal
results and an empty table gives an empty one; texts of any length are scanned whole; only the id and text
columns are read, so extra columns may have any name.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm._arrow import map_arrow, one_pass, texts

#: Kinds in the order in which spans of equal start are listed. The first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "contact_uri", "account")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_IDENT = _ALNUM | frozenset("-_")
_KEY = _ALNUM | frozenset("-_+/=.~")
_URI = _ALNUM | frozenset("._%+-:@/?=&#~")

# Schemes, cues, and the words and separators that may stand between a cue and its value.
_SCHEMES = ("mailto:", "tel:", "sip:")
_ACCOUNT_CUES = ("iban", "account", "acct", "passport", "konto", "compte", "cuenta")
_NUMBER_CUES = ("ssn", "social security")
_SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "api-key")
_FILLERS = frozenset(("number", "num", "no", "nr", "id", "is", "key", "code", "value", "was"))
_BETWEEN = frozenset(" \t:=#\"'`._->(")

MIN_ACCOUNT = 8
#: Characters between a cue and its value at most.
GAP = 40

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", (0, 1))
    a.add_word("+", (1, 1))
    for d in "0123456789":
        a.add_word(d, (2, 1))
    for kind, words in ((3, _SCHEMES), (4, _ACCOUNT_CUES), (5, _NUMBER_CUES), (6, _SECRET_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_FOUND: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    global _FOUND
    if _FOUND is None:
        _FOUND = _automaton()
    return _FOUND


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _run(text: str, i: int, end: int, allowed: frozenset) -> int:
    while i < end and text[i] in allowed:
        i += 1
    return i


def _email(text: str, at: int, floor: int, end: int) -> tuple[int, int] | None:
    """The span around an at-sign; floor is where the previous email ended."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    stop = _run(text, at + 1, end, _LABEL)
    if stop == at + 1:
        return None
    labels = 0
    while stop < end and text[stop] == ".":
        nxt = _run(text, stop + 1, end, _LABEL)
        if nxt == stop + 1:
            break
        stop, labels = nxt, labels + 1
    return (start, stop) if labels else None


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def _ips(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses in the dotted chain of digit runs that begins at start, and the end of the chain."""
    runs, i = [], start
    while True:
        stop = _run(text, i, end, _DIGITS)
        runs.append((i, stop))
        if stop + 1 < end and text[stop] == "." and text[stop + 1] in _DIGITS:
            i = stop + 1
        else:
            break
    out = []
    for k in range(0, len(runs) - 3, 4):
        if all(_octet(text[a:b]) for a, b in runs[k : k + 4]):
            out.append((runs[k][0], runs[k + 3][1]))
    return out, stop


def _card(text: str, start: int, end: int) -> tuple[int, bool]:
    """The end of the chain of digits with single separators from start, and whether it is a card number."""
    i, digits = start, []
    while True:
        digits.append(text[i])
        i += 1
        if i < end and text[i] in _DIGITS:
            continue
        if i + 1 < end and text[i] in " -" and text[i + 1] in _DIGITS:
            i += 1
            continue
        break
    return i, 12 <= len(digits) <= 19 and luhn("".join(digits))


def _phone(text: str, plus: int, end: int) -> tuple[int, int] | None:
    if plus + 1 >= end or text[plus + 1] not in _DIGITS:
        return None
    last = _run(text, plus + 2, end, _PHONE) - 1
    while last > plus + 2 and text[last] not in _DIGITS:
        last -= 1
    if last <= plus + 2 or text[last] not in _DIGITS:
        return None
    n = sum(c in _DIGITS for c in text[plus + 1 : last + 1])
    return (plus, last + 1) if 9 <= n <= 15 else None


class _Runs:
    """Runs of allowed characters, each read once however many cues point into it; marks may end a run, but no value in it."""

    def __init__(self, text: str, allowed: frozenset, marks: str = ""):
        self.text, self.allowed, self.marks, self.start, self.stop, self.digit, self.trimmed = text, allowed, marks, 0, 0, -1, 0

    def at(self, i: int) -> tuple[int, bool]:
        """The end of the value from i, without marks at its end, and whether a digit is in it."""
        if not self.start <= i < self.stop:
            self.start, self.stop, self.digit = i, _run(self.text, i, len(self.text), self.allowed), -1
            self.trimmed = self.stop
            while self.trimmed > i and self.text[self.trimmed - 1] in self.marks:
                self.trimmed -= 1
            for k in range(self.stop - 1, i - 1, -1):
                if self.text[k] in _DIGITS:
                    self.digit = k
                    break
        return max(i, self.trimmed), self.digit >= i


def _value(text: str, i: int, end: int) -> int:
    """Where the value of a cue that ends at i begins, after separators and filler words; behind such a word, a value has
    a digit among its first four characters, else there is none (end)."""
    stop, filler = min(end, i + GAP), False
    while i < stop:
        if text[i] in _BETWEEN:
            i += 1
            continue
        j = i
        while j < stop and j - i < 8 and text[j] in _ALNUM and text[j] not in _DIGITS:
            j += 1
        if text[i:j].lower() in _FILLERS and j < end and text[j] in _BETWEEN:
            i, filler = j, True
            continue
        break
    return end if filler and not any(c in _DIGITS for c in text[i : i + 4]) else i


def _iban(text: str, i: int, end: int) -> int:
    """The end of the IBAN from i (groups may be parted by single spaces or hyphens), or 0."""
    if not (end - i >= 15 and text[i : i + 2].isascii() and text[i : i + 2].isalpha() and text[i + 2] in _DIGITS and text[i + 3] in _DIGITS):
        return 0
    compact, ends, k = [], [], i
    while k < end and len(compact) <= 34:
        if text[k] in _ALNUM:
            compact.append(text[k].upper())
            k += 1
            if k == end or text[k] not in _ALNUM:
                ends.append((len(compact), k))
        elif text[k] in " -" and k + 1 < end and text[k + 1] in _ALNUM:
            k += 1
        else:
            break
    for n, stop in reversed(ends):
        if 15 <= n <= 34:
            turned = compact[4:n] + compact[:4]
            if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                return stop
    return 0


def _grouped(text: str, i: int, end: int, stop: int) -> int:
    """The end of a run of digits from i that goes on in groups after single spaces; stop is that of the run."""
    if not all(c in "0123456789-" for c in text[i : min(stop, i + 64)]):
        return stop
    while stop + 1 < end and stop - i < 64 and text[stop] == " " and text[stop + 1] in _DIGITS:
        stop = _run(text, stop + 1, min(end, stop + 64), _DIGITS)
    return stop


def _security_number(text: str, i: int, end: int) -> int:
    """The end of the social security number from i, or 0."""
    digits, k = [], i
    while k < end and len(digits) < 10:
        if text[k] in _DIGITS:
            digits.append(text[k])
        elif not (text[k] in " -" and len(digits) in (3, 5) and text[k - 1] in _DIGITS):
            break
        k += 1
    n = "".join(digits)
    if text[k - 1 : k] in ("-", " "):
        k -= 1
    return k if len(n) == 9 and n[:3] not in ("000", "666") and n[0] != "9" and n[3:5] != "00" and n[5:] != "0000" else 0


def _uri(text: str, scheme: str, i: int, stop: int) -> int:
    """The end of the address after a scheme, or 0 if it is none."""
    if scheme == "tel:":
        plain = text[i : min(stop, i + 64)].split("?")[0].split("/")[0]
        return stop if stop > i and 3 <= sum(c in _DIGITS for c in plain) <= 15 and not any(c in "@%" or "a" <= c.lower() <= "z" for c in plain) else 0
    at = _run(text, i, stop, _LOCAL)
    if i < at < stop - 1 and text[at] == "@" and text[at + 1] in _LABEL:
        return stop if scheme == "sip:" or _email(text, at, i, stop) else 0
    return 0


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """All spans of a text as (start, kind, end) in code points, ordered by start and then by kind."""
    found: list[tuple[int, int, int]] = []
    end = len(text)
    mail_end = ip_end = card_end = phone_end = uri_end = account_end = 0
    identifiers, keys, addresses = _Runs(text, _IDENT), _Runs(text, _KEY, "."), _Runs(text, _URI, ".:?#&=/-")
    for at, (kind, width) in automaton().iter(text.translate(_LOWER)):
        if kind == 2:
            if at >= ip_end:
                spans, ip_end = _ips(text, at, end)
                found.extend((a, 1, b) for a, b in spans)
            if at >= card_end:
                card_end, good = _card(text, at, end)
                if good:
                    found.append((at, 2, card_end))
        elif kind == 0:
            if at >= mail_end and (span := _email(text, at, mail_end, end)):
                found.append((span[0], 0, span[1]))
                mail_end = span[1]
        elif kind == 1:
            if at >= phone_end and (span := _phone(text, at, end)):
                found.append((span[0], 3, span[1]))
                phone_end = span[1]
        else:
            start, after = at + 1 - width, at + 1
            if start > 0 and text[start - 1] in _ALNUM:
                continue
            if kind == 3:
                if start >= uri_end and after < end and text[after] in _URI:
                    stop = _uri(text, text[start:after].lower(), after, addresses.at(after)[0])
                    if stop:
                        found.append((start, 4, stop))
                        uri_end = stop
            elif after >= account_end and after < end and text[after] not in _ALNUM:
                i = _value(text, after, end)
                stop = 0
                if kind == 5:
                    stop = _security_number(text, i, end)
                elif kind == 4:
                    stop = _iban(text, i, end)
                    if not stop:
                        run, digit = identifiers.at(i)
                        run = _grouped(text, i, end, run) if digit else run
                        stop = run if digit and _letters_and_digits(text, i, run) >= MIN_ACCOUNT else 0
                else:
                    run, digit = keys.at(i)
                    stop = run if digit and run - i >= MIN_ACCOUNT else 0
                if stop:
                    found.append((i, 5, stop))
                    account_end = stop
    found.sort()
    return [(a, KINDS[k], b) for a, k, b in found]


def _letters_and_digits(text: str, i: int, stop: int) -> int:
    """How many there are, counted up to where it decides."""
    return sum(c in _ALNUM for c in text[i : min(stop, i + 4 * MIN_ACCOUNT)])


def redact_text(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for start, kind, stop in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
            done = stop
        elif stop > done:
            done = stop
    return "".join([*out, text[done:]])


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """id, spans ARRAY<STRUCT<kind,start,end>> and, if asked for, the redacted text of every row."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, spans array<struct<kind:string,start:int,end:int>>" + ", redacted string" * redact

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_texts = texts(batch, "text")
        found = [find_spans(t) for t in all_texts]
        columns = [batch.column("id"), pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in s] for s in found], _SPAN_TYPE)]
        names = ["id", "spans"]
        if redact:
            columns.append(pa.array([redact_text(t, s) for t, s in zip(all_texts, found, strict=True)], pa.string()))
            names.append("redacted")
        return pa.RecordBatch.from_arrays(columns, names=names)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, lambda batches: one_pass(batches, build), schema)


def pii_digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans."""
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        F.col("id").alias("doc_id"), *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("has_personal_data"),
    )
