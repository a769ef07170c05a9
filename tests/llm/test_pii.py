import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(a, k, b) for a, _, k, b in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1@.-+ 0(5)4é\n", max_size=60))
def test_base_spans_equal_regular_expressions(text):
    assert [s for s in pii.find_spans(text) if s[1] in pii.BASE_KINDS] == brute(text)


def test_cards_and_added_spans():
    text = 'pay 4012 8888 8888 1881, token = "24be64439e3e49cf46b2", mailto:a@b.co or tel:+1234567890 from 10.0.0.255.7'
    spans = pii.find_spans(text)
    assert [s for s in spans if s[1] in pii.BASE_KINDS] == brute(text)
    assert {k for _, k, _ in spans} == {"email", "ip", "card", "phone", "contact_uri", "account"}
    assert "4012" not in pii.redact_text(text, spans) and "a@b.co" not in pii.redact_text(text, spans)


def accounts(text):
    return [text[a:b] for a, k, b in pii.find_spans(text) if k == "account"]


def test_cues_and_their_values():
    assert accounts("my account number is 12345678.") == ["12345678"]
    assert accounts("IBAN: DE89 3704 0044 0532 0130 00 is mine, IBAN DE88 3704 0044 0532 0130 00 is wrong") == ["DE89 3704 0044 0532 0130 00"]
    assert accounts("PassWord: hunter2hunter, ACCESS_TOKEN='abc.DEF-123=='") == ["hunter2hunter", "abc.DEF-123=="]
    assert accounts("accountability2024 tokenizer_v2024 secretary12345678 mytoken 12345678a") == []
    assert accounts("SSN 123-45-6789 ssn 000-45-6789 ssn 900-45-6789 social security number: 123 45 6789") == ["123-45-6789", "123 45 6789"]
    assert accounts("passport no. C01X00T47 and account 1234 5678 9012 only") == ["C01X00T47", "1234 5678 9012"]
    assert accounts("account") == accounts("account ") == accounts("account: ") == accounts("iban DE") == []
    kinds = lambda t: [(t[a:b], k) for a, k, b in pii.find_spans(t) if k == "contact_uri"]
    assert kinds("MAILTO:a@b.co, mailto:nobody tel:+1-234-567-890 tel:none sip:x@host sip:host") == [("MAILTO:a@b.co", "contact_uri"), ("tel:+1-234-567-890", "contact_uri"), ("sip:x@host", "contact_uri")]


def test_dense_cues_take_linear_time():
    for piece in ("token", "token ", "token-", "token=", "account-", "account 1-", "iban DE89 ", "ssn 1", "mailto:", "mailto:a", "sip:a@", "+1", "1.", "1 ", "a@", "secret.key/"):
        text = piece * (1_000_000 // len(piece))
        began = time.process_time()
        pii.find_spans(text)
        assert time.process_time() - began < 12, piece


def test_query_on_nulls_long_texts_repeats_and_clashing_columns(spark):
    long = "x" * 200_000 + " a@b.cd " + "1.2.3.4 " * 3
    rows = [(1, None, 5), (2, "", 6), (3, "me@x.org", 7), (3, "me@x.org", 7), (None, long, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(pii.pii_digest(pii.pii_spans(df)).collect(), key=lambda r: (r.doc_id or 0, r.base_sha256))
    assert [(r.doc_id, r.n_email, r.n_ip) for r in got] == [(None, 1, 3), (1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0)]
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    assert got[3].spans == "email:0:8" and got[3].base_sha256 == hashlib.sha256(b"email:0:8").hexdigest()
    assert pii.pii_digest(pii.pii_spans(df.limit(0))).count() == 0
    assert pii.pii_spans(df, redact=True).where("id = 3").first().redacted == "[EMAIL]"


def test_cues_in_one_run_take_linear_time():
    """Five megabytes of cues and of marks behind them: each run is trimmed once."""
    for text in ("token=" * 400_000 + "." * 2_600_000, "tel:" * 600_000 + ":" * 2_600_000, "mailto:" * 700_000, "sip:a" * 1_000_000, "account no " * 450_000):
        began = time.process_time()
        pii.find_spans(text)
        assert time.process_time() - began < 60


def test_fillers_stand_before_values_only():
    kinds = lambda t: [(k, t[a:b]) for a, k, b in pii.find_spans(t)]
    assert kinds("account no longer2024things") == []
    assert kinds("account no 12345678") == [("account", "12345678")]
    assert kinds("account number: AB12345678") == [("account", "AB12345678")]
    assert kinds("account longer2024things") == [("account", "longer2024things")]
    assert kinds("token=abcdefg1... mailto:me@x.org:// tel:+49-30-1234567.") == [
        ("account", "abcdefg1"), ("contact_uri", "mailto:me@x.org"), ("email", "me@x.org"), ("contact_uri", "tel:+49-30-1234567"), ("phone", "+49-30-1234567"),
    ]
