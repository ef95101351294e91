import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import pii

AUTO = pii.cue_automaton()
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    """The base patterns by plain regular expressions."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def base(text):
    return [s for s in pii.find_spans(text, AUTO) if s[0] in pii.BASE]


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="aZ9012@.+-() %_é:/\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "a.b@c.de", "1.2.3.4", "256.1.1.1", "@", ".", " ", "-", "x", "0", "\U0001F600", "a@b", "+"]), max_size=14))
def test_base_spans_in_dense_texts(parts):
    text = "".join(parts)
    assert base(text) == plain(text)


def test_added_kinds():
    text = 'see https://ex.org/a?b=1). IBAN GB82WEST12345698765432, iban GB00WEST12345698765432; account: 12-3456-77 token = "f3ef4d6b2755"; myaccount 12345'
    got = [(k, text[a:b]) for k, a, b in pii.find_spans(text, AUTO)]
    assert got == [("url", "https://ex.org/a?b=1"), ("account", "GB82WEST12345698765432"), ("account", "12-3456-77"), ("account", "f3ef4d6b2755")]


def test_long_hostile_texts_stay_linear():
    import time

    t = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1.1." * 80_000, "a@" * 100_000, "+1" * 100_000, "1 " * 150_000, "+1" + "." * 200_000, "a=" * 100_000, "key=" + "a1" * 150_000, "=" * 300_000, "token " * 50_000, "iban DE89" + " 3704" * 60_000):
        base(text)
    assert time.time() - t < 20


def test_rows(spark, odd, none):
    got = {(r[0], tuple((s.kind, s.start, s.end) for s in r[1])) for r in pii.find_pii(odd).collect()}
    rows = odd.select("doc_id", "text").collect()
    assert got == {(i, tuple(pii.find_spans(t or "", AUTO))) for i, t in rows} and pii.find_pii(odd).count() == len(rows)
    assert {s[0] for i, t in rows if i == 17 for s in pii.find_spans(t, AUTO)} == {"email", "ip", "phone", "url", "account"}
    assert pii.find_pii(none).count() == 0


def accounts(text):
    return [text[a:b] for k, a, b in pii.find_spans(text, AUTO) if k == "account"]


def test_values_are_taken_whole():
    long = "ab1" * 400
    assert accounts(f"token: {long}") == [long] and accounts(f"token = \"{long}\".") == [long]
    assert accounts("api_key = sk_live_51H8x.Y2eZvKYlo2C") == ["sk_live_51H8x.Y2eZvKYlo2C"]
    assert accounts("iban DE89 3704 0044 0532 0130 00 THE end") == ["DE89 3704 0044 0532 0130 00"]
    assert accounts("IBAN: GB82 WEST 1234 5698 7654 32.") == ["GB82 WEST 1234 5698 7654 32"] and accounts("iban GB00 WEST 1234 5698 7654 32") == []


def test_secrets_by_name_and_by_look():
    assert accounts("password=hunter2") == ["hunter2"] and accounts("db_passwd: 's3cret!x'") == ["s3cret!x"]
    assert accounts("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY") == ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    assert accounts("x = 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b") == ["9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"]
    for clean in ("the key: another thing", "note: see below", "a = b", "time 12:30:45", "x == y", "secret: yes", "ratio=0.5", "https://a.b/c?key=1234567890abcdef1234567890",
                  "password: none", "total = 123456789012345678901234567890"):
        assert accounts(clean) == [], clean


def test_query_columns_match_a_plain_way(spark):
    """The query's own columns, from the spans and patterns over the whole texts of the smallest scale."""
    import hashlib

    from ledgerlens.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op2_pii"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for r in rows:
        want, every = plain(texts[r.doc_id]), pii.find_spans(texts[r.doc_id], AUTO)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(join(want).encode()).hexdigest()
        assert r.spans == join(every) and r.n_spans == len(every) and [s for s in every if s[0] in pii.BASE] == want
        assert (r.n_url, r.n_account) == tuple(sum(s[0] == k for s in every) for k in ("url", "account"))
