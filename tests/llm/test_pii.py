import hashlib
import re

from topolark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in match.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if good(kind, m[0]))


TEXTS = [
    "a@b.c%x@d.e a@b@c.d x@y..z a@b.- _@_.x", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.0255.4 0000000000001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112  4 1 1 1",
    "+1 (555) 123-4567+44 20 7946 0958 +1 +12", "é€😀 a@b.co 😀+1 555-123-4567 1.1.1.1", "1 " * 3000 + "x", "a" * 2500, "a." * 1500 + "@b.c", "1." * 1500, "+" + "1-" * 2000,
    "", None, "x@y.z" * 200, "@@@ a@", "1.1.1.1" * 300, "+1 234 567 8901 4111111111111111", "a@b" + ".c" * 2000, "4111111111111111" + "1" * 500, "378282246310005 6011-1111-1111-1117",
]


def test_base_spans_match_brute_force(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x")], "doc_id long, text string, pii string")
    found = {r.doc_id: r for r in pii.digest(pii.find_pii(df)).collect()}
    for k, text in [*enumerate(TEXTS), (None, TEXTS[0])]:
        spans = brute(text)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert found[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [found[k][f"n_{kind}"] for kind in BASE] == [sum(s[3] == kind for s in spans) for kind in BASE]
        assert [s for s in found[k].spans.split(",") if not s.startswith("iban")] == joined.split(",")


def test_iban_checksum_and_scores(spark):
    text = "my bank account GB82 WEST 1234 5698 7654 32 is fine, DE89370400440532013001 is not"
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.kind, s.text, s.score) for s in row.pii] == [("iban", "GB82 WEST 1234 5698 7654 32", 0.9)]
    scores = pii.find_pii(spark.createDataFrame([(1, "call +1 555 123 4567"), (2, "so +1 555 123 4567")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.pii[0].score for r in scores} == {1: 0.8, 2: 0.6}


def test_context_decides_on_added_kinds(spark):
    iban = "DE89370400440532013000"
    rows = [(1, f"konto {iban}"), (2, f"x {iban}"), (3, f"order {iban}"), (4, f"order of my bank {iban}"), (5, "order 4111 1111 1111 1111"), (6, "konto DE8937040044053201300012")]
    found = {r.doc_id: (r.spans, r.scores) for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found == {1: ("iban:6:28", "90"), 2: ("iban:2:24", "70"), 3: ("", ""), 4: ("iban:17:39", "70"), 5: ("card:6:25", "50"), 6: ("", "")}


def brute_redacted(text, spans):
    merged = []
    for a, _, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    for a, b, kind in reversed(merged):
        text = text[:a] + f"[{kind.upper()}]" + text[b:]
    return text


def test_redaction_covers_the_spans_found(spark):
    texts = [t for t in TEXTS if t is not None] + ["me@10.0.0.1 and +49.10.0.0.1234"]
    df = spark.createDataFrame([(k, t, "x", "y", "z", k) for k, t in enumerate(texts)], "doc_id long, text string, pii string, before_ string, signs string, n int")
    out = pii.redact(df, pii.KINDS[:4], length="n")
    assert out.columns == df.columns
    for r in out.collect():
        spans = brute(texts[r.doc_id])
        assert r.text == brute_redacted(texts[r.doc_id], spans)
        assert r.n == (len(r.text) if spans else r.doc_id) and (r.pii, r.before_, r.signs) == ("x", "y", "z")


def test_redaction_leaves_clean_text_alone(spark):
    rows = [(1, "mail me@x.org or +1 (555) 123-4567 now"), (2, "clean 12 text"), (3, None), (4, "card 4111 1111 1111 1111, host 10.0.0.1, 999.1.1.1")]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string"))
    # A filter on the result must not repeat the work exponentially.
    assert {r.doc_id: r.text for r in out.where("text is null or length(text) > 1").collect()} == {1: "mail [EMAIL] or [PHONE] now", 2: "clean 12 text", 3: None, 4: "card [CARD], host [IP], 999.1.1.1"}


def test_plan_is_native_and_empty_table_works(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.find_pii(df)).count() == 0
    assert "Python" not in pii.find_pii(spark.range(1).selectExpr("id as doc_id", "'a@b.c' as text"))._jdf.queryExecution().toString()
