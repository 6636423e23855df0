"""Personal data in lists and before other words."""

from test_operators import docs_of

from quarry.llm import pii


def test_pii_context_spans_other_matches(spark):
    rows = [(1, "SSN 123-45-6789, 234-56-7890", "s"), (2, "123-45-6789, 234-56-7890 are SSN", "s"), (3, "SSN " + "x" * 40 + " 234-56-7890", "s"),
            (4, "tel 030 1234567, 030 2345678, 030 3456789", "s"), (5, "SSN " + "x" * 25 + " 123-45-6789, 234-56-7890", "s")]
    got = {r.doc_id: r.spans for r in pii.digest(docs_of(spark, rows)).collect()}
    assert got[1] == "ssn:4:15,ssn:17:28" and got[2] == "ssn:0:11,ssn:13:24" and got[3] == ""
    assert got[4] == "phone:4:15,phone:17:28,phone:30:41" and got[5] == "ssn:30:41"


def test_pii_iban_before_other_words(spark):
    rows = [(1, "ES91 2100 0418 4502 0005 1332 BIC CAIX", "s"), (2, "ES91 2100 0418 4502 0005 1332 CODE X12", "s"), (3, "DE89 3704 0044 0532 0130 00 BIC", "s"), (4, "ES91 2100 0418 4502 0005 1333 BIC", "s")]
    got = {r.doc_id: r.spans for r in pii.digest(docs_of(spark, rows)).collect()}
    assert got == {1: "iban:0:29", 2: "iban:0:29", 3: "iban:0:27", 4: ""}
