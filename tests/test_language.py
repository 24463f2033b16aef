from datetime import datetime

import pytest

from sparklode.plans import query as q
from sparklode.plans.literals import Bounds, QueryError, byte_count, date_test, size_test


def test_or_binds_tighter_than_and():
    t = q.parse("report summary|draft ext:pdf")
    assert t == q.All((q.Term("report"), q.Any((q.Term("summary"), q.Term("draft"))), q.Test("ext", frozenset({"pdf"}))))
    assert q.parse("<a|b> !c") == q.All((q.Any((q.Term("a"), q.Term("b"))), q.Not(q.Term("c"))))


def test_quotes_escapes_and_keys():
    assert q.parse('"a \\"b\\\\ (c)"') == q.Term('a "b\\ (c)', True)
    assert q.parse('"ext:pdf"') == q.Test("ext", frozenset({"pdf"}))
    assert q.parse('"" *.rs') == q.Term("*.rs", True)
    assert q.parse("regex:a|b") == q.Any((q.Pattern("a"), q.Term("b")))
    assert q.parse("unknown:x") == q.Term("unknown:x")
    assert q.parse('"and" x') == q.All((q.Term("and", True), q.Term("x")))
    assert q.parse("") == q.Everything()


def test_comparison_inside_angle_group():
    assert q.parse("<size:>4b|ext:md>") == q.Any((q.Test("size", ">4b"), q.Test("ext", frozenset({"md"}))))


@pytest.mark.parametrize("text", ['"a', "<a", "(a", "a)", "a OR", "NOT", "| a", "size:zz", "dm:2024-13-01", "dm:!=2024-01-01", "in:rel", "ext:;", "type:nope", "content:", "regex:", "tag:"])
def test_invalid(text):
    with pytest.raises(QueryError):
        q.parse(text)


def test_sizes():
    assert byte_count("1.5k") == 1536 and byte_count("2mib") == 2 << 20 and byte_count("3 ".strip()) == 3 and byte_count("1petabytes") == 1 << 50
    assert size_test("tiny") == Bounds(1, 10240) and size_test("1..2k") == Bounds(1, 2048)
    assert size_test("!=0b").negated and size_test(">4").low_open
    with pytest.raises(QueryError):
        size_test("5..1")


def test_dates():
    now = datetime(2024, 2, 14, 15, 30)
    assert date_test("thisweek", now) == Bounds(datetime(2024, 2, 11), datetime(2024, 2, 18), high_open=True)
    assert date_test("thisweek", now, 0).low == datetime(2024, 2, 12)
    assert date_test("lastmonth", datetime(2024, 1, 31)) == Bounds(datetime(2023, 12, 1), datetime(2024, 1, 1), high_open=True)
    assert date_test("pastmonth", datetime(2024, 3, 31, 1)).low == datetime(2024, 2, 29, 1)
    assert date_test("01/02/2024", now).low == datetime(2024, 1, 2) and date_test("01-02-2024", now).low == datetime(2024, 2, 1)
    assert date_test(">2024-01-01", now) == Bounds(low=datetime(2024, 1, 1), low_open=True)


def test_required_literals():
    need = lambda s: set(q.required_literals(q.parse(s)))
    assert need("content:shared AND (content:left OR content:right)") == {"shared"}
    assert need("content:left OR content:right") == set()
    assert need("content:needle OR content:needle") == {"needle"}
    assert need("NOT content:needle") == set() and need("content:ab") == set() and need("content:äöü") == set()


def test_ranking_term_and_metadata():
    assert q.ranking_term(q.parse("ab abc xyz !longest")) == "abc"
    assert q.needs_metadata(q.parse("a size:>1k")) and not q.needs_metadata(q.parse("a ext:md"))
