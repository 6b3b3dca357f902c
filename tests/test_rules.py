"""Truth tables of the format rules and scalars."""

import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions import scalars
from tamis.functions.predicates import RULES, breaks, register_rule
from tamis.plans.ruleset import label_of, title_case

TABLE = {
    "github_username": (["user", "user123", "user-name", "a", "test-user-123", "User123", "a" * 39],
                        ["", "-username", "username-", "user--name", "a" * 55, "user name", "user@name", "a" * 40]),
    "hexcolor": (["#FF0000", "#00ff00", "FF0000", "#123456"],
                 ["", "#FFF", "#FFFFFFF", "#GGGGGG", "red", "#FF00", "12345", "#FF0000\n"]),
    "api_version": (["", "v1", "v1.2", "v1.2.3", "1.2.3-alpha.1", "2023-01-01", "20230101"], ["invalid", "1.", "v", "v1\n"]),
    "api_content_type": (["", "application/json", "application/xml", "text/plain", "application/json; charset=utf-8", "font/woff2"],
                         ["invalid", "a/b", "application/vnd.x+json"]),
    "semver": (["", "1.2.3", "0.0.1", "1.0.0-alpha.1", "1.0.0-0a", "1.0.0--", "1.0.0+01.x", "1.0.0-a+b"],
               ["1.2", "01.2.3", "v1.2.3", "1.0.0-01", "1.0.0-a..b", "1.0.0-", "1.0.0+", "1.0.0-a.", "1.2.3\n"]),
    "loose_semver": (["1.2.3", "01.002.3", "1.0.0-01", "2.1.3-alpha.1+x"], ["", "1.2", "v1.0.0", "1.0.0-", "1.0.0-a..b"]),
    "deployment_name": (["ab", "a-b", "a", "7", "App2"], ["", "-a", "a-", "2ab", "é", "a_b"]),
    "priority_level": (["", "low", "URGENT", "Normal", "1", "5"], ["0", "6", "mid", "1\n", "12"]),
    "hostname_rfc1123": (["a", "db.example.com", "9a", "a-b.c"], ["", "-a", "a-", "a..b", "a.-b", "a_b", "a" * 254]),
    "hostname": (["ab", "host-1.example", "a1"], ["a", "a.b", "9a", "ab..c", "ab-", ""]),
    "hexadecimal": (["0", "abcDEF09", "0x1f", "0XFF"], ["", "0x", "xyz", "12 "]),
    "uuid": (["123e4567-e89b-12d3-a456-426614174000"], ["123E4567-e89b-12d3-a456-426614174000", "x", ""]),
    "numeric": (["1", "-1.5", "+3"], ["1.", ".5", "1e3", ""]),
    "alpha": (["abc"], ["ab1", "", "é"]),
    "alphanum": (["ab1"], ["a b", ""]),
    "boolean": (["true", "1", "F"], ["yes", "tRUE", ""]),
    "url": (["http://a.b", "https://a.b:80/x?y=%zz#f", "mailto:a@b", "ftp://u:p@h/", "http://[::1]:80/", "file:///tmp/x", "file:/x",
             "http://h:", "urn:isbn:1", "http:///x#f", "x://é.de/ü", "http://a.b/" + "x" * 20000, "http://a.b/" + "%20" * 5000],
            ["", "not a url", "/path", "a.b.c", "http://", "http:", "http://a b/", "http://a.b/%zz", "http://h:port/", "://x",
             "1http://a", "http://a.b/\x01", "http:///x", "http://a.b/#%zz", "http://a{b}/"]),
    "email": (["a@b.co", "a.b+c@sub.example.org", "é@exämple.de", "a@b.c", '"a b"@c.de', '"a@b..c"@d.de', '""@a.de', '"a\\"b"@c.de', '"a \r\n b"@c.de', '"' + "x y\\z " * 30000 + '"@c.de'],
              ['"a"b"@c.de', '"a@c.de', '"a\r\nb"@c.de', '"a\n"@c.de', 'a"b"@c.de', '"a"', '"a"@', '"a"@@c.de', '"\\"@c.de', "", "a", "a@b", "a@@b.co", "a..b@c.de", ".a@b.co", "a.@b.co", "a@b.c0", "a@-b.co", "a b@c.de"]),
    "ip": (["1.2.3.4", "255.255.255.255", "::", "::1", "2001:db8::8:800:200c:417a", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::"],
           ["", "256.1.1.1", "01.2.3.4", "1.2.3", "1::2::3", "1:2:3:4:5:6:7", "::g", "fe80::1%eth0", "1:2:3:4:5:6:7:8:9"]),
}


@pytest.mark.parametrize("rule", TABLE)
def test_format(spark, rule):
    good, bad = TABLE[rule]
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, ok boolean")
    wrong = df.filter(F.expr(f"({breaks(rule, 'v')}) = ok")).collect()
    assert [r.v[:60] for r in wrong] == []


def test_ip_agrees_with_the_standard_library(spark):
    texts = st.one_of(
        st.ip_addresses().map(str), st.text("0123456789abcdef:.", max_size=20),
        st.lists(st.integers(0, 300), min_size=3, max_size=5).map(lambda xs: ".".join(map(str, xs))))
    seen = []

    @settings(max_examples=300, database=None, deadline=None)
    @given(texts)
    def collect(v):
        seen.append(v)

    collect()

    def ok(v):
        try:
            ipaddress.ip_address(v)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(v, ok(v)) for v in seen], "v string, ok boolean")
    assert df.filter(F.expr(f"({breaks('ip', 'v')}) = ok")).collect() == []


def test_long_texts_do_not_overflow_the_matcher(spark):
    long = {"semver": "1.0.0-" + "a." * 20000 + "a", "email": "a." * 20000 + "a@b.co", "hostname": "ab." * 20000 + "c"}
    for rule, v in long.items():
        assert spark.createDataFrame([(v,)], "v string").select(F.expr(breaks(rule, "v"))).first()[0] is False


def test_unknown_and_custom_rule(spark):
    with pytest.raises(KeyError):
        breaks("no_such_rule", "v")
    register_rule("test_even", "{value} % {param} != 0")
    assert spark.range(4).filter(F.expr(breaks("test_even", "id", "integer", 2))).count() == 2
    RULES.pop("test_even")


@pytest.mark.parametrize("ns, text", [
    (0, "0s"), (5, "5ns"), (1500, "1.5µs"), (250_000_000, "250ms"), (6_000_000_000, "6s"), (90_500_000_000, "1m30.5s"),
    (7_200_000_000_000, "2h0m0s"), (-1_500_000_000, "-1.5s"), (3_661_000_000_001, "1h1m1.000000001s")])
def test_duration_text(spark, ns, text):
    assert spark.sql(f"SELECT {scalars.duration_text(f'({ns}L)')}").first()[0] == text


@pytest.mark.parametrize("n, text", [
    ("0", "0"), ("5", "5"), ("3.7", "3.7"), ("-12.25", "-12.25"), ("100000", "100000"), ("1000000", "1e+06"),
    ("1234567", "1.234567e+06"), ("123456789", "1.23456789e+08"), ("0.00001D", "1e-05"), ("0.0001D", "0.0001")])
def test_number_text(spark, n, text):
    assert spark.sql(f"SELECT {scalars.number_text(n)}").first()[0] == text


def test_word_count_knows_unicode_blanks(spark):
    df = spark.createDataFrame([("a\u00a0b\u0085c  d\te",)], "v string")
    assert df.select(F.expr(scalars.word_count("v"))).first()[0] == 5


def test_names():
    assert [label_of(n) for n in ("id", "html_url", "remote_ip", "merge_commit_sha", "io_wait_time", "reported_by")] == [
        "ID", "HTMLURL", "RemoteIP", "MergeCommitSHA", "IOWaitTime", "ReportedBy"]
    assert [title_case(n) for n in ("api", "github", "my_model", "ABC")] == ["Api", "Github", "My_Model", "Abc"]
