import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coppice.llm.queries import URL_RULES
from coppice.llm.urls import Rule, build_trie, judge_urls, longest


def plain(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)


RULES = [Rule(h, p, v) for h, p, v in [("b", "/", "allow"), ("a.b", "/x", "block"), ("a.b", "/x/", "allow"), ("b", "/x/yyyy", "block"), ("c.a.b", "/", "block")]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), st.text("/xy", max_size=6))
def test_trie_finds_the_longest_rule(labels, path):
    host = ".".join(labels)
    assert longest(build_trie(RULES), host, path) == plain(RULES, host, path)


URLS = {
    1: None,
    2: "",
    3: "no scheme.org/",
    4: "http://Example.ORG/es/a?b#c",
    5: "https://www.example.org/en/123",
    6: "https://x.example.org/de/1",
    7: "http://a.com/fr/x",
    8: "http://a.com/de/x",
    9: "http://a.com/de",
    10: "http://org",
    11: "http://notorg/",
    12: "http://a.net/x://b.org/y",
    13: "ftp://\nA.org/\n/z?q",
    14: "http://É.org/É#://",
}


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_rules_and_odd_urls(spark, max_bytes):
    pages = spark.createDataFrame([(i, u, "h") for i, u in [*URLS.items(), (7, URLS[7]), (None, URLS[4])]], "page_id long, url string, host string")
    rows = [tuple(r) for r in judge_urls(pages, URL_RULES, max_bytes=max_bytes).collect()]
    found = {r[0]: r[1:] for r in rows}
    assert len(rows) == len(URLS) + 2 and rows.count((7, *found[7])) == 2
    assert found[1] == found[2] == found[3] == ("", "", None, "allow")
    assert found[4] == found[None] == ("example.org", "/es/a", "example.org/es/", "block")
    assert found[5] == ("www.example.org", "/en/123", "example.org/en/1", "block")
    assert found[6] == ("x.example.org", "/de/1", "org/", "allow")
    assert found[7] == ("a.com", "/fr/x", "com/fr/", "allow")
    assert found[8] == ("a.com", "/de/x", "com/de/", "block")
    assert found[9] == ("a.com", "/de", None, "allow")
    assert found[10] == ("org", "", None, "allow")
    assert found[11] == ("notorg", "/", None, "allow")
    assert found[12] == ("a.net", "/x://b.org/y", None, "allow")
    assert found[13] == ("\na.org", "/\n/z", "org/", "allow")
    assert found[14] == ("É.org", "/É", "org/", "allow")
    assert judge_urls(pages.filter("false"), URL_RULES, max_bytes=max_bytes).collect() == []


def test_default_and_wrong_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert judge_urls(pages, URL_RULES, default="block").first().verdict == "block"
    with pytest.raises(ValueError, match="path from"):
        judge_urls(pages, [Rule("a", "x", "block")])
