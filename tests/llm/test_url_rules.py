import random
import re

from veilstone.llm import url_rules as u

URLS = [
    "http://a.com/", "http://a.com", "HTTP://WWW.Example.COM/en/x", "https://x.example.com/en/1", "https://x.example.com/EN/1", "http://b.net/es/9", "http://b.net/fr", "http://b.net/fr/",
    "http://casino.org/x", "http://a.org/adult?x", "http://a.org/adults", "nothing", "", None, "://", "http://com/", "http://notexample.com/en/", "x://y.net/es/#a", "http://www.example.com/en/?q=http://b.net/es/",
]


def brute(url, rules=u.PATH_RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(t), t, v) for v, t in rules for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        _, rule, verdict = max(fits, key=lambda f: f[0])
        return host, path, rule, verdict
    words = re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (host + "/" + path).lower())
    return host, path, None, "block" if set(words) & set(u.BLOCK_WORDS) else "allow"


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, x, "h", "clash") for i, x in enumerate(URLS)], "page_id long, url string, host string, html string")
    for rows in (u.INDEX_ROWS, 0):  # literal index; joined index
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(pages, index_rows=rows).collect()}
        assert got == {i: brute(x) for i, x in enumerate(URLS)}


def test_index_takes_the_rarest_token(spark):
    urls = spark.createDataFrame([("a.example.com", "/en/")] * 3 + [("b.com", "/en/")] * 5, "host string, path string")
    index = u.rarest([u.path_rule("block", "example.com/en/")], urls)
    assert list(index) == ["example"]


def test_only_whole_words_of_a_path_are_tokens():
    assert u.path_rule("block", "a.com/en/ab").tokens == ("a", "com", "en")


def test_many_rules(spark):
    r = random.Random(5)
    rules = [(r.choice(["allow", "block"]), f"{r.choice('abc')}.{r.choice(['com', 'net'])}/{r.choice(['', 'x/', 'y/', 'x/y'])}") for _ in range(12)]
    rules = list({t: (v, t) for v, t in rules}.values())
    urls = [f"http://{r.choice(['', 'w.'])}{r.choice('abcd')}.{r.choice(['com', 'net'])}/{r.choice(['x/', 'y/', 'x/yz', 'q', ''])}" for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for rows in (100, 0):
        got = {x.page_id: (x.rule, x.verdict) for x in u.judge(pages, [u.path_rule(*t) for t in rules], index_rows=rows).collect()}
        assert got == {i: brute(x, rules)[2:] for i, x in enumerate(urls)}


def test_no_rules_no_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(pages).count() == 0
    assert u.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), []).first().verdict == "allow"
