import random
import re
import time

from docmill.llm import urls as U

URLS = [
    "https://a.example.org/es/1", "http://EXAMPLE.org/en/12?x=1", "https://example.org/en/2", "https://x.com/fr/1", "https://x.com/de/1", "https://notorg/x", "https://org/", "https://example.org", "https://example.org?q=/es/",
    "ftp://casino-win.example.net/", "no scheme casino-win", "https://ads-track.example.net/a", "https://sub.spam-farm.example.net", "https://myspam-farm.example.net/", "", None, "https://x.com/de", "a://b://c.com/de/x", "https://h.com/DE/x", "https://h.com/de/x#f", "://org/p", "https://user@x.org/es/",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for action, h, p in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    if best:
        return host, path, best[1], best[0]
    low = (url or "").lower()
    bad = any(re.search(rf"(?:^|[^a-z0-9]){re.escape(r.pattern[1:-1])}(?:[^a-z0-9]|$)", low) for r in U.PATTERN_RULES)
    return host, path, None, "block" if bad else "allow"


def test_verdicts(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judged(df.selectExpr("*", "'mine' AS token", "1 AS host")).collect()}
    assert got == {i: plain(u) for i, u in enumerate([*URLS, URLS[0]])}
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_index_takes_the_rarest_token():
    rules = (U.PatternRule("block", "^common-rare^"), U.PatternRule("block", "*open*"), U.HostRule("block", "example.org", "/en/1"))
    filed = U.index(rules, {"common": 9, "rare": 1, "example": 3, "org": 8, "en": 5})
    assert filed == {"rare": [0], "": [1], "example": [2]}
    assert rules[2].tokens() == ["example", "org", "en"] and rules[1].tokens() == []


def test_ties_and_thousands_of_rules(spark):
    """Every rule tried on every URL gives the same; rules of one length are told apart by action, then name."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcde", k=r.randint(1, 3)))
    rules = tuple({U.HostRule(r.choice(["allow", "block"]), f"{word()}.{word()}", f"/{word()}{r.choice(['', '/'])}") for _ in range(2500)}) + tuple({U.PatternRule(r.choice(["allow", "block"]), f"^{word()}-{word()}^") for _ in range(1500)})
    urls = [f"https://{'.'.join(word() for _ in range(r.randint(2, 4)))}/{'/'.join(word() for _ in range(r.randint(0, 3)))}-{word()}?{word()}" for _ in range(900)]
    got = {x.page_id: (x.rule, x.verdict) for x in U.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    assert 20 < sum(1 for rule, _ in got.values() if rule)
    compiled = [(x, re.compile(x.regex())) for x in rules]
    for i, u in enumerate(urls):
        key = u.removeprefix("https://").partition("?")[0]
        fits = [(len(x.name), x.action == "block", x.name, x.action) for x, c in compiled if isinstance(x, U.HostRule) and c.search(key)]
        hits = {x.action for x, c in compiled if isinstance(x, U.PatternRule) and c.search(u)}
        best = max(fits, default=None)
        assert got[i] == (best and best[2], best[3] if best else "block" if "block" in hits else "allow"), u


def test_candidates_only(spark):
    df = spark.createDataFrame([(1, "https://plain.net/page"), (2, "https://casino.net/")], "page_id long, url string")
    got = {r.page_id: r.n_candidates for r in U.judged(df).collect()}
    assert got[1] == 0 and got[2] >= 1


def test_capitals_and_escapes_against_all_rules(spark):
    """Every rule tried on every URL gives the same."""
    rules = tuple(U.HostRule("block", h, p) for h, p in (("a.org", "/Es/"), ("b.org", "/caf%C3%A9/"), ("c.org", "/EN/"), ("d.org", "/x/Ab"), ("e.org", ""), ("f.org", "/éA/"), ("g.org", "/a.B-c/"))) + (U.PatternRule("block", "^casino^"),)
    urls = [f"https://{h}{p}" for h in ("a.org", "x.b.org", "C.ORG", "d.org", "e.org", "e.organic", "f.org", "g.org") for p in ("/Es/1", "/es/1", "/caf%C3%A9/", "/EN/x", "/x/Abc", "/x/Ab", "/éA/", "/a.B-c/casino", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in U.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    low = str.maketrans(U._UPPER, U._LOWERED)
    for i, u in enumerate(urls):
        host, slash, path = u.removeprefix("https://").partition("/")
        fits = [r.name for r in rules if isinstance(r, U.HostRule) and re.search(r.regex(), host.translate(low) + slash + path)]
        rule = max(fits, key=len, default=None)
        assert got[i] == (rule, "block" if rule or "/casino" in u else "allow"), u
    assert sum(1 for r, _ in got.values() if r) >= 14
    assert rules[0].tokens() == ["a", "org", "es"] and rules[1].tokens() == ["b", "org", "caf", "c3", "a9"]


def test_linear_patterns_equal_plain_ones_and_long_urls_end():
    r = random.Random(7)
    for _ in range(3000):
        rule = U.PatternRule("block", "".join(r.choice("ab.^*") for _ in range(r.randint(1, 7))))
        text = "".join(r.choice("ab./") for _ in range(r.randint(0, 9)))
        assert bool(re.search(rule.regex(), text, re.DOTALL)) == bool(re.search(rule.linear(), text, re.DOTALL)), (rule.pattern, text)
    began = time.process_time()
    for pattern in ("*a*b*c^", "a*a*a*a*b", "^x*y*z^"):
        assert not re.search(U.PatternRule("block", pattern).linear(), "http://h/" + "a" * 100_000, re.DOTALL)
    assert time.process_time() - began < 2


def test_long_url(spark):
    df = spark.createDataFrame([(1, "http://a.example.org/es/" + "a-" * 50_000 + "casino/"), (2, "x" * 100_000)], "page_id long, url string")
    out = {x.page_id: x for x in U.judged(df, rules=(*U.RULES, U.PatternRule("block", "*a*b*c^"))).collect()}
    assert out[1].verdict == "block" and out[1].rule == "example.org/es/" and out[2].verdict == "allow"
