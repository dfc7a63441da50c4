from msgspark.llm.urls import RULES, url_verdicts


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, "allow"))


URLS = [None, "", "nothing", "://", "http://com/", "http://COM", "https://www.Example.com/en/x?y#z", "https://example.com/en", "http://a.example.com/en/", "http://aexample.com/en/", "ftp://b.net/es/1", "ftp://b.net/fr/", "http://net/es/x#/fr/",
        "http://x.org/a://com/", "http://ÉX.com/é", "http://a..com/", "http://www.example.com/en/", "http://z.www.example.com/en/q", "http://" + "a." * 300 + "com/" + "p/" * 500, "http://www.example.com/en/", "http://" + "." * 100_000 + "net/es/", "http://" + "a." * 50_000 + "example.com/en/" + "q" * 100_000]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(3, "http://b.net/es/", "h", "v")], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_verdicts(pages, rules).collect())
    want = sorted((i, h, p, r or "", v) for i, u in [*enumerate(URLS), (3, "http://b.net/es/")] for h, p, r, v in [brute(u)])
    assert got == want


def test_no_rules_no_pages(spark):
    pages, rules = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_verdicts(pages, rules.where("false")).first().verdict == "allow"
    assert url_verdicts(pages.where("false"), rules).collect() == []
