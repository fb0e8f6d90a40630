"""Every shipped rule fits a sample URL of its purpose, and the junk hosts of the pages are blocked."""

from basketry.llm import url_filter

SAMPLES = {
    "spam-farm.": "www.spam-farm.test/a", "cheap-pills.": "cheap-pills.test/", "ads-track.": "m.ads-track.test/", "/banner/": "a.test/banner/1",
    "||doubleclick^": "doubleclick/x", "||doubleclick.": "ad.doubleclick.test/x", "||adserver.": "adserver.test/", "||ads.": "ads.test/",
    "||tracker.": "tracker.test/", "/adclick^": "a.test/adclick?x=1", "/popup/": "a.test/popup/", "casino^": "a.test/casino/",
    "||casino-": "m.casino-win.test/en/1", "||casino.": "www.casino.test/", "||free-bet": "free-bets.test/", "||bets.": "my.bets.test/",
    "||betting.": "betting.test/", "||betting-": "a.betting-odds.test/", "||adult-x": "blog.adult-x.test/", "||xxx.": "xxx.test/",
    "/phishing/": "a.test/phishing/x", "*.exe^": "a.test/setup.exe",
}


def test_rules_fit_their_purpose(spark):
    for (pattern, _), (k, url) in ((r, (r[0], SAMPLES[r[0]])) for r in url_filter.PATTERN_RULES):
        rules = url_filter.rule_table(spark, [(pattern, pattern, "block", 0)])
        pages = spark.createDataFrame([(1, f"http://{url}"), (2, "http://plain.test/adult-education/alphabet.html")], "page_id long, url string")
        got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules).collect()}
        assert got == {1: "block", 2: "allow"}, k


def test_junk_hosts(spark):
    hosts = ["m.casino-win.example.com", "free-bets.example.com", "blog.adult-x.example.com", "ad.doubleclick.example.com", "adult-education.example.com"]
    pages = spark.createDataFrame([(i, f"https://{h}/en/7.html") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, url_filter.default_rules(spark)).collect()}
    assert [got[i] for i in range(5)] == ["block"] * 4 + ["allow"]
