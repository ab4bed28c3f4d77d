import __spark_entry__ as contract
from check_oracle import compare, connect
from helpers import SF
from tidemark.llm import url_rules as urls


def test_query(spark):
    text, _, good = compare(spark, connect(SF), "op6_url_filter", SF)
    assert good, text


def judged(spark, rows, **more):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, **more).collect()}


def canonical(target):
    return f'<link rel="canonical" href="{target}">'


def test_rules(spark):
    got = judged(spark, [(u, "") for u in ("http://a.ORG/x", "http://org/", "http://a.org", "x://example.org/en/12?a", "http://b.example.org/en/2",
                                           "http://fexample.org/en/1", "http://a.com/de/", "http://a.com/DE/", "//a.com/de/", "http://com.net/de/")])
    assert [got[i][0] for i in range(10)] == ["org/", "org/", None, "example.org/en/1", "org/", "org/", "com/de/", None, None, None]
    assert [got[i][1] for i in range(10)] == ["allow"] * 3 + ["block", "allow", "allow", "block", "allow", "allow", "allow"]


def test_blocks_follow_aliases(spark):
    rows = [("http://a.net/1", canonical("http://x.com/de/p")), ("http://b.net/1", '<meta http-equiv=refresh content="0; URL=//a.net/1">'),
            ("http://c.org/1", canonical("http://x.com/de/p")), ("http://d.net/", canonical("/e?x=1&amp;y=2#f")), ("http://d.net/e?x=1&y=2", ""),
            ("http://f.net/1", "<!-- " + canonical("http://x.com/de/p") + "-->"), (None, canonical("http://x.com/de/p"))]
    assert [v[1] for _, v in sorted(judged(spark, rows[:2]).items())] == ["block", "block"]
    # an allowed alias outweighs a blocked one, for addresses without a rule
    assert [v[1] for _, v in sorted(judged(spark, rows).items())] == ["allow"] * 7
    more = spark.createDataFrame([("d.net/e?x=1&y=2", "y.com/de/")], "a string, b string")
    got = judged(spark, rows, more_links=more)
    assert got[3][1] == got[4][1] == "block" and got[5][1] == "allow"


def test_long_chain_and_hub(spark):
    chain = [(f"http://n{i}.net/", canonical(f"http://n{i + 1}.net/")) for i in range(40)] + [("http://n40.net/", canonical("http://z.com/de/"))]
    assert all(v[1] == "block" for v in judged(spark, chain).values())
    hub = [(f"http://h{i}.net/", canonical("http://hub.com/de/")) for i in range(300)]
    assert all(v[1] == "block" for v in judged(spark, hub).values())


def test_odd_rows(spark):
    rows = [(None, None), ("", ""), ("no scheme", "x"), ("http://", ""), ("http://x.net", None), ("http://x.net", None)]
    assert len(judged(spark, rows)) == 6
    df = spark.createDataFrame([(1, "http://a.com/de/", "", 5, "x")], "page_id long, url string, html string, host int, verdict string")
    assert urls.judge(df).collect()[0].verdict == "block"
    assert urls.judge(df.limit(0)).count() == 0
    assert contract.oracle_sql()["op6_url_filter"]
