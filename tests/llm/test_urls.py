"""op4's trees: held-out labels, features against plain Python, and lexical features where endings say nothing."""

import math
from collections import Counter
from urllib.parse import quote

from pyspark.sql import functions as F

from strataspark.llm import op4_url_filter as op4
from tests.conftest import DATA

RULES = (op4.Rule("block", "bad.org", ""), op4.Rule("allow", "good.org", ""))


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def training(n=120):
    """Blocked and allowed URLs that share their paths' first segments; blocked ones are full of digits and parameters."""
    bad = [f"http://h{k}.bad.org/x/{k * 7919 % 10**7}{k * 104729}?a={k}&b={k * 31}&c={k * 17}" for k in range(n)]
    good = [f"https://h{k}.good.org/x/{quote('quiet' * (k % 3 + 1))}/page" for k in range(n)]
    return bad + good


def test_lexical_features_decide_where_endings_are_unknown(spark):
    unseen = ["http://new.test/y/8812349917?a=1&b=22&c=333", "https://new.test/y/quietquiet/page", "http://q.example/z/123456789012345?u=9&v=8&w=7", "https://q.example/z/quiet/page"]
    got = {r.url: r for r in op4.judge_urls(pages(spark, training() + unseen), RULES).collect()}
    assert [got[u].verdict for u in unseen] == ["block", "allow", "block", "allow"] and all(got[u].rule is None for u in unseen)


def test_held_out_labels_of_the_table(spark):
    r = op4.held_out_report(spark.read.parquet(f"{DATA}/pages.parquet")).first()
    assert r.urls > 5 and r.right >= 0.9


def test_a_hot_url_and_a_rare_label_are_still_learnt_from(spark):
    urls = ["https://h0.good.org/x/hot"] * 500 + training(40) + ["https://none.test/y/quiet/page"]
    got = op4.judge_urls(pages(spark, urls), RULES, max_labelled=40).where("rule IS NULL").collect()
    assert [r.verdict for r in got] == ["allow"] and 0 < got[0].blocked < 1


def test_features_equal_plain_python(spark):
    urls = ["http://a-b.example.com/en/x/1.html?p=1&q=2", "https://ü.net", "x" * 100_000 + "0=/", "", "http://EXAMPLE.com"]
    df = op4.lexical(op4._keyed(pages(spark, urls), op4.RULES))
    for r in df.collect():
        u = r._url
        counts = Counter(c if ord(c) < 128 else "beyond" for c in u)
        bits = -sum(n / len(u) * math.log2(n / len(u)) for n in counts.values()) if u else 0.0
        assert r.url_length == len(u) and abs(r.entropy - bits) < 1e-9 and r.parameters == u.count("=") and r.hyphens == u.count("-")
        assert abs(r.digit_ratio - (sum(c in "0123456789" for c in u) / len(u) if u else 0)) < 1e-9 and r.path_depth == r._path.count("/")


def test_repeated_rows_and_very_long_urls(spark):
    long = "http://" + "h" * 50_000 + ".com/" + "p" * 50_000
    got = op4.judge_urls(pages(spark, [long, long, None, ""]).withColumn("host", F.lit("clash"))).collect()
    assert [(len(r.host), len(r.path), r.verdict) for r in got[:2]] == [(50_004, 50_001, "allow")] * 2
    assert [(r.host, r.path, r.rule) for r in got[2:]] == [("", "", None)] * 2
