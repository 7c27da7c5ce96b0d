
from quarry.functions import text as T


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("o")).first()["o"]


def test_tokens_lower_split_drop_empty(spark):
    assert _one(spark, T.tokens("t"), "  Héllo, WORLD!! 12ab--x ") == ["héllo", "world", "12ab", "x"]
    assert _one(spark, T.tokens("t"), "") == []
    assert _one(spark, T.tokens("t"), "...") == []


def test_shorten_boundaries(spark):
    for n in (999, 1000, 1001):
        assert len(_one(spark, T.shorten("t"), "a" * n)) == min(n, 1000)
    assert len(_one(spark, T.shorten("t", shortened=False), "a" * 1001)) == 1001


def test_first_url_and_linkify(spark):
    text = "see https://ex.com/a?b=1 and https://ex.com/a?b=1 again"
    url = _one(spark, T.first_url("t"), text)
    assert url == "https://ex.com/a?b=1"
    df = spark.createDataFrame([(text,)], "t string")
    out = df.select(T.linkify("t", T.first_url("t")).alias("o")).first()["o"]
    assert out.count('<a href="https://ex.com/a?b=1">Source</a> ') == 2
    # no link: unchanged (no link inserted between characters)
    assert _one(spark, T.linkify("t", T.first_url("t")), "no link here") == "no link here"


def test_url_cut_at_1000(spark):
    import re

    text = "x" * 990 + " http://abcdefghijklmnop.org"
    url = _one(spark, T.first_url(T.shorten("t")), text)
    assert url == re.search(r"https?://[!$-_a-z]+", text[:1000]).group(0)  # cut by the shortening
    assert len(url) < len("http://abcdefghijklmnop.org")


def test_sentences(spark):
    out = _one(spark, T.sentences("t"), "One two. Three!  Four?\nFive")
    assert out == ["One two", "Three", "Four", "Five"]


def test_md5_hash32_matches_python(spark):
    import hashlib

    got = _one(spark, T.md5_hash32("t"), "token")
    assert got == int(hashlib.md5(b"token").hexdigest()[:8], 16)
