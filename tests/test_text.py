from __future__ import annotations

import hashlib
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolemesh.functions import dates, richtext, text, urls

def python_slug(value: str) -> str:
    folded = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "-", folded).strip("-") or "unknown"


def test_slugs_fold_accents_ligatures_and_wide_forms(column):
    values = ["Café Münster", "ﬁnance ½ ㎏", "ＡＢＣ①", "腾讯", "", "--a__b--", "Ångström & Søn ß", "㈠ ℡ Ⅷ"]
    assert column(values, lambda V: text.slug(V)) == [python_slug(v) for v in values]
    assert column(["腾讯 Inc.", "a  b", "", "É!"], lambda V: text.graph_slug(V)) == ["腾讯-inc", "a--b", "unknown", "é"]
    assert column(["My Source!", "源"], lambda V: text.source_slug(V)) == ["my-source", "source"]


def test_slug_of_any_text(spark, column):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(max_size=20), min_size=40, max_size=40))
    def check(values):
        clean = [v.replace("\x00", "") for v in values]
        assert column(clean, lambda V: text.slug(V)) == [python_slug(v) for v in clean]

    check()


def test_markup_variants(column):
    values = ["<p>a<br>b</p> c", "x < y > z", "open <b", "a>b", None]
    assert column(values, lambda V: text.strip_markup(V)) == ["a b c", "x z", "open", "ab", ""]
    assert column(["<p>a</p>  b &lt;i&gt;"], lambda V: text.normalize_text(V)) == ["a b &lt;i&gt;"]


def test_clean_whitespace(column):
    values = [" a  b​ \r\n\r\n\r\n\r\n\tc \n", "   ", None, "x\ry"]
    assert column(values, lambda V: text.clean_whitespace(V)) == ["a b\n\nc", None, None, "x\ny"]


def test_remote_and_employment(column):
    values = ["Remote or on-site", "hybrid, onsite", "on site", "remotely", "Onsite!", None]
    assert column(values, lambda V: text.infer_remote_mode(F.lit(None).cast("string"), V)) == [
        "remote", "hybrid", "onsite", None, "onsite", None,
    ]
    values = ["Full time contract", "internships", "an Internship", "contractors and contractor"]
    assert column(values, lambda V: text.infer_employment_type(F.lit(""), V)) == ["full-time", None, "internship", "contract"]
    assert column(["x"], lambda V: text.infer_employment_type(F.lit("Given"), V)) == ["Given"]


def test_word_boundaries_are_unicode(column):
    cue = text.Cue(["java", "c++"])
    values = ["使用Java构建", "use java.", "C++ dev", "C++11", "naïvejava"]
    assert column(values, lambda V: cue.found(F.lower(V))) == [False, True, False, True, False]


def test_dates(column):
    values = ["2026年4月6日", "2026/4/6 12:30", "at 2024.01.2T9:05:07", "April", None]
    assert column(values, lambda V: dates.normalize_date(V)) == [
        "2026-04-06", "2026-04-06 12:30", "2024-01-02 9:05:07", None, None,
    ]
    assert column([1700000000123, 1700000000, 0, 10**18], lambda V: dates.epoch_to_iso(V), "long") == [
        "2023-11-14T22:13:20.123000+00:00", "2023-11-14T22:13:20+00:00", "1970-01-01T00:00:00+00:00", None,
    ]
    assert column(["2024-01-02", "2024-1-2", "2024-01-02T10:11"], lambda V: dates.looks_like_date(V)) == [True, False, True]
    assert column(["2024-01-02T10:11:12+00:00", "2024-13-02T10:11", "x"], lambda V: dates.looks_like_datetime(V)) == [True, False, False]


def test_urls(column):
    url = "https://jobs.bytedance.com/campus/position/9001700170/detail?recomId=q7"
    assert column([url], lambda V: urls.canonical_detail_url(V, "bytedance_campus")) == [url.split("?")[0]]
    post = "https://join.qq.com/post_detail.html?postId=4400551&from=mail"
    assert column([post], lambda V: urls.canonical_detail_url(V, "tencent_campus")) == [
        "https://join.qq.com/post_detail.html?postid=4400551"
    ]
    assert column(["https://join.qq.com/post_detail.html?id=58&pid=9&tid=4", url], lambda V: urls.url_job_id(V)) == [
        "58", "9001700170",
    ]
    values = ["https://a.b/c;p?utm_source=x&q=a b&empty&r=%7E*#frag", "http://a.b/?UTM-Medium=1", "no url"]
    assert column(values, lambda V: urls.strip_tracking_params(V)) == [
        "https://a.b/c;p?q=a+b&empty=&r=~%2A", "http://a.b/", "no url",
    ]
    assert column(["https://www.X.com/a", "::", None], lambda V: urls.source_host(V)) == ["x.com", "External link", "External link"]


def test_sections_and_titles(column):
    body = "\n  职位描述\n 负责模型训练与优化。\n职位要求\n2026届硕士或博士。\n相关职位\n其他岗位\n"
    assert column([body], lambda V: text.merge_sections(text.parse_sections(V), ["职位描述", "职位要求"])) == [
        "职位描述\n负责模型训练与优化。\n\n职位要求\n2026届硕士或博士。"
    ]
    assert column(["Engineer", "首页", "a", "——", "x" * 121, None], lambda V: text.plausible_title(V)) == [
        True, False, False, False, False, False,
    ]
    assert column(["首页\n腾讯校园招聘\n后端工程师\nmore"], lambda V: text.page_title(V)) == ["后端工程师"]


def test_rich_text(column):
    values = [
        "&lt;p onclick=x&gt;R&amp;amp;D&lt;/p&gt;",
        "<div><P class='a'>x</P><script>bad()</script><br/></div>",
        "1 < 2 & 3",
        "",
    ]
    assert column(values, lambda V: richtext.safe_rich_text(V)) == [
        "<p>R&amp;D</p>", "<p>x</p><br>", "1 &lt; 2 &amp; 3", "",
    ]


def test_sanitize_and_hash(column):
    assert column(["<b>x</b><script>1</script><STYLE a>b</STYLE>", "<script>1</script>"], lambda V: text.sanitize_html(V)) == ["<b>x</b>", None]
    assert column(["abc"], lambda V: text.short_hash(V)) == [hashlib.sha256(b"abc").hexdigest()[:12]]


def test_merged_sections_read_the_text_once(spark):
    body = spark.range(3).select(F.col("id").cast("string").alias("body"))
    merged = body.select(text.merge_sections(text.parse_sections(F.col("body"))).alias("merged"))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|".join(text.SECTION_HEADINGS[:3])) == 1
