"""Sources, crawl merge and contract checks over payloads written from the given tables.

The payloads are made by Spark from every row of a table, so parsing work grows with it
and the SQL counterpart can state the expected fields from the same columns.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import quality
from ..plans.standins import FETCHED_AT, table
from ..session import spread
from ..sources import boards, crawl, pages, registry
from .registry import query
from .sql import collapse, strip_tags


def _json(**fields):
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _fields(df, *names):
    return df.select(*names)


# --- job boards ----------------------------------------------------------------


@query("greenhouse_postings", f"""
WITH d AS (SELECT *, {collapse("replace(replace(text, '<', ' '), '>', '')")} AS plain FROM documents)
SELECT doc_id, 0 AS pos, 'greenhouse' AS source_type, 'https://boards.test/' || doc_id AS source_url, doc_id::VARCHAR AS external_job_id,
       source AS title, source AS company_name, lang || ', ' || source AS location_text, '2024-02-03' AS posted_at, plain AS description_text FROM d
UNION ALL
SELECT doc_id, 1, 'greenhouse', 'https://boards-api.greenhouse.io/v1/boards/' || source || '/jobs?content=true', NULL,
       'Untitled role', source, NULL, NULL, '' FROM d""")
def greenhouse_postings(spark, sf):
    """Two postings per payload: a full one and one with nearly nothing."""
    d = table(spark, sf, "documents")
    office = F.struct(F.col("lang").alias("name"))
    full = F.struct(
        F.col("doc_id").alias("id"),
        F.col("source").alias("title"),
        F.concat(F.lit("https://boards.test/"), F.col("doc_id").cast("string")).alias("absolute_url"),
        F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("content"),
        F.lit("2024-02-03").alias("updated_at"),
        F.array(office, F.struct(F.lit("").alias("name")), F.struct(F.col("source").alias("name"))).alias("offices"),
    )
    payload = F.concat(F.lit('{"jobs":['), F.to_json(full), F.lit(',{"title":"","offices":[]}]}'))
    landed = d.select("doc_id", F.col("source").alias("board"), payload.alias("payload"), F.lit(FETCHED_AT).alias("fetched_at"))
    return _fields(
        boards.flatten_greenhouse(landed, carry=["doc_id"]),
        "doc_id", "pos", "source_type", "source_url", "external_job_id", "title", "company_name", "location_text",
        "posted_at", "description_text",
    )


@query("lever_postings", f"""
WITH e AS (SELECT event_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events)
SELECT event_id, 0 AS pos, 'first ' || event_type AS title, 'https://lever.test/' || event_id AS source_url, event_id::VARCHAR AS external_job_id,
       'Place, ' || event_type AS location_text, CASE WHEN event_type = 'view' THEN 'full-time' ELSE event_type END AS employment_type,
       strftime(make_timestamp((ms // 1000) * 1000000), '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || lpad((ms % 1000)::VARCHAR, 3, '0') || '000' END || '+00:00' AS posted_at,
       'a b' AS description_text FROM e
UNION ALL
SELECT event_id, 1, event_type, 'https://api.lever.co/v0/postings/acme', NULL, event_type, NULL, '2024-05-06', 'plain' FROM e
UNION ALL
SELECT event_id, 2, 'Untitled role', 'https://lever.test/apply', 'L' || event_id, NULL, NULL, NULL, '' FROM e""")
def lever_postings(spark, sf):
    """Three postings per payload, below a list, a wrapper and a wrapper inside a wrapper."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    millis = F.unix_millis(F.col("ts").cast("timestamp_ntz").cast("timestamp"))
    first = _json(
        id=F.col("event_id"),
        text=F.concat(F.lit("first "), kind),
        hostedUrl=F.concat(F.lit("https://lever.test/"), F.col("event_id").cast("string")),
        descriptionHtml=F.lit("a<br/>b"),
        categories=F.struct(
            F.struct(F.lit("Place").alias("name"), kind.alias("country")).alias("location"),
            F.when(kind == "view", "Full Time").otherwise(F.upper(kind)).alias("commitment"),
        ),
        createdAt=millis,
        workplaceType=F.lit("remote"),
        extra=F.col("value"),
    )
    second = _json(
        title=kind, descriptionPlain=F.lit("plain"), categories=F.struct(kind.alias("location")), updatedAt=F.lit("2024-05-06"),
    )
    third = _json(applyUrl=F.lit("https://lever.test/apply"), leverId=F.concat(F.lit("L"), F.col("event_id").cast("string")))
    payload = F.concat(
        F.lit('{"data":{"items":['), third, F.lit(']},"results":['), first, F.lit(',{"jobs":['), second, F.lit("]}]}"),
    )
    landed = e.select("event_id", F.lit("acme").alias("account"), payload.alias("payload"), F.lit(FETCHED_AT).alias("fetched_at"))
    return _fields(
        boards.flatten_lever(landed, carry=["event_id"]),
        "event_id", "pos", "title", "source_url", "external_job_id", "location_text", "employment_type", "posted_at",
        "description_text",
    )


@query("ashby_postings", """
SELECT c_custkey, 0 AS pos, c_name AS title, CASE WHEN c_acctbal < 0 THEN 'Board' ELSE 'Meta ' || c_mktsegment END AS company_name,
       'https://ashby.test/' || c_custkey AS source_url,
       c_mktsegment || ', City, XX' || CASE WHEN c_nationkey = 1 THEN '' ELSE ', Extra ' || c_nationkey END AS location_text,
       CASE WHEN c_acctbal < 0 THEN 'part-time' ELSE 'fellowship' END AS employment_type, 'the text' AS description_text FROM customer
UNION ALL
SELECT c_custkey, 1, 'Untitled role', CASE WHEN c_acctbal < 0 THEN 'Board' ELSE 'Meta ' || c_mktsegment END, 'https://board.test',
       NULL, NULL, 'x y' FROM customer""")
def ashby_postings(spark, sf):
    c = F.col
    meta = F.struct(
        F.when(c("c_acctbal") >= 0, F.concat(F.lit("Meta "), c("c_mktsegment"))).alias("name"),
        F.lit("https://board.test").alias("jobBoardLink"),
    )
    extra = F.when(
        c("c_nationkey") != 1,
        F.array(
            F.struct(c("c_mktsegment").alias("location")),
            F.struct(F.concat(F.lit("Extra "), c("c_nationkey").cast("string")).alias("location")),
        ),
    )
    full = F.struct(
        c("c_custkey").alias("id"),
        c("c_name").alias("title"),
        c("c_mktsegment").alias("location"),
        F.struct(F.struct(F.lit("City").alias("addressLocality"), F.lit("XX").alias("addressCountry")).alias("postalAddress")).alias("address"),
        extra.alias("secondaryLocations"),
        F.when(c("c_acctbal") < 0, "PartTime").otherwise("Fellowship").alias("employmentType"),
        F.concat(F.lit("https://ashby.test/"), c("c_custkey").cast("string")).alias("jobUrl"),
        F.lit("the text").alias("descriptionPlain"),
        F.lit("<b>no</b>").alias("descriptionHtml"),
    )
    payload = F.concat(
        F.lit('{"apiVersion":"1","meta":'), F.to_json(meta), F.lit(',"jobs":['), F.to_json(full),
        F.lit(',{"descriptionHtml":"<i>x</i><br>y"}]}'),
    )
    landed = table(spark, sf, "customer").select(
        "c_custkey", F.lit("Board").alias("board"), payload.alias("payload"), F.lit(FETCHED_AT).alias("fetched_at")
    )
    return _fields(
        boards.flatten_ashby(landed, carry=["c_custkey"]),
        "c_custkey", "pos", "title", "company_name", "source_url", "location_text", "employment_type", "description_text",
    )


# --- pages ---------------------------------------------------------------------


@query("jsonld_postings", f"""
SELECT page_id, 0 AS script_no, 0 AS pos, 'Role ' || page_id AS title, url AS source_url, 'Org' AS company_name, 'Town, YY' AS location_text,
       page_id::VARCHAR AS external_job_id, {strip_tags("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS description_text FROM pages
UNION ALL
SELECT page_id, 2, 1, 'Untitled role', 'https://own.test', 'Unknown company', NULL, NULL, '' FROM pages""")
def jsonld_postings(spark, sf):
    """Pages with three linked-data scripts put in: one posting, broken JSON, and a graph."""
    heading = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    one = _json(
        **{
            "@type": F.lit("JobPosting"),
            "title": F.concat(F.lit("Role "), F.col("page_id").cast("string")),
            "description": heading,
            "hiringOrganization": F.struct(F.lit("Org").alias("name")),
            "jobLocation": F.array(
                F.struct(F.struct(F.lit("Town").alias("addressLocality"), F.lit("YY").alias("addressCountry")).alias("address"))
            ),
            "identifier": F.struct(F.col("page_id").alias("value")),
        }
    )
    open_tag, close_tag = '<script type="application/ld+json">', "</script>"
    scripts = F.concat(
        F.lit(open_tag), one, F.lit(close_tag),
        F.lit("<SCRIPT id='x' type='application/ld+json'>{broken</SCRIPT>"),
        F.lit(open_tag + '[{"@graph":[{"@type":"WebSite"},{"@type":"JobPosting","url":"https://own.test","identifier":"z"}]}]' + close_tag),
    )
    marked = table(spark, sf, "pages").select(
        "page_id", "url", F.concat(F.col("html"), scripts).alias("html"), F.lit(FETCHED_AT).alias("fetched_at")
    )
    return _fields(
        pages.extract_jsonld(marked, carry=["page_id"]),
        "page_id", "script_no", "pos", "title", "source_url", "company_name", "location_text", "external_job_id",
        "description_text",
    )


# --- captured career sites -------------------------------------------------------


def _captured(spark, sf):
    """Two payloads per detail page: noise first, the posting nested in the second."""
    p = table(spark, sf, "pages").withColumn("num", (F.lit(1000000) + F.col("page_id")).cast("string"))
    url = F.concat(F.lit("https://jobs.bytedance.com/campus/position/"), F.col("num"), F.lit("/detail"))
    heading = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    noise = F.concat(F.lit('{"banner":{"title":"Noise","id":1},"list":[{"name":"a"},{"name":"b"}]}'))
    job = _json(
        jobName=heading,
        positionId=F.col("num"),
        cityList=F.array(F.create_map(F.lit("name"), F.lit("Here")), F.create_map(F.lit("city"), F.col("num"))),
        jobDesc=F.concat(F.lit("about "), F.col("num")),
        meta=F.struct(F.lit("2024/3/4").alias("publish_time"), F.struct(F.lit("Team X").alias("teamName")).alias("org")),
    )
    real = F.concat(F.lit('{"code":0,"data":{"wrap":[{"x":[1,[null]]},'), job, F.lit("]}}"))
    base = p.select("page_id", url.alias("page_url"), noise.alias("noise"), real.alias("real"))
    return base.select(
        "page_id", "page_url", F.posexplode(F.array("noise", "real")).alias("seq", "payload")
    )


PAGES = r"p AS (SELECT page_id, (1000000 + page_id)::VARCHAR AS num, 'https://jobs.bytedance.com/campus/position/' || (1000000 + page_id) || '/detail' AS page_url, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS heading FROM pages)"
RESOLVED_TITLE = "trim(regexp_replace(heading, '[ \\t]+', ' ', 'g'))"


@query("resolved_detail_payloads", f"""
WITH {PAGES}
SELECT page_url, {RESOLVED_TITLE} AS title, num AS external_id, 'Here / ' || num AS location, 'about ' || num AS description,
       '2024/3/4' AS posted, 'Team X' AS team FROM p""")
def resolved_detail_payloads(spark, sf):
    return _fields(
        crawl.resolve_detail_payload(_captured(spark, sf)),
        "page_url", "title", "external_id", "location", "description", "posted", "team",
    )


def _list_payloads(spark, sf):
    """A list page per nation: one payload of tags, one whose nested list holds postings."""
    n = spread(table(spark, sf, "customer"))
    item = F.struct(
        (F.lit(20000000) + F.col("c_custkey")).cast("string").alias("id"),
        F.col("c_name").alias("title"),
        F.array(F.col("c_mktsegment"), F.lit("Remote")).alias("city"),
        F.lit("2024年5月6日").alias("publishTime"),
    )
    payload = F.concat(
        F.lit('{"tags":[{"name":"x"}],"deep":{"rows":['), F.to_json(item), F.lit(',{"id":7,"title":"short id"}]},"nums":[1,2]}')
    )
    lists = n.select(
        F.concat(F.lit("list://"), F.col("c_custkey").cast("string")).alias("page_url"),
        F.posexplode(F.array(F.lit('{"tags":[{"name":"x"},{"name":"y"}]}'), payload)).alias("seq", "payload"),
    )
    return lists


@query("resolved_list_payloads", """
SELECT 'list://' || c_custkey AS page_url, 0 AS pos, c_name AS title FROM customer
UNION ALL SELECT 'list://' || c_custkey, 1, 'short id' FROM customer""")
def resolved_list_payloads(spark, sf):
    items = crawl.resolve_list_payload(_list_payloads(spark, sf))
    return items.select("page_url", "pos", F.get_json_object("item", "$.title").alias("title"))


@query("listing_stubs", """
SELECT 'https://jobs.bytedance.com/campus/position/' || (20000000 + c_custkey) || '/detail' AS detail_url, c_name AS title,
       c_mktsegment || ' / Remote' AS location, '2024-05-06' AS posted, (20000000 + c_custkey)::VARCHAR AS external_id FROM customer""")
def listing_stubs(spark, sf):
    items = crawl.resolve_list_payload(_list_payloads(spark, sf))
    return _fields(
        crawl.listing_stubs(items, urls.BYTEDANCE.key), "detail_url", "title", "location", "posted", "external_id"
    )


@query("listing_stubs_by_query", """
SELECT 'https://join.qq.com/post_detail.html?id=' || l_orderkey || '&pid=' || l_linenumber || '&tid=' || l_suppkey AS detail_url,
       l_shipdate::DATE::VARCHAR AS title, l_orderkey::VARCHAR AS external_id FROM lineitem""")
def listing_stubs_by_query(spark, sf):
    c = F.col
    item = _json(
        id=c("l_orderkey"), pid=c("l_linenumber"), tid=c("l_suppkey"), title=c("l_shipdate").cast("date").cast("string")
    )
    items = spread(table(spark, sf, "lineitem")).select(item.alias("item"))
    return _fields(crawl.listing_stubs(items, urls.TENCENT.key), "detail_url", "title", "external_id")


def _anchors(spark, sf):
    """Links of a list page from customers; a third of the card lines are hints."""
    c = F.col
    num = (F.lit(20000000) + c("c_custkey")).cast("string")
    return table(spark, sf, "customer").select(
        c("c_custkey").alias("pos"),
        F.concat(F.lit("https://jobs.bytedance.com/campus/position/"), num, F.lit("/detail?recomId="), c("c_nationkey").cast("string")).alias("href"),
        F.when(c("c_acctbal") < 0, "首页").otherwise(c("c_name")).alias("text"),
        F.concat(c("c_mktsegment"), F.lit(" · 北京市 · intern · 研发部")).alias("card_text"),
    )


@query("listing_card_hints", """
SELECT c_custkey AS pos, 'https://jobs.bytedance.com/campus/position/' || (20000000 + c_custkey) || '/detail' AS detail_url,
       CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_name END AS title, '北京市' AS location, 'intern' AS employment,
       '研发部' AS department, (20000000 + c_custkey)::VARCHAR AS external_id FROM customer""")
def listing_card_hints(spark, sf):
    hints = crawl.listing_card_hints(_anchors(spark, sf), urls.BYTEDANCE.key, carry=["pos"])
    return _fields(hints, "pos", "detail_url", "title", "location", "employment", "department", "external_id")


@query("collected_listing", """
WITH a AS (SELECT 0 AS part, c_custkey AS pos, (20000000 + c_custkey % 1000)::VARCHAR AS num, c_name AS title FROM customer WHERE c_nationkey < 20
  UNION ALL SELECT 1, c_custkey, (20000000 + c_custkey)::VARCHAR, upper(c_mktsegment) FROM customer)
SELECT 'https://jobs.bytedance.com/campus/position/' || num || '/detail' AS detail_url, arg_min(title, part * 1000000000 + pos) AS title
FROM a GROUP BY 1""")
def collected_listing(spark, sf):
    """Links repeat every thousand customers and win over list items of the same URL."""
    c = F.col
    customers = table(spark, sf, "customer")
    site = urls.BYTEDANCE.key

    def link(num):
        return F.concat(F.lit("https://jobs.bytedance.com/campus/position/"), num.cast("string"), F.lit("/detail"))

    anchors = customers.where(c("c_nationkey") < 20).select(
        c("c_custkey").alias("pos"),
        link(F.lit(20000000) + c("c_custkey") % 1000).alias("href"),
        c("c_name").alias("text"),
        c("c_name").alias("card_text"),
    )
    items = customers.select(
        c("c_custkey").alias("pos"),
        _json(url=link(F.lit(20000000) + c("c_custkey")), title=F.upper("c_mktsegment")).alias("item"),
    )
    stubs = crawl.collect_listing(
        crawl.listing_card_hints(anchors, site, carry=["pos"]), crawl.listing_stubs(items, site, carry=["pos"])
    )
    return stubs.select("detail_url", "title")


def _merged(spark, sf):
    """Stubs for all pages; text and payloads captured for some of them, a few blocked."""
    site = urls.BYTEDANCE.key
    captured = _captured(spark, sf)
    base = captured.where(F.col("seq") == 0).select("page_id", "page_url")
    none = F.lit(None).cast("string")
    stubs = base.select(
        F.col("page_url").alias("detail_url"), F.lit("Listed title").alias("title"), F.lit("Listed place").alias("location"),
        F.lit("intern").alias("employment"), none.alias("posted"), none.alias("external_id"), none.alias("department"),
        none.alias("team"), none.alias("payload"), F.lit("card").alias("card_text"),
    )
    p = table(spark, sf, "pages").select("page_id", "url", "html")
    body = F.when(F.contains("url", F.lit("utm_source")), "please SIGN IN first").otherwise(
        F.concat(F.lit("Page title line\n工作地点：Somewhere\n职位描述\nfrom page "), F.col("page_id").cast("string"), F.lit("\n相关职位\nother"))
    )
    texts = base.join(p, "page_id").where(~F.contains("url", F.lit("#top"))).select(
        "page_url", body.alias("body_text"), F.col("html").alias("page_html"), F.lit(FETCHED_AT).alias("fetched_at")
    )
    with_payload = base.join(p.where(F.contains("url", F.lit("page="))).select("page_id"), "page_id", "left_semi")
    resolved = crawl.resolve_detail_payload(captured.join(with_payload.select("page_url"), "page_url", "left_semi"))
    return (stubs, *crawl.merge_detail_records(stubs, texts, resolved, site))


MERGED = r"""p AS (SELECT *, (1000000 + page_id)::VARCHAR AS num, 'https://jobs.bytedance.com/campus/position/' || (1000000 + page_id) || '/detail' AS page_url,
  contains(url, '#top') AS uncaptured, contains(url, 'utm_source') AS blocked, contains(url, 'page=') AS paid,
  regexp_extract(html, '<h1>(.*?)</h1>', 1) AS heading FROM pages)"""


@query("merged_detail_records", f"""
WITH {MERGED}
SELECT page_url AS source_url, CASE WHEN paid THEN {RESOLVED_TITLE} ELSE 'Page title line' END AS title, num AS external_job_id,
       CASE WHEN paid THEN 'Here / ' || num ELSE 'Somewhere' END AS location_text, 'intern' AS employment_type,
       CASE WHEN paid THEN '2024-03-04' END AS posted_at,
       CASE WHEN paid THEN 'about ' || num ELSE '职位描述' || chr(10) || 'from page ' || page_id END AS description_text,
       CASE WHEN paid THEN 'Team X' END AS team
FROM p WHERE NOT uncaptured AND NOT blocked""")
def merged_detail_records(spark, sf):
    records = _merged(spark, sf)[1]
    return records.select(
        "source_url", "title", "external_job_id", "location_text", "employment_type", "posted_at", "description_text",
        F.try_element_at("metadata", F.lit("team_raw")).alias("team"),
    )


@query("detail_failures", f"""
WITH {MERGED}
SELECT page_url AS url, 'detail_extract' AS stage, CASE WHEN uncaptured THEN 'not_captured' ELSE 'blocked' END AS reason
FROM p WHERE uncaptured OR blocked""")
def detail_failures(spark, sf):
    return _merged(spark, sf)[2].select("url", "stage", "reason")


@query("crawl_counters", f"""
WITH {MERGED}
SELECT 'collected' AS counter, NULL AS reason, count(*) AS n FROM p
UNION ALL SELECT 'emitted', NULL, count(*) FROM p WHERE NOT uncaptured AND NOT blocked
UNION ALL SELECT 'failed:detail_extract', CASE WHEN uncaptured THEN 'not_captured' ELSE 'blocked' END, count(*) FROM p
          WHERE uncaptured OR blocked GROUP BY 2""")
def crawl_counters(spark, sf):
    return crawl.crawl_counters(*_merged(spark, sf))


# --- source registry ---------------------------------------------------------------

SOURCES = [
    {"name": "view", "type": "greenhouse", "config": {"board": "views", "max_jobs": 100}},
    {"name": "click", "type": "lever", "account": "clicks"},
    {"name": "signup", "kind": "html", "config": {"url": "https://html.test", "max_jobs": 50, "company_name": "HTML Co"}},
    {"name": "error", "type": "ashby", "config": {}},
    {"name": "purchase", "type": "ashby", "enabled": False, "config": {"job_board": "off"}},
    "not an object",
]


def _ingest(spark, sf):
    """Events as landed payloads; the event type is the source they came from."""
    c = F.col
    payload = (
        F.when(c("event_type") == "view", F.concat(F.lit('{"jobs":[{"id":'), c("event_id").cast("string"), F.lit(',"title":"V"}]}')))
        .when(c("event_type") == "click", F.concat(F.lit('[{"text":"C","id":"c'), c("event_id").cast("string"), F.lit('"}]')))
        .otherwise(F.concat(F.lit("<h1>S"), c("event_id").cast("string"), F.lit("</h1>")))
    )
    landed = table(spark, sf, "events").select(
        c("event_type").alias("source_name"), c("event_id").alias("seq"), payload.alias("payload"), F.lit(FETCHED_AT).alias("fetched_at")
    )
    return registry.ingest_sources(spark, SOURCES, landed)


@query("ingested_source_records", """
SELECT event_type AS source_name, event_id AS seq, CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'C' ELSE 'S' || event_id END AS title,
       CASE event_type WHEN 'view' THEN 'views' WHEN 'click' THEN 'clicks' ELSE 'HTML Co' END AS company_name
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
WHERE event_type = 'click' OR (event_type = 'view' AND r <= 100) OR (event_type = 'signup' AND r <= 50)""")
def ingested_source_records(spark, sf):
    return _ingest(spark, sf)[0].select("source_name", "seq", "title", "company_name")


REPORT = """
WITH n AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1),
report AS (
  SELECT 'view' AS name, 'ok' AS status, least(n, 100) AS records FROM n WHERE name = 'view'
  UNION ALL SELECT 'click', 'ok', n FROM n WHERE name = 'click'
  UNION ALL SELECT 'signup', 'ok', least(n, 50) FROM n WHERE name = 'signup'
  UNION ALL SELECT 'error', 'error', 0 UNION ALL SELECT 'purchase', 'skipped', 0 UNION ALL SELECT '<invalid>', 'error', 0)
"""


@query("source_report", REPORT + "SELECT * FROM report")
def source_report(spark, sf):
    return _ingest(spark, sf)[1].select("name", "status", "records")


@query("source_summary", REPORT + """
SELECT count(*) AS sources_seen, count(*) FILTER (status = 'ok') AS sources_succeeded, count(*) FILTER (status = 'error') AS sources_failed,
       count(*) FILTER (status = 'skipped') AS sources_skipped, sum(records)::BIGINT AS records_written, 'error' AS status FROM report""")
def source_summary(spark, sf):
    return registry.ingest_summary(_ingest(spark, sf)[1])


# --- contract checks -----------------------------------------------------------------


@query("raw_job_violations", """
SELECT 'doc ' || doc_id AS context, path, message FROM (
  SELECT doc_id, '$.title' AS path, 'is required' AS message FROM documents WHERE lang = 'de'
  UNION ALL SELECT doc_id, '$.company_name', 'expected string, got int' FROM documents WHERE lang = 'fr'
  UNION ALL SELECT doc_id, '$.location_text', 'expected string | null, got bool' FROM documents WHERE lang = 'fr'
  UNION ALL SELECT doc_id, '$.metadata', 'expected object | null, got list' FROM documents WHERE lang = 'es'
  UNION ALL SELECT doc_id, '$.fetched_at', 'expected string, got NoneType' FROM documents WHERE lang = 'es')""")
def raw_job_violations(spark, sf):
    lang, text_value = F.col("lang"), F.col("text")
    good = _json(source_type=lang, source_url=lang, title=F.col("source"), company_name=F.col("source"), fetched_at=lang,
                 description_text=text_value, metadata=F.create_map(F.lit("k"), lang))
    no_title = _json(source_type=lang, source_url=lang, company_name=lang, fetched_at=lang, description_text=text_value)
    wrong = _json(source_type=lang, source_url=lang, title=lang, company_name=F.col("doc_id"), location_text=F.lit(True), fetched_at=lang)
    nulls = F.to_json(
        F.struct(lang.alias("source_type"), lang.alias("source_url"), lang.alias("title"), lang.alias("company_name"),
                 F.lit(None).cast("string").alias("fetched_at"), F.array(lang).alias("metadata"), F.lit(None).cast("string").alias("posted_at")),
        {"ignoreNullFields": "false"},
    )
    record = F.when(lang == "de", no_title).when(lang == "fr", wrong).when(lang == "es", nulls).otherwise(good)
    docs = table(spark, sf, "documents").select("doc_id", record.alias("record"))
    context = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return quality.violations(docs, "raw_job", "record", context)


@query("nested_violations", """
SELECT o_orderkey::VARCHAR AS context, '$.job[1].edge_type' AS path, 'is required' AS message FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, '$.job[1].weight', 'expected number | null, got str' FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, '$.bad', 'expected array, got float' FROM orders WHERE o_orderstatus = 'F'""")
def nested_violations(spark, sf):
    """Maps of lists of objects: the paths lead to the item that is wrong."""
    ok = json.dumps({"skill_id": "s", "label": "l", "edge_type": "REQUIRES", "weight": 1, "confidence": None})
    bad = json.dumps({"skill_id": "s", "label": "l", "weight": "heavy"})
    tail = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(',"bad":0.5'))).otherwise("")
    record = F.concat(F.lit('{"job":[' + ok + "," + bad + "]"), tail, F.lit("}"))
    orders = table(spark, sf, "orders").select("o_orderkey", record.alias("record"))
    return quality.violations(orders, "job_skills", "record", F.col("o_orderkey").cast("string"))


@query("company_table_violations", """
SELECT 'company[' || c_custkey || ']' AS context, '$.name' AS path, 'expected string, got NoneType' AS message FROM customer WHERE c_acctbal < 0""")
def company_table_violations(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"),
        F.col("c_mktsegment").alias("industry"),
    )
    return quality.table_violations(c, "company", "id")
