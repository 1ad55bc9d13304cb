"""Column work on documents, pages, events: text, ids, URLs, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, ids, richtext, text, urls
from ..operators import dedupe, quality
from ..plans.standins import RULES, table
from ..sources import pages as page_source
from .registry import query
from .sql import collapse, edge_id, graph_slug, has_word, slug, strip, strip_tags

FIRST_LINE = "split_part(text, chr(10), 1)"


@query("slugs_of_documents", f"""
SELECT doc_id, {slug(FIRST_LINE)} AS slug, {graph_slug(FIRST_LINE)} AS graph_slug,
       coalesce(nullif(trim(regexp_replace(lower({FIRST_LINE}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'source') AS source_slug,
       md5({slug('text')}) AS whole_slug, md5({graph_slug('text')}) AS whole_graph_slug
FROM documents""")
def slugs_of_documents(spark, sf):
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf, "documents").select(
        "doc_id", text.slug(title).alias("slug"), text.graph_slug(title).alias("graph_slug"),
        text.source_slug(title).alias("source_slug"), F.md5(text.slug(F.col("text"))).alias("whole_slug"),
        F.md5(text.graph_slug(F.col("text"))).alias("whole_graph_slug"),
    )


@query("short_hashes", "SELECT doc_id, left(sha256(text), 12) AS short_hash, sha256(text) AS full_hash FROM documents")
def short_hashes(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.short_hash(F.col("text")).alias("short_hash"), F.sha2("text", 256).alias("full_hash")
    )


@query("derived_ids", f"""
SELECT doc_id, 'company:' || {slug('source')} AS company_id, 'skill:' || {slug('lang')} AS skill_id,
       'job:' || {slug('source')} || ':' || CASE WHEN lang = 'fr' THEN left(sha256(text), 12) ELSE {slug('n_chars::VARCHAR')} END AS job_id,
       'location:' || {graph_slug('lang')} AS location_id, 'role_family:' || {graph_slug(FIRST_LINE)} AS role_family_id,
       {edge_id('source', "'POSTS'", 'lang')} AS edge_id,
       CASE WHEN lang = 'fr' THEN 'doc::doc://' || doc_id ELSE 'doc::' || source || '::' || n_chars END AS source_key
FROM documents""")
def derived_ids(spark, sf):
    c = F.col
    external = F.when(c("lang") != "fr", c("n_chars").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id",
        ids.company_id(c("source")).alias("company_id"),
        ids.skill_id(c("lang")).alias("skill_id"),
        ids.job_id(ids.company_id(c("source")), external, c("text")).alias("job_id"),
        ids.location_id(c("lang")).alias("location_id"),
        ids.role_family_id(F.substring_index("text", "\n", 1)).alias("role_family_id"),
        ids.edge_id(c("source"), F.lit("POSTS"), c("lang")).alias("edge_id"),
        ids.source_key(F.lit("doc"), c("source"), external, F.concat(F.lit("doc://"), c("doc_id").cast("string"))).alias("source_key"),
    )


@query("stripped_markup", f"""
SELECT page_id, {collapse("replace(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g'), '>', '')")} AS plain,
       {strip_tags('html')} AS tagless FROM pages""")
def stripped_markup(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.strip_markup(F.col("html")).alias("plain"), text.strip_tags(F.col("html")).alias("tagless")
    )


@query("normalized_text", f"""
SELECT doc_id, {strip_tags('text')} AS clean,
       trim(regexp_replace(lower({FIRST_LINE}), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents""")
def normalized_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.normalize_text(F.col("text")).alias("clean"),
        text.normalize_title(F.substring_index("text", "\n", 1)).alias("title"),
    )


def cleaned(expr: str) -> str:
    plain = f"replace(replace({expr}, chr(160), ' '), chr(8203), '')"
    plain = rf"regexp_replace(regexp_replace({plain}, chr(13) || chr(10) || '?', chr(10), 'g'), '[ \t\f\x0b]+', ' ', 'g')"
    lines = f"array_to_string(list_transform(string_split({plain}, chr(10)), lambda x: {strip('x')}), chr(10))"
    few = rf"regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"nullif({strip(few)}, '')"


@query("cleaned_whitespace", f"SELECT doc_id, {cleaned('text')} AS cleaned FROM documents")
def cleaned_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_whitespace(F.col("text")).alias("cleaned"))


def _rules(expr: str, rules) -> str:
    whens = " ".join(f"WHEN {has_word(expr, '|'.join(cue.words))} THEN '{label}'" for label, cue in rules)
    return f"CASE {whens} END"


@query("remote_mode", f"SELECT doc_id, {_rules('lang || chr(32) || text', RULES.remote)} AS remote_mode FROM documents")
def remote_mode(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.infer_remote_mode(F.col("lang"), F.col("text"), RULES.remote).alias("remote_mode")
    )


@query("employment_type", f"""
SELECT doc_id, CASE WHEN lang = 'de' THEN 'given' ELSE {_rules('text', RULES.employment)} END AS employment_type FROM documents""")
def employment_type(spark, sf):
    given = F.when(F.col("lang") == "de", "given").when(F.col("lang") == "es", "")
    return table(spark, sf, "documents").select(
        "doc_id", text.infer_employment_type(given, F.col("text"), RULES.employment).alias("employment_type")
    )


@query("mapped_employment", """
WITH n AS (SELECT event_id, CASE event_type WHEN 'view' THEN ' Full Time' WHEN 'click' THEN 'FullTime' WHEN 'error' THEN ''
                  WHEN 'signup' THEN 'TEMP' ELSE 'Shift Work' END AS name FROM events)
SELECT event_id,
       CASE lower(trim(name)) WHEN 'full time' THEN 'full-time' WHEN 'fulltime' THEN 'full-time' WHEN 'temp' THEN 'temporary'
            WHEN '' THEN NULL ELSE lower(trim(name)) END AS lever,
       CASE lower(trim(name)) WHEN 'fulltime' THEN 'full-time' WHEN '' THEN NULL ELSE lower(trim(name)) END AS ashby
FROM n""")
def mapped_employment(spark, sf):
    kind = F.col("event_type")
    name = (
        F.when(kind == "view", " Full Time").when(kind == "click", "FullTime").when(kind == "error", "")
        .when(kind == "signup", "TEMP").otherwise("Shift Work")
    )
    return table(spark, sf, "events").select(
        "event_id",
        text.map_employment(name, text.LEVER_EMPLOYMENT).alias("lever"),
        text.map_employment(name, text.ASHBY_EMPLOYMENT).alias("ashby"),
    )


@query("epochs_as_iso", """
WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS s FROM events)
SELECT event_id, strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS from_seconds,
       strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || lpad((ms % 1000)::VARCHAR, 3, '0') || '000' END || '+00:00' AS from_millis
FROM e""")
def epochs_as_iso(spark, sf):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        "event_id",
        dates.epoch_to_iso(F.floor(millis / 1000)).alias("from_seconds"),
        dates.epoch_to_iso(millis).alias("from_millis"),
    )


@query("normalized_dates", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d') ||
         CASE WHEN event_type IN ('view', 'signup') THEN '' ELSE ' ' || strftime(ts, '%-H:%M') END END AS day,
       event_type <> 'error' AND (event_type IN ('view', 'signup') OR hour(ts) > 9) AS is_date
FROM events""")
def normalized_dates(spark, sf):
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp_ntz")
    written = (
        F.when(kind == "view", F.date_format(ts, "yyyy年M月d日"))
        .when(kind == "signup", F.date_format(ts, "'posted 'yyyy.M.d"))
        .when(kind == "click", F.date_format(ts, "yyyy/M/d H:mm"))
        .when(kind == "purchase", F.date_format(ts, "yyyy-MM-dd'T'H:mm"))
        .otherwise("no date")
    )
    day = dates.normalize_date(written)
    return table(spark, sf, "events").select("event_id", day.alias("day"), dates.looks_like_date(day).alias("is_date"))


@query("clean_page_urls", r"""
WITH q AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
k AS (SELECT page_id, url, base, list_filter(string_split(query, '&'), lambda x: x <> ''
        AND lower(regexp_replace(split_part(x, '=', 1), '[^A-Za-z0-9]', '', 'g')) NOT IN
          ('externalreferralcode', 'referralcode', 'recomid', 'sourcejobid', 'utmsource', 'utmmedium', 'utmcampaign',
           'utmcontent', 'utmterm', 'spread', 'activity', 'activitylink', 'from')) AS kept FROM q)
SELECT page_id, base || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS clean_url,
       regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS host,
       regexp_matches(url, '^https?://[^/?#]+') AS absolute
FROM k""")
def clean_page_urls(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.strip_tracking_params(url).alias("clean_url"),
        urls.source_host(url).alias("host"),
        urls.is_absolute_url(url).alias("absolute"),
    )


@query("canonical_detail_urls", r"""
WITH n AS (SELECT page_id, (1000000 + page_id)::VARCHAR AS num, regexp_extract(url, '[?&](page=\d+)', 1) AS q FROM pages)
SELECT page_id, 'https://jobs.bytedance.com/campus/position/' || num || '/detail' || CASE WHEN q = '' THEN '' ELSE '?' || q END AS path_url,
       'https://join.qq.com/post_detail.html?postid=' || num AS query_url, num AS path_id, num AS query_id,
       true AS path_is_detail, true AS query_is_detail, false AS page_is_detail
FROM n""")
def canonical_detail_urls(spark, sf):
    """Detail URLs of both sites spelled from page ids, with each page's own query string."""
    num = (F.lit(1000000) + F.col("page_id")).cast("string")
    page = F.regexp_extract("url", r"[?&](page=\d+)", 1)
    by_path = F.concat(
        F.lit("https://www.jobs.bytedance.com/campus/position/"), num, F.lit("/detail?recomId=7&"), page, F.lit("&utm-source=x#top")
    )
    by_query = F.concat(F.lit("https://join.qq.com/m/post_detail.html?from=a&postId="), num, F.lit("&activity=1#end"))
    by, te = urls.BYTEDANCE.key, urls.TENCENT.key
    return table(spark, sf, "pages").select(
        "page_id",
        urls.canonical_detail_url(by_path, by).alias("path_url"),
        urls.canonical_detail_url(by_query, te).alias("query_url"),
        urls.url_job_id(by_path).alias("path_id"),
        urls.url_job_id(urls.canonical_detail_url(by_query, te)).alias("query_id"),
        urls.is_detail_url(by_path, by).alias("path_is_detail"),
        urls.is_detail_url(by_query, te).alias("query_is_detail"),
        (urls.is_detail_url(F.col("url"), by) | urls.is_detail_url(F.col("url"), te)).alias("page_is_detail"),
    )


# A document's text under one heading, its first line under another, and more behind an end marker.
WHOLE, TOP = cleaned("text"), cleaned("split_part(text, chr(10), 1)")


def _sectioned():
    c = F.col
    return F.concat_ws(
        "\n", F.lit("Job Description:"), c("text"), F.lit("职位要求："), F.substring_index("text", "\n", 1),
        F.lit("相关职位"), c("text"),
    )


@query("page_sections", rf"""
SELECT doc_id, lang, ((t IS NOT NULL)::INT + (h IS NOT NULL)::INT)::BIGINT AS sections, md5(t) AS whole_md5, h AS top
FROM (SELECT doc_id, lang, {WHOLE} AS t, {TOP} AS h FROM documents)""")
def page_sections(spark, sf):
    """Whole texts under known headings, an end marker last."""
    found = text.parse_sections(_sectioned())
    of = lambda name: F.get(F.filter("found", lambda s: s["heading"] == name), 0)["content"]
    return table(spark, sf, "documents").select("doc_id", "lang", found.alias("found")).select(
        "doc_id", "lang", F.size("found").cast("long").alias("sections"),
        F.md5(of("Job Description")).alias("whole_md5"), of("职位要求").alias("top"),
    )


@query("merged_sections", rf"""
SELECT doc_id, md5(nullif(concat_ws(chr(10) || chr(10), '职位描述' || chr(10) || {WHOLE}, '加分项' || chr(10) || source), '')) AS merged_md5 FROM documents""")
def merged_sections(spark, sf):
    """A repeated heading keeps its last text, the whole document; the preferred order decides the output order."""
    body = F.concat_ws(
        "\n", F.lit("加分项"), F.col("source"), F.lit("职位描述："), F.lit("earlier"), F.lit("职位描述："),
        F.col("text"), F.lit("Apply"), F.lit("now"),
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.merge_sections(text.parse_sections(body))).alias("merged_md5")
    )


@query("page_titles", rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
             lambda x: {collapse('x')}), lambda x: x <> '')[1:30] AS lines FROM documents)
SELECT doc_id, list_filter(lines, lambda x: len(x) BETWEEN 2 AND 80 AND NOT regexp_full_match(x, '[^\p{{L}}\p{{N}}]+'))[1] AS title FROM l""")
def page_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.page_title(F.col("text")).alias("title"))


@query("sanitized_html", """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'),
       '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', '', 'g') AS html FROM pages""".replace("\\\\", "\\"))
def sanitized_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.sanitize_html(F.col("html")).alias("html"))


def _rich_text_sql() -> str:
    """The same steps, and the stack of open elements folded by list_reduce."""
    # The entities that the pages hold.
    decoded = "raw"
    for _ in range(2):
        for name, sign in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
            decoded = f"replace({decoded}, '&{name};', '{sign}')"
    body = f"regexp_replace({decoded}, '(?s)<!--.*?(?:-->|$)', '', 'g')"
    for tag in richtext.BLOCKED:
        body = f"regexp_replace({body}, '(?is)<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|$)', '', 'g')"
    for tag in richtext.ALLOWED:
        body = f"regexp_replace({body}, '(?i)<{tag}(?:\\s[^>]*|/)?>', chr(1) || '{tag}' || chr(3), 'g')"
        body = f"regexp_replace({body}, '(?i)</{tag}\\s*>', chr(2) || '{tag}' || chr(3), 'g')"
    body = f"regexp_replace({body}, '</?[A-Za-z!?][^>]*>', '', 'g')"
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
        body = f"replace({body}, '{sign}', '&{name};')"
    walls, ends = (", ".join(f"'{t}'" for t in x) for x in (richtext.WALLS, richtext.ENDS_PARAGRAPH))
    closers = "array_to_string(list_transform(a.open[1:n], lambda t: '</' || t || '>'), '')"
    return f"""
WITH p AS (SELECT page_id, {strip('html')} AS raw FROM pages),
b AS (SELECT page_id, raw, {body} AS body FROM p),
t AS (
  SELECT page_id, list_transform(regexp_extract_all(body, '[\\x01\\x02][a-z]+\\x03|[^\\x01\\x02]+'), lambda x:
    {{'kind': ascii(x), 'name': CASE WHEN ascii(x) < 3 THEN x[2:-2] ELSE '' END, 'out': x, 'open': []::VARCHAR[]}}) AS tokens FROM b),
f AS (
  SELECT page_id, list_reduce(list_prepend({{'kind': 0, 'name': '', 'out': '', 'open': []::VARCHAR[]}}, tokens), lambda a, x:
    list_transform([CASE
        WHEN x.kind = 2 THEN coalesce(list_position(a.open, x.name), 0)
        WHEN x.kind = 1 AND x.name = 'li' AND coalesce(list_position(a.open, 'li'), 0) > 0
             AND coalesce(list_position(a.open, 'li') < list_position(list_transform(a.open, lambda o: o IN ({walls})), true), true)
          THEN list_position(a.open, 'li')
        WHEN x.kind = 1 AND x.name IN ({ends}) THEN coalesce(list_position(a.open, 'p'), 0) ELSE 0 END],
      lambda n: {{'kind': 0, 'name': '',
        'out': a.out || {closers} || CASE x.kind WHEN 1 THEN '<' || x.name || '>' WHEN 2 THEN '' ELSE x.out END,
        'open': CASE WHEN x.kind = 1 AND x.name <> 'br' THEN list_prepend(x.name, a.open[n + 1:]) ELSE a.open[n + 1:] END}})[1]) AS a FROM t)
SELECT page_id, a.out || array_to_string(list_transform(a.open, lambda t: '</' || t || '>'), '') AS safe FROM f"""


@query("safe_rich_text", _rich_text_sql())
def safe_rich_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", richtext.safe_rich_text(F.col("html")).alias("safe"))


@query("page_headings", f"""
SELECT page_id, coalesce(nullif({strip_tags("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''),
       nullif({strip_tags("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ''), 'Untitled role') AS title,
       {strip_tags('html')} AS plain,
       CASE WHEN regexp_matches({strip_tags('html')}, '(?i)location[:\\s]+([A-Za-z0-9,\\- ]+)')
            THEN trim(regexp_extract({strip_tags('html')}, '(?i)location[:\\s]+([A-Za-z0-9,\\- ]+)', 1))
            WHEN regexp_matches({strip_tags('html')}, '(?i)based in ([A-Za-z0-9,\\- ]+)')
            THEN trim(regexp_extract({strip_tags('html')}, '(?i)based in ([A-Za-z0-9,\\- ]+)', 1)) END AS location
FROM pages""")
def page_headings(spark, sf):
    pages = table(spark, sf, "pages").withColumn("fetched_at", F.lit(""))
    raw = page_source.extract_html(pages, carry=["page_id"])
    return raw.select(
        "page_id", "title", F.col("description_text").alias("plain"), F.col("location_text").alias("location")
    )


@query("phrase_locations", rf"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Place ' || page_id WHEN page_id % 3 = 1 THEN 'Town ' || page_id END AS location,
       {strip_tags("html || CASE page_id % 3 WHEN 0 THEN '<p>Location: Place ' || page_id || '</p>;' WHEN 1 THEN '<p>We are based in <b>Town ' || page_id || '</b>.' ELSE '' END")} AS plain
FROM pages""")
def phrase_locations(spark, sf):
    """Whole pages, two of three of which name a location at their end, in either wording."""
    number = F.col("page_id")
    name = number.cast("string")
    added = (
        F.when(number % 3 == 0, F.concat(F.lit("<p>Location: Place "), name, F.lit("</p>;")))
        .when(number % 3 == 1, F.concat(F.lit("<p>We are based in <b>Town "), name, F.lit("</b>.")))
        .otherwise("")
    )
    pages = table(spark, sf, "pages").select("page_id", F.concat("html", added).alias("html"), "url", F.lit("").alias("fetched_at"))
    return page_source.extract_html(pages, carry=["page_id"]).select(
        "page_id", F.col("location_text").alias("location"), F.col("description_text").alias("plain")
    )


@query("keyword_hashes", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9+\-]+'),
    lambda x: x NOT IN ('the','and','with','for','you','our','will','this','that','are','job','role'))[1:100] AS words FROM documents)
SELECT doc_id, left(sha256(array_to_string(list_sort(list_distinct(words))[1:12], ' ')), 12) AS keywords FROM w""")
def keyword_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", dedupe.keyword_hash(F.col("text")).alias("keywords"))


@query("ordered_distinct_words", """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
f AS (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY 1, 2)
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS words FROM f GROUP BY 1""")
def ordered_distinct_words(spark, sf):
    words = F.array_distinct(F.split("text", " "))
    return table(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("words"))


@query("crawl_record_problems", r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, 'utm') THEN 'crawl' ELSE 'company_site' END AS source_type,
    CASE WHEN contains(url, '#top') THEN replace(url, 'https://', '//') ELSE url END AS source_url,
    CASE WHEN url LIKE '%.html' THEN '' ELSE 'T' END AS title FROM pages)
SELECT page_id, CASE WHEN title = '' THEN 'missing: title' WHEN source_type <> 'company_site' THEN 'source_type'
    WHEN NOT regexp_matches(source_url, '^https?://[^/?#]+') THEN 'source_url' END AS problem FROM r""")
def crawl_record_problems(spark, sf):
    url = F.col("url")
    records = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.contains(url, F.lit("utm")), "crawl").otherwise("company_site").alias("source_type"),
        F.when(F.contains(url, F.lit("#top")), F.replace(url, F.lit("https://"), F.lit("//"))).otherwise(url).alias("source_url"),
        F.when(F.endswith(url, F.lit(".html")), "").otherwise("T").alias("title"),
        F.lit("C").alias("company_name"),
        F.lit("2024-01-01").alias("posted_at"),
        F.lit("2024-01-01T00:00:00+00:00").alias("fetched_at"),
    )
    return quality.crawl_record_problems(records).select("page_id", "problem")
