"""Captured career-site pages and payloads -> raw postings.

Inputs are tables: captured JSON payloads per page, link anchors of list pages, visible
text of detail pages. Each payload is opened once, its best part is chosen inside the row,
and only the chosen part takes part in the choice per page.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..functions.urls import PROFILES
from ..operators.quality import crawl_record_problems
from ..operators.ranking import first_per_key
from ..schemas import RAW_COLUMNS
from .walk import json_lists, json_objects

# Spellings of each attribute, in order of preference (compared after
# ``normalize_key``), the words that mark a posting, block markers, scores.
TITLE_KEYS = [
    "title", "name", "jobTitle", "positionTitle", "positionName", "jobName", "postName",
    "recruitPostName", "岗位名称", "职位名称",
]
ID_KEYS = ["id", "jobId", "positionId", "postId", "postid", "recruitPostId", "requisitionId"]
URL_KEYS = [
    "url", "detailUrl", "detailURL", "positionUrl", "positionURL", "postUrl", "postURL", "link", "href",
]
LOCATION_KEYS = [
    "location", "locationName", "locationNames", "city", "cityName", "cityList", "workLocation",
    "workAddress", "工作地点", "工作地",
]
EMPLOYMENT_KEYS = ["employmentType", "jobType", "recruitType", "type", "positionType", "招募类型"]
POSTED_KEYS = [
    "postedAt", "publishTime", "publishedAt", "发布日期", "发布时间", "createTime", "createdAt",
]
DESCRIPTION_KEYS = [
    "description", "descriptionText", "jobDescription", "jobDesc", "岗位描述", "职位描述",
    "responsibilities", "requirement", "requirements", "qualifications", "content",
]
DESCRIPTION_HTML_KEYS = [
    "descriptionHtml", "descriptionHTML", "jobDescriptionHtml", "jobDescHtml", "contentHtml",
    "richText", "html",
]
TEAM_KEYS = ["team", "teamName", "业务线", "团队"]
DEPARTMENT_KEYS = ["department", "departmentName", "bg", "bgName", "部门"]
NAME_KEYS = ["name", "title", "label", "value", "text", "city", "location"]
POSTING_WORDS = "(?i)实习|校招|岗位|职位|intern|graduate|position|job"
BLOCK_MARKERS = [
    "captcha", "人机验证", "验证", "访问频率", "forbidden", "access denied", "登录后查看", "sign in",
]
OBJECT_SCORES = {"title": 3, "id": 2, "location": 1, "description": 3, "same_id": 3, "words": 1}
LIST_SCORES = {"title": 3, "id": 3, "url": 1, "location": 1, "words": 2}
CRAWLER_VERSION = "1.0.0"
DETAIL_PAGE_TYPE = "career_site_job_detail"


def _normal(keys: list[str]) -> list[str]:
    """Distinct normalised spellings, first one first."""
    plain = ["".join(ch for ch in k.lower() if ch.isascii() and ch.isalnum() or "一" <= ch <= "鿿") for k in keys]
    return list(dict.fromkeys(plain))


def _names(*key_sets: list[str]) -> Column:
    """Spellings of several attributes as one constant array of arrays."""
    return F.from_json(F.lit(json.dumps([_normal(k) for k in key_sets])), "array<array<string>>")


def object_fields(item: Column) -> Column:
    """JSON text of an object -> its members by normalised key, as JSON text.

    Of keys that differ only in case or signs the last in order counts.
    """
    members = F.map_entries(F.try_variant_get(F.try_parse_json(item), "$", "map<string,variant>"))
    plain = F.transform(members, lambda e: F.struct(urls.normalize_key(e["key"]).alias("key"), F.to_json(e["value"]).alias("value")))

    def last_of_each(entries: Column) -> Column:
        return F.filter(
            entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])
        )

    return F.map_from_entries(text.let(plain, last_of_each))


def first_field(fields: Column, names: Column) -> Column:
    """JSON text of the first filled spelling of an attribute in one object."""
    values = F.transform(names, lambda k: F.try_element_at(fields, k))
    return F.get(F.filter(values, lambda x: ~x.isin("null", '""')), 0)


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def value_text(json_text: Column, depth: int = 3) -> Column:
    """JSON value -> text: lists joined by `` / ``, objects by their naming keys."""
    return text.let(
        json_text,
        lambda t: F.when(t.rlike(r'^"[^"\\]*"$'), text.clean_whitespace(F.btrim(t, F.lit('"'))))
        .when(t.rlike(r"^-?\d+$"), t)
        .otherwise(text.let(F.try_parse_json(t), lambda v: _variant_text(v, depth))),
    )


def _variant_text(v: Column, depth: int) -> Column:
    def by_kind(kind: Column) -> Column:
        plain = F.try_variant_get(v, "$", "string")
        out = (
            F.when(kind == "STRING", text.clean_whitespace(plain))
            .when(kind.isin("BIGINT", "DOUBLE", "DECIMAL"), plain)
            .when(kind == "BOOLEAN", F.initcap(plain))
        )
        if depth:
            parts = F.transform(
                F.try_variant_get(v, "$", "array<variant>"), lambda x: _variant_text(x, depth - 1)
            )
            joined = F.array_join(F.filter(parts, lambda p: F.length(p) > 0), " / ")
            members = F.transform_keys(
                F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: urls.normalize_key(k)
            )
            named = text.let(members, _naming_values)
            out = out.when(kind == "ARRAY", text.blank_to_null(joined)).when(
                kind == "OBJECT", F.coalesce(named, text.clean_whitespace(plain))
            )
        return out.when(kind != "VOID", text.clean_whitespace(plain))

    return text.let(_kind(v), by_kind)


def _naming_values(members: Column) -> Column:
    values = F.transform(
        F.array(*[F.lit(k) for k in NAME_KEYS]),
        lambda k: text.blank_to_null(F.try_variant_get(F.try_element_at(members, k), "$", "string")),
    )
    return text.blank_to_null(F.array_join(F.array_compact(values), " / "))


def html_value(json_text: Column) -> Column:
    """JSON value -> markup text; lists joined by line breaks."""

    def read(v: Column) -> Column:
        parts = F.transform(
            F.try_variant_get(v, "$", "array<variant>"),
            lambda x: text.blank_to_null(text.strip(F.try_variant_get(x, "$", "string"))),
        )
        listed = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")
        return F.when(_kind(v) == "ARRAY", text.blank_to_null(listed)).when(
            _kind(v) != "VOID", text.blank_to_null(text.strip(F.try_variant_get(v, "$", "string")))
        )

    return text.let(F.try_parse_json(json_text), read)


def _object_score(o: Column, page_id: Column) -> Column:
    """How much an object looks like the posting of the page."""
    sets = _names(TITLE_KEYS, ID_KEYS, LOCATION_KEYS, DESCRIPTION_KEYS + DESCRIPTION_HTML_KEYS)
    points = F.array(*[F.lit(OBJECT_SCORES[n]) for n in ("title", "id", "location", "description")])
    # Zero, false and empty containers do not count as filled.
    filled = F.transform(
        sets,
        lambda names: ~F.coalesce(
            first_field(o["fields"], names).isin("0", "0.0", "false", "[]", "{}"), F.lit(True)
        ),
    )
    scored = F.aggregate(
        F.zip_with(filled, points, lambda has, n: F.when(has, n).otherwise(0)), F.lit(0), lambda x, y: x + y
    )
    own_id = F.btrim(first_field(o["fields"], F.get(sets, 1)), F.lit('"'))
    return (
        scored
        + F.when(F.coalesce(own_id == page_id, F.lit(False)), OBJECT_SCORES["same_id"]).otherwise(0)
        + F.when(o["scalars"].rlike(POSTING_WORDS), OBJECT_SCORES["words"]).otherwise(0)
    )


def _best(items: Column, score) -> Column:
    """(score, item) of the highest score, the earliest on a tie; null without items."""
    scored = F.transform(items, lambda o: F.struct(score(o).alias("score"), (-o["pos"]).alias("neg"), o.alias("item")))
    keyed = F.transform(scored, lambda s: F.struct(s["score"], s["neg"]))
    top = F.array_max(keyed)
    return F.get(F.filter(scored, lambda s: (s["score"] == top["score"]) & (s["neg"] == top["neg"])), 0)


_RESOLVED = {
    "title": TITLE_KEYS,
    "external_id": ID_KEYS,
    "location": LOCATION_KEYS,
    "employment": EMPLOYMENT_KEYS,
    "posted": POSTED_KEYS,
    "description": DESCRIPTION_KEYS,
    "team": TEAM_KEYS,
    "department": DEPARTMENT_KEYS,
}


def resolve_detail_payload(payloads: DataFrame, page: str = "page_url") -> DataFrame:
    """(page_url, seq, payload) -> per page the best object's attributes and JSON.

    An attribute missing in the object itself is looked for in the objects inside it.
    """
    opened = payloads.select(
        page, "seq", json_objects("payload").alias("_objects"), urls.url_job_id(F.col(page)).alias("_page_id")
    )
    chosen = opened.withColumn(
        "_best", _best(F.col("_objects"), lambda o: _object_score(o, F.col("_page_id")))
    ).where(F.col("_best").isNotNull())
    best = F.col("_best.item")
    inside = F.filter(
        F.col("_objects"), lambda o: (o["pos"] >= best["pos"]) & (o["pos"] <= best["last"])
    )

    def found(names: Column) -> Column:
        values = F.transform(F.col("_inside"), lambda o: first_field(o["fields"], names))
        return F.get(F.filter(values, lambda x: x.isNotNull()), 0)

    read = chosen.withColumn("_inside", inside).withColumns(
        {
            "_texts": F.transform(
                F.transform(_names(*_RESOLVED.values()), found), lambda t: value_text(t)
            ),
            "_html": html_value(found(F.get(_names(DESCRIPTION_HTML_KEYS), 0))),
        }
    )
    resolved = read.select(
        page,
        F.struct((-F.col("_best.score")).alias("neg"), F.col("seq"), best["pos"].alias("pos")).alias("_rank"),
        F.struct(
            F.col("_best.score").alias("score"),
            *[F.get("_texts", i).alias(name) for i, name in enumerate(_RESOLVED)],
            F.col("_html").alias("description_html"),
            best["json"].alias("payload"),
        ).alias("_picked"),
    )
    return resolved.groupBy(page).agg(F.min_by("_picked", "_rank").alias("p")).select(page, "p.*")


def _list_score(x: Column) -> Column:
    sets = _names(TITLE_KEYS, ID_KEYS, URL_KEYS, LOCATION_KEYS)
    points = F.array(*[F.lit(LIST_SCORES[n]) for n in ("title", "id", "url", "location")])
    hits = F.zip_with(
        sets, points, lambda names, n: F.when(F.arrays_overlap(x["keys"], names), n).otherwise(0)
    )
    total = F.aggregate(hits, F.lit(0), lambda a, b: a + b) + F.when(
        x["scalars"].rlike(POSTING_WORDS), LIST_SCORES["words"]
    ).otherwise(0)
    return F.when(x["all_objects"], total).otherwise(-1)


def resolve_list_payload(payloads: DataFrame, page: str = "page_url") -> DataFrame:
    """(page_url, seq, payload) -> the items (page_url, pos, item) of the best list per page.

    Only (score, place) of each payload's best list meets the others of its page; the items
    stay where they are until the winner is known.
    """
    opened = payloads.select(page, "seq", json_lists("payload").alias("_lists"))
    best = opened.withColumn("_best", _best(F.col("_lists"), _list_score)).where(
        F.col("_best.score") >= 0
    )
    rank = F.struct((-F.col("_best.score")).alias("neg"), F.col("seq").alias("seq"))
    winners = best.groupBy(page).agg(F.min(rank).alias("w")).select(page, F.col("w.seq").alias("seq"))
    return best.join(winners, [page, "seq"]).select(
        page, F.posexplode("_best.item.items").alias("pos", "item")
    )


_STUB = [
    "detail_url", "title", "location", "employment", "posted", "external_id", "department", "team",
    "payload", "card_text",
]


def listing_stubs(items: DataFrame, site: str, carry: list[str] = ()) -> DataFrame:
    """List items (item: JSON text) -> stubs; a missing URL is built from ids; no URL, no stub."""
    # The outer form keeps Spark from reading the object again for every attribute.
    opened = items.select("*", F.explode_outer(F.array(object_fields(F.col("item")))).alias("_f"))

    by_path = site == urls.BYTEDANCE.key
    wanted = {
        "url": URL_KEYS,
        "title": TITLE_KEYS,
        "location": LOCATION_KEYS,
        "employment": EMPLOYMENT_KEYS,
        "posted": POSTED_KEYS,
        "department": DEPARTMENT_KEYS,
        "team": TEAM_KEYS,
        "external_id": ID_KEYS if by_path else ["postid", "postId", "id", "jobId"],
        "postid": ["postid", "postId"],
        "id": ["id", "jobId"],
        "pid": ["pid", "projectId"],
        "tid": ["tid", "typeId"],
    }
    values = F.transform(
        F.transform(_names(*wanted.values()), lambda names: first_field(F.col("_f"), names)),
        lambda t: value_text(t),
    )
    # So does this one: the filter below would read every attribute again for each that it names.
    opened = opened.select("*", F.explode_outer(F.array(values)).alias("_values"))
    read = {name: F.get("_values", i) for i, name in enumerate(wanted)}
    if by_path:
        built = F.when(
            read["external_id"].rlike(r"^\d{8,}$"),
            F.concat(F.lit("https://jobs.bytedance.com/campus/position/"), read["external_id"], F.lit("/detail")),
        )
    else:
        base = "https://join.qq.com/post_detail.html?"
        built = F.coalesce(
            F.concat(F.lit(base + "postid="), read["postid"]),
            F.concat(F.lit(base + "id="), read["id"], F.lit("&pid="), read["pid"], F.lit("&tid="), read["tid"]),
        )
    return (
        opened.withColumn("_url", F.coalesce(read["url"], built))
        .where(F.col("_url").isNotNull())
        .select(
            *carry,
            urls.canonical_detail_url(F.col("_url"), site).alias("detail_url"),
            read["title"].alias("title"),
            read["location"].alias("location"),
            read["employment"].alias("employment"),
            dates.normalize_date(read["posted"]).alias("posted"),
            read["external_id"].alias("external_id"),
            read["department"].alias("department"),
            read["team"].alias("team"),
            F.col("item").alias("payload"),
            F.lit(None).cast("string").alias("card_text"),
        )
    )


def listing_card_hints(anchors: DataFrame, site: str, carry: list[str] = ()) -> DataFrame:
    """Links (href, text, card_text) of one site's detail pages -> stubs with hints.

    A hint is the first line of the card that looks like it.
    """
    profile = PROFILES[site]
    link = F.coalesce(text.clean_whitespace(F.col("text")), F.lit(""))
    card = F.coalesce(text.clean_whitespace(F.col("card_text")), link)
    lines = F.filter(
        F.transform(F.split(F.replace(card, F.lit(" · "), F.lit("\n")), "\n"), text.strip),
        lambda x: x != "",
    )

    def first_line(pattern: str) -> Column:
        return F.get(F.filter(lines, lambda x: x.rlike("(?iU)" + pattern)), 0)

    title = F.coalesce(
        F.when(text.plausible_title(link), link), F.get(F.filter(lines, text.plausible_title), 0)
    )
    detail = urls.canonical_detail_url(F.col("href"), site)
    return anchors.where(urls.is_detail_url(F.col("href"), site)).select(
        *carry,
        detail.alias("detail_url"),
        title.alias("title"),
        first_line(profile.location_words).alias("location"),
        first_line(profile.employment_words).alias("employment"),
        F.lit(None).cast("string").alias("posted"),
        urls.url_job_id(detail).alias("external_id"),
        first_line(profile.department_words).alias("department"),
        F.lit(None).cast("string").alias("team"),
        F.lit(None).cast("string").alias("payload"),
        card.alias("card_text"),
    )


def collect_listing(from_anchors: DataFrame, from_items: DataFrame, order: str = "pos") -> DataFrame:
    """Stubs of links, then of list items; the first per canonical URL stays."""
    both = from_anchors.select(F.lit(0).alias("_part"), order, *_STUB).unionByName(
        from_items.select(F.lit(1).alias("_part"), order, *_STUB)
    )
    return first_per_key(both, ["detail_url"], [F.col("_part").asc(), F.col(order).asc()]).drop("_part")


def blocked_marker(body: Column) -> Column:
    """First sign that a page is a login or bot check instead of a posting."""
    lowered = F.lower(body)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(m)), m) for m in BLOCK_MARKERS])


def _first_match(body: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(
        *[
            F.when(body.rlike("(?U)" + p), text.clean_whitespace(F.regexp_extract(body, "(?U)" + p, 1)))
            for p in patterns
        ]
    )


def merge_detail_records(
    stubs: DataFrame, pages: DataFrame, resolved: DataFrame, site: str
) -> tuple[DataFrame, DataFrame]:
    """Stubs joined with page text (page_url, body_text, page_html, fetched_at) and resolved
    payloads -> raw postings, and the failures (url, stage, reason, detail).

    Every attribute comes from the payload, else from the page text, else from the listing.
    """
    profile = PROFILES[site]
    s = stubs.select(F.col("detail_url").alias("page_url"), *[F.col(c).alias("_s_" + c) for c in _STUB[1:]])
    found = [*_RESOLVED, "description_html", "payload"]
    r = resolved.select("page_url", *[F.col(c).alias("_r_" + c) for c in found])
    body = F.coalesce(text.clean_whitespace(F.col("body_text")), F.lit(""))
    joined = s.join(pages.withColumn("_body", body), "page_url", "left").join(r, "page_url", "left")
    b = F.col("_body")

    def pick(*options: Column) -> Column:
        return F.coalesce(*[F.when(text.strip(o) != "", o) for o in options])

    source_url = urls.canonical_detail_url(F.col("page_url"), site)
    location = pick(F.col("_r_location"), _first_match(b, profile.location_labels), F.col("_s_location"))
    employment = pick(F.col("_r_employment"), _first_match(b, profile.employment_labels), F.col("_s_employment"))
    posted = pick(F.col("_r_posted"), _first_match(b, profile.posted_labels), F.col("_s_posted"))
    metadata = F.map_filter(
        F.create_map(
            *[
                x
                for name, value in {
                    "company_slug": F.lit(profile.company_slug),
                    "crawler_name": F.lit(profile.company_slug + "-company-site"),
                    "crawler_version": F.lit(CRAWLER_VERSION),
                    "list_url": F.lit(profile.list_url),
                    "detail_url": source_url,
                    "source_page_type": F.lit(DETAIL_PAGE_TYPE),
                    "location_raw": location,
                    "employment_type_raw": employment,
                    "posted_at_raw": posted,
                    "req_id_raw": _first_match(b, (profile.req_id,)),
                    "department_raw": pick(F.col("_r_department"), F.col("_s_department")),
                    "team_raw": pick(F.col("_r_team"), F.col("_s_team")),
                    "listing_card_text": F.col("_s_card_text"),
                }.items()
                for x in (F.lit(name), value)
            ]
        ),
        lambda k, v: F.coalesce(v, F.lit("")) != "",
    )
    records = joined.select(
        F.lit("company_site").alias("source_type"),
        source_url.alias("source_url"),
        text.clean_whitespace(
            pick(F.col("_r_external_id"), F.col("_s_external_id"), urls.url_job_id(source_url))
        ).alias("external_job_id"),
        text.clean_whitespace(pick(F.col("_r_title"), text.page_title(b), F.col("_s_title"))).alias("title"),
        F.lit(profile.company_name).alias("company_name"),
        text.clean_whitespace(location).alias("location_text"),
        text.clean_whitespace(employment).alias("employment_type"),
        dates.normalize_date(posted).alias("posted_at"),
        text.clean_whitespace(
            pick(F.col("_r_description"), text.merge_sections(text.parse_sections(b)))
        ).alias("description_text"),
        text.sanitize_html(pick(F.col("_r_description_html"), text.sanitize_html(F.col("page_html")))).alias(
            "description_html"
        ),
        F.coalesce("_r_payload", "_s_payload").alias("json_payload"),
        metadata.alias("metadata"),
        "fetched_at",
        F.col("page_url").alias("_url"),
        blocked_marker(b).alias("_blocked"),
    )
    checked = crawl_record_problems(records)
    reason = (
        F.when(F.col("fetched_at").isNull(), "not_captured")
        .when(F.col("_blocked").isNotNull(), "blocked")
        .when(F.col("title").isNull(), "no_title")
        .when(F.col("problem").isNotNull(), "invalid_record")
    )
    judged = checked.withColumn("_reason", reason)
    failures = judged.where(F.col("_reason").isNotNull()).select(
        F.col("_url").alias("url"),
        F.lit("detail_extract").alias("stage"),
        F.col("_reason").alias("reason"),
        F.coalesce("_blocked", "problem").alias("detail"),
    )
    return judged.where(F.col("_reason").isNull()).select(*RAW_COLUMNS), failures


def crawl_counters(stubs: DataFrame, records: DataFrame, failures: DataFrame) -> DataFrame:
    """(counter, reason, n): collected, emitted, skipped and failures by stage and reason."""
    none = F.lit(None).cast("string")
    parts = [
        stubs.agg(F.count("*").alias("n")).select(F.lit("collected").alias("counter"), none.alias("reason"), "n"),
        records.agg(F.count("*").alias("n")).select(F.lit("emitted").alias("counter"), none.alias("reason"), "n"),
        failures.groupBy("stage", "reason").agg(F.count("*").alias("n")).select(
            F.concat(F.lit("failed:"), "stage").alias("counter"), "reason", "n"
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
