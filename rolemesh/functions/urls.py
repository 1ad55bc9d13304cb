"""URL clean-up: tracking parameters, canonical detail URLs, hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, let

# Query keys that never identify a posting.
TRACKING_KEYS = [
    "external_referral_code",
    "referral_code",
    "recomid",
    "sourcejobid",
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_content",
    "utm_term",
    "spread",
    "activity",
    "activitylink",
    "from",
]


@dataclass(frozen=True)
class SiteProfile:
    """What differs between the two supported career sites."""

    key: str
    company_name: str
    company_slug: str
    list_url: str
    host: str
    req_id: str
    location_labels: tuple[str, ...]
    employment_labels: tuple[str, ...]
    posted_labels: tuple[str, ...]
    location_words: str
    employment_words: str
    department_words: str


# Names, hosts, labels and word lists of the two sites.
EMPLOYMENT_TOKENS = [
    "实习",
    "应届实习",
    "日常实习",
    "校招",
    "校园招聘",
    "Graduate",
    "Intern",
    "Internship",
    "Regular",
    "Full Time",
    "Part Time",
    "Contract",
]
BYTEDANCE = SiteProfile(
    key="bytedance_campus",
    company_name="字节跳动",
    company_slug="bytedance",
    list_url="https://jobs.bytedance.com/campus/position/list?keywords=",
    host="jobs.bytedance.com",
    req_id=r"职位ID\s*[:：]?\s*([A-Za-z0-9_-]+)",
    location_labels=(r"工作地点\s*[:：]?\s*(.+)", r"(?i)Location\s*[:：]?\s*(.+)"),
    employment_labels=(r"(?i)Employment Type\s*[:：]?\s*(.+)", r"招聘类型\s*[:：]?\s*(.+)"),
    posted_labels=(
        r"发布时间\s*[:：]?\s*(\d{4}[./-]\d{1,2}[./-]\d{1,2})",
        r"(?i)Posted\s*(?:on|at)?\s*[:：]?\s*(\d{4}[./-]\d{1,2}[./-]\d{1,2})",
    ),
    location_words="北京|上海|深圳|广州|杭州|成都|远程|Remote|Singapore|San Jose|Seattle|London|Tokyo",
    employment_words="^(" + "|".join(EMPLOYMENT_TOKENS) + ")$",
    department_words="研发|算法|后端|前端|运营|设计|产品|人力|技术|marketing|design|product|technology",
)
TENCENT = SiteProfile(
    key="tencent_campus",
    company_name="腾讯",
    company_slug="tencent",
    list_url="https://join.qq.com/post.html?query=p_2",
    host="join.qq.com",
    req_id=r"(?:职位ID|岗位ID)\s*[:：]?\s*([A-Za-z0-9_-]+)",
    location_labels=(r"招聘部门和工作地\s*[:：]?\s*(.+)", r"参加面试的城市\s*[:：]?\s*(.+)"),
    employment_labels=(r"(?m)^(应届实习|日常实习|实习|校招|培训生)$",),
    posted_labels=(r"发布时间\s*[:：]?\s*(\d{4}[./-]\d{1,2}[./-]\d{1,2})",),
    location_words="北京|上海|深圳|广州|成都|杭州|天津|武汉|西安|南京|远程|Remote",
    employment_words="实习|校招|培训生|青云计划|Graduate|Intern",
    department_words="CSIG|IEG|PCG|TEG|WXG|CDG|S[0-9]|事业群|部门",
)
PROFILES = {p.key: p for p in (BYTEDANCE, TENCENT)}


def normalize_key(c: Column) -> Column:
    """Letters a-z, digits and CJK only, so ``postId``, ``post_id`` and ``postid`` agree."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9一-鿿]", "")


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    encoded = F.url_encode(c)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)", group)


def query_pairs(url: Column) -> Column:
    """Decoded (key, value) pairs of the query string, in order."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.struct(
            _decode(F.substring_index(x, "=", 1)).alias("k"),
            _decode(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )


def _query_text(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def _with_query(base: Column, query: Column) -> Column:
    return let(query, lambda q: F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q)))


def strip_tracking_params(url: Column) -> Column:
    """Drop tracking keys and the fragment; the other pairs keep their order."""
    banned = [k.replace("_", "") for k in TRACKING_KEYS]
    kept = F.filter(query_pairs(url), lambda p: ~normalize_key(p["k"]).isin(banned))
    return _with_query(F.regexp_extract(url, r"^([^?#]*)", 1), _query_text(kept))


def _value_of(pairs: Column, key: str) -> Column:
    """First non-empty value of one exact query key."""
    return F.get(F.filter(pairs, lambda p: (p["k"] == key) & (p["v"] != "")), 0)["v"]


def _query_value(url: Column, *keys: str) -> Column:
    return let(query_pairs(url), lambda pairs: F.coalesce(*[_value_of(pairs, k) for k in keys]))


def canonical_detail_url(url: Column, site: str) -> Column:
    """One spelling per posting page of a site."""
    build = _path_detail if site == BYTEDANCE.key else _query_detail
    return let(strip_tracking_params(url), lambda clean: build(clean, PROFILES[site].host))


def _scheme(url: Column) -> Column:
    return F.coalesce(blank_to_null(F.lower(_part(url, 1))), F.lit("https"))


def _path_detail(clean: Column, host: str) -> Column:
    """The id is part of the path; the rest of the query stays."""
    path = _part(clean, 3)
    before = F.regexp_extract(path, r"/campus/position/(\d+)/detail", 1)
    after = F.regexp_extract(path, r"/campus/position/detail/(\d+)", 1)
    short = (
        F.when(before != "", F.concat(F.lit("/campus/position/"), before, F.lit("/detail")))
        .when(after != "", F.concat(F.lit("/campus/position/detail/"), after))
        .otherwise(path)
    )
    query = F.regexp_extract(clean, r"\?(.*)$", 1)
    return _with_query(F.concat(_scheme(clean), F.lit("://" + host), short), query)


def _query_detail(clean: Column, host: str) -> Column:
    """The id is a query key: a post id in any case, else the id, pid and tid given."""

    def query(pairs: Column) -> Column:
        posts = F.filter(pairs, lambda p: (F.lower(p["k"]) == "postid") & (p["v"] != ""))
        others = [F.concat(F.lit(k + "="), _encode(_value_of(pairs, k))) for k in ("id", "pid", "tid")]
        return F.coalesce(
            F.concat(F.lit("postid="), _encode(F.get(posts, 0)["v"])), F.concat_ws("&", *others)
        )

    base = F.concat(_scheme(clean), F.lit("://" + host + "/post_detail.html"))
    return _with_query(base, let(query_pairs(clean), query))


def is_detail_url(url: Column, site: str) -> Column:
    host, path = _part(url, 2), _part(url, 3)
    on_site = host.isin(PROFILES[site].host, "www." + PROFILES[site].host)
    if site == BYTEDANCE.key:
        return on_site & path.rlike(r"/campus/position/(\d+/detail|detail/\d+)")
    has_id = _query_value(url, "id", "postid", "postId").isNotNull()
    return on_site & path.isin("/post_detail.html", "/m/post_detail.html") & has_id


def url_job_id(url: Column) -> Column:
    """The posting id a detail URL carries, for either site."""
    host, path = _part(url, 2), _part(url, 3)
    from_path = F.when(
        F.endswith(host, F.lit("bytedance.com")),
        blank_to_null(F.regexp_extract(path, r"/position/(\d+)/detail", 1)),
    )
    from_query = F.when(
        F.endswith(host, F.lit("qq.com")),
        _query_value(url, "postid", "postId", "id"),
    )
    return F.coalesce(from_path, from_query)


def source_host(url: Column, placeholder: str = "External link") -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(blank_to_null(F.regexp_replace(host, r"^www\.", "")), F.lit(placeholder))


def is_absolute_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))
