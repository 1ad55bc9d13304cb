"""Text clean-up as Column -> Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that Java's \s leaves out.
WS = r"[\s\x1c-\x1f]"

_WS_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


@dataclass(frozen=True)
class Cue:
    """What to look for in text, ignoring case.

    ``words`` are literal terms between word boundaries, ``shapes`` are (literal part,
    pattern) pairs between word boundaries, ``free`` terms match anywhere. A pattern only
    runs where a literal part occurs, which a plain substring search finds out first.
    """

    words: Sequence[str] = ()
    shapes: Sequence[tuple[str, str]] = ()
    free: Sequence[str] = ()

    def found(self, lowered: Column) -> Column:
        """Whether lower-cased text holds any of the terms."""
        tests = [F.contains(lowered, F.lit(t.lower())) for t in self.free]
        needles = [w.lower() for w in self.words] + [needle.lower() for needle, _ in self.shapes]
        if needles:
            some = reduce(or_, [F.contains(lowered, F.lit(n)) for n in needles])
            patterns = [r"\Q" + w + r"\E" for w in self.words] + [p for _, p in self.shapes]
            tests.append(some & lowered.rlike(r"(?iU)\b(?:" + "|".join(patterns) + r")\b"))
        return reduce(or_, tests, F.lit(False))


# Terms and their order decide the result.
REMOTE_RULES = [
    ("remote", Cue(["remote"])),
    ("hybrid", Cue(["hybrid"])),
    ("onsite", Cue(shapes=[("site", "on[- ]?site")])),
]
EMPLOYMENT_RULES = [
    ("full-time", Cue(shapes=[("time", "full[- ]?time")])),
    ("part-time", Cue(shapes=[("time", "part[- ]?time")])),
    ("contract", Cue(["contract", "contractor"])),
    ("internship", Cue(["intern", "internship"])),
]
LEVER_EMPLOYMENT = {
    "full time": "full-time",
    "fulltime": "full-time",
    "part time": "part-time",
    "parttime": "part-time",
    "contract": "contract",
    "intern": "internship",
    "internship": "internship",
    "temporary": "temporary",
    "temp": "temporary",
}
ASHBY_EMPLOYMENT = {
    "fulltime": "full-time",
    "parttime": "part-time",
    "intern": "internship",
    "contract": "contract",
    "temporary": "temporary",
}


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def blank_to_null(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(_WS_CHARS))


def collapse(c: Column) -> Column:
    """White space runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


@lru_cache(maxsize=1)
def _ascii_table() -> tuple[str, str, str, str]:
    """Characters whose compatibility decomposition holds ASCII: those that become one
    character (as two aligned strings), and the others (as a character class and JSON)."""
    singles_from, singles_to, longer = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        folded = "".join(x for x in unicodedata.normalize("NFKD", char) if x < "\x80")
        if len(folded) == 1:
            singles_from.append(char)
            singles_to.append(folded)
        elif folded:
            longer[char] = folded
    points = [ord(c) for c in longer]
    starts = [p for p in points if p - 1 not in set(points)]
    ends = [p for p in points if p + 1 not in set(points)]
    ranges = "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in zip(starts, ends))
    return "".join(singles_from), "".join(singles_to), f"[{ranges}]", json.dumps(longer)


def ascii_fold(c: Column) -> Column:
    """Decompose accents, ligatures and wide forms, then drop what is not ASCII."""
    singles_from, singles_to, has_longer, longer = _ascii_table()
    table = F.from_json(F.lit(longer), "map<string,string>")
    expanded = F.when(
        c.rlike(has_longer),
        F.array_join(
            F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
        ),
    ).otherwise(c)
    folded = F.regexp_replace(
        F.translate(expanded, singles_from, singles_to), r"[^\x00-\x7F]+", ""
    )
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "-")
    return F.coalesce(blank_to_null(F.btrim(dashed, F.lit("-"))), F.lit("unknown"))


def graph_slug(c: Column) -> Column:
    """Letters and digits of any script are kept, every other character becomes one dash."""
    dashed = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "-"))
    return F.coalesce(blank_to_null(F.btrim(dashed, F.lit("-"))), F.lit("unknown"))


def source_slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.coalesce(blank_to_null(F.btrim(dashed, F.lit("-"))), F.lit("source"))


def short_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def strip_markup(c: Column) -> Column:
    """Tags (even unclosed ones) become blanks, stray ``>`` vanishes, blanks collapse."""
    tagless = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*(?:>|$)", " ")
    return collapse(F.replace(tagless, F.lit(">"), F.lit("")))


def strip_tags(c: Column) -> Column:
    """Well-formed tags become blanks, white space collapses."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def normalize_text(c: Column) -> Column:
    return strip_tags(c)


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def first_rule(c: Column, rules: Sequence[tuple[str, Cue]]) -> Column:
    """Label of the first cue found, in rule order; null when none is."""

    def choose(lowered: Column) -> Column:
        result = F.lit(None).cast("string")
        for label, cue in reversed(rules):
            result = F.when(cue.found(lowered), label).otherwise(result)
        return result

    return let(F.lower(c), choose)


def infer_remote_mode(location: Column, description: Column, rules=REMOTE_RULES) -> Column:
    return first_rule(F.concat_ws(" ", blank_to_null(location), blank_to_null(description)), rules)


def infer_employment_type(given: Column, description: Column, rules=EMPLOYMENT_RULES) -> Column:
    return F.coalesce(blank_to_null(given), first_rule(description, rules))


def map_employment(c: Column, mapping: dict[str, str]) -> Column:
    """Known names are mapped; unknown ones pass through lower-cased; empty is missing."""
    key = F.lower(strip(c))
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.when(F.length(c) > 0, F.coalesce(F.try_element_at(table, key), key))


def clean_whitespace(c: Column) -> Column:
    """Per-line trim, single blanks, at most one empty line in a row; empty becomes null."""
    text = F.regexp_replace(F.translate(c, "\u00a0\u200b", " "), "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t\f\x0b]+", " ")
    line_ws = r"[\s\x1c-\x1f&&[^\n]]"
    text = F.regexp_replace(text, rf"(?mdU)^{line_ws}+|{line_ws}+$", "")
    return blank_to_null(strip(F.regexp_replace(text, "\n{3,}", "\n\n")))


def sanitize_html(c: Column) -> Column:
    """Remove script, style and noscript elements with their content; empty becomes null."""
    out = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")
    return F.when(F.length(strip(out)) > 0, out)


# Headings, end markers and navigation words of the supported career sites.
SECTION_HEADINGS = [
    "职位描述",
    "职位要求",
    "岗位描述",
    "岗位要求",
    "团队介绍",
    "加分项或注意事项",
    "加分项",
    "参加面试的城市",
    "招聘部门和工作地",
    "Job Description",
    "Responsibilities",
    "Qualifications",
    "Preferred Qualifications",
]
SECTION_END_MARKERS = [
    "相关职位",
    "推荐职位",
    "更多职位",
    "你可能还喜欢",
    "岗位已下架",
    "职位已下架",
    "立即投递",
    "关注腾讯招聘",
    "Apply",
    "Search now",
]
NAV_TEXTS = [
    "首页",
    "校园招聘",
    "社招官网",
    "全球招聘",
    "了解腾讯",
    "求职攻略",
    "招聘动态",
    "Apply",
    "Search now",
    "Jobs",
    "登录",
    "退出登录",
    "我的简历",
    "应聘进度",
    "账号绑定",
    "首页青云计划岗位投递招聘动态了解腾讯求职攻略",
]
NAV_TITLE = "^(登录|注册|首页|招聘动态|相关职位|更多职位|校园招聘|求职攻略)$"
PAGE_TITLE_NOISE = "腾讯校园招聘|字节跳动|校园招聘|岗位详情|首页|求职攻略|招聘动态"
DESCRIPTION_SECTIONS = [
    "团队介绍",
    "职位描述",
    "岗位描述",
    "职位要求",
    "岗位要求",
    "加分项或注意事项",
    "加分项",
]


def parse_sections(
    body: Column,
    headings: list[str] = SECTION_HEADINGS,
    end_markers: list[str] = SECTION_END_MARKERS,
) -> Column:
    """Body text -> array of (heading, content), in page order, end markers left out."""
    names = "|".join(headings + end_markers)
    # The first letters rule out most places before the names are tried one by one.
    letters = sorted({name[:1] for name in headings + end_markers})
    ahead = f"(?=[{''.join(letters)}])" if all(letter.isalpha() for letter in letters) else ""
    marked = F.regexp_replace(
        F.coalesce(clean_whitespace(body), F.lit("")),
        rf"(?U){ahead}({names}){WS}*[:：]?",
        "\u0001$1\u0002",
    )
    pieces = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            F.substring_index(p, "\u0002", 1).alias("heading"),
            clean_whitespace(F.substring_index(p, "\u0002", -1)).alias("content"),
        ),
    )
    return F.filter(
        pairs, lambda s: s["content"].isNotNull() & ~s["heading"].isin(end_markers)
    )


def merge_sections(sections: Column, preferred: list[str] = DESCRIPTION_SECTIONS) -> Column:
    """Wanted sections in the wanted order; of a repeated heading the last one counts."""

    def merged(found: Column) -> Column:
        blocks = []
        for name in preferred:
            wanted = F.lit(name)
            own = F.filter(found, lambda s: s["heading"] == wanted)  # noqa: B023 - used at once
            blocks.append(F.concat(F.lit(name + "\n"), F.try_element_at(own, F.lit(-1))["content"]))
        return blank_to_null(F.concat_ws("\n\n", *blocks))

    # The sections are read from the text once, not once per heading.
    return let(sections, merged)


def plausible_title(c: Column) -> Column:
    text = clean_whitespace(c)
    return F.coalesce(
        ~text.isin(NAV_TEXTS)
        & F.length(text).between(2, 120)
        & ~text.rlike(r"(?U)^[\W_]+$")
        & ~text.rlike(NAV_TITLE),
        F.lit(False),
    )


def page_title(body: Column) -> Column:
    """First plausible line of at most 80 characters among the first 30 lines of a page."""
    lines = F.filter(
        F.split(F.coalesce(clean_whitespace(body), F.lit("")), "\n"), lambda x: F.length(x) > 0
    )
    good = F.filter(
        F.slice(lines, 1, 30),
        lambda x: plausible_title(x) & ~x.rlike(PAGE_TITLE_NOISE) & (F.length(x) <= 80),
    )
    return F.get(good, 0)
