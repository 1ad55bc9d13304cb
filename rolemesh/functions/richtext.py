"""Posting markup -> a safe subset for display."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank_to_null, let, strip

# Tags that stay, and elements that go with everything inside.
ALLOWED = ["p", "br", "strong", "em", "b", "i", "ul", "ol", "li", "code", "pre", "blockquote"]
BLOCKED = ["script", "style", "template", "iframe", "object", "embed", "svg", "math", "noscript"]
MARKUP = r"(?i)&lt;/?[a-z][^&]*&gt;|</?[a-z][^>]*>"


def _decode(value: str | None) -> str | None:
    if value is None:
        return None
    while (decoded := html.unescape(value)) != value:
        value = decoded
    return value


@F.pandas_udf(T.StringType())
def _decoded(value: pd.Series) -> pd.Series:
    return value.map(_decode)


def decode_entities(c: Column) -> Column:
    """Character references decoded until nothing changes; text without ``&`` stays in the JVM."""
    return F.coalesce(_decoded(F.when(F.contains(c, F.lit("&")), c)), c)


def _escape(c: Column, quotes: bool) -> Column:
    out = c
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quotes:
        pairs += [('"', "&quot;"), ("'", "&#39;")]
    for char, entity in pairs:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


# Elements that end an open paragraph, and those that hold list entries together.
ENDS_PARAGRAPH = ["p", "ul", "ol", "li", "pre", "blockquote"]
WALLS = ["ul", "ol", "blockquote", "pre"]
_OPEN, _CLOSE, _END = "\u0001", "\u0002", "\u0003"


def _closers(stack: Column, depth: Column) -> Column:
    return F.transform(F.slice(stack, F.lit(1), depth), lambda t: F.concat(F.lit("</"), t, F.lit(">")))


def balanced(marked: Column) -> Column:
    """Text with marked tags -> markup in which every element that is opened is closed, in order.

    A stack of open elements (the innermost first) is folded over the tags. An end tag closes
    what stands open inside its element; one without an open element goes. A paragraph ends
    where a block begins, a list entry where the next one of its list begins, and what is
    still open at the end is closed there.
    """
    tokens = F.regexp_extract_all(marked, F.lit(f"[{_OPEN}{_CLOSE}][a-z]+{_END}|[^{_OPEN}{_CLOSE}]+"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("open"))

    def step(acc: Column, token: Column) -> Column:
        stack = acc["open"]
        opens, closes = F.startswith(token, F.lit(_OPEN)), F.startswith(token, F.lit(_CLOSE))
        name = token.substr(F.lit(2), F.length(token) - 2)
        place = lambda tag: F.array_position(stack, tag).cast("int")
        wall = F.array_position(F.transform(stack, lambda t: t.isin(WALLS)), F.lit(True)).cast("int")
        entry = place(F.lit("li"))
        in_list = (entry > 0) & ((wall == 0) | (entry < wall))
        depth = (
            F.when(closes, place(name))
            .when(opens & (name == "li") & in_list, entry)
            .when(opens & name.isin(ENDS_PARAGRAPH), place(F.lit("p")))
            .otherwise(0)
        )

        def after(n: Column) -> Column:
            shown = F.when(opens, F.array(F.concat(F.lit("<"), name, F.lit(">")))).when(closes, F.array().cast("array<string>"))
            rest = F.slice(stack, n + 1, F.size(stack))
            return F.struct(
                F.concat(acc["out"], _closers(stack, n), F.coalesce(shown, F.array(token))).alias("out"),
                F.when(opens & (name != "br"), F.concat(F.array(name), rest)).otherwise(rest).alias("open"),
            )

        return let(depth, after)

    done = lambda acc: F.array_join(F.concat(acc["out"], _closers(acc["open"], F.size(acc["open"]))), "")
    return F.aggregate(tokens, start, step, done)


def safe_rich_text(c: Column) -> Column:
    """Markup: entities decoded, blocked elements dropped, unknown tags unwrapped, attributes
    removed, text escaped, tags balanced. Anything else is escaped as plain text."""
    raw = strip(F.coalesce(c, F.lit("")))
    blocked, allowed = "|".join(BLOCKED), "|".join(ALLOWED)
    body = F.translate(decode_entities(raw), _OPEN + _CLOSE + _END, "")
    body = F.regexp_replace(body, "(?s)<!--.*?(?:-->|$)", "")
    body = F.regexp_replace(body, rf"(?is)<({blocked})\b[^>]*>.*?(?:</\1\s*>|$)", "")
    # Allowed tags are set aside as control characters while the text around is escaped.
    for tag in ALLOWED:  # tag names in lower case
        body = F.regexp_replace(body, rf"(?i)<{tag}(?:\s[^>]*|/)?>", f"{_OPEN}{tag}{_END}")
        body = F.regexp_replace(body, rf"(?i)</{tag}\s*>", f"{_CLOSE}{tag}{_END}")
    body = F.regexp_replace(body, r"</?[A-Za-z!?][^>]*>", "")
    safe = F.coalesce(blank_to_null(balanced(_escape(body, quotes=False))), _escape(raw, quotes=True))
    return F.when(raw.rlike(MARKUP), safe).otherwise(_escape(raw, quotes=True))
