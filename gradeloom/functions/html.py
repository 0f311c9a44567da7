"""Column functions over HTML bodies: text, attributes and deterministic rules."""

from __future__ import annotations

import json
import zlib
from html import unescape as unescape_one
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that close up on screen, and the two safe-tag lists.
INLINE_TAGS = ("a|abbr|acronym|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|ins|kbd|mark|q|rp|rt|ruby|s|samp|"
               "small|span|strike|strong|sub|sup|time|tt|u|var")
REMEDIATION_SAFE = ("div", "h2", "h3", "p", "ul", "li", "a", "strong", "span", "img", "table", "tr", "th", "td")
AUTHORING_SAFE = REMEDIATION_SAFE + ("thead", "tbody")
# Constructs the platform's editor strips.
STRIPPED = {"ol": r"<ol\b", "br": r"<br\b", "em": r"<em\b", "style": r"<style\b", "hr": r"<hr\b",
            "box_shadow": r"box-shadow", "link": r"<link\b", "comment": r"<!--", "script": r"<script\b"}
MAX_ALT = 110
HEADING_TEXT = 350
IMAGE_NAME = r"\.(png|jpe?g|gif|svg|webp|bmp|tiff?)\s*$"

SCRIPT_OR_STYLE = r"(?is)<(script|style)\b[^>]*>.*?</\1>"
ANY_TAG = r"<[^>]+>"


def found(html: Column, pattern: str) -> Column:
    return html.rlike(f"(?i){pattern}")


def all_of(html: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(html, F.lit(f"(?is){pattern}"), F.lit(group))


#: Named references dealt to buckets by their CRC, so that a look-up compares a name or two; the longest of those that may lack the ``;``.
BUCKETS = 512
OPEN_NAMES = range(max(len(k) for k in html5 if not k.endswith(";")), 1, -1)


def _names() -> Column:
    table: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, value in html5.items():
        table[zlib.crc32(name.encode()) % BUCKETS][name] = value
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,string>>")


def unescape(text: Column) -> Column:
    """Character references to characters, as browsers read them.

    Names may lack the ``;`` where HTML allows it, then the longest name counts. Numbers may lack it too; those of the old Windows page stand
    for its characters, impossible ones for U+FFFD, and non-characters for nothing.
    """
    names, low = _names(), F.array(*[F.lit(unescape_one(f"&#{n};")) for n in range(0xA0)])

    def named(ref):
        return F.try_element_at(F.get(names, (F.crc32(ref.cast("binary")) % BUCKETS).cast("int")), ref)

    def number(ref):
        hexed = ref.rlike(r"^#[xX]")
        digits = F.ltrim(F.regexp_extract(ref, r"^#[xX]?([0-9a-fA-F]+)", 1), F.lit("0"))
        of = lambda base: F.conv(F.concat(F.lit("0"), digits), base, 10).cast("bigint")
        n = F.when(F.length(digits) > 8, F.lit(1 << 40)).otherwise(F.when(hexed, of(16)).otherwise(of(10)))
        bad = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(~bad, n)), 8, "0")), "UTF-32")
        return F.when(n < 0xA0, F.get(low, n.cast("int"))).when(bad, "\ufffd").when(none, "").otherwise(char)

    def segment(seg):
        ref = F.regexp_extract(seg, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
        # the reference as it stands, then its beginnings: one look-up expression for all, as the table is a big constant
        tries = F.array(ref, *[F.when(F.length(ref) > n, F.left(ref, F.lit(n))) for n in OPEN_NAMES])
        read = F.filter(F.transform(tries, lambda t: F.struct(F.length(t).alias("n"), named(t).alias("v"))), lambda x: x["v"].isNotNull())
        named_text = F.get(F.transform(F.slice(read, 1, 1), lambda x: F.concat(x["v"], F.substr(seg, x["n"] + 1))), F.lit(0))
        numbered = F.concat(number(ref), F.substr(seg, F.length(ref) + 1))
        return F.coalesce(F.when(ref.startswith("#"), numbered).when(ref != "", named_text), F.concat(F.lit("&"), seg))

    parts = F.split(text, "&")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), segment)
    return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))).otherwise(text)


def _squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def visible_text(html: Column) -> Column:
    """Words on the page, every tag a space."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), SCRIPT_OR_STYLE, " ")
    return _squash(unescape(F.regexp_replace(body, ANY_TAG, " ")))


def reader_text(html: Column) -> Column:
    """Words as a reader sees them: inline tags close up instead of spacing."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), SCRIPT_OR_STYLE, " ")
    body = F.regexp_replace(body, rf"(?i)</?(?:{INLINE_TAGS})\b[^>]*>", "")
    return _squash(unescape(F.regexp_replace(body, ANY_TAG, " ")))


def html_to_text(html: Column) -> Column:
    """Readable text that keeps list, table and indentation shape."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    for pattern, mark in ((r"(?i)<li[^>]*>", "\n  - "), (r"(?i)<tr[^>]*>", "\n| "), (r"(?i)</t[dh]>", " | "),
                          (r"(?i)<(br|/p|/div|/h[1-6]|/table)[^>]*>", "\n"), (ANY_TAG, "")):
        t = F.regexp_replace(t, pattern, mark)
    t = F.replace(unescape(t), F.lit("\u00a0"), F.lit(" "))
    lines = F.transform(F.split(t, "\n"), lambda line: F.rtrim(F.concat(
        F.regexp_extract(line, r"^[ \t]*", 0), F.regexp_replace(F.trim(line), r"[ \t]+", " "))))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n\s*\n+", "\n\n"), r"^\s+|\s+$", ""))


def attr_values(html: Column, attr: str) -> Column:
    """The sorted multiset of one attribute's values."""
    return F.array_sort(all_of(F.coalesce(html, F.lit("")), attr + r'\s*=\s*"([^"]*)"', 1))


def heading_texts(html: Column) -> Column:
    return F.transform(all_of(html, r"<h[23]\b[^>]*>(.*?)</h[23]>", 1),
                       lambda m: _squash(unescape(F.regexp_replace(m, ANY_TAG, ""))))


def asciify(html: Column) -> Column:
    """Characters past ASCII as numeric references."""
    return F.when(html.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(html, ""), lambda c: F.when(
        c.rlike(r"^[^\x00-\x7f]"), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c)), "")).otherwise(html)


def alt_of(tag: Column) -> Column:
    """The alt text of an image tag; null where there is none."""
    return F.when(tag.rlike(r'(?is)alt\s*=\s*".*?"'), F.regexp_extract(tag, r'(?is)alt\s*=\s*"(.*?)"', 1))


def a11y_issues(html: Column) -> Column:
    """The hard accessibility rules of one body as an array of findings, in rule order."""
    h = F.coalesce(html, F.lit(""))
    none = F.lit(None).cast("string")

    def image(tag):
        alt = F.trim(alt_of(tag))
        named = found(alt, IMAGE_NAME) | (~alt.contains(" ") & alt.contains("."))
        return (F.when(alt.isNull(), "img missing alt").when(alt == "", none)
                .when(named, F.concat(F.lit("alt is a filename: '"), F.left(alt, F.lit(40)), F.lit("'")))
                .when(F.length(alt) > MAX_ALT, F.concat(F.lit("alt too long ("), F.length(alt).cast("string"), F.lit(" chars)"))))

    h2, h3 = found(h, r"<h2\b"), found(h, r"<h3\b")
    tables = F.transform(all_of(h, r"<table\b.*?</table>"), lambda t: F.when(
        ~found(t, r"<th\b[^>]*scope"), "table without <th scope>"))
    links = F.transform(all_of(h, r"<a\b[^>]*>(.*?)</a>", 1), lambda a: F.when(
        (F.trim(F.regexp_replace(a, ANY_TAG, "")) == "") & ~found(a, "<img"), "empty link (no text)"))
    page = F.array(
        F.when((F.length(visible_text(h)) > HEADING_TEXT) & ~h2 & ~h3, "no semantic heading (h2/h3)"),
        F.when(found(h, r"<h[45]\b") & ~h3, "skipped heading level"))
    active = F.array(
        F.when(found(h, r"<script\b"), "script element in page HTML"),
        F.when(found(h, r"\son[a-z]+\s*="), "inline event handler attribute"),
        F.when(found(h, r"(href|src)\s*=\s*[\"']\s*javascript:"), "javascript: link"))
    return F.array_compact(F.concat(F.transform(all_of(h, r"<img\b[^>]*>"), image), page, tables, links, active))


def heading_levels(html: Column) -> Column:
    return F.transform(all_of(html, r"<h([1-6])\b", 1), lambda d: d.cast("int"))


def heading_order_problem(html: Column) -> Column:
    """Why the headings are out of order, or null."""
    levels = heading_levels(html)
    jump = F.filter(F.zip_with(F.concat(F.array(F.lit(2)), levels), levels, lambda a, b: F.struct(
        a.alias("a"), b.alias("b"))), lambda p: p["b"] > p["a"] + 1)
    first = F.get(levels, F.lit(0))
    return (F.when(first != 2, F.concat(F.lit("first heading is h"), first.cast("string"), F.lit(", not h2")))
            .when(F.array_contains(levels, 1), "an <h1> is present")
            .when(F.size(jump) > 0, F.concat(F.lit("h"), F.get(jump, F.lit(0))["a"].cast("string"), F.lit(" jumps to h"),
                                             F.get(jump, F.lit(0))["b"].cast("string"))))


def list_depth(html: Column) -> Column:
    """Deepest nesting of <ul>."""
    steps = F.transform(all_of(html, r"<(/?)ul\b", 1), lambda s: F.when(s == "/", -1).otherwise(1))
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    return F.aggregate(steps, zero, lambda a, s: F.struct(
        (a["d"] + s).alias("d"), F.greatest(a["m"], a["d"] + s).alias("m")), lambda a: a["m"])


def tags_used(html: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(
        all_of(html, r"<\s*/?\s*([a-zA-Z][a-zA-Z0-9]*)", 1), lambda t: F.lower(t))))


def unsafe_tags(html: Column, safe=AUTHORING_SAFE) -> Column:
    return F.array_except(tags_used(html), F.array(*[F.lit(t) for t in safe]))


def colours_used(html: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(all_of(html, r"(?<!&)#[0-9a-fA-F]{6}\b"), lambda c: F.lower(c))))


def off_palette(html: Column, palette: Column) -> Column:
    return F.array_except(colours_used(html), F.transform(palette, lambda p: F.lower(p)))


def luminance(colour: Column) -> Column:
    """Relative luminance of #rgb or #rrggbb."""
    raw = F.lower(F.ltrim(colour, F.lit("#")))
    full = F.when(F.length(raw) == 3, F.regexp_replace(raw, "(.)", "$1$1")).otherwise(raw)

    def channel(at):
        c = F.conv(F.substring(full, at, 2), 16, 10).cast("double") / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5)


def contrast_ratio(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def _state(bad: Column, state: str = "fail") -> Column:
    return F.when(bad, state).otherwise("pass")


def style_rules(html: Column, profile: str = "remediation", palette: Column | None = None,
                max_alt: int = MAX_ALT) -> dict[str, Column]:
    """Rule name to state (pass, warn, fail; null where the rule does not apply)."""
    h = F.coalesce(html, F.lit(""))
    authoring = profile == "authoring"
    ths = all_of(h, r"<th\b([^>]*)>", 1)
    images = F.transform(all_of(h, r"<img\b([^>]*)>", 1), lambda a: F.regexp_extract(a, r'(?i)alt\s*=\s*"([^"]*)"', 1))
    lacking = F.exists(all_of(h, r"<img\b([^>]*)>", 1), lambda a: ~a.rlike(r'(?i)alt\s*=\s*"[^"]*"'))
    bad_alt = F.exists(images, lambda alt: F.trim(alt).rlike(r"(?i)\.(png|jpe?g|gif|webp|bmp|svg)$") | (F.length(alt) > max_alt))
    links = all_of(h, r"<a\b[^>]*>.*?</a>")
    empty_link = F.exists(links, lambda a: F.trim(F.regexp_replace(a, ANY_TAG, "")) == "")
    plain_link = F.exists(links, lambda a: ~F.lower(F.regexp_extract(a, r"(?is)^<a\b([^>]*)>", 1)).contains("underline"))
    classes = F.exists(all_of(h, r'class\s*=\s*"([^"]*)"', 1), lambda c: ~c.contains("instructure_file_link"))
    rules = {"one_h2": _state(F.size(all_of(h, r"<h2\b")) != 1), "h3_sections": _state(~found(h, r"<h3\b"), "warn")}
    if authoring:
        rules["heading_order"] = _state(heading_order_problem(h).isNotNull())
    else:
        rules["other_headings"] = _state(found(h, r"<h[1456]\b"))
    stripped = dict(STRIPPED, iframe=r"<iframe\b") if authoring else STRIPPED
    rules.update({f"no_{name}": _state(found(h, rx)) for name, rx in stripped.items()})
    rules.update({
        "no_class": _state(classes), "no_id": _state(found(h, r'\sid\s*=\s*"')),
        "nested_list": _state(list_depth(h) > 1),
        "safe_tags": _state(F.size(unsafe_tags(h, AUTHORING_SAFE if authoring else REMEDIATION_SAFE)) > 0),
        "table_headers": F.when(F.size(ths) > 0, _state(F.exists(ths, lambda t: ~F.lower(t).contains("scope="))))
        .otherwise(_state(found(h, r"<table\b"))),
        "images": _state(lacking | bad_alt),
        "links": F.when(empty_link, "fail").when(plain_link, "warn").otherwise("pass"),
        "ascii": _state(h.rlike(r"[^\x00-\x7f]"), "warn")})
    if palette is not None:
        rules["palette"] = F.when(F.size(colours_used(h)) > 0,
                                  _state(F.size(off_palette(h, palette)) > 0, "warn" if authoring else "fail"))
    elif not authoring:
        rules["palette"] = F.when(F.size(colours_used(h)) > 0, "warn")
    return rules


def rule_rows(rules: dict[str, Column]) -> Column:
    """array<struct<rule,state>> of a rule set, rules that do not apply left out."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("state")) for n, c in rules.items()])
    return F.filter(rows, lambda r: r["state"].isNotNull())
