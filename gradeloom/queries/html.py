"""HTML queries: web pages are course bodies, twenty courses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import html as h
from gradeloom.operators import html_audit, scores
from gradeloom.queries.registry import query

B = "bodies"


def body():
    return F.col("html")


@query("visible_text", "SELECT page_id, vis AS text FROM texts", "bodies texts")
def visible_text(feed):
    return feed.bodies.select("page_id", h.visible_text(body()).alias("text"))


READER = """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t0, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'),
 '&#233;', 'é'), '&nbsp;', chr(160)), '&amp;', '&'), '[\\s\\x{00A0}]+', ' ', 'g')) AS text
 FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', ' ', 'g'),
  '(?i)</?(a|b|span|strong|i|em)\\b[^>]*>', '', 'g'), '<[^>]+>', ' ', 'g') AS t0 FROM bodies)"""


@query("reader_text", READER, B)
def reader_text(feed):
    return feed.bodies.select("page_id", h.reader_text(body()).alias("text"))


@query("html_to_text", """SELECT page_id, len(text) AS chars, len(regexp_extract_all(text, '  - ')) AS bullets,
 len(regexp_extract_all(text, chr(10))) + 1 AS lines FROM (SELECT page_id, trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t3, chr(10)),
   lambda l: rtrim(regexp_extract(l, '^[ \\t]*') || regexp_replace(trim(l), '[ \\t]+', ' ', 'g'))), chr(10)), '\\n\\s*\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text
 FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(t2, '<[^>]+>', '', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&#233;', 'é'), '&nbsp;', ' '), '&amp;', '&') AS t3
 FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'),
   '(?i)<li[^>]*>', chr(10) || '  - ', 'g'), '(?i)<tr[^>]*>', chr(10) || '| ', 'g'), '(?i)</t[dh]>', ' | ', 'g'), '(?i)<(br|/p|/div|/h[1-6]|/table)[^>]*>', chr(10), 'g') AS t2 FROM bodies)))""", B)
def html_to_text(feed):
    t = feed.bodies.select("page_id", h.html_to_text(body()).alias("text"))
    return t.select("page_id", F.length("text").alias("chars"), F.regexp_count("text", F.lit("  - ")).alias("bullets"),
                    F.size(F.split("text", "\n")).alias("lines"))


ISSUES = r"""SELECT page_id, course_id, list_filter(list_concat(
 list_transform(regexp_extract_all(html, '(?i)<img\b[^>]*>'), lambda t: CASE WHEN NOT regexp_matches(t, '(?is)alt\s*=\s*".*?"') THEN 'img missing alt'
   WHEN regexp_extract(t, '(?is)alt\s*=\s*"(.*?)"', 1) = '' THEN NULL
   WHEN regexp_matches(regexp_extract(t, '(?is)alt\s*=\s*"(.*?)"', 1), '(?i)\.(png|jpe?g|gif|svg|webp|bmp|tiff?)\s*$')
   THEN 'alt is a filename: ''' || regexp_extract(t, '(?is)alt\s*=\s*"(.*?)"', 1) || '''' END),
 [CASE WHEN length(vis) > 350 AND NOT regexp_matches(html, '(?i)<h[23]\b') THEN 'no semantic heading (h2/h3)' END,
  CASE WHEN regexp_matches(html, '(?i)<h[45]\b') AND NOT regexp_matches(html, '(?i)<h3\b') THEN 'skipped heading level' END],
 list_transform(regexp_extract_all(html, '(?is)<table\b.*?</table>'), lambda t: CASE WHEN NOT regexp_matches(t, '(?i)<th\b[^>]*scope') THEN 'table without <th scope>' END),
 list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda a: CASE WHEN trim(regexp_replace(a, '<[^>]+>', '', 'g')) = '' AND NOT contains(a, '<img') THEN 'empty link (no text)' END),
 [CASE WHEN regexp_matches(html, '(?i)<script\b') THEN 'script element in page HTML' END,
  CASE WHEN regexp_matches(html, '(?i)\son[a-z]+\s*=') THEN 'inline event handler attribute' END,
  CASE WHEN regexp_matches(html, '(?i)(href|src)\s*=\s*["'']\s*javascript:') THEN 'javascript: link' END]), lambda x: x IS NOT NULL) AS issues FROM texts"""


@query("a11y_issues", ISSUES, "bodies texts")
def a11y_issues(feed):
    return feed.bodies.select("page_id", "course_id", h.a11y_issues(body()).alias("issues"))


@query("heading_order", r"""SELECT page_id, levels, 'first heading is h' || levels[1] || ', not h2' AS problem
 FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<h([1-6])\b', 1), lambda x: CAST(x AS INT)) AS levels FROM bodies)""", B)
def heading_order(feed):
    return feed.bodies.select("page_id", h.heading_levels(body()).alias("levels"), h.heading_order_problem(body()).alias("problem"))


@query("list_depth", r"""SELECT page_id, CASE WHEN page_id % 8 = 5 THEN 2 WHEN contains(html, '<ul') THEN 1 ELSE 0 END AS depth FROM bodies""", B)
def list_depth(feed):
    return feed.bodies.select("page_id", h.list_depth(body()).alias("depth"))


@query("attr_set_equal", r"""SELECT page_id, list_sort(regexp_extract_all(html, '(?is)href\s*=\s*"([^"]*)"', 1)) AS hrefs,
 list_sort(regexp_extract_all(html, '(?is)src\s*=\s*"([^"]*)"', 1)) AS srcs, page_id % 8 NOT IN (3, 6) AS same_href FROM bodies""", B)
def attr_set_equal(feed):
    both = feed.bodies.join(feed.pages.select("page_id", F.col("html").alias("old")), "page_id")
    return both.select("page_id", h.attr_values(body(), "href").alias("hrefs"), h.attr_values(body(), "src").alias("srcs"),
                       (h.attr_values(body(), "href") == h.attr_values(F.col("old"), "href")).alias("same_href"))


PALETTE = ["#777777", "#061E3F"]


@query("palette_except", r"""SELECT page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '#[0-9a-fA-F]{6}\b'), lambda c: lower(c)),
 lambda c: c NOT IN ('#777777', '#061e3f')))) AS off FROM bodies""", B)
def palette_except(feed):
    return feed.bodies.select("page_id", h.off_palette(body(), F.array(*[F.lit(c) for c in PALETTE])).alias("off"))


@query("tag_except", r"""SELECT page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '<\s*/?\s*([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t)),
 lambda t: t NOT IN ('div','h2','h3','p','ul','li','a','strong','span','img','table','tr','th','td','thead','tbody')))) AS extra FROM bodies""", B)
def tag_except(feed):
    return feed.bodies.select("page_id", h.unsafe_tags(body()).alias("extra"))


def _has(rx):
    return f"regexp_matches(html, '(?i){rx}')"


def _sql_state(cond, state="fail"):
    return f"CASE WHEN {cond} THEN '{state}' ELSE 'pass' END"


def _rules_sql(profile):
    authoring = profile == "authoring"
    stripped = dict(h.STRIPPED, iframe=r"<iframe\b") if authoring else h.STRIPPED
    safe = h.AUTHORING_SAFE if authoring else h.REMEDIATION_SAFE
    tags = r"list_transform(regexp_extract_all(html, '<\s*/?\s*([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t))"
    rules = {"one_h2": _sql_state(r"len(regexp_extract_all(html, '(?i)<h2\b')) <> 1"),
             "h3_sections": _sql_state(f"NOT {_has(r'<h3\b')}", "warn")}
    if authoring:
        rules["heading_order"] = "'fail'"  # every page opens with an h1
    else:
        rules["other_headings"] = _sql_state(_has(r"<h[1456]\b"))
    rules.update({f"no_{n}": _sql_state(_has(rx)) for n, rx in stripped.items()})
    rules.update({
        "no_class": _sql_state(_has(r'class\s*=\s*"[^"]*"')), "no_id": _sql_state(_has(r'\sid\s*=\s*"')),
        "nested_list": _sql_state("page_id % 8 = 5"),
        "safe_tags": _sql_state(f"len(list_filter({tags}, lambda t: t NOT IN {safe})) > 0"),
        "table_headers": _sql_state("page_id % 8 = 2"), "images": _sql_state("page_id % 8 = 1"),
        "links": "CASE WHEN page_id % 8 = 3 THEN 'fail' WHEN contains(html, '<a ') THEN 'warn' ELSE 'pass' END",
        "ascii": _sql_state(r"regexp_matches(html, '[^\x00-\x7f]')", "warn")})
    colours = "regexp_matches(html, '#[0-9a-fA-F]{6}\\b')"
    off = "len(list_filter(regexp_extract_all(html, '#[0-9a-fA-F]{6}\\b'), lambda c: c <> '#777777')) > 0"
    rules["palette"] = f"CASE WHEN {colours} THEN {_sql_state(off, 'warn')} END" if authoring else f"CASE WHEN {colours} THEN 'warn' END"
    rows = ", ".join(f"{{'rule': '{n}', 'state': {c}}}" for n, c in rules.items())
    return f"SELECT page_id, rule, state FROM (SELECT page_id, unnest([{rows}], recursive := true) FROM bodies) WHERE state IS NOT NULL"


@query("style_rules_remediation", _rules_sql("remediation"), B)
def style_rules_remediation(feed):
    return html_audit.style_report(feed.bodies, ["page_id"], "html", "remediation")


@query("style_rules_authoring", _rules_sql("authoring"), B)
def style_rules_authoring(feed):
    return html_audit.style_report(feed.bodies, ["page_id"], "html", "authoring", F.array(F.lit("#777777")))


@query("contrast", """SELECT page_id, '#777777' AS fg, '#888888' AS bg, 'dim é text' AS snippet, 1.26::DOUBLE AS ratio FROM bodies WHERE page_id % 8 = 5""", B)
def contrast(feed):
    runs = html_audit.text_runs(feed.bodies, "page_id", "html")
    return html_audit.contrast_failures(runs)


@query("emphasis_census", r"""SELECT page_id, count(*) FILTER (WHERE cls='code') AS code, count(*) FILTER (WHERE cls='label') AS label,
 count(*) FILTER (WHERE cls='sentence') AS sentence, count(*) FILTER (WHERE cls='unclassified') AS unclassified FROM
 (SELECT page_id, CASE WHEN regexp_matches(t, '[{};]|\breturn\b|\(\s*\)|\bpublic\s+\w|\bvoid\b') THEN 'code' WHEN regexp_matches(t, '^You Do It \d+$') THEN 'label'
   WHEN length(t) >= 40 THEN 'sentence' ELSE 'unclassified' END AS cls
  FROM (SELECT page_id, trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?is)<p[^>]*>\s*(?:<b\b[^>]*>.*?</b>|<strong\b[^>]*>.*?</strong>)\s*</p>')), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t FROM bodies) WHERE t <> '') GROUP BY page_id""", B)
def emphasis_census(feed):
    return html_audit.emphasis_census(feed.bodies, ["page_id"], "html")


@query("boxed_span_census", "SELECT course_id, count(*) AS bodies, CAST(sum(CASE WHEN page_id % 8 = 7 THEN 1 ELSE 0 END) AS BIGINT) AS boxes FROM bodies GROUP BY 1", B)
def boxed_span_census(feed):
    return feed.bodies.groupBy("course_id").agg(F.count(F.lit(1)).alias("bodies"), F.sum(html_audit.boxed_spans(body(), "#d7dce3")).alias("boxes"))


@query("embedded_file_refs", """SELECT page_id, x.file_id, x.tag, x.url, x.host FROM (SELECT page_id, unnest(CASE page_id % 8
  WHEN 1 THEN [{'file_id': '12', 'tag': 'img', 'url': '/files/12/a.png', 'host': ''}]
  WHEN 6 THEN [{'file_id': '77', 'tag': 'a', 'url': 'https://files.example.com/courses/1/files/77/download', 'host': 'files.example.com'},
               {'file_id': '78', 'tag': 'img', 'url': '/courses/1/files/78', 'host': ''}] END) AS x FROM bodies)""", B)
def embedded_file_refs(feed):
    hosts = feed.pages.select(F.lit("files.example.com").alias("host")).distinct()
    return html_audit.embedded_file_refs(feed.bodies, ["page_id"], "html", hosts)


@query("body_corpus", """SELECT kind, count(*) AS bodies, count(DISTINCT sha) AS distinct_bodies, min(sha) AS first_sha FROM
 (SELECT CASE page_id % 5 WHEN 0 THEN 'page' WHEN 1 THEN 'assignment' WHEN 2 THEN 'discussion' WHEN 3 THEN 'quiz' ELSE 'syllabus' END AS kind, page_id, sha256(html) AS sha FROM bodies)
 WHERE NOT (kind = 'assignment' AND page_id % 3 = 0) GROUP BY kind""", B)
def body_corpus(feed):
    rows = feed.bodies.select("course_id", F.col("page_id").alias("item_id"), F.col("url").alias("title"), "html",
                              F.when(F.col("page_id") % 3 == 0, F.col("page_id")).alias("quiz_id"), F.lit(False).alias("discussion_backed"))
    kind = lambda n: rows.where(F.col("item_id") % 5 == n)
    corpus = html_audit.body_corpus(kind(0), kind(1), kind(2), kind(3), kind(4))
    return corpus.groupBy("kind").agg(F.count(F.lit(1)).alias("bodies"), F.count_distinct("sha256").alias("distinct_bodies"), F.min("sha256").alias("first_sha"))


CODE_LINES = '<p><strong>if (x &lt; 1) {</strong></p> <p><b>&nbsp;&nbsp;return&nbsp;x;<br></b></p><p><em>}</em></p><p><i><b>Read the <u>whole</u> chapter twice before the next class.</b></i></p>'
CODE_BLOCK = ('<div style="' + html_audit.CODE_STYLE.replace("'", "''") + '">if (x &lt; 1) {\n  return x;\n}</div><p>Read the <u>whole</u> chapter twice before the next class.</p>')
PARTED, REDUCED = '<span style="border: 1px solid #d7dce3; font-weight: bold">kept', '<span style="font-weight: bold">kept'


def rewritable(feed):
    """The pages, with code runs after every fifth and boxes of two kinds, some without an end, after others."""
    k = F.col("page_id")
    more = (F.when(k % 5 == 1, CODE_LINES).when(k % 5 == 2, f"{PARTED} <span>x</span></span>")
            .when(k % 5 == 3, '<span style="border: 1px solid #d7dce3">open').otherwise(""))
    return feed.bodies.select("page_id", F.concat("html", more).alias("html"))


@query("bulk_rewrite", fr"""SELECT page_id, changes, boxes, held, sha256(CASE WHEN held IS NULL THEN n ELSE o END) AS sha256 FROM
 (SELECT *, trim(html || CASE page_id%5 WHEN 1 THEN '{CODE_LINES}' WHEN 2 THEN '{PARTED} <span>x</span></span>' WHEN 3 THEN '<span style="border: 1px solid #d7dce3">open' ELSE '' END) AS o,
   trim(replace(replace(replace(html, '<p><strong>You Do It 1</strong></p>', '<h3 style="{html_audit.HEADING_STYLE}">You Do It 1</h3>'),
     '<p><b>This sentence is bold for no good reason at all.</b></p>', '<p>This sentence is bold for no good reason at all.</p>'), '<span style="border: 1px solid #d7dce3;">boxed</span>', 'boxed')
    || CASE page_id%5 WHEN 1 THEN '{CODE_BLOCK}' WHEN 2 THEN '{REDUCED} <span>x</span></span>' ELSE '' END) AS n,
   CASE WHEN page_id%5 = 3 THEN 'unbalanced span' END AS held,
   CASE WHEN page_id%5 IN (2, 3) THEN 1 ELSE 0 END + CASE WHEN page_id%8 = 7 THEN 1 ELSE 0 END AS boxes,
   CASE WHEN page_id%5 IN (2, 3) THEN 1 ELSE 0 END + CASE WHEN page_id%8 = 7 THEN 1 ELSE 0 END + CASE WHEN page_id%8 = 4 THEN 2 ELSE 0 END + CASE WHEN page_id%5 = 1 THEN 2 ELSE 0 END AS changes
  FROM bodies) WHERE changes > 0""", B)
def bulk_rewrite(feed):
    done = html_audit.bulk_rewrite(rewritable(feed), "page_id", "html", heading_style=html_audit.HEADING_STYLE, colour=html_audit.HAIRLINE)
    return done.select("page_id", "changes", "boxes", "held", F.sha2("html", 256).alias("sha256"))


@query("rewrite_gate", """SELECT page_id, note, list_filter([CASE WHEN page_id % 4 = 1 THEN 'text changed' END, CASE WHEN page_id % 8 IN (3, 6) AND page_id % 4 = 2 THEN 'href set changed' END,
  CASE WHEN regexp_matches(html, '[^\\x00-\\x7f]') THEN 'non-ascii survived' END, CASE WHEN page_id % 8 = 5 THEN 'fill survived' END, CASE WHEN page_id % 8 = 5 THEN 'coloured text survived' END,
  CASE WHEN length(vis) > 350 AND NOT regexp_matches(html, '(?i)<h[23]\\b') THEN 'missing heading not fixed' END], lambda x: x IS NOT NULL) AS issues
 FROM (SELECT *, 'styled' AS note FROM texts)""", "bodies texts")
def rewrite_gate(feed):
    changed = F.when(F.col("page_id") % 4 == 1, F.concat(body(), F.lit("<p>one more line</p>"))).when(
        (F.col("page_id") % 8 == 6), F.regexp_replace("html", "https://evil.example", "https://other.example")).otherwise(body())
    new = feed.bodies.select("page_id", changed.alias("html"), F.lit("styled").alias("note"))
    return html_audit.rewrite_gate(feed.bodies, new, "page_id").select("page_id", "note", "issues")


@query("sanitize_corpus", r"""SELECT tag, CAST(sum(n) AS BIGINT) AS removed, count(*) AS bodies FROM (SELECT page_id, tag, count(*) AS n FROM
 (SELECT page_id, unnest(list_transform(regexp_extract_all(regexp_replace(html, '(?is)<script>.*?</script>', '<script>', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t))) AS tag FROM bodies)
 WHERE tag IN ('html','head','meta','title','style','script','body','nav','article','footer','iframe') GROUP BY ALL) GROUP BY tag""", B)
def sanitize_corpus(feed):
    return html_audit.removal_census(html_audit.sanitize_corpus(feed.bodies, "page_id", "html"))


POLICIES = [("contact", "Instructor contact", ["office hours", r"example\.(com|net)"]), ("scale", "Grading scale", [r"\d+ point scale", "edition"]),
            ("none", "Never stated", ["section 504"])]
COVER = r"""SELECT page_id, policy_id, label, matched <> '' AS present, matched, vis = '' AS empty FROM (SELECT page_id, vis, unnest([
 {'policy_id':'contact','label':'Instructor contact','matched': CASE WHEN regexp_matches(vis, '(?i)office hours') THEN 'office hours' WHEN regexp_matches(vis, '(?i)example\.(com|net)') THEN 'example\.(com|net)' ELSE '' END},
 {'policy_id':'scale','label':'Grading scale','matched': CASE WHEN regexp_matches(vis, '(?i)\d+ point scale') THEN '\d+ point scale' WHEN regexp_matches(vis, '(?i)edition') THEN 'edition' ELSE '' END},
 {'policy_id':'none','label':'Never stated','matched': CASE WHEN regexp_matches(vis, '(?i)section 504') THEN 'section 504' ELSE '' END}], recursive := true) FROM texts)"""


def coverage(feed):
    return html_audit.policy_coverage(feed.bodies, "page_id", "html", POLICIES)


@query("policy_coverage", COVER, "bodies texts")
def policy_coverage(feed):
    return coverage(feed).drop("excerpt")


@query("policy_summary", f"SELECT policy_id, label, count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE NOT present) AS missing FROM ({COVER}) WHERE NOT empty GROUP BY ALL", "bodies texts")
def policy_summary(feed):
    return html_audit.policy_summary(coverage(feed))


# ------------------------------------------------------------------ scores
DEFECT = """SELECT page_id, course_id, unnest(list_transform(issues, lambda i: CASE WHEN contains(i,'img missing alt') THEN 'html_img_no_alt' WHEN contains(i,'alt is a filename') THEN 'html_alt_filename'
 WHEN contains(i,'no semantic heading') THEN 'html_no_heading' WHEN contains(i,'skipped heading') THEN 'html_skipped_heading' WHEN contains(i,'table without') THEN 'html_table_no_header'
 WHEN contains(i,'empty link') THEN 'html_empty_link' ELSE 'html_script' END)) AS d FROM (%s)""" % ISSUES
COST = """CASE d WHEN 'html_img_no_alt' THEN 12 WHEN 'html_no_heading' THEN 15 WHEN 'html_table_no_header' THEN 10 WHEN 'html_alt_filename' THEN 8 WHEN 'html_skipped_heading' THEN 8 ELSE 6 END"""
SCORED = f"""SELECT b.page_id, b.course_id, 'Pages' AS part, round(100.0 - coalesce(before_cost, 0), 1) AS before,
 CASE WHEN b.page_id % 2 = 0 THEN round(100.0 - coalesce(kept_cost, 0), 1) ELSE round(100.0 - coalesce(before_cost, 0), 1) END AS after, b.page_id % 2 = 0 AS fixed
 FROM bodies b LEFT JOIN (SELECT page_id, sum(c) AS before_cost, sum(c) FILTER (WHERE d IN ('html_img_no_alt','html_alt_filename')) AS kept_cost
  FROM (SELECT page_id, d, least(n, 3) * {COST} AS c FROM (SELECT page_id, d, count(*) AS n FROM ({DEFECT}) GROUP BY ALL)) GROUP BY page_id) USING (page_id)"""


def scored(feed):
    rows = feed.bodies.select("page_id", "course_id", h.a11y_issues(body()).alias("issues"))
    return scores.html_before_after(rows, ["page_id", "course_id"], "issues", F.col("page_id") % 2 == 0)


@query("a11y_before_after", SCORED, "bodies texts")
def a11y_before_after(feed):
    return scored(feed)


@query("a11y_score", f"""SELECT course_id, round(greatest(0, 100.0 - sum(c)), 1) AS score FROM (SELECT course_id, d, least(n, 3) * {COST} AS c FROM (SELECT course_id, d, count(*) AS n FROM ({DEFECT}) GROUP BY ALL)) GROUP BY ALL""", "bodies texts")
def a11y_score(feed):
    defects = feed.bodies.select("course_id", F.explode(scores.html_defects(h.a11y_issues(body()))).alias("defect"))
    return scores.a11y_score(defects, ["course_id"])


FORECAST = f"""SELECT course_id, files, fixed, round(b,1) AS before, round(a,1) AS after, round(round(a,1)-round(b,1),1) AS gain FROM
 (SELECT course_id, count(*) AS files, count(*) FILTER (WHERE fixed) AS fixed, avg(before) AS b, avg(after) AS a FROM ({SCORED}) GROUP BY 1)"""


@query("a11y_forecast", FORECAST, "bodies texts")
def a11y_forecast(feed):
    return scores.a11y_forecast(scored(feed), "course_id")


@query("a11y_multi_course", f"SELECT count(*) AS courses, CAST(sum(files) AS BIGINT) AS files, round(avg(before),1) AS before, round(avg(after),1) AS after FROM ({FORECAST})", "bodies texts")
def a11y_multi_course(feed):
    return scores.a11y_multi_course(scores.a11y_forecast(scored(feed), "course_id"))


@query("worst_files", f"SELECT course_id, place, page_id, before, after FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY after, page_id) AS place FROM ({SCORED})) WHERE place <= 8", "bodies texts")
def worst_files(feed):
    return scores.worst_files(scored(feed), "course_id", "page_id")


@query("a11y_forecast_parts", """SELECT course_id, part, CASE WHEN part='Pages' THEN n ELSE 0 END AS checked, CASE part WHEN 'Pages' THEN n WHEN 'PDFs' THEN n // 2 WHEN 'Word' THEN 0 END AS listed,
 CASE WHEN part='Pages' THEN 'scored' WHEN part='PowerPoint' THEN 'unlisted' WHEN part='Word' OR n // 2 = 0 THEN 'empty' ELSE 'waiting' END AS state
 FROM (SELECT course_id, count(*) AS n FROM bodies GROUP BY 1), (VALUES ('Pages'), ('PDFs'), ('PowerPoint'), ('Word')) p(part)""", B)
def a11y_forecast_parts(feed):
    n = feed.bodies.groupBy("course_id").agg(F.count(F.lit(1)).alias("n"))
    listed = n.select("course_id", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), c.cast("long").alias("listed")) for p, c in (
        ("Pages", F.col("n")), ("PDFs", F.floor(F.col("n") / 2)), ("PowerPoint", F.lit(None)), ("Word", F.lit(0)))])))
    return scores.forecast_parts(scored(feed), listed, "course_id")


# Files that are no pages: parts are office files, suppliers PDFs.
OFFICE = """SELECT CAST(p_partkey%30 AS VARCHAR) AS course_id, CAST(p_partkey AS VARCHAR) AS file_id, CASE WHEN p_size%2=0 THEN 'Word' ELSE 'PowerPoint' END AS part, before, CASE WHEN fixed THEN after ELSE before END AS after, fixed FROM
 (SELECT *, round(100.0 - least(p_size%4 + p_size%3, 3)*12 - least(p_size%5, 3)*8 - least(p_size%6, 3)*10, 1) AS before, p_size%3<>1 AS fixed,
  round(100.0 - least(p_size%4, 3)*12 - least(p_size%5 - least(p_size%5, p_size%2), 3)*8 - CASE WHEN p_size%7=0 THEN 0 ELSE least(p_size%6, 3)*10 END, 1) AS after FROM part)"""
PDFS = """SELECT CAST(s_suppkey%30 AS VARCHAR) AS course_id, CAST(s_suppkey AS VARCHAR) AS file_id, 'PDFs' AS part, round(greatest(0, 100.0 - b), 1) AS before, round(greatest(0, 100.0 - CASE WHEN fixed THEN a ELSE b END), 1) AS after, fixed FROM
 (SELECT s_suppkey, s_suppkey%2=0 AS fixed, CASE s_suppkey%4 WHEN 0 THEN 105 WHEN 1 THEN 65 ELSE 0 END + least(s_suppkey%5, 3)*8 AS b,
  CASE WHEN s_suppkey%4<2 AND s_suppkey%3=1 THEN 20 ELSE 0 END + least(s_suppkey%5, 3)*8 AS a FROM supplier)"""


def office(feed):
    size = F.col("p_size")
    rows = feed.part.select(
        (F.col("p_partkey") % 30).cast("string").alias("course_id"), F.col("p_partkey").cast("string").alias("file_id"), (size % 2).alias("_odd"),
        (size % 4).alias("alt_todo"), (size % 3).alias("alt_done"), (size % 5).alias("untitled"), F.least(size % 5, size % 2).alias("titled"),
        (size % 6).alias("headerless"), (size % 7 == 0).alias("headers_fixed"), (size % 3 != 1).alias("fixed"))
    word = scores.office_before_after(rows.where("_odd = 0"), ["course_id", "file_id"], "Word")
    return word.unionByName(scores.office_before_after(rows.where("_odd = 1"), ["course_id", "file_id"], "PowerPoint"))


def pdfs(feed):
    k = F.col("s_suppkey")
    rows = feed.supplier.select(
        (k % 30).cast("string").alias("course_id"), k.cast("string").alias("file_id"),
        F.when(k % 4 == 0, "scanned image").when(k % 4 == 1, "text-untagged").when(k % 4 == 2, "tagged").alias("class_before"),
        (k % 5).alias("figures_waiting"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("compliant"), (k % 2 == 0).alias("fixed"))
    return scores.pdf_before_after(rows, ["course_id", "file_id"])


@query("office_before_after", OFFICE)
def office_before_after(feed):
    return office(feed)


@query("pdf_before_after", PDFS)
def pdf_before_after(feed):
    return pdfs(feed)


ALL_FILES = f"SELECT course_id, before, after, fixed FROM ({SCORED}) UNION ALL SELECT course_id, before, after, fixed FROM ({OFFICE}) UNION ALL SELECT course_id, before, after, fixed FROM ({PDFS})"
FORECAST_ALL = f"""SELECT course_id, files, fixed, round(b,1) AS before, round(a,1) AS after, round(round(a,1)-round(b,1),1) AS gain FROM
 (SELECT course_id, count(*) AS files, count(*) FILTER (WHERE fixed) AS fixed, avg(before) AS b, avg(after) AS a FROM ({ALL_FILES}) GROUP BY 1)"""


def all_forecast(feed):
    cols = ["course_id", "part", "before", "after", "fixed"]
    return scores.a11y_forecast(scored(feed).select(cols).unionByName(office(feed).select(cols)).unionByName(pdfs(feed).select(cols)), "course_id")


@query("a11y_forecast_files", FORECAST_ALL, "bodies texts")
def a11y_forecast_files(feed):
    """Pages, office files and PDFs in one mean per course."""
    return all_forecast(feed)


@query("a11y_unscanned", f"SELECT CAST(c AS VARCHAR) AS course_id FROM (SELECT DISTINCT c_custkey%40 AS c FROM customer) WHERE CAST(c AS VARCHAR) NOT IN (SELECT course_id FROM ({ALL_FILES}))", "bodies texts")
def a11y_unscanned(feed):
    """Courses that have no scored file."""
    courses = feed.customer.select((F.col("c_custkey") % 40).cast("string").alias("course_id"))
    return scores.unscanned_courses(courses, all_forecast(feed), "course_id")
