"""Identity and audit queries: customers are people, nations courses, events the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.html import asciify
from gradeloom.functions.text import clip, mask_pii, norm_title, slug, word_count
from gradeloom.operators import audit, identity
from gradeloom.queries.registry import query
from gradeloom.streaming import upserts


def c(n):
    return F.col(n)


FIRST = ("Jordan", "Chase", "Maria", "Omar", "Ingrid")
PEOPLE = f"""people AS (SELECT c_nationkey AS course_id, CAST(c_custkey AS VARCHAR) AS user_id, {list(FIRST)!r}[c_custkey%5+1] AS first, 'Vo' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS last, c_custkey FROM customer),
 known AS (SELECT course_id, user_id, row_number() OVER (PARTITION BY course_id ORDER BY c_custkey) AS tag_no FROM people WHERE c_custkey%3=0),
 tags AS (SELECT * FROM known UNION ALL SELECT course_id, user_id, coalesce((SELECT max(tag_no) FROM known k WHERE k.course_id=p.course_id),0) + row_number() OVER (PARTITION BY course_id ORDER BY c_custkey) FROM people p WHERE c_custkey%3<>0),
 roster AS (SELECT p.*, first || ' ' || last AS name, CAST(tag_no AS INT) AS tag_no, 'Student-' || tag_no AS tag, count(*) OVER (PARTITION BY course_id, first) AS same FROM people p JOIN tags USING (course_id, user_id))"""


def people(feed):
    k = c("c_custkey")
    first = F.element_at(F.array(*[F.lit(x) for x in FIRST]), (k % 5 + 1).cast("int"))
    last = F.concat(F.lit("Vo"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    return feed.customer.select(c("c_nationkey").alias("course_id"), k.cast("string").alias("user_id"), first.alias("first"), last.alias("last"), k)


def tags(feed):
    from pyspark.sql import Window as W
    rows = people(feed)
    known = rows.where("c_custkey % 3 = 0").select("course_id", "user_id", F.row_number().over(W.partitionBy("course_id").orderBy("c_custkey")).alias("tag_no"))
    return identity.pseudonym_tags(rows, known)


def roster(feed):
    return people(feed).join(tags(feed), ["course_id", "user_id"]).withColumn("name", F.concat_ws(" ", "first", "last"))


@query("pseudonym_tags", f"WITH {PEOPLE} SELECT course_id, user_id, tag_no, tag FROM roster")
def pseudonym_tags(feed):
    return tags(feed)


def texts(feed):
    return roster(feed).select("course_id", c("c_custkey").alias("text_id"), F.concat(
        F.lit("Is "), "name", F.lit(" late? Ask "), "first", F.lit(" and "), "last", F.lit("'s group, or "), F.lower("name"), F.lit(".")).alias("text"))


@query("mask_roster", f"""WITH {PEOPLE} SELECT course_id, c_custkey AS text_id, 'Is ' || tag || ' late? Ask ' || CASE WHEN same=1 AND first<>'Chase' THEN tag ELSE first END || ' and ' || tag || '''s group, or ' || tag || '.' AS text,
 CASE WHEN same>1 AND first<>'Chase' THEN [first] ELSE [] END AS ambiguous FROM roster""")
def mask_roster(feed):
    return identity.mask_roster(texts(feed), roster(feed))


NICKS = f"""{PEOPLE}, nicks AS (SELECT *, CASE c_custkey%4 WHEN 0 THEN 'Ziz' || substr(last, 3) WHEN 1 THEN 'Rusty' WHEN 2 THEN 'Al' ELSE '' END AS nick FROM roster)"""


@query("mask_nicknames", f"""WITH {NICKS} SELECT course_id, c_custkey AS text_id, CASE c_custkey%4
 WHEN 0 THEN 'See ' || tag || ' or ' || tag || ', or ' || tag || '; ' || upper(nick) || 's.' WHEN 1 THEN 'See ' || tag || ' or Rusty, or rusty; RUSTYs.' WHEN 2 THEN 'See ' || tag || ' or Al, or al; ALs.'
 ELSE 'See ' || tag || ' or , or ; s.' END AS text FROM nicks""")
def mask_nicknames(feed):
    """Nicknames: quoted inside the name, alone, in lower case, and as part of a longer word; short ones and ordinary words stay alone."""
    k = c("c_custkey") % 4
    nick = F.when(k == 0, F.concat(F.lit("Ziz"), F.substr("last", F.lit(3)))).when(k == 1, "Rusty").when(k == 2, "Al").otherwise("")
    people = roster(feed).withColumn("nickname", nick)
    shown = F.when(c("nickname") == "", c("name")).otherwise(F.concat(c("first"), F.lit(' "'), c("nickname"), F.lit('" '), c("last")))
    text = F.concat(F.lit("See "), shown, F.lit(" or "), "nickname", F.lit(", or "), F.lower("nickname"), F.lit("; "), F.upper("nickname"), F.lit("s."))
    return identity.mask_roster(people.select("course_id", c("c_custkey").alias("text_id"), text.alias("text")), people).select("course_id", "text_id", "text")


@query("unmask", f"WITH {PEOPLE} SELECT course_id, c_custkey AS text_id, 'Tell ' || name || ', not Student-9999: ' || name || '.' AS text FROM roster")
def unmask(feed):
    rows = roster(feed).select("course_id", c("c_custkey").alias("text_id"), F.concat(F.lit("Tell "), "tag", F.lit(", not Student-9999: "), "tag", F.lit(".")).alias("text"))
    return identity.unmask(rows, roster(feed))


@query("leak_check", f"""WITH {PEOPLE}, t AS (SELECT course_id, c_custkey AS text_id, CASE WHEN c_custkey%4=0 THEN 'ask ' || name || ' now' WHEN c_custkey%4=1 THEN 'ask ' || upper(name) ELSE 'ask ' || tag END AS text FROM roster),
 n AS (SELECT course_id, name AS n FROM roster UNION SELECT course_id, first FROM roster WHERE length(first)>=4 UNION SELECT course_id, last FROM roster WHERE length(last)>=4)
 SELECT DISTINCT t.course_id, t.text_id, n.n AS name FROM t JOIN n ON t.course_id=n.course_id AND contains(t.text, n.n)""")
def leak_check(feed):
    k = c("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("ask "), "name", F.lit(" now"))).when(k == 1, F.concat(F.lit("ask "), F.upper("name"))).otherwise(F.concat(F.lit("ask "), "tag"))
    return identity.leak_check(roster(feed).select("course_id", c("c_custkey").alias("text_id"), text.alias("text")), roster(feed))


@query("near_name")
def near_name(feed):
    """Two letters of every last name swapped; exact spellings of somebody else are no near miss."""
    n = F.length("last")
    typo = F.concat(F.left("last", n - 2), F.right("last", F.lit(1)), F.substr("last", n - 1, F.lit(1)))
    rows = roster(feed).select("course_id", c("c_custkey").alias("text_id"), F.concat(F.lit("On Monday tell "), "first", F.lit(" "), typo, F.lit(" about it.")).alias("text"))
    return identity.near_name(rows, roster(feed))


@query("name_top3", f"""WITH {PEOPLE} SELECT course_id, written, place, name, tag, CAST(distance AS INT) AS distance FROM (SELECT w.course_id, w.written, r.name, r.tag, levenshtein(lower(w.written), lower(r.name)) AS distance,
 row_number() OVER (PARTITION BY w.course_id, w.written ORDER BY levenshtein(lower(w.written), lower(r.name)), r.name, r.tag) AS place
 FROM (SELECT DISTINCT course_id, name AS written FROM roster) w JOIN roster r USING (course_id) WHERE levenshtein(lower(w.written), lower(r.name)) <= 6) WHERE place <= 3""")
def name_top3(feed):
    """Every whole name of every customer against the names of its course."""
    people = roster(feed)
    return identity.nearest_names(people.select("course_id", F.col("name").alias("written")).distinct(), people)


@query("name_top3_all", f"""WITH {PEOPLE} SELECT course_id, written, place, name, tag, CAST(distance AS INT) AS distance FROM (SELECT w.course_id, w.written, r.name, r.tag, levenshtein(lower(w.written), lower(r.name)) AS distance,
 row_number() OVER (PARTITION BY w.course_id, w.written ORDER BY levenshtein(lower(w.written), lower(r.name)), r.name, r.tag) AS place
 FROM (SELECT DISTINCT course_id, name AS written FROM roster) w JOIN roster r USING (course_id) WHERE levenshtein(lower(w.written), lower(r.name)) <= 6) WHERE place <= 3""")
def name_top3_all(feed):
    """The former name of ``name_top3``."""
    return name_top3(feed)


@query("display_name", """SELECT c_custkey, CASE c_custkey%5 WHEN 0 THEN 'Ann "Bo" Lee' WHEN 1 THEN 'Ann Lee' WHEN 2 THEN 'Ann "O''Neil" May Lee' WHEN 3 THEN 'Ann Lee' ELSE '"Bo"' END AS shown FROM customer""")
def display_name(feed):
    k = c("c_custkey") % 5
    legal = F.when(k == 2, "Lee,  Ann May").when(k == 4, "").otherwise("Ann  Lee ")
    nick = F.when(k == 0, ' "Bo" ').when(k == 1, "").when(k == 2, "O’Neil").when(k == 3, "4ever").otherwise("Bo")
    return feed.customer.select("c_custkey", identity.display_name(legal, nick).alias("shown"))


@query("mask_pii", r"""SELECT doc_id, length(t) AS chars, len(regexp_extract_all(t, '\[EMAIL\]')) AS emails, len(regexp_extract_all(t, '\[PHONE\]')) AS phones, len(regexp_extract_all(t, '\[SSN\]')) AS ssns FROM (SELECT doc_id,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\(?\b\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b', '[PHONE]', 'g'),
  '\b\d{3}\.[A-Za-z]\d{8,9}\b', '[SISID]', 'g'), '\b[A-Za-z]\d{8,9}\b', '[USERID]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[SSN]', 'g') AS t FROM documents)""")
def pii(feed):
    t = feed.documents.select("doc_id", mask_pii(c("text")).alias("t"))
    count = lambda m: F.regexp_count("t", F.lit(m))
    return t.select("doc_id", F.length("t").alias("chars"), count(r"\[EMAIL\]").alias("emails"), count(r"\[PHONE\]").alias("phones"), count(r"\[SSN\]").alias("ssns"))


@query("slug", r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || '  & ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 3 AS words FROM part""")
def slugs(feed):
    return feed.part.select("p_partkey", slug(F.concat_ws("  & ", "p_name", "p_type")).alias("slug"), word_count(F.concat_ws("\n ", "p_name", "p_type")).alias("words"))


@query("norm_title", r"""SELECT page_id, lower(regexp_replace(regexp_replace(replace(replace(t, '&amp;', '&'), '&mdash;', '-'), '<[^>]+>', '', 'g'), '[^a-zA-Z0-9]', '', 'g')) AS norm
 FROM (SELECT page_id, '<b>Unit ' || page_id || '</b> &mdash; ' || regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' &amp; more' AS t FROM pages)""")
def norm_titles(feed):
    """Titles of the pages themselves, as they are matched."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return feed.pages.select("page_id", norm_title(F.concat(F.lit("<b>Unit "), c("page_id").cast("string"), F.lit("</b> &mdash; "), title, F.lit(" &amp; more"))).alias("norm"))


@query("clip", r"""SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE substr(t, 1, 239) || '…' END AS clipped FROM
 (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t FROM documents)""")
def clipped(feed):
    return feed.documents.select("doc_id", clip(c("text")).alias("clipped"))


@query("asciify", r"""SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda x: CASE WHEN unicode(x) < 128 THEN x ELSE '&#' || unicode(x) || ';' END), '') AS ascii FROM documents""")
def asciified(feed):
    return feed.documents.select("doc_id", asciify(c("text")).alias("ascii"))


# --------------------------------------------------------------------- audit
LOG = """log AS (SELECT CAST(user_id%10 AS VARCHAR) AS chain_id, event_id AS seq, ts AS "at", CAST(user_id%7 AS VARCHAR) AS course_id, event_type AS area, CASE event_id%5 WHEN 0 THEN 'posted' WHEN 1 THEN 'opened' WHEN 2 THEN 'extended' ELSE 'read' END AS action,
 CASE WHEN event_id%9=0 THEN 'error' ELSE 'ok' END AS result, CAST(user_id AS VARCHAR) AS sid, 'User ' || user_id || CASE WHEN event_id%2=0 THEN ' A' ELSE ' B' END AS sname FROM events)"""


def log(feed):
    k = c("event_id")
    return feed.events.select(
        (c("user_id") % 10).cast("string").alias("chain_id"), k.alias("seq"), c("ts").cast("timestamp").alias("at"), (c("user_id") % 7).cast("string").alias("course_id"), c("event_type").alias("area"),
        F.when(k % 5 == 0, "posted").when(k % 5 == 1, "opened").when(k % 5 == 2, "extended").otherwise("read").alias("action"), F.when(k % 9 == 0, "error").otherwise("ok").alias("result"),
        F.array(F.struct(c("user_id").cast("string").alias("id"), F.concat(F.lit("User "), c("user_id").cast("string"), F.when(k % 2 == 0, " A").otherwise(" B")).alias("name"))).alias("students"))


@query("log_filter", f"""WITH {LOG} SELECT chain_id, seq, "at", action FROM log WHERE area='view' AND contains(lower(sname), 'user 1') ORDER BY seq DESC, chain_id LIMIT 200""")
def log_filter(feed):
    return audit.log_filter(log(feed), 200, month="2024-01", student="USER 1", area="view").select("chain_id", "seq", "at", "action")


@query("log_newest", f"""WITH {LOG} SELECT chain_id, seq, action FROM log ORDER BY seq DESC, chain_id LIMIT 50""")
def log_newest(feed):
    return audit.log_filter(log(feed), 50).select("chain_id", "seq", "action")


@query("people_seen", f"WITH {LOG} SELECT person, x.name AS name FROM (SELECT sid AS person, min({{'seq': seq, 'name': sname}}) AS x FROM log GROUP BY 1)")
def people_seen(feed):
    return audit.people_seen(log(feed))


@query("writes_today", f"""WITH {LOG} SELECT course_id, count(*) AS writes FROM (SELECT course_id, "at" FROM log WHERE action IN ('posted','extended') AND result='ok' UNION ALL SELECT 'ledger', o_orderdate + INTERVAL 5 HOUR + to_days(8000) FROM orders WHERE false
 UNION ALL SELECT course_id, "at" FROM log WHERE area='purchase') WHERE CAST(timezone('America/Chicago', timezone('UTC', "at")) AS DATE) = DATE '2024-01-10' GROUP BY 1""")
def writes_today(feed):
    rows = log(feed)
    return audit.writes_today(rows, rows.where("area = 'purchase'"), F.lit("2024-01-10").cast("date"), "America/Chicago")


def chained(feed):
    rows = feed.events.select((c("user_id") % 10).cast("string").alias("chain_id"), c("event_id").alias("entry_id"), c("ts").cast("string").alias("at"), c("event_type").alias("action"), c("props").alias("sentence"))
    state = rows.select("chain_id").distinct().select("chain_id", F.lit(0).cast("bigint").alias("seq"), F.lit(audit.GENESIS).alias("hash"))
    return audit.audit_chain(rows, state)


@query("audit_chain", """SELECT chain_id, entry_id, row_number() OVER (PARTITION BY chain_id ORDER BY ts, event_id) AS seq, true AS linked FROM (SELECT CAST(user_id%10 AS VARCHAR) AS chain_id, event_id AS entry_id, event_id, ts FROM events)""")
def audit_chain(feed):
    from gradeloom.staging import stage
    rows = stage(chained(feed))
    before = rows.select("chain_id", (c("seq") + 1).alias("seq"), c("hash").alias("p"))
    return rows.join(before, ["chain_id", "seq"], "left").select("chain_id", "entry_id", "seq", (c("prev") == F.coalesce("p", F.lit(audit.GENESIS))).alias("linked"))


@query("audit_verify", """SELECT chain_id, ch%4=0 AS ok, CAST(CASE ch%4 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE n END AS BIGINT) AS entries, CASE ch%4 WHEN 1 THEN 'edited' WHEN 2 THEN 'removed or inserted' WHEN 3 THEN 'tail removed' END AS why,
 CASE ch%4 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN n END AS seq FROM (SELECT CAST(user_id%10 AS VARCHAR) AS chain_id, user_id%10 AS ch, count(*) AS n FROM events GROUP BY ALL)""")
def audit_verify(feed):
    """Chains of the event stream as day files, three of four damaged in their own way."""
    from gradeloom.staging import stage
    rows = stage(chained(feed))
    ch = c("chain_id").cast("int") % 4
    line = F.when((ch == 1) & (c("seq") == 5), F.regexp_replace("line", '"sentence": "', '"sentence": "x')).otherwise(c("line"))
    kept = rows.where(~((ch == 2) & (c("seq") == 6))).select("chain_id", "seq", day(), line.alias("line"))
    mark = rows.groupBy("chain_id").agg((F.max("seq") + F.when(ch == 3, 2).otherwise(0)).alias("seq"), F.max_by("hash", "seq").alias("hash"))
    return audit.audit_verify(audit.parse_log(audit.read_log(feed.spark, day_files(feed, kept))), mark)


def day():
    return F.substring(F.get_json_object("line", "$.at"), 1, 10).alias("file")


def day_files(feed, rows) -> str:
    """Log rows as one text file per chain and day, a blank and a broken line at the end of each."""
    path = upserts.new_folder(feed.spark, "log")
    junk = rows.select("chain_id", "file").distinct().select("chain_id", F.lit(1 << 60).cast("bigint").alias("seq"), "file", F.explode(F.array(F.lit(""), F.lit("not json"))).alias("line"))
    (rows.unionByName(junk).repartition("chain_id", "file").sortWithinPartitions("chain_id", "file", "seq", "line")
     .select("chain_id", "file", "line").write.partitionBy("chain_id", "file").text(path))
    return path


@query("log_lines", """SELECT chain_id, file, CAST(row_number() OVER (PARTITION BY chain_id, file ORDER BY ts, event_id) - 1 AS BIGINT) AS line, event_id AS entry_id FROM
 (SELECT CAST(user_id%10 AS VARCHAR) AS chain_id, strftime(ts, '%Y-%m-%d') AS file, event_id, ts FROM events)""")
def log_lines(feed):
    """The whole log as day files, split into small blocks, each line with its number."""
    rows = chained(feed).select("chain_id", "seq", day(), "line")
    read = audit.read_log(feed.spark, day_files(feed, rows))
    return read.select("chain_id", "file", "line", F.get_json_object("raw", "$.entry_id").cast("bigint").alias("entry_id"))


@query("canonical_digest", r"""SELECT event_id, sha256('{"event":"' || event_type || '","k":' || regexp_extract(props, '([0-9]+)', 1) || ',"name":"\u00e9t\u00e9"}') AS digest FROM events""")
def canonical_digest(feed):
    raw = F.concat(F.lit('{"name": "été", "k": '), F.regexp_extract("props", r"(\d+)", 1), F.lit(', "hash": "x", "event": "'), "event_type", F.lit('"}'))
    return feed.events.select("event_id", audit.canonical_digest(raw).alias("digest"))
