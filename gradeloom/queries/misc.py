"""Inbox, file, text and build-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import files, inbox, overlap, prose
from gradeloom.plans import changes
from gradeloom.queries.registry import query
from gradeloom.sources import snapshots
from gradeloom.staging import shared_folder, stage


def c(n):
    return F.col(n)


def st(n):
    return F.col(n).cast("string")


# --------------------------------------------------------------------- inbox
POSTS = """posts AS (SELECT conv_id AS topic_id, conv_id || '-' || turn AS post_id, role AS user_id, CASE WHEN turn=0 THEN 'post' ELSE 'reply' END AS kind, turn, text FROM conversations WHERE turn=0 OR (turn%5<>4 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn=0 AND conv_id%11=0)
  AND conv_id IN (SELECT conv_id FROM conversations WHERE turn=0)))"""


def posts(feed):
    turn = feed.conversations
    head = turn.where("turn = 0").select("conv_id", c("role").alias("user_id"), "text")
    reply = F.struct(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), c("role").alias("user_id"), c("text").alias("message"), F.timestamp_seconds("turn").alias("created_at"), (c("turn") % 5 == 4).alias("deleted"))
    replies = turn.where("turn > 0").groupBy("conv_id").agg(F.collect_list(reply).alias("replies"))
    entries = head.join(replies, "conv_id", "left").select(
        c("conv_id").alias("topic_id"), F.concat(st("conv_id"), F.lit("-0")).alias("entry_id"), "user_id", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("message"),
        F.timestamp_seconds(F.lit(0)).alias("created_at"), (c("conv_id") % 11 == 0).alias("deleted"), "replies")
    return inbox.discussion_posts(entries)


@query("discussion_posts", f"""WITH {POSTS} SELECT topic_id, post_id, user_id, kind FROM posts WHERE NOT (kind='post' AND topic_id%11=0)""")
def discussion_posts(feed):
    return posts(feed).select("topic_id", "post_id", "user_id", "kind")


@query("discussion_words", f"""WITH {POSTS}, w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x<>'')) AS n FROM posts WHERE NOT (kind='post' AND topic_id%11=0))
 SELECT topic_id, user_id, max(n) FILTER (WHERE kind='post') AS post_words, count(*) FILTER (WHERE kind='reply') AS replies, CAST(coalesce(sum(n) FILTER (WHERE kind='reply'),0) AS BIGINT) AS reply_words FROM w GROUP BY ALL""")
def discussion_words(feed):
    return inbox.discussion_words(posts(feed))


@query("message_assets", """SELECT conv_id, turn, x.asset, x.name, x.kind FROM (SELECT conv_id, turn, unnest(list_concat(CASE WHEN turn%2=0 THEN [{'asset':'a-7','name':'notes.PDF','kind':'pdf'}] ELSE [] END, CASE WHEN turn%3=0 THEN [{'asset':'a-9','name':'clip','kind':'video'}] ELSE [] END,
  [{'asset':'a-8','name':'a view','kind':'image'}], CASE WHEN turn%2=0 THEN [] ELSE [{'asset':'a-7','name':'again','kind':'file'}] END)) AS x FROM conversations)""")
def message_assets(feed):
    att = lambda i, n, m, u: F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(m).alias("mime"), F.lit(u).alias("url"))
    attached = F.when(c("turn") % 2 == 0, F.array(att("7", "notes.PDF", "", "/files/7/download"), att("x", "bad", "", "/b")))
    msgs = feed.conversations.select(
        "conv_id", "turn", F.concat("text", F.lit('<img src="/files/8/v.png" alt="a view"><img src="data:x"><a href="/files/7">again</a><a href="/page">no</a>')).alias("body"),
        F.coalesce(attached, F.slice(F.array(att("7", "", "", "")), 1, 0)).alias("attachments"), F.when(c("turn") % 3 == 0, att("m", "clip", "video/mp4", "//cdn.example.com/files/9")).alias("media"))
    keyed = msgs.withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    out = inbox.message_assets(keyed, "key", "https://lms.example.com")
    return out.join(keyed.select("key", "conv_id", "turn").distinct(), "key").select("conv_id", "turn", "asset", "name", "kind")


@query("forwarded_assets", """SELECT conv_id, turn, x.asset, x.name, x.kind FROM (SELECT conv_id, turn, unnest(list_concat([{'asset':'a-8','name':'a view','kind':'image'}],
 CASE WHEN turn%2=0 THEN [{'asset':'a-5','name':'plan.docx','kind':'file'}] ELSE [] END, CASE WHEN turn%3=0 THEN [{'asset':'u-' || sha256('media:m-' || turn),'name':'recording','kind':'audio'}] ELSE [] END)) AS x FROM conversations)""")
def forwarded_assets(feed):
    """Messages that forward two others: what these hold comes after their own, each file once, a recording by its media id."""
    shape = "array<struct<id:string,name:string,mime:string,url:string>>"
    media = F.when(c("turn") % 3 == 0, F.struct(F.concat(F.lit("m-!"), st("turn")).alias("id"), F.lit(None).cast("string").alias("name"), F.lit("audio/mp4").alias("mime"), F.concat(F.lit("//cdn.example.com/v/"), st("conv_id")).alias("url")))
    plan = F.struct(F.lit("5").alias("id"), F.lit("plan.docx").alias("name"), F.lit("").alias("mime"), F.lit("/files/5").alias("url"))
    files_ = F.when(c("turn") % 2 == 0, F.array(plan)).cast(shape)
    inner = lambda body, attached, m: F.struct(body.alias("body"), attached.alias("attachments"), m.alias("media"))
    none = F.lit(None)
    kind = "struct<id:string,name:string,mime:string,url:string>"
    msgs = feed.conversations.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("key"), F.concat("text", F.lit('<img src="/files/8/v.png" alt="a view">')).alias("body"),
                                     none.cast(shape).alias("attachments"), none.cast(kind).alias("media"),
                                     F.array(inner(F.lit('<a href="/files/8">old</a>'), files_, media.cast(kind)), inner(F.lit("x"), files_, media.cast(kind))).alias("forwarded"))
    out = inbox.message_assets(msgs, "key", "https://lms.example.com")
    return out.join(msgs.select("key", "conv_id", "turn").distinct(), "key").select("conv_id", "turn", "asset", "name", "kind")


def threads(feed):
    k = c("c_custkey")
    return feed.customer.select(
        k.alias("thread_id"), F.when(k % 3 == 0, F.concat(F.lit("course_"), (k % 25).cast("string"))).otherwise("").alias("context_code"), F.lit("District").alias("context_name"),
        F.when(k % 3 == 1, F.create_map(st("c_nationkey"), F.lit("Student"))).alias("audience"),
        F.when(k % 3 == 0, (k % 25).cast("string")).when(k % 3 == 1, st("c_nationkey")).alias("course_id"), F.array(k.cast("string"), (k + 1).cast("string"), F.lit("me")).alias("participants"))


THREADS = """threads AS (SELECT c_custkey AS thread_id, CASE c_custkey%3 WHEN 0 THEN CAST(c_custkey%25 AS VARCHAR) WHEN 1 THEN CAST(c_nationkey AS VARCHAR) END AS course_id, c_custkey FROM customer)"""


@query("thread_course", f"WITH {THREADS} SELECT thread_id, course_id, coalesce(n_name, 'District') AS label FROM threads LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR)=course_id")
def thread_course(feed):
    return inbox.thread_course(threads(feed).drop("course_id"), feed.nation.select(st("n_nationkey").alias("course_id"), c("n_name").alias("name")))


@query("thread_tags", f"""WITH {THREADS}, t AS (SELECT CAST(c_nationkey AS VARCHAR) AS course_id, CAST(c_custkey AS VARCHAR) AS user_id, 'Student-' || c_custkey AS tag FROM customer WHERE c_custkey%4<>0)
 SELECT p.thread_id, p.user_id, t.tag, CASE WHEN t.tag IS NULL THEN 'new' WHEN t.course_id=p.course_id THEN 'course' ELSE 'elsewhere' END AS origin FROM (SELECT thread_id, course_id, CAST(unnest([c_custkey, c_custkey+1]) AS VARCHAR) AS user_id FROM threads) p LEFT JOIN t USING (user_id)""")
def thread_tags(feed):
    worn = feed.customer.where("c_custkey % 4 <> 0").select(st("c_nationkey").alias("course_id"), st("c_custkey").alias("user_id"), F.concat(F.lit("Student-"), st("c_custkey")).alias("tag"))
    return inbox.thread_tags(threads(feed), worn, "me")


@query("threads_with", "SELECT c_custkey AS thread_id FROM customer WHERE c_custkey%10 IN (0, 9)")
def threads_with(feed):
    return inbox.threads_with(threads(feed), feed.customer.select((c("c_custkey") * 10).cast("string").alias("user_id"))).select("thread_id")


# --------------------------------------------------------------------- files
LANE = """CASE WHEN l_returnflag='N' THEN CASE WHEN l_linenumber IN (1,2) THEN 'refused' ELSE 'queued' END WHEN l_linestatus='O' AND l_returnflag='R' THEN 'review' WHEN l_linenumber=7 THEN 'light' ELSE 'full' END"""


def lane():
    status = F.when(c("l_returnflag") == "N", "fallback").when((c("l_linestatus") == "O") & (c("l_returnflag") == "R"), "review").otherwise("ok")
    actions = F.when(c("l_linenumber") == 7, F.array(F.lit("tags kept"), F.lit("metadata-only"))).otherwise(F.array(F.lit("tagged")))
    was = F.when(c("l_linenumber") == 1, "encrypted").when(c("l_linenumber") == 2, "signed").otherwise("text-untagged")
    return files.file_lane(status, actions, was)


@query("file_lane", f"SELECT {LANE} AS lane, count(*) AS n FROM lineitem GROUP BY 1")
def file_lane(feed):
    return feed.lineitem.groupBy(lane().alias("lane")).agg(F.count(F.lit(1)).alias("n"))


RULES = ("7.1-3 metadata stream", "7.2-10 table row", "font not embedded 7.21.4", "6.7 xmp", "unknown thing")


@query("rule_census", f"""WITH r AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber AS file_id, {LANE} AS lane, CAST(l_quantity AS INT)%5 AS q, CAST(l_quantity AS INT)%3 AS p FROM lineitem),
 x AS (SELECT DISTINCT file_id, lane, unnest([{list(RULES)!r}[q+1], {list(RULES)!r}[p+1]]) AS rule FROM r),
 n AS (SELECT rule, lane, count(DISTINCT file_id) AS n FROM x GROUP BY ALL)
 SELECT rule, CAST(sum(n) AS BIGINT) AS files, list_sort(list({{'lane': lane, 'n': n}})) AS lanes, CASE WHEN contains(rule,'embedded') THEN 'source re-export' WHEN contains(rule,'table') OR contains(rule,'unknown') THEN 'semantic' ELSE 'mechanical' END AS kind FROM n GROUP BY rule""")
def rule_census(feed):
    rules = F.array(*[F.lit(r) for r in RULES])
    q = c("l_quantity").cast("int")
    rows = feed.lineitem.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("file_id"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("name"), lane().alias("lane"),
                                F.array(F.element_at(rules, q % 5 + 1), F.element_at(rules, q % 3 + 1), F.element_at(rules, q % 5 + 1)).alias("failed_rules"))
    return files.rule_census(rows).select("rule", "files", "lanes", "kind")


@query("queue_groups", """SELECT l_returnflag AS lane, CASE l_linenumber%3 WHEN 0 THEN 'encrypted PDF' WHEN 1 THEN 'bad table' ELSE 'no reason recorded' END AS head, count(*) AS count, CASE WHEN max(CASE WHEN l_quantity>49 THEN 1 ELSE 0 END)=1 THEN 'error' ELSE 'review' END AS severity FROM lineitem GROUP BY ALL""")
def queue_groups(feed):
    n = c("l_linenumber") % 3
    reason = F.when(n == 0, F.concat(F.lit("encrypted PDF - needs "), st("l_partkey"))).when(n == 1, F.concat(F.lit("bad table: row ("), st("l_partkey"))).otherwise("")
    rows = feed.lineitem.select(c("l_returnflag").alias("lane"), reason.alias("reason"), F.when(c("l_quantity") > 49, "error").otherwise("review").alias("severity"))
    return files.queue_groups(rows, ["lane"])


@query("file_triage", """SELECT *, CASE class WHEN 'scanned-image' THEN 3 WHEN 'text-untagged' THEN 2 WHEN 'encrypted' THEN 2 WHEN 'empty/odd' THEN 1 WHEN 'tagged' THEN 0 ELSE 1 END AS severity FROM (SELECT p_partkey AS file_id, coalesce(n,0) AS pages, coalesce(t,0) AS text_pages, coalesce(i,0) AS image_pages, CASE WHEN p_size=1 THEN 'encrypted' WHEN p_size%13=3 THEN 'signed' WHEN n>0 AND t<0.5*n AND i>0 THEN 'scanned-image' WHEN coalesce(t,0)=0 AND coalesce(i,0)=0 THEN 'empty/odd' WHEN p_size%2=0 THEN 'tagged' ELSE 'text-untagged' END AS class
 FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_quantity>25) AS t, count(*) FILTER (WHERE l_discount>0.05::DOUBLE) AS i FROM lineitem GROUP BY 1) ON l_partkey=p_partkey)""")
def file_triage(feed):
    pages = feed.lineitem.select(c("l_partkey").alias("file_id"), (c("l_quantity") > 25).alias("has_text"), (c("l_discount") > 0.05).alias("has_image"))
    facts = feed.part.select(c("p_partkey").alias("file_id"), (c("p_size") == 1).alias("encrypted"), (c("p_size") % 2 == 0).alias("tagged"),
                             (c("p_size") % 13 == 3).alias("signed"))
    return files.file_triage(pages, facts).select("file_id", "pages", "text_pages", "image_pages", "class", "severity")


def figures(feed):
    k = c("page_id")
    return feed.pages.select((k % 20).cast("string").alias("course_id"), (k % 50).alias("file_id"), (k % 7).cast("string").alias("hash"), F.when(k % 6 != 0, F.lit("a.png")).alias("path"), (k % 2 == 0).alias("needs_alt"), (k % 4 == 0).alias("described"),
                             F.when(k % 5 == 0, "photo_1.jpg").when(k % 5 == 1, "Picture 3").when(k % 5 == 2, "").otherwise("A chart of results by year").alias("alt"))


@query("alt_census", """SELECT CAST(page_id%20 AS VARCHAR) AS course_id, count(*) FILTER (WHERE page_id%2=0) AS needs_alt, count(DISTINCT CASE WHEN page_id%2=0 THEN page_id%7 END) AS unique_pictures, count(*) FILTER (WHERE page_id%4=0) AS described, count(*) FILTER (WHERE page_id%6=0) AS no_picture,
 count(*) FILTER (WHERE page_id%5<2) AS useless_alt, count(*) FILTER (WHERE page_id%4=2) AS waiting FROM pages GROUP BY 1""")
def alt_census(feed):
    return files.alt_census(figures(feed), ["course_id"])


@query("image_reuse", "SELECT CAST(page_id%20 AS VARCHAR) AS course_id, CAST(page_id%7 AS VARCHAR) AS hash, count(*) AS places, count(DISTINCT page_id%50) AS files FROM pages GROUP BY ALL")
def image_reuse(feed):
    return files.image_reuse(figures(feed), ["course_id"])


STATE = """states AS (SELECT CAST(l_partkey%97 AS VARCHAR) AS course_id, CASE l_returnflag WHEN 'N' THEN 'pptx' WHEN 'A' THEN 'docx' ELSE 'pdf' END AS kind, CASE WHEN l_quantity>48 THEN 'unsupported' WHEN l_linenumber=7 THEN 'not fetched' WHEN l_returnflag='R' THEN CASE WHEN l_linestatus='F' THEN 'triaged' ELSE 'not scanned' END
  WHEN l_linestatus<>'F' THEN 'not scanned' WHEN l_linenumber=1 THEN 'pushed' WHEN l_linenumber=2 THEN 'scanned' WHEN l_linenumber=3 THEN CASE WHEN l_tax>0.04::DOUBLE THEN 'verified' ELSE 'failed' END ELSE 'fixes ready' END AS state, CAST(l_discount*100 AS INT) AS issues FROM lineitem)"""


def states(feed):
    n = c("l_linenumber")
    kind = F.when(c("l_returnflag") == "N", "pptx").when(c("l_returnflag") == "A", "docx").otherwise("pdf")
    row = {"legacy": c("l_quantity") > 48, "fetched": n != 7, "report_only": kind == "pdf", "scanned": c("l_linestatus") == "F", "unreadable": F.lit(False), "has_fixes": n != 2,
           "fixes_sha": F.lit("s"), "push_sha": F.when(n.isin(1, 2), "s").otherwise("old"), "verify_sha": F.when(n == 3, "s"), "verify_ok": c("l_tax") > 0.04}
    return feed.lineitem.select((c("l_partkey") % 97).cast("string").alias("course_id"), kind.alias("kind"), files.item_state(row).alias("state"), F.round(c("l_discount") * 100).cast("int").alias("issues"))


@query("item_state", f"WITH {STATE} SELECT kind, state, count(*) AS n FROM states GROUP BY ALL")
def item_state(feed):
    return states(feed).groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


SURVEY = f"""WITH {STATE} SELECT course_id, kind, count(*) AS files, count(*) FILTER (WHERE state NOT IN ('not fetched','not scanned')) AS scanned, CAST(sum(issues) AS BIGINT) AS issues, count(*) FILTER (WHERE state='unsupported') AS needs_person,
 count(*) FILTER (WHERE state IN ('fixes ready','verified')) AS ready, count(*) FILTER (WHERE state='pushed') AS uploaded FROM states GROUP BY ALL"""


@query("file_survey", SURVEY)
def file_survey(feed):
    return files.file_survey(states(feed))


@query("survey_totals", f"SELECT kind, CAST(sum(files) AS BIGINT) AS files, CAST(sum(scanned) AS BIGINT) AS scanned, CAST(sum(issues) AS BIGINT) AS issues, CAST(sum(needs_person) AS BIGINT) AS needs_person, CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(uploaded) AS BIGINT) AS uploaded FROM ({SURVEY}) GROUP BY 1")
def survey_totals(feed):
    return files.survey_totals(files.file_survey(states(feed)))


# ---------------------------------------------------------------------- text
@query("kwic", r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, hits[i] AS term, length(hits[i]) AS chars FROM (SELECT doc_id, hits, unnest(range(1, len(hits)+1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?i)licen[sc]e\w*|the of') AS hits FROM documents))""")
def kwic(feed):
    return files.kwic(feed.documents, ["doc_id"], "text", r"licen[sc]e\w*|the of").select("doc_id", "n", "term", F.length("term").alias("chars"))


@query("replace_map", """SELECT doc_id, length(replace(replace(text, 'License', 'Licence'), 'the', 'THE&')) AS chars, len(regexp_extract_all(replace(replace(text, 'License', 'Licence'), 'the', 'THE&'), '(?i)license')) + len(regexp_extract_all(replace(replace(text, 'License', 'Licence'), 'the', 'THE&'), '(?i)the')) AS residual FROM documents""")
def replace_map(feed):
    return files.replace_map(feed.documents, ["doc_id"], "text", {"License": "Licence", "the": "THE&"}).select("doc_id", F.length("text").alias("chars"), "residual")


@query("text_survival", r"""WITH w AS (SELECT doc_id, w FROM (SELECT doc_id, regexp_replace(unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: NOT starts_with(x, '/'))), '[^\pL\pN]', '', 'g') AS w FROM documents) WHERE w<>''),
 k AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, regexp_replace(unnest(list_filter(regexp_split_to_array(replace(text, ' the ', ' '), '\s+'), lambda x: NOT starts_with(x, '/'))), '[^\pL\pN]', '', 'g') AS w FROM documents))
 SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE k.w IS NULL) AS missing, round(1.0::DOUBLE - count(*) FILTER (WHERE k.w IS NULL)/count(*), 4) AS share, 1.0::DOUBLE - count(*) FILTER (WHERE k.w IS NULL)/count(*) >= 0.98 AS ok FROM w LEFT JOIN k USING (doc_id, w) GROUP BY doc_id""")
def text_survival(feed):
    new = feed.documents.select("doc_id", F.replace("text", F.lit(" the "), F.lit(" ")).alias("text"))
    return files.text_survival(feed.documents, new, "doc_id")


@query("word_diff", r"""WITH a AS (SELECT page_id, w AS word, count(*) AS a FROM (SELECT page_id, unnest(regexp_extract_all(lower(vis), '[a-z0-9]+')) AS w FROM texts) GROUP BY ALL),
 b AS (SELECT page_id, w AS word, count(*) AS b FROM (SELECT page_id, unnest(regexp_extract_all(lower(replace(vis, ' the ', ' one two ')), '[a-z0-9]+')) AS w FROM texts) GROUP BY ALL),
 d AS (SELECT page_id, CASE WHEN coalesce(a,0)>coalesce(b,0) THEN 'lost' ELSE 'gained' END AS side, word, abs(coalesce(a,0)-coalesce(b,0)) AS count FROM a FULL JOIN b USING (page_id, word) WHERE coalesce(a,0)<>coalesce(b,0))
 SELECT page_id, side, word, count, place, total FROM (SELECT *, row_number() OVER (PARTITION BY page_id, side ORDER BY count DESC, word) AS place, CAST(sum(count) OVER (PARTITION BY page_id, side) AS BIGINT) AS total FROM d) WHERE place<=30""", "bodies texts")
def word_diff(feed):
    from gradeloom.functions.html import visible_text
    old = stage(feed.bodies.select("page_id", visible_text(c("html")).alias("html")))
    return files.word_diff(old, old.select("page_id", F.replace("html", F.lit(" the "), F.lit(" one two ")).alias("html")), "page_id")


@query("policy_passages")
def policy_passages(feed):
    return prose.policy_passages(feed.documents, ["doc_id"], "text", r"\blicen[sc]e\b")


@query("student_prose", "SELECT doc_id, CASE doc_id%3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || chr(10) || 'end' ELSE '' END AS prose FROM documents")
def student_prose(feed):
    part = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    parts = F.when(c("doc_id") % 3 == 1, F.array(part("text", c("text")), part("blend", F.lit("scene")), part("text", F.lit(" ")), part("text", F.lit("end")))).when(
        c("doc_id") % 3 == 2, F.array(part("binary", F.lit("x"))))
    return feed.documents.select("doc_id", overlap.student_prose(parts, c("text")).alias("prose"))


SAID = ("I was really confused about this part.", "The rubric was vague and hard to follow.", "We ran out of time at the end.", "Should I hand in the file again?", "I could not find the video.", "My laptop crashed and does not open it.", "It is a fine day today.")


def voices(feed):
    said = F.array(*[F.lit(x) for x in SAID])
    line = lambda n: F.element_at(said, (c("conv_id") * n % 7 + 1).cast("int"))
    rows = feed.conversations.select("conv_id", "turn", F.lit("submission").alias("source"), F.concat(F.regexp_replace("text", "[?]", "."), F.lit("\n"), line(1), F.lit(" "), line(3), F.lit(" "), line(1)).alias("text"))
    return prose.voice_items(rows.where("role = 'user'") if "role" in rows.columns else rows, ["conv_id", "turn"], "text", "source")


CATS = "['confusion','instructions','time','question','missed_resource','technical',NULL]"
VOICE = f"""v AS (SELECT conv_id, turn, i, {CATS}[conv_id*i%7+1] AS category, {list(SAID)!r}[conv_id*i%7+1] AS sentence FROM conversations, (VALUES (1), (3)) t(i) WHERE NOT (i=3 AND conv_id*3%7=conv_id%7))"""


@query("voice_cue", f"WITH {VOICE} SELECT conv_id, turn, category, sentence FROM v WHERE category IS NOT NULL")
def voice_cue(feed):
    return voices(feed).select("conv_id", "turn", "category", "sentence")


@query("student_voice", f"""WITH {VOICE}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS n, row_number() OVER (PARTITION BY conv_id, category ORDER BY turn, i) AS m FROM v WHERE category IS NOT NULL)
 SELECT category, count(*) AS count, count(DISTINCT conv_id) AS students FROM k WHERE n<=2 OR m=1 GROUP BY 1""")
def student_voice(feed):
    kept = prose.student_voice(voices(feed), ["conv_id"], ["turn", "pos"])
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("conv_id").alias("students"))


# -------------------------------------------------------------------- checks
def outcomes(feed):
    leaves = feed.customer.where("c_custkey % 10 <> 9").select(st("c_nationkey").alias("course_id"), st("c_custkey").alias("leaf_id"))
    items = feed.supplier.select(st("s_nationkey").alias("course_id"), st("s_suppkey").alias("item_id"))
    k = c("c_custkey")
    verdict = F.element_at(F.array(*[F.lit(v) for v in (*changes.VERDICTS, "maybe")]), (k % 5 + 1).cast("int"))
    rows = feed.customer.where("c_custkey % 10 <> 8").select(st("c_nationkey").alias("course_id"), F.when(k % 20 == 7, F.lit("dup")).otherwise(st("c_custkey")).alias("slo"), verdict.alias("verdict"),
                                                           F.when(k % 5 == 0, F.array(F.lit("nowhere"))).when(k % 5 == 2, F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>")).alias("evidence"), F.when(k % 4 != 0, "because").alias("rationale"), F.when(k % 3 == 0, "add one").alias("suggestion"))
    return leaves, items, rows


OUT = """l AS (SELECT CAST(c_nationkey AS VARCHAR) AS course_id, CAST(c_custkey AS VARCHAR) AS slo FROM customer WHERE c_custkey%10<>9),
 a AS (SELECT CAST(c_nationkey AS VARCHAR) AS course_id, CASE WHEN c_custkey%20=7 THEN 'dup' ELSE CAST(c_custkey AS VARCHAR) END AS slo, c_custkey AS k FROM customer WHERE c_custkey%10<>8)"""


@query("outcome_alignment_check", f"""WITH {OUT} SELECT course_id, slo, level, rule, count(*) AS n FROM (
 SELECT course_id, slo, 'error' AS level, 'omitted' AS rule FROM l WHERE (course_id, slo) NOT IN (SELECT (course_id, slo) FROM a) UNION ALL SELECT course_id, slo, 'error', 'invented' FROM a WHERE (course_id, slo) NOT IN (SELECT (course_id, slo) FROM l)
 UNION ALL SELECT course_id, slo, 'error', 'duplicate' FROM a GROUP BY ALL HAVING count(*)>1 UNION ALL SELECT course_id, slo, 'error', 'unknown verdict' FROM a WHERE k%5=4 UNION ALL SELECT course_id, slo, 'error', 'covered without evidence' FROM a WHERE k%5=1
 UNION ALL SELECT course_id, slo, 'warning', 'evidence on a gap' FROM a WHERE k%5=2 UNION ALL SELECT course_id, slo, 'warning', 'gap without a suggestion' FROM a WHERE k%5 IN (2,3) AND k%3<>0 UNION ALL SELECT course_id, slo, 'warning', 'no reason given' FROM a WHERE k%4=0
 UNION ALL SELECT DISTINCT course_id, slo, 'error', 'stray evidence' FROM a WHERE k%5 IN (0,2)) GROUP BY ALL""")
def outcome_alignment_check(feed):
    return changes.outcome_alignment_check(*outcomes(feed)).groupBy("course_id", "slo", "level", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("alignment_coverage", f"""WITH {OUT} SELECT *, not_assessed+ungraded_only AS gaps, round(100.0*(assessed+0.5*partially_assessed)/mapped,1) AS coverage FROM (SELECT course_id, count(*) AS mapped, count(*) FILTER (WHERE k%5=0) AS assessed, count(*) FILTER (WHERE k%5=1) AS partially_assessed,
 count(*) FILTER (WHERE k%5=2) AS not_assessed, count(*) FILTER (WHERE k%5=3) AS ungraded_only FROM a GROUP BY 1)""")
def alignment_coverage(feed):
    return changes.alignment_coverage(outcomes(feed)[2])


@query("content_inventory", """SELECT course_id, type, count(*) AS items, count(*) FILTER (WHERE graded) AS graded FROM (SELECT CAST(p_partkey%97 AS VARCHAR) AS course_id, 'assignment' AS type, p_size%2=0 AS graded FROM part WHERE p_type<>'PROMO' UNION ALL
 SELECT CAST(p_partkey%97 AS VARCHAR), 'quiz', true FROM part WHERE p_type='PROMO' UNION ALL SELECT CAST(page_id%97 AS VARCHAR), 'page', false FROM pages) GROUP BY ALL""")
def content_inventory(feed):
    part = feed.part.select((c("p_partkey") % 97).cast("string").alias("course_id"), c("p_partkey").alias("item_id"), c("p_name").alias("name"), c("p_size").alias("points"), (c("p_size") % 2 == 0).alias("graded"), "p_type")
    pages = feed.pages.select((c("page_id") % 97).cast("string").alias("course_id"), c("page_id").alias("item_id"), c("url").alias("name"), F.lit(None).cast("double").alias("points"), F.lit(False).alias("graded"))
    inv = changes.content_inventory({"assignment": part.where("p_type <> 'PROMO'"), "quiz": part.where("p_type = 'PROMO'").withColumn("graded", F.lit(True)), "page": pages})
    return changes.inventory_counts(inv)


@query("slo_leaves", """SELECT course_code, leaf_id, text FROM (SELECT course_code, unnest([{'leaf_id':'1.a','text':'Name ' || p || ' and more words'}, {'leaf_id':'1.b.1','text':'Draw'}, {'leaf_id':'1.b.2','text':'Cut'}, {'leaf_id':'2','text':'Plan ' || p}], recursive := true) FROM
 (SELECT 'AB ' || (1000 + p_partkey) AS course_code, p_name AS p FROM part))""")
def slo_leaves(feed):
    lines = F.concat(F.array(F.lit("The student will:"), F.lit("1. Basics"), F.lit("a. Name")), F.array(c("p_name"), F.lit("and more words"), F.lit("b."), F.lit("Make"), F.lit("(1) Draw"), F.lit("(2) Cut"), F.lit("2. ")), F.array(F.concat(F.lit("Plan "), c("p_name"))))
    full = feed.part.select(F.concat(F.lit("AB "), (c("p_partkey") + 1000).cast("string")).alias("course_code"), F.lit(2).alias("block_id"), F.posexplode(lines).alias("pos", "line"))
    thin = full.where("pos < 2").withColumn("block_id", F.lit(1))
    return changes.slo_leaves(full.unionByName(thin))


@query("manifest_check", """WITH e AS (SELECT CAST(p_partkey%97 AS VARCHAR) AS build_id, p_partkey AS k, CASE WHEN p_size%10=0 THEN 'Bad Slug' ELSE 'p-' || p_partkey//194 END AS key, p_size FROM part)
 SELECT build_id, rule, count(*) AS n FROM (SELECT build_id, 'bad slug' AS rule FROM e WHERE p_size%10=0 UNION ALL SELECT build_id, 'no body' FROM e WHERE p_size%7=0 UNION ALL SELECT build_id, 'key twice' FROM e GROUP BY build_id, key HAVING count(*)>1
 UNION ALL SELECT build_id, 'more than one front page' FROM e WHERE p_size=3 GROUP BY build_id HAVING count(*)>1 UNION ALL SELECT build_id, 'points nowhere' FROM (SELECT CAST(s_suppkey%97 AS VARCHAR) AS build_id, 'p-' || s_suppkey AS key FROM supplier WHERE s_suppkey%4<>0) s
  WHERE (build_id, key) NOT IN (SELECT (build_id, key) FROM e) UNION ALL SELECT CAST(s_suppkey%97 AS VARCHAR), 'unknown item type' FROM supplier WHERE s_suppkey%8=0 UNION ALL SELECT CAST(s_suppkey%97 AS VARCHAR), 'subheader without a title' FROM supplier WHERE s_suppkey%8=4) GROUP BY ALL""")
def manifest_check(feed):
    k = c("p_partkey")
    entries = feed.part.select((k % 97).cast("string").alias("build_id"), F.lit("pages").alias("kind"), F.when(c("p_size") % 10 == 0, "Bad Slug").otherwise(F.concat(F.lit("p-"), F.floor(k / 194).cast("string"))).alias("key"), c("p_name").alias("title"),
                               (c("p_size") % 7 != 0).alias("has_body"), F.lit(1.0).alias("points"), (c("p_size") == 3).alias("front_page"))
    n = c("s_suppkey")
    items = feed.supplier.select((n % 97).cast("string").alias("build_id"), c("s_name").alias("module"), F.when(n % 8 == 0, "Hologram").when(n % 8 == 4, "SubHeader").otherwise("Page").alias("type"), F.concat(F.lit("p-"), n.cast("string")).alias("target"), F.lit("").alias("title"))
    return changes.manifest_check(entries, items).groupBy("build_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_plan", """SELECT p_partkey, CASE WHEN p_size%9=0 THEN 'skip' WHEN p_size%11=0 THEN 'skip' WHEN p_partkey%2=0 THEN 'update' ELSE 'create' END AS action, CASE WHEN p_size%9=0 THEN 'no title' WHEN p_size%11=0 THEN 'no criteria' END AS reason,
 list_filter([CASE WHEN p_size%4=0 THEN 'Depth: top rating is not the points' END, CASE WHEN p_size%6=0 THEN 'Form: no ratings' END], lambda x: x IS NOT NULL) AS warnings FROM part""")
def upsert_plan(feed):
    size = c("p_size")
    crit = lambda n, r: F.struct(F.lit(n).alias("label"), F.lit(10.0).alias("points"), r.alias("ratings"))
    some = F.array(F.lit(5.0), F.lit(10.0))
    desired = feed.part.select("p_partkey", "p_size", "p_brand", F.when(size % 9 == 0, " ").otherwise(F.concat(F.lit(" R "), st("p_partkey"), F.lit(" "))).alias("title"),
                               F.array(crit("Depth", F.when(size % 4 == 0, F.array(F.lit(5.0))).otherwise(some)), crit("Form", F.when(size % 6 == 0, F.array().cast("array<double>")).otherwise(some))).alias("criteria"))
    existing = feed.part.where("p_partkey % 2 = 0").select("p_brand", F.concat(F.lit("R "), st("p_partkey")).alias("title"), c("p_partkey").alias("id"))
    plan = changes.upsert_plan(desired, existing, "p_brand", "title", F.when(size % 11 == 0, "no criteria"))
    return plan.select("p_partkey", "action", "reason", changes.rubric_warnings(c("criteria")).alias("warnings"))


TABS = ("home", "modules", "grades", "people", "pages", "settings")


@query("keep_list_plan", """SELECT CAST(s_suppkey AS VARCHAR) AS course_id, tab_id, position, CASE WHEN tab_id='settings' THEN 'leave' WHEN tab_id='home' THEN 'keep' WHEN pos IS NOT NULL THEN CASE WHEN hidden THEN 'show' WHEN position<>pos THEN 'order' ELSE 'keep' END WHEN hidden THEN 'keep hidden' ELSE 'hide' END AS action,
 CASE WHEN tab_id='home' THEN 1 ELSE CAST(pos AS INT) END AS position_after FROM (SELECT *, CASE tab_id WHEN 'grades' THEN 2 WHEN 'modules' THEN 3 END AS pos, (s_suppkey+i)%3=0 AS hidden, CASE WHEN s_suppkey%2=0 THEN i ELSE 7-i END AS position
 FROM supplier, (VALUES ('home',1),('modules',2),('grades',3),('people',4),('pages',5),('settings',6)) t(tab_id,i))""")
def keep_list_plan(feed):
    tabs = F.array(*[F.struct(F.lit(t).alias("tab_id"), F.lit(i).alias("i")) for i, t in enumerate(TABS, 1)])
    rows = feed.supplier.select(st("s_suppkey").alias("course_id"), "s_suppkey", F.inline(tabs)).select(
        "course_id", "tab_id", F.when(c("s_suppkey") % 2 == 0, c("i")).otherwise(7 - c("i")).alias("position"), ((c("s_suppkey") + c("i")) % 3 == 0).alias("hidden"))
    return changes.keep_list_plan(rows, ["grades", "modules", "not_here"])


@query("import_delta", """WITH s AS (SELECT p_brand AS course_id, p_type AS kind, count(*) AS n FROM part GROUP BY ALL) SELECT i.import_id, s.kind, coalesce(d.n,0) AS has, s.n AS adds, coalesce(d.n,0)+s.n AS after,
 EXISTS (SELECT 1 FROM s x WHERE x.course_id=i.dest_id AND x.kind IN ('PROMO','SMALL')) AND i.import_id%3<>0 AND i.import_id%5<>0 AS refused FROM (SELECT s_suppkey AS import_id, 'Brand#' || (s_suppkey%25+1) AS source_id, 'Brand#' || (s_suppkey%40+1) AS dest_id FROM supplier) i JOIN s ON s.course_id=i.source_id LEFT JOIN s d ON d.course_id=i.dest_id AND d.kind=s.kind""")
def import_delta(feed):
    items = feed.part.select(c("p_brand").alias("course_id"), c("p_type").alias("kind"))
    k = c("s_suppkey")
    pairs = feed.supplier.select(k.alias("import_id"), F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("source_id"), F.concat(F.lit("Brand#"), (k % 40 + 1).cast("string")).alias("dest_id"), (k % 3 == 0).alias("owned"), (k % 5 == 0).alias("force"))
    return changes.import_delta(items, items, pairs, ["PROMO", "SMALL"])


@query("settings_diff", """SELECT p_partkey AS quiz_id, field, CASE WHEN field='time_limit' THEN CAST(p_size AS VARCHAR) WHEN field='due_at' THEN '2026-09-10' END AS "from", CASE field WHEN 'time_limit' THEN '30' WHEN 'due_at' THEN '2026-09-20' WHEN 'cant_go_back' THEN 'true' ELSE '1' END AS "to",
 CASE WHEN field='due_at' AND p_size%2=0 THEN 'due after it locks' WHEN field='cant_go_back' AND p_size%3<>0 THEN 'needs one question at a time' WHEN field='shoe_size' THEN 'not a setting' END AS reject FROM part, (VALUES ('time_limit'),('due_at'),('cant_go_back'),('shoe_size')) t(field) WHERE NOT (field='time_limit' AND p_size=30)""")
def settings_diff(feed):
    size = c("p_size")
    current = feed.part.select(c("p_partkey").alias("quiz_id"), size.alias("time_limit"), F.lit("2026-09-10").alias("due_at"), F.when(size % 2 == 0, "2026-09-15").alias("lock_at"), F.lit(None).cast("string").alias("unlock_at"),
                               F.when(size % 3 == 0, "true").alias("one_question_at_a_time"), F.lit(None).cast("string").alias("cant_go_back"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in (("time_limit", "30"), ("due_at", "2026-09-20"), ("cant_go_back", "true"), ("shoe_size", "1"))])
    return changes.settings_diff(feed.part.select(c("p_partkey").alias("quiz_id"), F.inline(rows)), current, "quiz_id", ["time_limit", "due_at", "lock_at", "unlock_at", "one_question_at_a_time", "cant_go_back"])


@query("op_validate", """SELECT o_orderkey AS op_id, op, CASE WHEN op='erase' THEN 'unknown operation' WHEN op='announce' THEN CASE WHEN o_orderkey%200>=97 THEN 'course is not yours' WHEN o_orderkey%3=0 THEN 'no title or message' END WHEN p_partkey IS NULL THEN 'not in the schedule'
 WHEN o_orderkey%200<>p_partkey%97 THEN 'other course' WHEN op='publish' THEN CASE WHEN p_size%2=0 THEN 'already published' END WHEN o_orderstatus='P' THEN 'no usable date' END AS reject FROM (SELECT *, ['set_dates','publish','announce','erase'][o_orderkey%4+1] AS op FROM orders) LEFT JOIN part ON p_partkey=o_custkey*3""")
def op_validate(feed):
    k = c("o_orderkey")
    ops = feed.orders.select(k.alias("op_id"), F.element_at(F.array(*[F.lit(x) for x in ("set_dates", "publish", "announce", "erase")]), (k % 4 + 1).cast("int")).alias("op"), (k % 200).cast("string").alias("course_id"), (c("o_custkey") * 3).cast("string").alias("assignment_id"),
                             F.when(k % 3 != 0, "News").alias("title"), F.lit("text").alias("message"), F.when(c("o_orderstatus") != "P", "2026-09-01T10:00:00").otherwise("soon").alias("due_at"))
    items = feed.part.select((c("p_partkey") % 97).cast("string").alias("course_id"), st("p_partkey").alias("assignment_id"), (c("p_size") % 2 == 0).alias("published"))
    return changes.op_validate(ops, items, items.select("course_id"))


@query("slot_verify", """SELECT page_id, kind, CASE WHEN page_id%9=0 THEN ['empty body'] WHEN kind='page' AND page_id%4=1 THEN ['not one h2'] WHEN kind='page' AND page_id%4=2 THEN ['hero does not match'] ELSE [] END AS problems,
 CASE WHEN page_id%9=0 OR (kind='page' AND page_id%4 IN (1,2)) THEN 'fail' WHEN kind<>'page' AND page_id%4=1 THEN 'warn' ELSE 'ok' END AS state FROM (SELECT page_id, CASE WHEN page_id%2=0 OR page_id%3=0 THEN 'page' ELSE 'assignment' END AS kind FROM pages)""")
def slot_verify(feed):
    k = c("page_id")
    n = st("page_id")
    body = F.when(k % 9 == 0, "<p>&nbsp;</p>").when(k % 4 == 1, "<h2>Week</h2><h2>Two</h2>").when(k % 4 == 2, "<h2>Other thing</h2>").otherwise(F.concat(F.lit("<h2>Welcome to Week "), n, F.lit("</h2><h3>a</h3><p>text</p>")))
    rows = feed.pages.select("page_id", F.when((k % 2 == 0) | (k % 3 == 0), "page").otherwise("assignment").alias("kind"), F.concat(F.lit("Week "), n).alias("title"), body.alias("html"))
    return changes.slot_verify(rows, "page_id")


@query("slot_verify_pages")
def slot_verify_pages(feed):
    """The pages themselves, whole, under their own titles; ``slot_verify`` has planted bodies, as its SQL has them."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return changes.slot_verify(feed.pages.select("page_id", F.lit("page").alias("kind"), title.alias("title"), "html"), "page_id")


# ------------------------------------------------------------------- sources
@query("read_snapshot", """SELECT CAST(l_partkey AS VARCHAR) AS assignment_id, count(*) AS n, sum(l_quantity) AS score, count(*) FILTER (WHERE l_returnflag='R') AS late FROM lineitem GROUP BY 1""")
def read_snapshot(feed):
    """Line items landed as JSON under course folders, then read back with the declared schema."""
    import uuid
    path = f"{shared_folder(feed.spark)}/snapshot-{uuid.uuid4().hex}"
    feed.lineitem.select(st("l_partkey").alias("assignment_id"), st("l_suppkey").alias("user_id"), F.lit("graded").alias("workflow_state"), c("l_shipdate").alias("submitted_at"), (c("l_returnflag") == "R").alias("late"), F.lit(0).alias("seconds_late"),
                         c("l_quantity").alias("score"), c("l_returnflag").alias("course_id")).write.partitionBy("course_id").json(path)
    rows = snapshots.read_snapshot(feed.spark, path)
    return rows.groupBy("assignment_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.count_if("late").alias("late"))


@query("read_log", "SELECT event_type AS area, count(*) AS n, (SELECT count(*) FROM events WHERE event_id%10=0) AS bad FROM events WHERE event_id%10<>0 GROUP BY 1")
def read_log(feed):
    import uuid
    path = f"{shared_folder(feed.spark)}/log-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(c("ts").alias("at"), c("event_type").alias("area"), F.lit("posted").alias("action"), c("props").alias("detail")))
    feed.events.select(F.when(c("event_id") % 10 == 0, "{broken").otherwise(line)).write.text(path)
    good, bad = snapshots.read_log(feed.spark, path)
    return good.groupBy("area").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(bad.agg(F.sum("bad_lines").alias("bad"))))


@query("append_log", "SELECT strftime(ts, '%Y-%m') AS month, event_type AS area, count(*) AS n FROM events GROUP BY ALL")
def append_log(feed):
    import uuid
    path = f"{shared_folder(feed.spark)}/ledger-{uuid.uuid4().hex}"
    rows = feed.events.select(c("ts").alias("at"), c("event_type").alias("area"), "event_id")
    for part in (0, 1):
        snapshots.append_log(rows.where(c("event_id") % 2 == part), path)
    return feed.spark.read.parquet(path).groupBy(c("month").cast("string").alias("month"), "area").agg(F.count(F.lit(1)).alias("n"))
