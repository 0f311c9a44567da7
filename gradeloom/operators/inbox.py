"""Conversations and discussions: who wrote what, to whom, with which files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.html import ANY_TAG, html_to_text, unescape
from gradeloom.functions.text import word_count

EXCERPT = 400
# File kinds by extension.
EXTENSIONS = {"image": "png|jpg|jpeg|gif|webp|bmp", "video": "mp4|webm|mov|m4v", "audio": "mp3|m4a|wav|ogg", "pdf": "pdf"}


def discussion_posts(entries: DataFrame) -> DataFrame:
    """Threaded entries to one row per post or reply, deleted ones left out; a reply carries its
    parent's author and the first 400 characters of it. ``entries``: topic_id, entry_id, user_id,
    message, created_at, deleted, replies array<struct<reply_id,user_id,message,created_at,deleted>>."""
    live = entries.where("user_id IS NOT NULL AND NOT coalesce(deleted, false)").withColumn("text", html_to_text(F.col("message")))
    none = F.lit(None).cast("string")
    posts = live.select("topic_id", F.col("entry_id").alias("post_id"), "user_id", F.lit("post").alias("kind"), none.alias("to_user"), none.alias("to_excerpt"), "text", "created_at")
    replies = live.select("topic_id", F.col("user_id").cast("string").alias("to_user"), F.left("text", F.lit(EXCERPT)).alias("to_excerpt"), F.explode("replies").alias("r")).where(
        "r.user_id IS NOT NULL AND NOT coalesce(r.deleted, false)").select(
        "topic_id", F.col("r.reply_id").alias("post_id"), F.col("r.user_id").alias("user_id"), F.lit("reply").alias("kind"), "to_user", "to_excerpt",
        html_to_text(F.col("r.message")).alias("text"), F.col("r.created_at").alias("created_at"))
    return posts.unionByName(replies).withColumn("words", word_count(F.col("text")))


def discussion_words(posts: DataFrame) -> DataFrame:
    """Per author of a topic: the last post that counts, replies, and all words."""
    own = F.col("kind") == "post"
    return posts.groupBy("topic_id", "user_id").agg(
        F.max_by(F.when(own, F.col("words")), F.when(own, F.struct("created_at", "post_id"))).alias("post_words"),
        F.count_if(~own).alias("replies"), F.sum(F.when(~own, F.col("words")).otherwise(0)).alias("reply_words"))


def file_kind(mime: Column, name: Column, url: Column) -> Column:
    """Image, video, audio, pdf or file, from the type and the extension; vector and page types stay files."""
    mime = F.lower(F.trim(F.get(F.split(F.coalesce(mime, F.lit("")), ";"), F.lit(0))))
    ext_of = lambda c: F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"\?.*$", ""), r"\.([^./]+)$", 1))
    ext = F.coalesce(F.nullif(ext_of(name), F.lit("")), ext_of(url))
    out = F.when(mime.contains("svg") | (ext == "svg") | mime.isin("text/html", "application/xhtml+xml"), "file")
    for kind, exts in EXTENSIONS.items():
        by_mime = mime == "application/pdf" if kind == "pdf" else mime.startswith(f"{kind}/")
        out = out.when(by_mime | ext.rlike(f"^(?:{exts})$"), kind)
    return out.otherwise("file")


def absolute_url(url: Column, base: str) -> Column:
    u = F.trim(unescape(F.coalesce(url, F.lit(""))))
    return (F.when(u.rlike(r"(?i)^(javascript:|data:|blob:)") | (u == ""), F.lit(None)).when(u.startswith("//"), F.concat(F.lit("https:"), u))
            .when(u.startswith("/"), F.concat(F.lit(base.rstrip("/")), u)).when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), u)))


def message_assets(messages: DataFrame, key: str, base: str) -> DataFrame:
    """One row per file on a message: attachments, then the recording, then images and file links in
    the body; the first of each file stays. ``messages``: key, body, attachments
    array<struct<id,name,mime,url>>, media struct<id,name,mime,url>, and where it forwards others ``forwarded``
    array<struct<body,attachments,media>> in their order, whose files follow its own. A recording is known by its media id."""
    own = messages.select(key, F.lit(0).alias("_seq"), "body", "attachments", "media")
    if "forwarded" in messages.columns:
        passed = messages.select(key, F.posexplode("forwarded").alias("_at", "m")).select(key, (F.col("_at") + 1).alias("_seq"), "m.body", "m.attachments", "m.media")
        own = own.unionByName(passed)
    messages = own
    shape = lambda rank, i, ident, name, mime, url, hint, media=None: F.struct(
        F.lit(rank).alias("rank"), i.alias("at"), (F.lit(None).cast("string") if media is None else media).alias("media_id"), ident.alias("ident"), name.alias("name"), mime.alias("mime"), url.alias("raw"), F.lit(hint).alias("hint"))
    blank = F.lit("")
    attached = F.transform(F.filter("attachments", lambda a: a["id"].rlike(r"^\d+$")), lambda a, i: shape(0, i, a["id"], F.coalesce(a["name"], F.lit("file")), F.coalesce(a["mime"], blank), a["url"], ""))
    m = F.col("media")
    media = F.when(m["url"].isNotNull(), F.array(shape(1, F.lit(0), F.lit(None).cast("string"), F.coalesce(m["name"], F.lit("recording")), F.coalesce(m["mime"], blank), m["url"], "",
                                                         F.left(F.regexp_replace(F.coalesce(m["id"], blank), "[^A-Za-z0-9_-]", ""), F.lit(40)))))
    attr = lambda tag, n: F.regexp_extract(tag, rf'(?i)\b{n}\s*=\s*"([^"]*)"', 1)
    images = F.transform(F.regexp_extract_all("body", F.lit(r"(?i)<img\b[^>]*>"), F.lit(0)), lambda t, i: shape(
        2, i, F.lit(None).cast("string"), F.coalesce(F.nullif(attr(t, "alt"), blank), F.lit("image")), blank, attr(t, "src"), "image"))
    links = F.transform(F.filter(F.regexp_extract_all("body", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0)), lambda t: attr(t, "href").rlike(r"/files/\d+")), lambda t, i: shape(
        3, i, F.lit(None).cast("string"), F.coalesce(F.nullif(F.trim(F.regexp_replace(t, ANY_TAG, "")), blank), F.lit("file")), blank, attr(t, "href"), ""))
    none = F.array().cast("array<struct<rank:int,at:int,media_id:string,ident:string,name:string,mime:string,raw:string,hint:string>>")
    rows = messages.select(key, "_seq", F.inline(F.concat(F.coalesce(attached, none), F.coalesce(media, none), images, links)))
    rows = rows.withColumn("url", absolute_url(F.col("raw"), base)).where("url IS NOT NULL")
    fid = F.coalesce("ident", F.nullif(F.regexp_extract("url", r"/files/(\d+)", 1), blank))
    told = F.nullif("media_id", blank)
    ident = F.coalesce(F.concat(F.lit("a-"), fid), F.concat(F.lit("u-"), F.sha2(F.coalesce(F.concat(F.lit("media:"), told), F.col("url")), 256)))
    kind = file_kind(F.col("mime"), F.col("name"), F.col("url"))
    kind = F.when((F.col("hint") == "image") & (kind == "file") & ~F.lower("url").contains("svg"), "image").otherwise(kind)
    rows = rows.select(key, ident.alias("asset"), F.struct("_seq", "rank", "at").alias("o"), F.struct("name", kind.alias("kind"), "url").alias("v"))
    return rows.groupBy(key, "asset").agg(F.min_by("v", "o").alias("v")).select(key, "asset", "v.*")


def thread_course(threads: DataFrame, courses: DataFrame) -> DataFrame:
    """The course of each thread: its context, else its first audience course; and the name to show."""
    code = F.nullif(F.regexp_extract(F.coalesce("context_code", F.lit("")), r"^course_(.+)$", 1), F.lit(""))
    rows = threads.withColumn("course_id", F.coalesce(code, F.get(F.map_keys("audience"), F.lit(0))))
    return rows.join(courses.select("course_id", F.col("name").alias("label")), "course_id", "left").select(
        "thread_id", "course_id", F.coalesce("label", "context_name", F.lit("")).alias("label"))


def thread_tags(threads: DataFrame, course_tags: DataFrame, me: str) -> DataFrame:
    """Each participant's tag: the thread's course, else the one they wear elsewhere, else new.

    ``threads``: thread_id, course_id, participants. ``course_tags``: course_id, user_id, tag.
    """
    people = threads.select("thread_id", "course_id", F.explode("participants").alias("user_id")).where(F.col("user_id") != me)
    here = course_tags.select("course_id", "user_id", F.col("tag").alias("here"))
    known = course_tags.groupBy("user_id").agg(F.min_by("tag", "course_id").alias("elsewhere"))
    rows = people.join(here, ["course_id", "user_id"], "left").join(known, "user_id", "left")
    return rows.select("thread_id", "user_id", F.coalesce("here", "elsewhere").alias("tag"),
                       F.when(F.col("here").isNotNull(), "course").when(F.col("elsewhere").isNotNull(), "elsewhere").otherwise("new").alias("origin"))


def threads_with(threads: DataFrame, people: DataFrame) -> DataFrame:
    """Threads that involve any of the given people."""
    seats = threads.select("thread_id", F.explode("participants").alias("user_id"))
    return threads.join(seats.join(people.select("user_id"), "user_id", "left_semi").select("thread_id").distinct(), "thread_id", "left_semi")
