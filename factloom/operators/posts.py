"""Posts and comments: canonical form, flattening, Markdown, JSON paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMENT_COUNT_PATHS = (
    "$.feedback.comment_rendering_instance.comments.total_count", "$.comment_rendering_instance.comments.total_count",
    "$.feedback.comments.total_count", "$.comments.total_count", "$.comment_count",
)


def first_path(json: Column, *paths: str) -> Column:
    """The value at the first path that has one; null if none does or the text is no JSON."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def comment_count(json: Column, paths: tuple[str, ...] = COMMENT_COUNT_PATHS) -> Column:
    """The comment count at the first of several places, else 0."""
    return F.coalesce(first_path(json, *paths).try_cast("bigint"), F.lit(0))


def canonical(df: DataFrame) -> DataFrame:
    """Raw posts (post_id, page_name, group_name, text, message, created_time, permalink, media, photos, videos, image_urls,
    comment_count, comments) to the canonical form. Media keep their order, each address once."""
    pick = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit(""))
    none = F.array().cast("array<string>")
    of_kind = lambda kind: F.transform(F.filter(F.coalesce("media", F.array().cast("array<struct<type:string,url:string>>")), lambda m: (m["type"] == kind) & (m["url"] != "")), lambda m: m["url"])
    filled = lambda c: F.filter(F.coalesce(F.col(c), none), lambda u: u != "")
    return df.select(
        F.coalesce("post_id", F.lit("")).alias("post_id"), pick("page_name", "group_name").alias("source"),
        F.split(F.coalesce("created_time", F.lit("")), " ")[0].alias("post_date"), F.coalesce(F.nullif("permalink", F.lit("")), F.lit("")).alias("post_url"),
        pick("text", "message").alias("post_text"), F.array_distinct(F.concat(of_kind("photo"), filled("photos"), filled("image_urls"))).alias("image_urls"),
        F.array_distinct(F.concat(of_kind("video"), filled("videos"))).alias("video_urls"),
        F.coalesce("comment_count", F.size(F.coalesce("comments", F.array().cast(df.schema["comments"].dataType))).cast("long")).alias("comment_count"), "comments",
    )


def flat_rows(posts: DataFrame) -> DataFrame:
    """One row per comment and reply of canonical posts, one empty row for a post without any."""
    rows = posts.select(*[c for c in posts.columns if c != "comments"], F.explode_outer("comments").alias("c"))
    own = F.struct(F.coalesce(F.col("c.text"), F.lit("")).alias("text"), F.coalesce(F.col("c.reaction_count"), F.lit("")).alias("reactions"), F.lit(False).alias("reply"), F.lit("").alias("parent"))
    parent = F.coalesce(F.col("c.text"), F.lit(""))
    replies = F.transform(
        F.coalesce(F.col("c.replies"), F.array().cast("array<struct<text:string,reaction_count:string>>")),
        lambda r: F.struct(F.coalesce(r["text"], F.lit("")).alias("text"), F.coalesce(r["reaction_count"], F.lit("")).alias("reactions"), F.lit(True).alias("reply"), parent.alias("parent")),
    )
    out = rows.withColumn("r", F.explode(F.concat(F.array(own), replies)))
    keep = [F.array_join(c, "; ").alias(c) if c in ("image_urls", "video_urls") else F.col(c) for c in posts.columns if c != "comments"]
    return out.select(*keep, F.col("r.text").alias("comment_text"), F.col("r.reactions").alias("comment_reactions"), F.col("r.reply").alias("is_reply"), F.col("r.parent").alias("parent_comment"))


def nested(comments: DataFrame) -> DataFrame:
    """(post_id, comments) of comment rows (comment_key, post_id, comment_text, comment_reactions, is_reply, parent_comment).

    Comments stand in the order of their keys, replies under the first comment of their post that has their parent's text; a reply without such
    a comment stands as a comment. A post's comments become one array, as its document holds them all.
    """
    reply = F.coalesce("is_reply", F.lit(False))
    heads = comments.where(~reply).groupBy("post_id", F.col("comment_text").alias("parent")).agg(F.min("comment_key").alias("head"))
    replies = comments.where(reply).join(heads, (comments["post_id"] == heads["post_id"]) & comments["parent_comment"].eqNullSafe(heads["parent"]), "left").select(comments["*"], "head")
    under = replies.where("head is not null").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("comment_key", F.col("comment_text").alias("text"), F.col("comment_reactions").alias("reaction_count")))).alias("r"))
    alone = replies.where("head is null").drop("head")
    rows = comments.where(~reply).unionByName(alone).join(under, F.col("comment_key") == F.col("head"), "left")
    none = F.array().cast("array<struct<text:string,reaction_count:string>>")
    listed = F.coalesce(F.transform("r", lambda x: F.struct(x["text"].alias("text"), x["reaction_count"].alias("reaction_count"))), none)
    one = F.struct("comment_key", F.col("comment_text").alias("text"), F.col("comment_reactions").alias("reaction_count"), listed.alias("replies"))
    found = rows.groupBy("post_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return found.select("post_id", F.transform("c", lambda x: F.struct(x["text"].alias("text"), x["reaction_count"].alias("reaction_count"), x["replies"].alias("replies"))).alias("comments"))


def joined_rows(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """``flat_rows`` for comments that stand in rows of their own: each comment and reply beside its post, one empty row for a post without any.

    A join keeps a post with very many comments out of a single array. Reply rows keep their parent's text; missing texts and counts are empty.
    """
    own = comments.select("post_id", "comment_text", "comment_reactions", "is_reply", F.when(F.col("is_reply"), F.col("parent_comment")).alias("parent_comment"))
    filled = {c: F.coalesce(c, F.lit("")) for c in ("comment_text", "comment_reactions", "parent_comment")} | {"is_reply": F.coalesce("is_reply", F.lit(False))}
    joined = [F.array_join(c, "; ").alias(c) if c in ("image_urls", "video_urls") else F.col(c) for c in posts.columns if c != "comments"]
    return posts.select(*joined).join(own, "post_id", "left").withColumns(filled)


def markdown(posts: DataFrame) -> DataFrame:
    """(post_id, md): canonical posts as Markdown documents."""
    line = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f"**{label}:** "), F.col(c), F.lit("\n")))
    link = F.when(F.col("post_url") != "", F.concat(F.lit("**URL:** <"), "post_url", F.lit(">\n")))
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"**{label}:**\n"), F.array_join(F.transform(c, lambda u: F.concat(F.lit("- "), u)), "\n"), F.lit("\n")))
    comments = F.coalesce("comments", F.array().cast(posts.schema["comments"].dataType))

    def comment(c: Column, i: Column) -> Column:
        head = F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), F.coalesce(c["text"], F.lit("")), F.lit("\n*Reactions: "), F.coalesce(c["reaction_count"], F.lit("0")), F.lit("*"))
        replies = F.array_join(F.transform(c["replies"], lambda r: F.concat(F.lit("- "), F.coalesce(r["text"], F.lit("")), F.lit(" *(Reactions: "), F.coalesce(r["reaction_count"], F.lit("0")), F.lit(")*"))), "\n")
        return F.concat(head, F.when(F.size(c["replies"]) > 0, F.concat(F.lit("\n\n**Replies:**\n"), replies)).otherwise(""), F.lit("\n"))

    body = F.concat_ws(
        "\n", F.concat(F.lit("# Post "), "post_id", F.lit("\n")), line("Source", "source"), line("Date", "post_date"), link,
        F.concat(F.lit("**Content:**\n\n"), F.when(F.col("post_text") != "", F.col("post_text")).otherwise("(no text)"), F.lit("\n")),
        listed("Images", "image_urls"), listed("Videos", "video_urls"),
        F.concat(F.lit("---\n## Comments ("), F.size(comments).cast("string"), F.lit(")\n")), F.when(F.size(comments) > 0, F.array_join(F.transform(comments, comment), "\n")),
    )
    return posts.select("post_id", body.alias("md"))


def without_private(entries: Column) -> Column:
    """A map without the keys that begin with an underscore."""
    return F.map_filter(entries, lambda k, v: ~k.startswith("_"))
