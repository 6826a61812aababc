"""Feed responses: JSON lines and nested nodes to rows of posts and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.posts import first_path

_COMMENT = "array<struct<node:struct<body:struct<text:string>,feedback:struct<reactors:struct<count_reduced:string>>>>>"


def first_line(response: Column) -> Column:
    """The first line of a response, without a loop guard in front."""
    return F.regexp_replace(F.split(response, "\n")[0], r"^for \(;;\);", "")


def without_keys(response: Column, keys: tuple[str, ...] = ("errors", "extensions")) -> Column:
    """A JSON object without some keys, as a map of texts; null for anything that is no object."""
    return F.map_filter(F.from_json(response, "map<string,string>"), lambda k, v: ~k.isin(*keys))


def story_nodes(response: Column) -> Column:
    """Story nodes as JSON texts from the three shapes of a response: timeline edges, group edges, a single story."""
    edges = F.coalesce(F.get_json_object(response, "$.data.node.timeline_list_feed_units.edges"), F.get_json_object(response, "$.data.node.group_feed.edges"))
    listed = F.transform(F.from_json(edges, "array<map<string,string>>"), lambda e: e["node"])
    single = F.when(F.get_json_object(response, "$.data.node.__typename") == "Story", F.array(F.get_json_object(response, "$.data.node")))
    return F.filter(F.coalesce(listed, single, F.array().cast("array<string>")), lambda n: n.isNotNull())


def post_rows(responses: DataFrame, column: str) -> DataFrame:
    """(post_id, text, author, created, permalink, comment_count) of the stories in responses; stories without id give none."""
    node = responses.select(F.explode(story_nodes(F.col(column))).alias("n"))
    get = lambda *p: first_path(F.col("n"), *p)
    return node.select(
        get("$.post_id").alias("post_id"), F.coalesce(get("$.message.text", "$.comet_sections.content.story.message.text"), F.lit("")).alias("text"),
        get("$.actors[0].name", "$.owning_profile.name", "$.feedback.owning_profile.name").alias("author"),
        get("$.creation_time", "$.metadata[0].creation_time", "$.metadata[1].creation_time").try_cast("bigint").alias("created"),
        get("$.permalink_url", "$.url").alias("permalink"), F.coalesce(get("$.feedback.comments.total_count", "$.comment_count").try_cast("bigint"), F.lit(0)).alias("comment_count"),
    ).where("post_id is not null")


def media_of(node: Column) -> Column:
    """array of struct(type, url) of a node's attachments and their sub-attachments."""
    item = T.StructType([T.StructField("__typename", T.StringType()), T.StructField("url", T.StringType())])
    one = T.StructType([T.StructField("media", item), T.StructField("subattachments", T.ArrayType(T.StructType([T.StructField("media", item)])))])
    attached = F.coalesce(F.from_json(F.get_json_object(node, "$.attachments"), T.ArrayType(one)), F.array().cast(T.ArrayType(one)))
    flat = F.flatten(F.transform(attached, lambda a: F.concat(F.array(a["media"]), F.transform(F.coalesce(a["subattachments"], F.array().cast(one["subattachments"].dataType)), lambda s: s["media"]))))
    return F.transform(F.filter(flat, lambda m: m["url"].isNotNull()), lambda m: F.struct(F.when(m["__typename"] == "Video", "video").otherwise("photo").alias("type"), m["url"].alias("url")))


def has_video(node: Column) -> Column:
    """Whether a post is a reel or holds a video."""
    return F.exists(media_of(node), lambda m: m["type"] == "video") | F.lower(F.coalesce(F.get_json_object(node, "$.attachments"), F.lit(""))).contains("reel")


def comments_of(response: Column) -> Column:
    """array of struct(text, reaction_count) of a comment response; missing texts are empty, missing counts "0"."""
    edges = F.from_json(F.get_json_object(response, "$.data.node.comments.edges"), _COMMENT)
    return F.transform(F.coalesce(edges, F.array().cast(_COMMENT)), lambda e: F.struct(
        F.coalesce(e["node"]["body"]["text"], F.lit("")).alias("text"), F.coalesce(e["node"]["feedback"]["reactors"]["count_reduced"], F.lit("0")).alias("reaction_count")))


def open_metadata(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and a map ``metadata`` of all other columns as texts, nulls left out."""
    rest = [c for c in df.columns if c not in keep]
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in rest])) if rest else F.create_map().cast("map<string,string>")
    return df.select(*keep, F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("metadata"))


def walk(edges: DataFrame, source: str, target: str, start: DataFrame, most: int = 50) -> DataFrame:
    """(start, step, node): follow one link after another from each start, at most ``most`` steps; a node seen before ends the walk.

    ``start`` has a column ``start``. Each step is one join; the walk stops when no start has a next node.
    """
    from factloom.storage import materialize

    links = edges.select(F.col(source).alias("at"), F.col(target).alias("next")).where("next is not null").groupBy("at").agg(F.min("next").alias("next"))
    now = materialize(start.select("start", F.col("start").alias("at"), F.array("start").alias("seen")), "walk")
    out = now.select("start", F.lit(0).alias("step"), F.col("at").alias("node"))
    for step in range(1, most + 1):
        moved = now.join(links, "at").where(~F.array_contains("seen", F.col("next"))).select("start", F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen"))
        now = materialize(moved, "walk")
        if now.isEmpty():
            break
        out = out.unionByName(now.select("start", F.lit(step).alias("step"), F.col("at").alias("node")))
    return out
