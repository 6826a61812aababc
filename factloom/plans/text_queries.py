"""Queries of the text, URL, label, time and evidence functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import clock, labels, text, urls
from factloom.operators import evidence, html, kb, search
from factloom.plans.registry import query
from factloom.sources.tables import table

AS_OF = "2026-01-01 00:00:00"
_WS = text.BLANK


def _sql_list(words: tuple) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(rf"""SELECT sample_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{_WS}]', '', 'g'), '[{_WS}]+', ' ', 'g')) AS normalized FROM labeled_claims""")
def t1_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labeled_claims").select("sample_id", text.normalize(F.col("text")).alias("normalized"))


@query(rf"""SELECT social_key, trim(regexp_replace(coalesce(post_text, ''), '[{_WS}]+', ' ', 'g')) AS flat FROM social_posts""")
def t2_collapse_blank(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "social_posts").select("social_key", text.collapse_blank(F.col("post_text")).alias("flat"))


@query("""WITH t AS (SELECT sample_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(coalesce(evidence, '')), '[a-z0-9]+')) AS d FROM labeled_claims)
SELECT sample_id, round(CASE WHEN len(q) = 0 OR len(d) = 0 THEN 0 ELSE len(list_intersect(q, d)) / len(q) END, 6) AS ratio FROM t""")
def t4_token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labeled_claims").select("sample_id", F.round(text.overlap_ratio(F.col("text"), F.col("evidence")), 6).alias("ratio"))


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[{_WS}]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, length(s) >= 1200 OR len(regexp_extract_all(lower(s), '[a-z0-9]+')) >= 200 AS verbatim FROM t""")
def t5_verbatim_flags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.is_verbatim(F.col("text")).alias("verbatim"))


@query("SELECT doc_id, CASE WHEN length(title) > 40 THEN substr(title, 1, 39) || '…' ELSE title END AS short FROM documents")
def t6_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("title"), 40).alias("short"))


@query(r"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS t FROM documents)""")
def t8_word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_CASES = " || ".join(f"CASE WHEN contains(lower(text), '{t}') THEN ' {' '.join(s[:2])}' ELSE '' END" for t, s in text.GLOSSARY)


@query(f"SELECT sample_id, text || {_CASES} AS expanded FROM labeled_claims")
def t9_expand_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labeled_claims").select("sample_id", text.expand_query(F.col("text")).alias("expanded"))


@query(rf"""SELECT social_key, CASE WHEN length(post_text) > 0 THEN trim(regexp_replace(regexp_replace(post_text, '{text.ICONS}', '', 'g'), '[{_WS}]+', ' ', 'g')) ELSE post_text END AS clean FROM social_posts""")
def t10_strip_icons(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "social_posts").select("social_key", text.strip_icons(F.col("post_text")).alias("clean"))


@query(r"""WITH t AS (SELECT DISTINCT source, trim(regexp_replace(coalesce(source, ''), '[^\p{L}\p{N} _-]', '', 'g')) AS c FROM feed_sources)
SELECT source, substr(CASE WHEN c = '' THEN 'unknown' ELSE c END, 1, 80) AS name FROM t""")
def t11_safe_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "feed_sources").select("source").distinct().select("source", text.safe_name(F.col("source")).alias("name"))


@query("""WITH t AS (SELECT post_key, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS h, replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/', '_') AS p FROM web_posts)
SELECT post_key, CASE WHEN p = '' THEN 'post' ELSE right(p, 60) END AS slug, regexp_replace(trim(lower(regexp_replace(regexp_replace(h, '^.*@', ''), ':.*$', ''))), '^www\\.', '') AS domain, regexp_replace(url, '#.*$', '') AS bare FROM t""".replace("\\\\", "\\"))
def t12_url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "web_posts").select("post_key", urls.slug(u).alias("slug"), urls.domain(urls.host(u)).alias("domain"), urls.without_fragment(u).alias("bare"))


@query(r"""WITH t AS (SELECT post_key, lower(regexp_extract(source, '://([^/]*)', 1)) AS a, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS b FROM web_posts), u AS (SELECT post_key, regexp_replace(a, '^www\.', '') AS a, regexp_replace(b, '^www\.', '') AS b FROM t)
SELECT post_key, a <> '' AND b <> '' AND (a = b OR ends_with(b, '.' || a)) AS same FROM u""")
def t14_same_domain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "web_posts").select("post_key", urls.same_domain(urls.host(F.col("source")), urls.host(F.col("url"))).alias("same"))


def _any(column: str, test: str, parts: tuple) -> str:
    return "(" + " OR ".join(f"{test}({column}, '{x}')" for x in parts) + ")"


@query(rf"""WITH t AS (SELECT post_key, title, lower(url) AS u, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS p FROM web_posts)
SELECT post_key, CASE WHEN p = '' OR p = '/' OR {_any("p", "ends_with", urls.STATIC_ENDINGS)} OR {_any("u", "contains", urls.BLOCKED_HINTS)} THEN 0 ELSE
 (CASE WHEN regexp_matches(u, '(?:^|[/-])20\d{{2}}(?:[/-]|$)') THEN 2 ELSE 0 END) + (CASE WHEN {_any("p", "ends_with", urls.ARTICLE_ENDINGS)} THEN 2 ELSE 0 END)
 + (CASE WHEN {_any("u", "contains", urls.ARTICLE_HINTS)} THEN 1 ELSE 0 END) + (CASE WHEN length(p) - length(replace(p, '/', '')) >= 2 THEN 1 ELSE 0 END)
 + (CASE WHEN length(coalesce(title, '')) >= 20 THEN 1 ELSE 0 END) END AS points FROM t""")
def t18_article_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "web_posts").select("post_key", urls.article_score(F.col("url"), F.col("title")).alias("points"))


@query(r"""SELECT post_key, unnest([url, CASE WHEN regexp_matches(url, '^[A-Za-z]+://www\.') THEN regexp_replace(url, '^([A-Za-z]+://)www\.', '\1') ELSE regexp_replace(url, '^([A-Za-z]+://)', '\1www.') END]) AS variant FROM web_posts""")
def t19_url_variants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "web_posts").select("post_key", F.explode(urls.variants(F.col("url"))).alias("variant"))


@query(f"SELECT post_key, {_any('lower(content)', 'contains', urls.BOT_WALL)} AND length(content) < 2500 AS walled FROM web_posts")
def t22_bot_wall(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "web_posts").select("post_key", urls.behind_bot_wall(F.col("content")).alias("walled"))


@query(r"""WITH t AS (SELECT post_key, regexp_extract(date_raw, '(\d{4})[/-](\d{1,2})[/-](\d{1,2})', ['y', 'm', 'd']) AS i, regexp_extract(date_raw, '(\d{1,2})[/-](\d{1,2})[/-](\d{4})', ['a', 'b', 'y']) AS f, regexp_extract(date_raw, 'tháng\s+(\d{1,2})\s+năm\s+(\d{4})', ['m', 'y']) AS w FROM web_posts),
u AS (SELECT post_key, try_cast(i.y || '-' || lpad(i.m, 2, '0') || '-' || lpad(i.d, 2, '0') AS date) AS x,
 CASE WHEN try_cast(f.a AS int) > 12 THEN try_cast(f.y || '-' || lpad(f.b, 2, '0') || '-' || lpad(f.a, 2, '0') AS date) ELSE try_cast(f.y || '-' || lpad(f.a, 2, '0') || '-' || lpad(f.b, 2, '0') AS date) END AS y,
 try_cast(w.y || '-' || lpad(w.m, 2, '0') || '-01' AS date) AS z FROM t)
SELECT post_key, CAST(coalesce(x, y, z) AS varchar) AS day FROM u""")
def t26_element_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "web_posts").select("post_key", clock.element_date(F.col("date_raw")).cast("string").alias("day"))


_PIECES = r"""string_split(replace(regexp_replace(regexp_replace(regexp_replace(content, '(^|[^\p{L}\p{N}_])(\p{Lu})\.', '\1\2' || chr(3), 'g'), '(^|[^\p{L}\p{N}_])(\p{Lu})\.', '\1\2' || chr(3), 'g'), '([.!?])\s+', '\1' || chr(2), 'g'), chr(3), '.'), chr(2))"""


@query(rf"""WITH p AS (SELECT post_key, url, title, content, list_filter({_PIECES}, lambda s: trim(s) <> '') AS l FROM web_posts WHERE content IS NOT NULL),
c AS (SELECT post_key, url, title, CASE WHEN length(content) <= 1500 THEN CASE WHEN trim(content) = '' THEN [] ELSE [content] END
 ELSE string_split(list_reduce(l, lambda a, s: CASE WHEN length(split_part(a, chr(1), -1)) + length(s) + 1 <= 1500 THEN a || ' ' || s ELSE a || chr(1) || s END), chr(1)) END AS c FROM p),
u AS (SELECT post_key, url, title, unnest(c) AS piece, generate_subscripts(c, 1) - 1 AS chunk_no FROM c)
SELECT post_key, chunk_no, md5(coalesce(url, '') || '_' || chunk_no) AS chunk_id, concat_ws(' ', nullif(title, ''), piece) AS content FROM u""")
def t28_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.chunks(table(spark, sf, "web_posts"), "post_key", F.col("url"), F.col("title"), F.col("content"))


@query(r"""SELECT sample_id, coalesce(CASE WHEN trim(evidence) LIKE '[%]' THEN array_to_string(try_cast(trim(evidence) AS varchar[]), '|||') END, trim(evidence), '') AS joined FROM labeled_claims""")
def t31_evidence_literal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labeled_claims").select("sample_id", evidence.joined_evidence(F.col("evidence")).alias("joined"))


@query(r"""WITH p AS (SELECT sample_id, list_filter(list_transform(coalesce(CASE WHEN trim(evidence) LIKE '[%]' THEN try_cast(trim(evidence) AS varchar[]) END, regexp_split_to_array(evidence, '\n+|\.  ')), lambda s: trim(s)), lambda s: length(s) >= 10) AS l FROM labeled_claims WHERE evidence IS NOT NULL)
SELECT sample_id, array_to_string(list_filter(l, lambda s, i: list_position(list_transform(l, lambda z: lower(z)), lower(s)) = i), chr(10)) AS statements FROM p""")
def t32_evidence_list(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "labeled_claims").where("evidence is not null")
    return evidence.with_evidence_list(own, "evidence", "s").select("sample_id", F.array_join("s", "\n").alias("statements"))


@query(r"""WITH r AS (SELECT sample_id, unnest(CASE WHEN contains(evidence, '|||') THEN string_split(evidence, '|||') ELSE string_split(evidence, chr(10)) END) AS raw, generate_subscripts(CASE WHEN contains(evidence, '|||') THEN string_split(evidence, '|||') ELSE string_split(evidence, chr(10)) END, 1) AS pos FROM labeled_claims WHERE evidence IS NOT NULL),
c AS (SELECT *, trim(raw) AS item, CASE WHEN trim(raw) <> '' THEN length(trim(raw)) ELSE 0 END AS cost FROM r),
u AS (SELECT *, sum(cost) OVER (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM c)
SELECT sample_id, coalesce(string_agg(CASE WHEN item <> '' AND used <= 400 THEN pos || '. ' || item || chr(10) END, '' ORDER BY pos), '') AS evidence, count(CASE WHEN item <> '' AND used <= 400 THEN 1 END) AS n_items FROM u GROUP BY sample_id""")
def t34_evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "labeled_claims").where("evidence is not null")
    return evidence.budgeted(own, "sample_id", evidence.evidence_items(F.col("evidence")), 400, F.length("item"))


@query("SELECT doc_id, coalesce('[Thời gian của thông tin: ' || strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC] ' || title, title) AS line FROM documents")
def t35_timed_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", evidence.timed(F.col("title"), F.col("published_at")).alias("line"))


_PROMPT_SQL = "'" + text.PROMPT.replace("'", "''").replace("{claim}", "' || coalesce(text, '') || '").replace("{evidence}", "' || coalesce(evidence, '') || '") + "'"


@query(f"SELECT sample_id, {_PROMPT_SQL} AS prompt FROM labeled_claims")
def t36_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labeled_claims").select("sample_id", text.prompt(F.col("text"), F.col("evidence")).alias("prompt"))


@query("""SELECT sample_id, json_extract_string(nullif(regexp_extract(regexp_replace(r, '(?s)<think>.*?</think>', '', 'g'), '(?s)(\\{.*\\})', 1), ''), '$.claim') AS claim
FROM (SELECT sample_id, '<think>{"claim": 0}</think> Reply: {"claim": "' || replace(replace(label, '\\', ''), '"', '') || '", "n": 1} done' AS r FROM labeled_claims)""")
def t39_reply_json(spark: SparkSession, sf: str) -> DataFrame:
    label = F.replace(F.replace(F.col("label"), F.lit("\\"), F.lit("")), F.lit('"'), F.lit(""))
    reply = F.concat(F.lit('<think>{"claim": 0}</think> Reply: {"claim": "'), label, F.lit('", "n": 1} done'))
    return table(spark, sf, "labeled_claims").select("sample_id", F.get_json_object(text.reply_json(reply), "$.claim").alias("claim"))


@query("SELECT social_key, base64(encode('feedback:' || post_id)) AS feedback_id FROM social_posts")
def t40_feedback_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "social_posts").select("social_key", text.feedback_id(F.col("post_id")).alias("feedback_id"))


@query(r"""WITH u AS (SELECT social_key, 'https://s.example/groups/' || post_id || '/posts/' || post_id AS g, post_url FROM social_posts)
SELECT social_key, nullif(regexp_extract(g, '/groups/(\d+)', 1), '') AS group_id, nullif(regexp_extract(g, '/posts/(?:[^/]+/)?(\d+)', 1), '') AS post, CASE WHEN post_url LIKE '%/groups/%' OR post_url LIKE '%/group/%' THEN 'group' ELSE 'page' END AS kind FROM u""")
def t41_ids_from_url(spark: SparkSession, sf: str) -> DataFrame:
    g = F.concat(F.lit("https://s.example/groups/"), "post_id", F.lit("/posts/"), "post_id")
    kind = F.coalesce(urls.feed_kind(F.col("post_url")), F.lit("page"))
    return table(spark, sf, "social_posts").select("social_key", urls.group_id(g).alias("group_id"), urls.post_id(g).alias("post"), kind.alias("kind"))


@query(r"""WITH t AS (SELECT post_key, url, lower(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g')) AS h FROM web_posts)
SELECT post_key, CASE WHEN h <> '' THEN regexp_replace(h, '^www\.', '') ELSE substr(url, 1, 40) || '...' END AS shown FROM t""")
def t42_display_host(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "web_posts").select("post_key", urls.display_host(F.col("url")).alias("shown"))


@query("SELECT post_key, coalesce(nullif(trim(title), ''), nullif(trim(content), ''), '') AS picked FROM web_posts")
def t44_first_filled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "web_posts").select("post_key", text.first_filled(F.col("title"), F.col("content")).alias("picked"))


@query(rf"""WITH t AS (SELECT sample_id, regexp_replace(trim(timestamp_raw), 'Z', '+00:00', 'g') AS t FROM labeled_claims)
SELECT sample_id, CAST(epoch_ms(coalesce(
 CASE WHEN regexp_matches(t, '^\d{{4}}-\d{{2}}-\d{{2}}([ T]\d{{2}}(:\d{{2}}(:\d{{2}}(\.\d{{1,6}})?)?)?([+-]\d{{2}}:?\d{{2}})?)?$') THEN
  try_cast((CASE WHEN length(t) = 10 THEN t || ' 00:00:00' WHEN regexp_matches(t, '^.{{11}}\d{{2}}:\d{{2}}([+-].*)?$') THEN regexp_replace(t, '^(.{{11}}\d{{2}}:\d{{2}})', '\1:00') ELSE t END) || (CASE WHEN regexp_matches(t, '[+-]\d{{2}}:?\d{{2}}$') AND length(t) > 12 THEN '' ELSE '+00:00' END) AS timestamptz) END,
 CASE WHEN regexp_matches(t, '^\d{{8}}$') THEN try_strptime(t || ' +0000', '%Y%m%d %z') END,
 CASE WHEN regexp_matches(t, '^[+-]?\d+(\.\d*)?$') AND NOT regexp_matches(t, '^\d{{8}}$') AND abs(try_cast(t AS double)) < 2.5e11 THEN to_timestamp(try_cast(t AS double)) END,
 TIMESTAMPTZ '{AS_OF}+00:00')) // 1000 AS bigint) AS seconds FROM t""")
def dt1_lenient_time(spark: SparkSession, sf: str) -> DataFrame:
    when = clock.lenient(F.col("timestamp_raw"), F.lit(AS_OF).cast("timestamp"))
    return table(spark, sf, "labeled_claims").select("sample_id", F.floor(F.unix_millis(when) / 1000).cast("long").alias("seconds"))


@query(f"SELECT doc_id, round(greatest(0, (epoch_us(TIMESTAMPTZ '{AS_OF}+00:00') - epoch_us(published_at)) / 8.64e10), 3) AS age FROM documents WHERE published_at IS NOT NULL")
def dt5_age_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("published_at is not null").select("doc_id", F.round(clock.age_days(F.col("published_at"), F.lit(AS_OF).cast("timestamp")), 3).alias("age"))


@query("SELECT doc_id, strftime(to_timestamp(floor(epoch(published_at))) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM documents")
def dt3_date_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", clock.date_text(F.unix_seconds("published_at")).alias("day"))


@query("""WITH p AS (SELECT sample_id, unnest(string_split(evidence, '|||')) AS piece FROM labeled_claims)
SELECT sample_id, trim(piece) AS piece FROM p WHERE length(trim(piece)) > 10""")
def f1_evidence_pieces(spark: SparkSession, sf: str) -> DataFrame:
    pieces = table(spark, sf, "labeled_claims").select("sample_id", F.explode(F.split("evidence", "\\|\\|\\|")).alias("piece"))
    return pieces.select("sample_id", F.trim("piece").alias("piece")).where(F.length("piece") > 10)


@query("SELECT doc_id FROM documents WHERE lang = 'vi' AND published_at >= TIMESTAMPTZ '2023-01-01 00:00:00+00:00' AND published_at <= TIMESTAMPTZ '2024-01-01 00:00:00+00:00'")
def f2_term_and_range(spark: SparkSession, sf: str) -> DataFrame:
    span = search.in_range(F.col("published_at"), F.lit("2023-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf, "documents").where((F.col("lang") == "vi") & span).select("doc_id")


@query("SELECT social_key FROM social_posts WHERE comment_count >= 5")
def f3_min_comments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "social_posts").where("comment_count >= 5").select("social_key")


@query("SELECT social_key FROM social_posts WHERE len(coalesce(video_urls, [])) = 0 AND NOT contains(lower(array_to_string(coalesce(image_urls, []), ' ')), 'reel')")
def f4_without_video(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    reel = F.lower(F.array_join(F.coalesce("image_urls", none), " ")).contains("reel")
    return table(spark, sf, "social_posts").where((F.size(F.coalesce("video_urls", none)) == 0) & ~reel).select("social_key")


@query("SELECT s.social_key FROM social_posts s WHERE NOT EXISTS (SELECT 1 FROM flat_comments c WHERE c.post_id = s.post_id)")
def f5_not_stored_yet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "social_posts").join(table(spark, sf, "flat_comments").select("post_id"), "post_id", "left_anti").select("social_key")


_LEAK_SQL = _any("lower(c)", "contains", text.LEAKS)


@query(rf"""WITH t AS (SELECT sample_id, trim(regexp_replace(coalesce(text, ''), '[{_WS}]+', ' ', 'g')) AS c FROM labeled_claims),
u AS (SELECT sample_id, c, row_number() OVER (PARTITION BY md5(c) ORDER BY sample_id) AS rn FROM t WHERE c <> '' AND len(string_split(c, ' ')) BETWEEN 5 AND 50 AND NOT {_LEAK_SQL} AND NOT (starts_with(c, '- ') OR starts_with(c, '* ') OR starts_with(c, '1. ')))
SELECT sample_id FROM u WHERE rn = 1""")
def f6_claim_gate(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "labeled_claims").where(text.leak_free_claim(F.col("text"))).select("sample_id", F.md5(text.collapse_blank(F.col("text"))).alias("h"))
    return own.groupBy("h").agg(F.min("sample_id").alias("sample_id")).select("sample_id")


@query("SELECT doc_id FROM documents WHERE NOT coalesce(published_at < TIMESTAMPTZ '2024-06-01 00:00:00+00:00', false)")
def f8_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(clock.kept_after(F.col("published_at"), F.lit("2024-06-01 00:00:00").cast("timestamp"))).select("doc_id")


_LABELS = {p: "CASE " + " ".join(f"WHEN upper(trim(label)) IN ({_sql_list(names)}) THEN {k}" for k, names in enumerate(classes)) + " END" for p, classes in labels.ALIASES.items()}
_WHOLE = "CASE WHEN n > -1 AND n < 3 AND trunc(n) IN (0, 1, 2) THEN CAST(trunc(n) AS int) END"


@query(f"""SELECT sample_id, coalesce(CASE WHEN n IN (0, 1, 2) THEN CAST(n AS int) END, {_LABELS["loader"]}, 2) AS loader, coalesce({_WHOLE}, {_LABELS["fusion"]}, -1) AS fusion, coalesce({_WHOLE}, {_LABELS["tuned"]}, 2) AS tuned
FROM (SELECT *, try_cast(label AS double) AS n FROM labeled_claims)""")
def l1_label_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labeled_claims").select("sample_id", *[F.coalesce(labels.label_id(F.col("label"), p), F.lit(-1)).alias(p) for p in labels.ALIASES])


@query()
def t21_html_articles(spark: SparkSession, sf: str) -> DataFrame:
    esc = F.replace(F.replace(F.replace(F.col("content"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit("<html><head><meta property='article:published_time' content='2024-05-01T10:00:00+07:00'></head><body><nav><p>menu menu menu menu menu</p></nav><article><p>"),
        F.replace(esc, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article></body></html>"))
    got = table(spark, sf, "web_posts").select("post_key", html.article(page).alias("a"))
    return got.select("post_key", F.length("a.content").alias("n_chars"), F.col("a.published_at").alias("published_at"))


@query()
def t17_html_links(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit("<div><a href='"), F.col("url"), F.lit("'>"), F.coalesce(F.col("title"), F.lit("x")), F.lit("</a><a data-url='//x.example/a'>y</a></div>"))
    found = html.links(table(spark, sf, "web_posts").select("post_key", "source", page.alias("html")), "html", "source", ["post_key", "source"])
    scored = found.withColumn("points", urls.article_score(F.col("url"), F.col("title"))).withColumn("same", urls.same_domain(urls.host(F.col("source")), urls.host(F.col("url"))))
    return scored.where("same and points >= 2").select("post_key", "url", "points")


@query("""SELECT post_key FROM (SELECT post_key, row_number() OVER (PARTITION BY url ORDER BY fetched_at, post_key) AS rn FROM web_posts) WHERE rn = 1""")
def w5_first_by_url(spark: SparkSession, sf: str) -> DataFrame:
    return kb.keep_first(table(spark, sf, "web_posts").select("post_key", "url", "fetched_at"), ["url"], ["fetched_at", "post_key"]).select("post_key")


@query(rf"""WITH t AS (SELECT doc_id, text, published_at AS ts, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{_WS}]', '', 'g'), '[{_WS}]+', ' ', 'g')) AS k FROM documents)
SELECT min(doc_id) AS first_row, md5(arg_min(text, doc_id)) AS text_md5, CAST(epoch_us(arg_min(ts, doc_id) FILTER (ts IS NOT NULL)) AS varchar) AS ts_us FROM t GROUP BY k""")
def w6_dedup_backfill(spark: SparkSession, sf: str) -> DataFrame:
    out = kb.backfilled(table(spark, sf, "documents"), text.normalize(F.col("text")), "text", "published_at", "doc_id")
    return out.select("first_row", F.md5("text").alias("text_md5"), F.unix_micros("ts").cast("string").alias("ts_us"))


@query("SELECT min(comment_key) AS comment_key FROM flat_comments WHERE comment_text IS NOT NULL GROUP BY md5(comment_text)")
def w8_first_by_digest(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "flat_comments").where("comment_text is not null")
    return own.groupBy(F.md5("comment_text").alias("h")).agg(F.min("comment_key").alias("comment_key")).select("comment_key")


@query("SELECT sample_id, CAST('0x' || substr(md5('42|' || sample_id), 1, 7) AS bigint) % 10000 < 9000 AS in_train FROM labeled_claims")
def w11_stable_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labeled_claims").select("sample_id", kb.in_split(F.col("sample_id"), 0.9).alias("in_train"))


@query("""WITH b AS (SELECT doc_id, title, 2 AS seq FROM documents WHERE doc_type = 'news' UNION ALL SELECT doc_id, 'new ' || title, 3 FROM documents WHERE doc_type = 'qa'),
l AS (SELECT doc_id, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rn FROM b) WHERE rn = 1)
SELECT doc_id, title FROM l UNION ALL SELECT doc_id, title FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l)""")
def snk1_upsert(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "title", "doc_type")
    batch = docs.where("doc_type = 'news'").select("doc_id", "title", F.lit(2).alias("seq")).unionByName(docs.where("doc_type = 'qa'").select("doc_id", F.concat(F.lit("new "), "title").alias("title"), F.lit(3).alias("seq")))
    return kb.upsert(docs.select("doc_id", "title"), batch, "doc_id", "seq")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_labels)")
def snk2_delete(spark: SparkSession, sf: str) -> DataFrame:
    return kb.delete(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "doc_labels"), "doc_id")


@query("SELECT f.source, count(d.doc_id) AS n FROM feed_sources f LEFT JOIN documents d ON d.source = f.source AND d.text IS NOT NULL GROUP BY f.source")
def a7_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "documents").where("text is not null").groupBy("source").agg(F.count("*").alias("c"))
    return table(spark, sf, "feed_sources").join(counts, "source", "left").groupBy("source").agg(F.coalesce(F.max("c"), F.lit(0)).alias("n"))


@query("SELECT source FROM feed_sources WHERE source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def jn8_sources_without_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "feed_sources").join(table(spark, sf, "documents").select("source"), "source", "left_anti").select("source")


@query("""WITH p AS (SELECT sample_id, len(list_filter(string_split(evidence, '|||'), lambda s: length(trim(s)) > 0)) AS n FROM labeled_claims)
SELECT count(*) AS total, count(*) FILTER (n > 0) AS kept, count(*) FILTER (n IS NULL OR n = 0) AS skipped, round(avg(n) FILTER (n > 0), 6) AS mean_items, min(n) FILTER (n > 0) AS least, max(n) FILTER (n > 0) AS most FROM p""")
def a6_dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(F.filter(F.split("evidence", "\\|\\|\\|"), lambda s: F.length(F.trim(s)) > 0))
    own = table(spark, sf, "labeled_claims").select(F.when(F.col("evidence").isNotNull(), n).cast("long").alias("n"))
    some = F.when(F.col("n") > 0, F.col("n"))
    return own.agg(F.count("*").alias("total"), F.count(some).alias("kept"), F.count_if(some.isNull()).alias("skipped"), F.round(F.avg(some), 6).alias("mean_items"), F.min(some).alias("least"), F.max(some).alias("most"))
