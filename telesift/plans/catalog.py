"""The registered queries: each with the Spark form and SQL that says the same over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.params import SearchParams
from ..operators import facets, monitor, mutate, packets, search, timeline, trigram
from ..sources.tables import Tables, bind

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CTES = """
raw_lines AS (SELECT doc_id, u.pos - 1 AS pos, trim(u.line, ' ' || chr(9) || chr(13)) AS text FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos)),
ts_files AS (SELECT doc_id AS ts_file_id, concat('/rec/', source, '/', doc_id, '.ts') AS path, concat(doc_id, '.ts') AS filename,
  CASE doc_id % 20 WHEN 0 THEN 'error' WHEN 1 THEN 'pending' WHEN 2 THEN 'ingesting' ELSE 'done' END AS status,
  CASE WHEN doc_id % 40 = 0 THEN 'decode failed' END AS error_msg,
  CASE WHEN doc_id % 20 > 2 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS ingested_at,
  CASE WHEN doc_id % 17 <> 0 THEN CAST(substr(source, 4) AS BIGINT) + 1 END AS program_id,
  CASE WHEN (CAST(substr(source, 4) AS BIGINT) + 1) % 5 <> 0 AND doc_id % 7 <> 0 THEN CAST(doc_id % 13 AS INT) END AS episode_number,
  CASE WHEN doc_id % 3 <> 0 THEN concat(lang, ' ', doc_id % 4) END AS episode_title,
  CASE WHEN doc_id % 11 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS DATE) END AS air_date,
  CAST(CASE doc_id % 50 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS INT) AS pes_regen FROM documents),
programs AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) + 1 AS program_id, source AS title, lower(source) AS normalized_title FROM documents),
events0 AS (SELECT r.doc_id * 100000 + r.pos AS caption_id, r.doc_id AS ts_file_id, r.pos, r.pos * 2500 + r.doc_id % 1000 AS pts_start, CASE WHEN r.pos % 4 = 0 THEN 2000 WHEN r.pos % 9 = 8 THEN 0 END AS dur, r.text
  FROM raw_lines r JOIN ts_files f ON f.ts_file_id = r.doc_id WHERE f.status = 'done' AND r.text <> ''),
ends AS (SELECT *, coalesce(pts_start + dur, lead(pts_start) OVER (PARTITION BY ts_file_id ORDER BY pos), pts_start + 5000) AS pts_end FROM events0),
captions AS (SELECT caption_id, ts_file_id, pos, pts_start, pts_end, text FROM ends WHERE pts_end > pts_start),
tags AS (SELECT c.caption_id, d.lang AS tag FROM captions c JOIN documents d ON d.doc_id = c.ts_file_id WHERE c.pos % 5 = 0
  UNION ALL SELECT c.caption_id, 'quality' FROM captions c JOIN labels l ON l.doc_id = c.ts_file_id WHERE l.quality = 1 AND c.pos % 2 = 0
  UNION ALL SELECT c.caption_id, 'toxic' FROM captions c JOIN labels l ON l.doc_id = c.ts_file_id WHERE l.toxic = 1 AND c.pos % 3 = 0),
thumbnails AS (SELECT c.caption_id, CAST(c.pos % 6 AS INT) AS selected_frame FROM captions c JOIN labels l ON l.doc_id = c.ts_file_id WHERE c.pos % 3 = 0)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def fold(x: str) -> str:
    return f"translate({x}, '{UP}', '{LOW}')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g')"


def fmt(ms: str) -> str:
    s = f"(greatest({ms}, 0) // 1000)"
    return f"CASE WHEN {s} >= 3600 THEN printf('%02d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60) ELSE printf('%02d:%02d', {s} // 60 % 60, {s} % 60) END"


def shown(title: str, ep: str = "episode_number", sub: str = "episode_title") -> str:
    return f"concat_ws(' ', nullif({title}, ''), '#' || {ep}, nullif({trim(sub)}, ''))"


def query(key: str, sql: str, ctes: str = ""):
    """Registers a function of Tables under key."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: f(bind(spark, sf_dir))
        ORACLE_SQL[key] = f"WITH {CTES.strip()}{',' + ctes if ctes else ''} {sql}"
        return f

    return put


# sources

@query("s5_table_scan", "SELECT 'programs' AS name, count(*) AS n FROM programs UNION ALL SELECT 'ts_files', count(*) FROM ts_files UNION ALL SELECT 'captions', count(*) FROM captions UNION ALL SELECT 'tags', count(*) FROM tags UNION ALL SELECT 'thumbnails', count(*) FROM thumbnails")
def _(t):
    parts = [getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("programs", "ts_files", "captions", "tags", "thumbnails")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# sinks

@query("k2_insert_or_ignore", "SELECT caption_id, tag FROM tags UNION SELECT caption_id, 'quality' FROM captions WHERE pos % 4 = 0")
def _(t):
    new = t.captions.where("pos % 4 = 0").select("caption_id", F.lit("quality").alias("tag"))
    return mutate.insert_or_ignore(t.tags, new, ["caption_id", "tag"])


CHOSEN = " chosen AS (SELECT caption_id, CAST(pos % 5 AS INT) AS selected_frame, 1 AS seq FROM captions WHERE pos % 2 = 0 UNION ALL SELECT caption_id, CAST(pos % 4 AS INT), 2 FROM captions WHERE pos % 6 = 0)"


@query("k3_upsert_frame", "SELECT caption_id, selected_frame FROM thumbnails WHERE caption_id NOT IN (SELECT caption_id FROM chosen) UNION ALL SELECT caption_id, arg_max(selected_frame, seq) FROM chosen GROUP BY caption_id", CHOSEN)
def _(t):
    a = t.captions.where("pos % 2 = 0").select("caption_id", (F.col("pos") % 5).cast("int").alias("selected_frame"), F.lit(1).alias("seq"))
    b = t.captions.where("pos % 6 = 0").select("caption_id", (F.col("pos") % 4).cast("int").alias("selected_frame"), F.lit(2).alias("seq"))
    return mutate.select_frame(t, a.unionByName(b)).thumbnails.select("caption_id", "selected_frame")


# projections

@query("p1_coalesce_title", "SELECT ts_file_id, coalesce(p.title, f.filename) AS title FROM ts_files f LEFT JOIN programs p USING (program_id)")
def _(t):
    return search.titled(t.ts_files, t.programs).select("ts_file_id", "title")


@query("p2_has_thumb", "SELECT c.caption_id, CAST(CASE WHEN t.caption_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS has_thumb FROM captions c LEFT JOIN thumbnails t USING (caption_id)")
def _(t):
    return search.framed(t.captions, t.thumbnails).select("caption_id", "has_thumb")


@query("p3_preview_frame", "SELECT c.caption_id, coalesce(t.selected_frame, 3) AS preview_frame FROM captions c LEFT JOIN thumbnails t USING (caption_id)")
def _(t):
    return search.framed(t.captions, t.thumbnails).select("caption_id", "preview_frame")


@query("p4_error_msg_default", "SELECT ts_file_id, coalesce(error_msg, '(unknown)') AS error_msg FROM ts_files WHERE status = 'error'")
def _(t):
    return t.ts_files.where("status = 'error'").select("ts_file_id", F.coalesce("error_msg", F.lit("(unknown)")).alias("error_msg"))


@query("p5_caption_count", "SELECT ts_file_id, (SELECT count(*) FROM captions c WHERE c.ts_file_id = f.ts_file_id) AS caption_count FROM ts_files f")
def _(t):
    return monitor.with_caption_count(t.ts_files, t.captions).select("ts_file_id", "caption_count")


COUNTS = " counts AS (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ingesting') AS ingesting, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error, count(*) AS total, count(*) FILTER (pes_regen <> 0) AS regenerating FROM ts_files)"


@query("p6_status_pct", "SELECT CASE WHEN total > 0 THEN done * 100 // total ELSE 0 END AS pct FROM counts", COUNTS)
def _(t):
    return monitor.status_counts(t.ts_files).select(monitor.done_percent().alias("pct"))


LABEL = "CASE WHEN ingesting > 0 THEN 'ingesting' WHEN regenerating > 0 THEN 'regenerating' WHEN pending > 0 THEN 'pending' WHEN total = 0 THEN 'empty' ELSE 'done' END"


@query("p7_status_label", f"SELECT program_id, {LABEL} AS label FROM (SELECT program_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ingesting') AS ingesting, count(*) AS total, count(*) FILTER (pes_regen <> 0) AS regenerating FROM ts_files GROUP BY program_id) x")
def _(t):
    g = t.ts_files.groupBy("program_id").agg(F.count(F.when(F.col("status") == "pending", 1)).alias("pending"), F.count(F.when(F.col("status") == "ingesting", 1)).alias("ingesting"), F.count("*").alias("total"), F.count(F.when(F.col("pes_regen") != 0, 1)).alias("regenerating"))
    return g.select("program_id", monitor.status_label().alias("label"))


# filters: each is the search with one condition

BASE = "FROM captions c JOIN ts_files f USING (ts_file_id)"


def _filter(key: str, params: SearchParams, where: str) -> None:
    query(key, f"SELECT c.caption_id {BASE} WHERE {where}")(lambda t: search.matches(t, params).select("caption_id"))


_filter("f1_text_contains", SearchParams(q="THE"), f"{fold('c.text')} LIKE '%the%' ESCAPE '\\'")
_filter("f1_text_contains_percent", SearchParams(q="%%%"), f"{fold('c.text')} LIKE '%\\%\\%\\%%' ESCAPE '\\'")
_filter("f2_program_eq", SearchParams(program_id=8), "f.program_id = 8")
_filter("f3_episode_eq", SearchParams(episode=4), "f.episode_number = 4")
_filter("f4_subtitle_contains", SearchParams(subtitle=" EN "), f"{fold('f.episode_title')} LIKE '%en%'")
_filter("f5_date_from", SearchParams(date_from="2024-03-01"), "f.air_date >= DATE '2024-03-01'")
_filter("f6_date_to", SearchParams(date_to="2024-03-01"), "f.air_date <= DATE '2024-03-01'")
_filter("f7_tags_all", SearchParams(tags=["en", "quality", "en"]), "EXISTS (SELECT 1 FROM tags t WHERE t.caption_id = c.caption_id AND t.tag = 'en') AND EXISTS (SELECT 1 FROM tags t WHERE t.caption_id = c.caption_id AND t.tag = 'quality')")
_filter("f8_thumb_generated", SearchParams(filter="generated"), "EXISTS (SELECT 1 FROM thumbnails t WHERE t.caption_id = c.caption_id)")
_filter("f9_thumb_pending", SearchParams(filter="pending"), "NOT EXISTS (SELECT 1 FROM thumbnails t WHERE t.caption_id = c.caption_id)")
_filter("f10_search_gate", SearchParams(q="a"), "false")
_filter("f11_unknown_filter", SearchParams(filter="something"), "true")


@query("f12_filename_contains", "SELECT ts_file_id, filename FROM ts_files WHERE filename LIKE '%1%' AND status = 'done'")
def _(t):
    return monitor.filtered_files(t.ts_files, "1", "done").select("ts_file_id", "filename")


@query("f15_skip_known", "SELECT path FROM ts_files WHERE status = 'pending'")
def _(t):
    return t.ts_files.select("path").join(mutate.known_paths(t.ts_files), "path", "left_anti")


@query("f16_not_null", "SELECT ts_file_id, episode_title FROM ts_files WHERE episode_title IS NOT NULL")
def _(t):
    return t.ts_files.where(F.col("episode_title").isNotNull()).select("ts_file_id", "episode_title")


@query("f17_not_in_subquery", "SELECT program_id FROM programs WHERE program_id NOT IN (SELECT DISTINCT program_id FROM ts_files WHERE program_id IS NOT NULL AND ts_file_id % 30 = 0)")
def _(t):
    used = t.ts_files.where("program_id is not null and ts_file_id % 30 = 0").select("program_id").distinct()
    return t.programs.select("program_id").join(used, "program_id", "left_anti")


@query("f18_exists_join", "SELECT program_id FROM programs p WHERE EXISTS (SELECT 1 FROM ts_files f JOIN captions c USING (ts_file_id) WHERE f.program_id = p.program_id)")
def _(t):
    return facets.index_programs(t).select("program_id")


@query("f19_status_in", "SELECT ts_file_id, status, pes_regen FROM ts_files WHERE status IN ('done', 'error') AND pes_regen <> 0")
def _(t):
    return t.ts_files.where(F.col("status").isin("done", "error") & (F.col("pes_regen") != 0)).select("ts_file_id", "status", "pes_regen")


# joins

@query("j1_caption_file_join", f"SELECT c.caption_id, f.path, c.text {BASE}")
def _(t):
    return t.captions.join(t.ts_files.select("ts_file_id", "path"), "ts_file_id").select("caption_id", "path", "text")


@query("j2_program_left_join", "SELECT ts_file_id, p.title FROM ts_files f LEFT JOIN programs p USING (program_id)")
def _(t):
    return t.ts_files.join(t.programs.select("program_id", "title"), "program_id", "left").select("ts_file_id", "title")


@query("j3_thumb_left_join", "SELECT c.caption_id, t.selected_frame FROM captions c LEFT JOIN thumbnails t USING (caption_id)")
def _(t):
    return t.captions.join(t.thumbnails, "caption_id", "left").select("caption_id", "selected_frame")


@query("j4_semi", "SELECT ts_file_id FROM ts_files f WHERE EXISTS (SELECT 1 FROM captions c WHERE c.ts_file_id = f.ts_file_id)")
def _(t):
    return facets.with_captions(t.ts_files.select("ts_file_id"), t.captions)


@query("j5_anti", "SELECT ts_file_id FROM ts_files f WHERE NOT EXISTS (SELECT 1 FROM captions c WHERE c.ts_file_id = f.ts_file_id)")
def _(t):
    return t.ts_files.select("ts_file_id").join(t.captions.select("ts_file_id"), "ts_file_id", "left_anti")


@query("j6_point_lookup", f"SELECT f.path, c.pts_start, c.pts_end {BASE} WHERE c.caption_id = 500000")
def _(t):
    return search.locate(t, 500000)


PAGE = f" page AS (SELECT c.caption_id, c.pts_start, f.air_date, f.episode_number {BASE} WHERE {fold('c.text')} LIKE '%the%' ORDER BY f.air_date DESC NULLS LAST, f.episode_number ASC NULLS FIRST, c.pts_start, c.caption_id LIMIT 50)"


def _page(t):
    return search.matches(t, SearchParams(q="the")).orderBy(*search.search_order()).limit(50)


@query("j7_client_hash_join", "SELECT caption_id, coalesce((SELECT string_agg(tag, chr(10) ORDER BY tag) FROM tags t WHERE t.caption_id = p.caption_id), '') AS tags FROM page p", PAGE)
def _(t):
    return search.with_tags(_page(t), t.tags).select("caption_id", F.array_join("tags", "\n").alias("tags"))


@query("j8_key_in_list", "SELECT caption_id, tag FROM tags WHERE caption_id IN (SELECT caption_id FROM page) ORDER BY tag, caption_id", PAGE)
def _(t):
    return t.tags.join(_page(t).select("caption_id"), "caption_id", "left_semi").orderBy("tag", "caption_id").select("caption_id", "tag")


# aggregates

@query("a1_search_total", f"SELECT count(*) AS total {BASE} WHERE {fold('c.text')} LIKE '%the%' AND f.air_date >= DATE '2024-02-01'")
def _(t):
    return search.search_total(t, SearchParams(q="the", date_from="2024-02-01"))


@query("a2_status_counts", "SELECT pending, ingesting, done, error, total FROM counts", COUNTS)
def _(t):
    return monitor.status_counts(t.ts_files)


@query("a2_status_counts_orders", "SELECT count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders")
def _(t):
    return t.raw["orders"].agg(*[F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(s.lower()) for s in "POF"])


@query("a3_subtitle_first_air", "SELECT episode_title, min(air_date) AS air_date FROM ts_files WHERE episode_title IS NOT NULL GROUP BY episode_title")
def _(t):
    return facets.subtitle_first_air(t.ts_files)


@query("a4_distinct_tags", "SELECT DISTINCT tag FROM tags ORDER BY tag")
def _(t):
    return facets.tag_options(t)


@query("a5_summary_counts", "SELECT (SELECT count(*) FROM ts_files) AS files, (SELECT count(*) FROM ts_files WHERE status = 'done') AS done, (SELECT count(*) FROM ts_files WHERE status = 'error') AS error, (SELECT count(*) FROM captions) AS captions")
def _(t):
    return monitor.summary_counts(t)


@query("a6_all_null_switch", "SELECT program_id, coalesce(bool_and(episode_number IS NULL), true) AS all_null FROM programs LEFT JOIN ts_files USING (program_id) GROUP BY program_id")
def _(t):
    f = t.ts_files.select(F.col("program_id"), F.col("episode_number").isNull().alias("no"))
    g = f.groupBy("program_id").agg(F.bool_and("no").alias("all_null"))
    return t.programs.select("program_id").join(g, "program_id", "left").select("program_id", F.coalesce("all_null", F.lit(True)).alias("all_null"))


@query("a7_files_total", "SELECT count(*) AS total FROM ts_files WHERE filename LIKE '%2%' AND status = 'error'")
def _(t):
    return monitor.filtered_files(t.ts_files, "2", "error").agg(F.count("*").alias("total"))


@query("a8_regen_count", "SELECT regenerating FROM counts", COUNTS)
def _(t):
    return t.ts_files.where("pes_regen <> 0").agg(F.count("*").alias("regenerating"))


@query("a9_tags_per_caption", "SELECT caption_id, string_agg(tag, chr(10) ORDER BY tag) AS tags FROM tags GROUP BY caption_id")
def _(t):
    return t.tags.groupBy("caption_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), "\n").alias("tags"))


# ordered sequences

@query("w1_caption_end", "SELECT caption_id, pts_start, pts_end FROM ends")
def _(t):
    d = t.raw["documents"].where("doc_id % 20 > 2").select(F.col("doc_id").alias("ts_file_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    d = d.where(F.btrim("text", F.lit(" \t\r")) != "").select((F.col("ts_file_id") * 100000 + F.col("pos")).alias("caption_id"), "ts_file_id", "pos", (F.col("pos") * 2500 + F.col("ts_file_id") % 1000).alias("pts_start"), F.when(F.col("pos") % 4 == 0, 2000).when(F.col("pos") % 9 == 8, 0).alias("duration"))
    return timeline.caption_end(d, "ts_file_id", "pos").select("caption_id", "pts_start", "pts_end")


@query("w2_drop_empty_interval", "SELECT caption_id, pts_start, pts_end FROM ends WHERE pts_end > pts_start")
def _(t):
    return t.captions.select("caption_id", "pts_start", "pts_end")


@query("w3_pts_epoch", "SELECT event_id, pmod_ // 90 AS ms FROM (SELECT event_id, ((pts - e) % 8589934592 + 8589934592) % 8589934592 AS pmod_ FROM (SELECT event_id, pts, first_value(pts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 <> 0 THEN event_id * 900123 % 8589934592 END AS pts FROM events) a) b) c")
def _(t):
    e = t.raw["events"].select("event_id", "user_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 900123 % timeline.PTS_RANGE).alias("pts"))
    return timeline.pts_to_ms(e, ["user_id"], ["ts", "event_id"]).select("event_id", "ms")


# order and paging

@query("l1_search_order", f"SELECT c.caption_id, f.air_date, f.episode_number, c.pts_start {BASE} WHERE {fold('c.text')} LIKE '%the%' ORDER BY f.air_date DESC NULLS LAST, f.episode_number ASC NULLS FIRST, c.pts_start, c.caption_id LIMIT 50 OFFSET 100")
def _(t):
    return search.matches(t, SearchParams(q="the")).orderBy(*search.search_order()).offset(100).limit(50).select("caption_id", "air_date", "episode_number", "pts_start")


@query("l2_page_window", f"SELECT p.page * 50 AS \"offset\", least((p.page + 1) * 50, total) AS loaded, (p.page + 1) * 50 < total AS has_next FROM (SELECT count(*) AS total {BASE} WHERE {fold('c.text')} LIKE '%the%') x, (SELECT unnest([0, 1, 2, 100, 1000000])::BIGINT AS page) p")
def _(t):
    total = search.search_total(t, SearchParams(q="the"))
    pages = total.select("total", F.explode(F.array(*[F.lit(p).cast("long") for p in (0, 1, 2, 100, 1000000)])).alias("page"))
    return pages.select((F.col("page") * 50).alias("offset"), F.least((F.col("page") + 1) * 50, "total").alias("loaded"), ((F.col("page") + 1) * 50 < F.col("total")).alias("has_next"))


@query("l3_files_order", "SELECT ts_file_id, ingested_at FROM ts_files ORDER BY ingested_at DESC NULLS LAST, ts_file_id DESC LIMIT 50 OFFSET 50")
def _(t):
    return t.ts_files.orderBy(*monitor.files_order()).offset(50).limit(50).select("ts_file_id", "ingested_at")


@query("l4_recent_errors", "SELECT ts_file_id, filename, coalesce(error_msg, '(unknown)') AS error_msg FROM ts_files WHERE status = 'error' ORDER BY ingested_at DESC NULLS LAST, ts_file_id DESC LIMIT 5")
def _(t):
    return monitor.recent_errors(t.ts_files)


@query("l5_episode_order", "SELECT ts_file_id, episode_number, air_date FROM ts_files WHERE program_id = 8 AND status = 'done' ORDER BY episode_number NULLS FIRST, air_date NULLS FIRST, ts_file_id")
def _(t):
    f = t.ts_files.where("program_id = 8 and status = 'done'")
    return f.orderBy(F.col("episode_number").asc_nulls_first(), F.col("air_date").asc_nulls_first(), "ts_file_id").select("ts_file_id", "episode_number", "air_date")


@query("l6_regen_order", "SELECT filename, pes_regen FROM ts_files WHERE pes_regen <> 0 ORDER BY pes_regen DESC, filename")
def _(t):
    return monitor.regen_queue(t.ts_files)


@query("l7_program_order", "SELECT program_id, title FROM programs ORDER BY title")
def _(t):
    return t.programs.select("program_id", "title").orderBy("title")


# scalar functions

TITLE = "concat(source, CASE doc_id % 7 WHEN 0 THEN ' #' || doc_id * 37 % 70000 || ' ' || lang WHEN 1 THEN concat('＃', doc_id % 100, lang) WHEN 2 THEN concat(' 第', doc_id % 100, '話 ', lang) WHEN 3 THEN concat('　', lang) WHEN 4 THEN concat(' ', lang) WHEN 5 THEN concat('第 ', lpad(CAST(doc_id * 41 % 70000 AS VARCHAR), 7, '0')) ELSE '' END, CASE doc_id % 3 WHEN 0 THEN '[字][デ]' WHEN 1 THEN ' [SS] ' ELSE '' END)"


def _titles(t):
    i = F.col("doc_id")
    n = (i % 100).cast("string")
    mid = F.when(i % 7 == 0, F.concat(F.lit(" #"), (i * 37 % 70000).cast("string"), F.lit(" "), "lang")).when(i % 7 == 1, F.concat(F.lit("＃"), n, "lang")).when(i % 7 == 2, F.concat(F.lit(" 第"), n, F.lit("話 "), "lang")).when(i % 7 == 3, F.concat(F.lit("　"), "lang")).when(i % 7 == 4, F.concat(F.lit(" "), "lang")).when(i % 7 == 5, F.concat(F.lit("第 "), F.lpad((i * 41 % 70000).cast("string"), 7, "0"))).otherwise("")
    end = F.when(i % 3 == 0, "[字][デ]").when(i % 3 == 1, " [SS] ").otherwise("")
    return t.raw["documents"].select("doc_id", "source", "lang", F.concat("source", mid, end).alias("title"))


@query("x1_like_escape", "SELECT caption_id, replace(replace(replace(text, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM captions")
def _(t):
    return t.captions.select("caption_id", X.like_escape(F.col("text")).alias("escaped"))


@query("x2_fmt_ms", f"SELECT caption_id, {fmt('(pts_start * 37 - 1000)')} AS t FROM captions")
def _(t):
    return t.captions.select("caption_id", X.fmt_ms(F.col("pts_start") * 37 - 1000).alias("t"))


@query("x3_fmt_ms_millis", "SELECT caption_id, printf('%02d:%02d:%02d.%03d', p // 3600000, p // 60000 % 60, p // 1000 % 60, p % 1000) AS t FROM (SELECT caption_id, pts_start * 37 AS p FROM captions) x")
def _(t):
    return t.captions.select("caption_id", X.fmt_ms_millis(F.col("pts_start") * 37).alias("t"))


@query("x4_display_title", f"SELECT ts_file_id, {shown('coalesce(p.title, f.filename)')} AS display_title FROM ts_files f LEFT JOIN programs p USING (program_id)")
def _(t):
    return search.titled(t.ts_files, t.programs).select("ts_file_id", X.display_title(F.col("title"), F.col("episode_number"), F.col("episode_title")).alias("display_title"))


@query("x5_time_range", f"SELECT caption_id, {fmt('pts_start')} || ' – ' || {fmt('pts_end')} AS time_range FROM captions")
def _(t):
    return t.captions.select("caption_id", X.time_range(F.col("pts_start"), F.col("pts_end")).alias("time_range"))


@query("x6_parse_tag_list", "SELECT doc_id, count(*) AS n, string_agg(text, '|' ORDER BY pos) AS joined FROM raw_lines WHERE text <> '' GROUP BY doc_id")
def _(t):
    tags = X.tag_list(F.col("text"))
    return t.raw["documents"].select("doc_id", F.size(tags).cast("long").alias("n"), F.array_join(tags, "|").alias("joined")).where("n > 0")


@query("x8_empty_as_none_string", f"SELECT doc_id, nullif({trim("CASE doc_id % 4 WHEN 0 THEN '　 ' WHEN 1 THEN concat(' ', lang, '　') WHEN 2 THEN '' ELSE source END")}, '') AS value FROM documents")
def _(t):
    i = F.col("doc_id")
    x = F.when(i % 4 == 0, "　 ").when(i % 4 == 1, F.concat(F.lit(" "), "lang", F.lit("　"))).when(i % 4 == 2, "").otherwise(F.col("source"))
    return t.raw["documents"].select("doc_id", F.nullif(X.trim_u(x), F.lit("")).alias("value"))


@query("x9_normalize_title", "SELECT doc_id, lower(substr(coalesce(text, ''), 1, 60)) AS title FROM documents")
def _(t):
    """Titles in full-width signs become plain ones; accented letters only change their case."""
    plain = "".join(map(chr, range(0x21, 0x7F)))
    wide = F.translate(F.substring(F.coalesce("text", F.lit("")), 1, 60), plain, "".join(chr(ord(c) + 0xFEE0) for c in plain))
    return t.raw["documents"].select("doc_id", X.normalize_title(wide).alias("title"))


@query("x21_extract_pes_payload", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE hex(encode(CAST(o_orderkey AS VARCHAR))) END AS payload FROM orders")
def _(t):
    k = F.col("o_orderkey")
    fill = F.repeat(F.lit("00"), (k % 5).cast("int"))
    raw = F.unhex(F.concat(F.lit("000001BD00000000"), F.lpad(F.hex(k % 5), 2, "0"), fill, F.hex(F.encode(k.cast("string"), "utf-8"))))
    raw = F.when(k % 5 == 4, F.substring(raw, F.lit(1), F.lit(13))).otherwise(raw)
    return t.raw["orders"].select("o_orderkey", F.hex(packets.pes_payload(raw)).alias("payload"))


@query("x10_resolve_program_key", "SELECT doc_id, CASE WHEN s <> '' THEN s WHEN ti <> '(unknown)' THEN ti ELSE '' END AS program_key FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS s, CASE doc_id % 4 WHEN 0 THEN '(unknown)' WHEN 1 THEN '' ELSE lang END AS ti FROM documents) x")
def _(t):
    i = F.col("doc_id")
    return t.raw["documents"].select("doc_id", X.program_key(F.when(i % 3 == 0, F.col("source")).otherwise(""), F.when(i % 4 == 0, "(unknown)").when(i % 4 == 1, "").otherwise(F.col("lang"))).alias("program_key"))


@query("x11_file_stem", "SELECT ts_file_id, nullif(regexp_extract(path, '([^/]+?)(\\.[^./]*)?/*$', 1), '') AS stem FROM ts_files UNION ALL SELECT -1, NULL UNION ALL SELECT -2, '.hidden'")
def _(t):
    extra = t.ts_files.sparkSession.createDataFrame([(-1, "/"), (-2, "/rec/.hidden")], "ts_file_id long, path string")
    return t.ts_files.select("ts_file_id", "path").unionByName(extra).select("ts_file_id", X.file_stem(F.col("path")).alias("stem"))


@query("x12_strip_arib_icons", "SELECT doc_id, concat(source, lang) AS title FROM documents")
def _(t):
    return t.raw["documents"].select("doc_id", X.strip_icons(F.concat(F.lit("\U0001f100"), "source", F.lit("\U0001f14e"), "lang", F.lit("\U0001f2ff"))).alias("title"))


FLAGS = "(\\s*\\[[^\\[]*\\])+\\s*$"
STRIPPED = trim(f"regexp_replace({trim(TITLE)}, '{FLAGS}', '')")


@query("x13_strip_broadcast_flags", f"SELECT doc_id, {STRIPPED} AS title FROM documents")
def _(t):
    return _titles(t).select("doc_id", X.strip_flags(F.col("title")).alias("title"))


SPLIT = "regexp_matches(t, '^[^ 　]*[ 　]')"
#: The rule step by step: each place of a sign, the digits after it, how many count and what they are worth.
EPISODE_CTES = f"""
titles AS (SELECT doc_id, {STRIPPED} AS t FROM documents),
spots AS (SELECT doc_id, t, i, substr(t, i, 1) = '第' AS ordinal, CASE WHEN substr(t, i, 1) = '第' THEN ltrim(substr(t, i + 1), ' 　') ELSE substr(t, i + 1) END AS rest FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM titles) x WHERE substr(t, i, 1) IN ('#', '＃', '第')),
numbers AS (SELECT *, regexp_extract(translate(rest, '０１２３４５６７８９', '0123456789'), '^[0-9]+') AS d FROM spots),
worth AS (SELECT *, CASE WHEN length(ltrim(d, '0')) <= 4 THEN length(d) ELSE length(d) - length(ltrim(d, '0')) + 4 END AS used, CAST(coalesce(nullif(left(ltrim(d, '0'), 5), ''), '0') AS INT) AS v FROM numbers WHERE d <> ''),
firsts AS (SELECT doc_id, i, v, ordinal, substr(rest, used + 1) AS tail FROM worth WHERE v <= 65535 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1),
parts AS (SELECT t.doc_id, t, i, v, CASE WHEN i IS NULL AND {SPLIT} THEN regexp_replace(t, '^[^ 　]*', '') WHEN i IS NULL THEN '' WHEN ordinal AND starts_with(ltrim(tail, ' 　'), '話') THEN substr(ltrim(tail, ' 　'), 2) ELSE tail END AS rest FROM titles t LEFT JOIN firsts USING (doc_id)),
episodes AS (SELECT doc_id, CASE WHEN i IS NOT NULL THEN {trim('left(t, i - 1)')} WHEN {SPLIT} THEN regexp_extract(t, '^[^ 　]*') ELSE t END AS series, v AS episode, nullif({trim(f"regexp_replace({trim('rest')}, '{FLAGS}', '')")}, '') AS subtitle FROM parts)"""


@query("x14_parse_digits", f"SELECT doc_id, CASE WHEN d <> '' AND v <= 65535 THEN v END AS value, CASE WHEN d <> '' AND v <= 65535 THEN used END AS digits FROM (SELECT doc_id, d, CASE WHEN length(ltrim(d, '0')) <= 4 THEN length(d) ELSE length(d) - length(ltrim(d, '0')) + 4 END AS used, CAST(coalesce(nullif(left(ltrim(d, '0'), 5), ''), '0') AS INT) AS v FROM (SELECT doc_id, regexp_extract(concat(CASE WHEN doc_id % 9 > 0 THEN doc_id * 7919 % (10 ** (doc_id % 9))::BIGINT END, lang), '^[0-9]+') AS d FROM documents) x) y")
def _(t):
    i = F.col("doc_id")
    number = F.when(i % 9 > 0, (i * 7919 % F.pow(F.lit(10.0), i % 9).cast("long")).cast("string")).otherwise("")
    n = t.raw["documents"].select("doc_id", X.leading_number(F.concat(F.translate(number, "012345", "０１２345"), "lang")).alias("n"))
    return n.select("doc_id", F.col("n.value").alias("value"), F.col("n.digits").cast("long").alias("digits"))


@query("x15_extract_series_episode", "SELECT doc_id, series, episode, subtitle FROM episodes", EPISODE_CTES)
def _(t):
    s = _titles(t).select("doc_id", X.series_episode(X.strip_flags(F.col("title"))).alias("s"))
    return s.select("doc_id", "s.series", "s.episode", "s.subtitle")


@query("x16_fill_series_episode", "SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 9 AS INT) END, episode) AS episode FROM episodes", EPISODE_CTES)
def _(t):
    s = _titles(t).select("doc_id", X.series_episode(X.strip_flags(F.col("title"))).alias("s"))
    return s.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 5 == 0, (F.col("doc_id") % 9).cast("int")), "s.episode").alias("episode"))


@query("x17_bcd_byte", "SELECT o_orderkey, CASE WHEN b >> 4 <= 9 AND b & 15 <= 9 THEN (b >> 4) * 10 + (b & 15) END AS v FROM (SELECT o_orderkey, CAST(o_orderkey % 256 AS INT) AS b FROM orders) x")
def _(t):
    return t.raw["orders"].select("o_orderkey", X.bcd_byte((F.col("o_orderkey") % 256).cast("int")).alias("v"))


def _bcd(x):
    return f"(({x}) >> 4) * 10 + (({x}) & 15)"


def _isbcd(x):
    return f"(({x}) >> 4) <= 9 AND (({x}) & 15) <= 9"


@query("x18_decode_mjd_bcd", f"SELECT o_orderkey, CASE WHEN mjd <> 65535 AND {_isbcd('h')} AND {_isbcd('m')} AND {_isbcd('s')} AND {_bcd('h')} < 24 AND {_bcd('m')} < 60 AND {_bcd('s')} < 60 THEN CAST(DATE '1858-11-17' + mjd AS TIMESTAMP) + to_seconds((({_bcd('h')}) * 60 + {_bcd('m')}) * 60 + {_bcd('s')}) END AS start_time FROM (SELECT o_orderkey, CAST(51544 + o_orderkey % 13992 AS INT) AS mjd, CAST(o_orderkey % 37 AS INT) AS h, CAST(o_orderkey % 101 AS INT) AS m, CAST(o_orderkey % 91 AS INT) AS s FROM orders) x")
def _(t):
    k = F.col("o_orderkey")
    return t.raw["orders"].select("o_orderkey", X.decode_mjd((51544 + k % 13992).cast("int"), (k % 37).cast("int"), (k % 101).cast("int"), (k % 91).cast("int")).alias("start_time"))


@query("x19_air_date", "SELECT ts_file_id, CASE WHEN ts_file_id % 2 = 0 THEN CAST(ingested_at AS DATE) ELSE CAST(ingested_at + INTERVAL 9 HOUR AS DATE) END AS air_date FROM ts_files")
def _(t):
    return t.ts_files.select("ts_file_id", X.air_date(F.when(F.col("ts_file_id") % 2 == 0, F.col("ingested_at")), F.col("ingested_at")).alias("air_date"))


@query("x20_parse_pts", "SELECT o_orderkey, (((b0 >> 1) & 7) << 30) | (b1 << 22) | ((b2 >> 1) << 15) | (b3 << 7) | (b4 >> 1) AS pts FROM (SELECT o_orderkey, o_orderkey * 7 % 256 AS b0, o_orderkey * 11 % 256 AS b1, o_orderkey * 13 % 256 AS b2, o_orderkey * 17 % 256 AS b3, o_orderkey * 19 % 256 AS b4 FROM orders) x")
def _(t):
    k = F.col("o_orderkey")
    return t.raw["orders"].select("o_orderkey", X.parse_pts(*[k * n % 256 for n in (7, 11, 13, 17, 19)]).alias("pts"))


@query("x22_active_q", f"SELECT ts_file_id, CASE WHEN octet_length(encode({trim('q')})) >= 2 THEN {trim('q')} END AS q FROM (SELECT ts_file_id, CASE ts_file_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN ' あ ' WHEN 2 THEN 'ab' ELSE '  ' END AS q FROM ts_files) x")
def _(t):
    i = F.col("ts_file_id")
    return t.ts_files.select("ts_file_id", X.active_query(F.when(i % 4 == 0, "a").when(i % 4 == 1, " あ ").when(i % 4 == 2, "ab").otherwise("  ")).alias("q"))


@query("x23_tag_trim_nonblank", f"SELECT DISTINCT caption_id, {trim('g')} AS tag FROM (SELECT caption_id, CASE WHEN pos % 2 = 0 THEN ' ' || tag || ' ' ELSE '  ' END AS g FROM tags JOIN captions USING (caption_id)) x WHERE {trim('g')} <> ''")
def _(t):
    g = t.tags.join(t.captions.select("caption_id", "pos"), "caption_id").select("caption_id", X.trim_u(F.when(F.col("pos") % 2 == 0, F.concat(F.lit(" "), "tag", F.lit(" "))).otherwise("  ")).alias("tag"))
    return g.where("tag <> ''").distinct()


@query("x24_cache_paths", "SELECT caption_id, printf('%d/thumbs/%d_%02d.jpg', ts_file_id, caption_id, pos % 6) AS thumb, printf('%d/full/%d_%02d.jpg', ts_file_id, caption_id, pos % 6) AS \"full\", printf('%d/preview/%d.jpg', ts_file_id, caption_id) AS preview, printf('%d/sub/%d.png', ts_file_id, caption_id) AS sub FROM captions")
def _(t):
    p = X.cache_paths(F.col("ts_file_id").cast("string"), F.col("caption_id"), F.col("pos") % 6)
    return t.captions.select("caption_id", p.alias("p")).select("caption_id", "p.thumb", "p.full", "p.preview", "p.sub")


@query("x25_sql_coalesce_case", "SELECT caption_id, coalesce(t.selected_frame, 6 // 2) + CAST(CASE WHEN c.pts_end - c.pts_start > 2400 THEN 1 ELSE 0 END AS INT) AS v FROM captions c LEFT JOIN thumbnails t USING (caption_id)")
def _(t):
    return search.framed(t.captions, t.thumbnails).select("caption_id", (F.col("preview_frame") + F.when(F.col("pts_end") - F.col("pts_start") > 2400, 1).otherwise(0)).alias("v"))


# frames

WS = "(pts_start / 1000.0::DOUBLE + 1.5::DOUBLE)"
END = "(pts_end / 1000.0::DOUBLE)"
WE = f"(CASE WHEN {END} > {WS} THEN {END} ELSE {WS} + 0.5::DOUBLE END)"
PRE = "greatest(pts_start / 1000.0::DOUBLE - 6.0::DOUBLE, 0.0::DOUBLE)"
FRAME = f"CAST(round(greatest({WS} + k * ({WE} - {WS}) / 5.0::DOUBLE - {PRE}, 0.0::DOUBLE) * (30000.0::DOUBLE / 1001.0::DOUBLE)) AS BIGINT)"


@query("m1_frame_indices", f"SELECT caption_id, k, {FRAME} AS frame FROM captions, (SELECT unnest(range(0, 6)) AS k) r")
def _(t):
    s, e = F.col("pts_start"), F.col("pts_end")
    return t.captions.select("caption_id", F.posexplode(timeline.frame_indices(s, e, 6)).alias("k", "frame")).select("caption_id", F.col("k").cast("long").alias("k"), "frame")


@query("m2_capture_window", f"SELECT caption_id, round(({WE} - {PRE}) + 0.5::DOUBLE, 6) AS seconds FROM captions")
def _(t):
    return t.captions.select("caption_id", F.round(timeline.capture_seconds(F.col("pts_start"), F.col("pts_end")), 6).alias("seconds"))


@query("m3_select_expr", f"SELECT caption_id, string_agg('eq(n\\,' || frame || ')', '+' ORDER BY k) AS expr FROM (SELECT caption_id, k, {FRAME} AS frame FROM captions, (SELECT unnest(range(0, 6)) AS k) r) x GROUP BY caption_id")
def _(t):
    return t.captions.select("caption_id", timeline.select_expr(timeline.frame_indices(F.col("pts_start"), F.col("pts_end"), 6)).alias("expr"))


@query("m6_rep_frame", f"SELECT caption_id, {FRAME.replace(' k *', ' 3 *')} AS frame FROM captions")
def _(t):
    return t.captions.select("caption_id", timeline.middle_frame(timeline.frame_indices(F.col("pts_start"), F.col("pts_end"), 6)).alias("frame"))


# packets

BYTES = "SELECT o_orderkey, CAST(o_orderkey * 7 % 256 AS INT) AS b1, CAST(o_orderkey * 11 % 256 AS INT) AS b2, CAST(o_orderkey * 13 % 256 AS INT) AS b3, CAST(o_orderkey * 29 % 256 AS INT) AS b4 FROM orders"


@query("b1_packet_header", f"SELECT o_orderkey, ((b1 & 31) << 8) | b2 AS pid, (b1 & 64) <> 0 AS pusi, (b3 >> 4) & 3 AS afc, CASE (b3 >> 4) & 3 WHEN 2 THEN NULL WHEN 3 THEN CASE WHEN 5 + b4 < 188 THEN 5 + b4 END ELSE 4 END AS payload_start FROM ({BYTES}) x")
def _(t):
    k = F.col("o_orderkey")
    b = [(k * n % 256).cast("int") for n in (7, 11, 13, 29)]
    h = packets.header(*b)
    return t.raw["orders"].select("o_orderkey", h.alias("h")).select("o_orderkey", "h.pid", "h.pusi", "h.afc", "h.payload_start")


# full text

@query("t2_fts_match", f"SELECT caption_id FROM captions WHERE {fold('text')} LIKE '%tion%'")
def _(t):
    return trigram.lookup(trigram.build(t.captions, trigram.grams_of("TION")), t.captions, "TION").select("caption_id")


# changes, as the state afterwards

FILES = "ts_file_id, path, status, error_msg, program_id, episode_number, pes_regen"


def _files(df):
    return df.select(*FILES.split(", "))


def _disk(t, where):
    """A listing: the paths of some files, and two new ones."""
    new = t.ts_files.sparkSession.createDataFrame([("/rec/new/a.ts",), ("/rec/new/skip_b.ts",)], "path string")
    return t.ts_files.where(where).select("path").unionByName(new)


@query("q3_scan_and_enqueue", "SELECT path, filename, status FROM ts_files WHERE ts_file_id % 10 <> 3 OR status = 'ingesting' UNION ALL SELECT '/rec/new/a.ts', 'a.ts', 'pending'")
def _(t):
    return mutate.enqueue(t, _disk(t, "ts_file_id % 10 <> 3"), exclude=("**/*skip*.ts",)).ts_files.select("path", "filename", "status")


@query("q4_delete_file_cascade", "SELECT 'ts_files' AS name, count(*) AS n FROM ts_files WHERE ts_file_id % 7 <> 0 UNION ALL SELECT 'captions', count(*) FROM captions WHERE ts_file_id % 7 <> 0 UNION ALL SELECT 'tags', count(*) FROM tags WHERE caption_id // 100000 % 7 <> 0 UNION ALL SELECT 'thumbnails', count(*) FROM thumbnails WHERE caption_id // 100000 % 7 <> 0")
def _(t):
    out = mutate.delete_files(t, t.ts_files.where("ts_file_id % 7 = 0").select("ts_file_id"))
    parts = [getattr(out, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("ts_files", "captions", "tags", "thumbnails")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("q5_reconcile_deleted", "SELECT program_id, title FROM programs WHERE program_id IN (SELECT program_id FROM ts_files WHERE program_id IS NOT NULL AND (ts_file_id % 3 = 0 OR status = 'ingesting'))")
def _(t):
    return mutate.reconcile_deleted(t, _disk(t, "ts_file_id % 3 = 0")).programs.select("program_id", "title")


@query("q6_enqueue_missing_pes", "SELECT ts_file_id, CAST(CASE WHEN status = 'done' AND pes_regen = 0 AND ts_file_id IN (SELECT ts_file_id FROM captions) AND ts_file_id % 4 <> 0 AND ts_file_id % 3 = 0 THEN 1 ELSE pes_regen END AS INT) AS pes_regen FROM ts_files")
def _(t):
    return mutate.enqueue_missing_pes(t, t.ts_files.where("ts_file_id % 4 = 0").select("ts_file_id"), _disk(t, "ts_file_id % 3 = 0")).ts_files.select("ts_file_id", "pes_regen")


def _reset(cond):
    return f"SELECT ts_file_id, path, CASE WHEN {cond} THEN 'pending' ELSE status END AS status, CASE WHEN NOT coalesce({cond}, false) THEN error_msg END AS error_msg, CASE WHEN NOT coalesce({cond}, false) THEN program_id END AS program_id, CASE WHEN NOT coalesce({cond}, false) THEN episode_number END AS episode_number, pes_regen FROM ts_files"


@query("q7_reset_file", _reset("ts_file_id % 6 = 0"))
def _(t):
    return _files(mutate.reset_files(t, t.ts_files.where("ts_file_id % 6 = 0").select("ts_file_id")).ts_files)


@query("q8_clear_subtitles", "SELECT ts_file_id, status, (SELECT count(*) FROM captions c WHERE c.ts_file_id = f.ts_file_id AND c.ts_file_id % 6 <> 0) AS caption_count FROM ts_files f")
def _(t):
    out = mutate.clear_subtitles(t, t.ts_files.where("ts_file_id % 6 = 0").select("ts_file_id"))
    return monitor.with_caption_count(out.ts_files, out.captions).select("ts_file_id", "status", "caption_count")


@query("q9_reset_program", _reset("program_id = 4"))
def _(t):
    return _files(mutate.reset_program(t, 4).ts_files)


@query("q10_crash_recovery", "SELECT ts_file_id, path, CASE WHEN status = 'ingesting' THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'ingesting' THEN error_msg END AS error_msg, program_id, episode_number, CAST(0 AS INT) AS pes_regen FROM ts_files")
def _(t):
    return _files(mutate.crash_recovery(t).ts_files)


@query("q11_apply_ingest_result", "SELECT f.ts_file_id, CASE WHEN f.status <> 'ingesting' THEN f.status WHEN f.ts_file_id % 3 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN f.status = 'ingesting' AND f.ts_file_id % 3 = 0 THEN 'no service' ELSE f.error_msg END AS error_msg, CASE WHEN f.status = 'ingesting' AND f.ts_file_id % 3 <> 0 THEN CASE WHEN f.ts_file_id % 2 = 0 THEN 'src1' ELSE 'a new one' END ELSE p.title END AS title FROM ts_files f LEFT JOIN programs p USING (program_id)")
def _(t):
    i = F.col("ts_file_id")
    r = t.ts_files.where("status = 'ingesting'").select("ts_file_id", F.when(i % 3 == 0, "no service").alias("error"), F.when(i % 2 == 0, "src1").otherwise("").alias("series_title"), F.lit("a new one").alias("title"), F.lit(1).alias("episode_number"), F.lit(None).cast("string").alias("episode_title"), F.lit(None).cast("date").alias("air_date"), F.lit(None).cast("timestamp_ntz").alias("ingested_at"))
    out = mutate.apply_results(t, r)
    return out.ts_files.join(out.programs.select("program_id", "title"), "program_id", "left").select("ts_file_id", "status", "error_msg", "title")


@query("q12_add_tag", "SELECT tag FROM (SELECT tag FROM tags WHERE caption_id = 500000 AND tag <> 'quality' UNION SELECT 'new tag') x ORDER BY tag")
def _(t):
    spark = t.tags.sparkSession
    return mutate.tags_of(mutate.delete_tag(mutate.add_tag(mutate.add_tag(t, 500000, " new tag ", spark), 500000, "new tag", spark), 500000, "quality"), 500000)


@query("q1_claim_pending", "SELECT ts_file_id, CASE WHEN ts_file_id IN (SELECT ts_file_id FROM ts_files WHERE status = 'pending' ORDER BY ts_file_id LIMIT 3) THEN 'ingesting' ELSE status END AS status FROM ts_files")
def _(t):
    return mutate.start(t, mutate.claim(t.ts_files, 3)).ts_files.select("ts_file_id", "status")


@query("q2_claim_regen", "SELECT ts_file_id, CAST(CASE WHEN r = 1 THEN 0 WHEN r IN (2, 3) THEN 2 ELSE pes_regen END AS INT) AS pes_regen FROM (SELECT ts_file_id, pes_regen, CASE WHEN pes_regen = 1 THEN row_number() OVER (PARTITION BY pes_regen ORDER BY ts_file_id) END AS r FROM ts_files) x")
def _(t):
    t = mutate.start_regen(t, mutate.claim_regen(t.ts_files, 3))
    done = t.ts_files.where("pes_regen = 2 and ts_file_id % 50 = 3").orderBy("ts_file_id").limit(1).select("ts_file_id")
    return mutate.finish_regen(t, done).ts_files.select("ts_file_id", "pes_regen")


@query("l8_limit1_claim", "SELECT ts_file_id FROM ts_files WHERE status = 'pending' ORDER BY ts_file_id LIMIT 1")
def _(t):
    return mutate.claim(t.ts_files)


@query("f13_glob_include_exclude", "SELECT path FROM ts_files WHERE path NOT LIKE '%7.ts' AND path LIKE '/rec/src%/%'")
def _(t):
    return mutate.by_globs(t.ts_files.select("path"), exclude=("**/*7.ts", "[broken"), include=("/rec/src*/*", "/none/*"))


@query("t1_fts_maintain", f"SELECT gram, count(*) AS n FROM (SELECT DISTINCT caption_id, substr({fold('text')}, i, 3) AS gram FROM (SELECT caption_id, text, unnest(range(1, greatest(length(text) - 1, 1))) AS i FROM captions WHERE caption_id % 7 <> 1) x) y GROUP BY gram")
def _(t):
    first, second = t.captions.where("caption_id % 7 < 3"), t.captions.where("caption_id % 7 >= 3")
    index = trigram.maintain(trigram.build(first), second, t.captions.where("caption_id % 7 = 1"))
    return index.groupBy("gram").agg(F.count("*").alias("n"))


@query("w5_frame_no", "SELECT caption_id, n, caption_id || '_' || (n + 1) || '.jpg' AS frame FROM (SELECT caption_id, unnest(range(0, selected_frame + 1)) AS n FROM thumbnails) x")
def _(t):
    files = F.transform(F.sequence(F.lit(1), F.col("selected_frame") + 1), lambda k: F.concat(F.col("caption_id").cast("string"), F.lit("_"), k.cast("string"), F.lit(".jpg")))
    return t.thumbnails.select("caption_id", F.inline(timeline.numbered(files))).select("caption_id", F.col("n").cast("long").alias("n"), F.col("file").alias("frame"))


# the API

@query("e1_index_programs", "SELECT program_id, title FROM programs p WHERE EXISTS (SELECT 1 FROM ts_files f JOIN captions c USING (ts_file_id) WHERE f.program_id = p.program_id) ORDER BY title, program_id")
def _(t):
    return facets.index_programs(t)


def search_sql(where: str, page: int = 0) -> str:
    tags = "coalesce((SELECT string_agg(tag, chr(10) ORDER BY tag) FROM tags g WHERE g.caption_id = c.caption_id), '')"
    return f"SELECT c.caption_id, c.ts_file_id, c.text, f.air_date, f.episode_number, c.pts_start, {shown('coalesce(p.title, f.filename)', 'f.episode_number', 'f.episode_title')} AS display_title, {fmt('c.pts_start')} || ' – ' || {fmt('c.pts_end')} AS time_range, CAST(CASE WHEN th.caption_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS has_thumb, coalesce(th.selected_frame, 3) AS preview_frame, {tags} AS tags {BASE} LEFT JOIN programs p USING (program_id) LEFT JOIN thumbnails th ON th.caption_id = c.caption_id WHERE {where} ORDER BY f.air_date DESC NULLS LAST, f.episode_number ASC NULLS FIRST, c.pts_start, c.caption_id LIMIT 50 OFFSET {page * 50}"


@query("e2_search", search_sql(f"{fold('c.text')} LIKE '%the%'"))
def _(t):
    return search.search(t, SearchParams(q="the"))


@query("e2_search_all_filters", search_sql(f"{fold('c.text')} LIKE '%en%' AND f.air_date >= DATE '2024-01-10' AND f.air_date <= DATE '2024-12-01' AND EXISTS (SELECT 1 FROM tags t WHERE t.caption_id = c.caption_id AND t.tag = 'quality') AND EXISTS (SELECT 1 FROM tags t WHERE t.caption_id = c.caption_id AND t.tag = 'en') AND EXISTS (SELECT 1 FROM thumbnails t WHERE t.caption_id = c.caption_id)"))
def _(t):
    return search.search(t, SearchParams(q="En", date_from="2024-01-10", date_to="2024-12-01", tags=["quality", "en"], filter="generated"))


@query("e2_search_page_2", search_sql("f.program_id = 8", 2))
def _(t):
    return search.search(t, SearchParams(program_id=8, page=2))


@query("e3_contact", f"SELECT c.caption_id, {shown('coalesce(p.title, f.filename)', 'f.episode_number', 'f.episode_title')} AS display_title, c.text, {fmt('c.pts_start')} || ' – ' || {fmt('c.pts_end')} AS time_range, coalesce(th.selected_frame, 3) AS preview_frame, '0,1,2,3,4,5' AS frames, coalesce((SELECT string_agg(tag, chr(10) ORDER BY tag) FROM tags g WHERE g.caption_id = c.caption_id), '') AS tags {BASE} LEFT JOIN programs p USING (program_id) LEFT JOIN thumbnails th ON th.caption_id = c.caption_id WHERE c.caption_id = 500000")
def _(t):
    return search.contact(t, 500000)


def episodes_sql(pid: int) -> str:
    return f"SELECT 'episode' AS kind, episode_number, episode_title, air_date FROM own WHERE (SELECT bool_or(episode_number IS NOT NULL) FROM own) UNION ALL SELECT 'subtitle', NULL, episode_title, min(air_date) FROM own WHERE episode_title IS NOT NULL AND NOT (SELECT coalesce(bool_or(episode_number IS NOT NULL), false) FROM own) GROUP BY episode_title"


def own_sql(pid: int) -> str:
    return f" own AS (SELECT * FROM ts_files f WHERE program_id = {pid} AND status = 'done' AND EXISTS (SELECT 1 FROM captions c WHERE c.ts_file_id = f.ts_file_id))"


@query("e4_episodes", episodes_sql(8), own_sql(8))
def _(t):
    return facets.episodes(t, 8)


@query("e4_episodes_subtitles", episodes_sql(5), own_sql(5))
def _(t):
    return facets.episodes(t, 5)


@query("e5_tag_options", "SELECT DISTINCT tag FROM tags ORDER BY tag")
def _(t):
    return facets.tag_options(t)


@query("e6_ingest_status", f"SELECT pending, ingesting, done, error, total, regenerating, (SELECT coalesce(string_agg(filename, chr(10) ORDER BY pes_regen DESC, filename), '') FROM ts_files WHERE pes_regen <> 0) AS regenerating_files, (SELECT coalesce(string_agg(filename || ': ' || coalesce(error_msg, '(unknown)'), chr(10) ORDER BY ts_file_id DESC), '') FROM (SELECT * FROM ts_files WHERE status = 'error' ORDER BY ingested_at DESC NULLS LAST, ts_file_id DESC LIMIT 5) e) AS recent_errors, (SELECT coalesce(string_agg(filename, chr(10) ORDER BY filename), '') FROM ts_files WHERE status = 'ingesting') AS ingesting_files, CASE WHEN total > 0 THEN done * 100 // total ELSE 0 END AS pct, {LABEL} AS label FROM counts", COUNTS)
def _(t):
    return monitor.ingest_status(t.ts_files)


@query("e7_ingest_files", f"SELECT ts_file_id, filename, status, ingested_at, {shown('coalesce(p.title, f.filename)')} AS display_title, (SELECT count(*) FROM captions c WHERE c.ts_file_id = f.ts_file_id) AS caption_count FROM ts_files f LEFT JOIN programs p USING (program_id) WHERE filename LIKE '%1%' ORDER BY ingested_at DESC NULLS LAST, ts_file_id DESC LIMIT 50")
def _(t):
    return monitor.ingest_files(t, "1")


@query("e8_ingest_file", "SELECT ts_file_id, filename, path, status, coalesce(p.title, f.filename) AS title, coalesce(error_msg, '(unknown)') AS error_msg, (SELECT count(*) FROM captions c WHERE c.ts_file_id = f.ts_file_id) AS caption_count FROM ts_files f LEFT JOIN programs p USING (program_id) WHERE ts_file_id = 5")
def _(t):
    return monitor.ingest_file(t, 5)
