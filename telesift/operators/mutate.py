"""Changes as transforms from one snapshot of the tables to the next.

Each function takes Tables and returns Tables; nothing is updated in place, so a failed job leaves the old state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import normalize_title, program_key
from ..sources.tables import Tables


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], first: list[str] | None = None) -> DataFrame:
    """old with the rows of new whose key is not there yet; of equal keys in new the first by `first` stays."""
    w = Window.partitionBy(*key).orderBy(*(first or key))
    new = new.where(" and ".join(f"{k} is not null" for k in key)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(*new.columns), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """old overwritten by the last row of new of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    last = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*old.columns)
    return old.join(last.select(*key), key, "left_anti").select(*old.columns).unionByName(last)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_anti")


def require(files: DataFrame, ids: DataFrame) -> None:
    """An error if an id is not there."""
    gone = [r[0] for r in ids.join(files.select("ts_file_id"), "ts_file_id", "left_anti").limit(5).collect()]
    if gone:
        raise KeyError(f"no such file: {gone}")


def drop_captions(t: Tables, ids: DataFrame) -> Tables:
    """Without the captions of files, and without their tags and frames, as a cascade does."""
    gone = t.captions.join(ids, "ts_file_id", "left_semi").select("caption_id")
    return t.with_(captions=without(t.captions, ids, "ts_file_id"), tags=without(t.tags, gone, "caption_id"), thumbnails=without(t.thumbnails, gone, "caption_id"))


def delete_files(t: Tables, ids: DataFrame) -> Tables:
    """Files go with all that belongs to them; unknown ids change nothing."""
    return drop_captions(t, ids).with_(ts_files=without(t.ts_files, ids, "ts_file_id"))


def purge_programs(t: Tables) -> Tables:
    """Without programmes that no file has."""
    used = t.ts_files.where(F.col("program_id").isNotNull()).select("program_id").distinct()
    return t.with_(programs=t.programs.join(used, "program_id", "left_semi"))


def reconcile_deleted(t: Tables, on_disk: DataFrame, mounted: bool = True) -> Tables:
    """Without files that are no longer on disk, unless the listing is empty or the mount is gone.  Running ones stay."""
    if not mounted or on_disk.isEmpty():
        return t
    gone = t.ts_files.where(F.col("status").isin("done", "error", "pending")).join(on_disk.select("path"), "path", "left_anti").select("ts_file_id")
    if gone.isEmpty():
        return t
    return purge_programs(delete_files(t, gone))


def known_paths(files: DataFrame) -> DataFrame:
    return files.where(F.col("status").isin("done", "error", "ingesting")).select("path")


def glob_regex(pattern: str) -> str:
    """A pattern of *, **, ?, [..] as a regular expression; * and ? also match a slash."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            out.append(".*")
            i += 2 if pattern.startswith("**", i) else 1
            continue
        if c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        elif c == "[":
            raise ValueError(f"unclosed bracket in {pattern}")
        else:
            out.append("\\" + c if c in r"\.^$|()+{}" else c)
        i += 1
    return "^" + "".join(out) + "$"


def _regexes(patterns) -> list[str]:
    """Patterns that are not valid are left out."""
    out = []
    for p in patterns:
        try:
            out.append(glob_regex(p))
        except ValueError:
            continue
    return out


def by_globs(paths: DataFrame, exclude: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> DataFrame:
    """Paths that no exclude pattern matches and, if there are include patterns, one of them does."""
    for r in _regexes(exclude):
        paths = paths.where(~F.col("path").rlike(r))
    wanted = _regexes(include)
    if wanted:
        hit = F.lit(False)
        for r in wanted:
            hit = hit | F.col("path").rlike(r)
        paths = paths.where(hit)
    return paths


def last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def next_ids(df: DataFrame, old: DataFrame, key: str, order: str) -> DataFrame:
    """df with ids that go on from the largest of old.

    Rows are numbered within cells of a hash of `order` (unique), and at most 65,536 counts say where each cell starts;
    so no task sees all rows, and a retry gives the same ids.
    """
    top = old.agg(F.coalesce(F.max(key), F.lit(-1)).alias("_top"))
    cells = df.withColumn("_cell", F.pmod(F.xxhash64(order), F.lit(1 << 16)))
    size = cells.groupBy("_cell").agg(F.count("*").alias("_n"))
    start = size.select(F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy(order))
    out = cells.withColumn("_i", within).join(F.broadcast(start), F.col("_cell") == F.col("_c")).crossJoin(F.broadcast(top))
    return out.withColumn(key, F.col("_top") + F.col("_start") + F.col("_i")).drop("_top", "_cell", "_c", "_start", "_i")


def enqueue(t: Tables, on_disk: DataFrame, exclude: tuple[str, ...] = (), include: tuple[str, ...] = (), mounted: bool = True) -> Tables:
    """Reconciled, then with a pending file for each new path."""
    t = reconcile_deleted(t, on_disk, mounted)
    new = by_globs(on_disk.select("path").distinct(), exclude, include)
    new = new.join(known_paths(t.ts_files), "path", "left_anti").join(t.ts_files.select("path"), "path", "left_anti")
    new = next_ids(new.withColumns({"filename": last_part(F.col("path")), "status": F.lit("pending"), "pes_regen": F.lit(0)}), t.ts_files, "ts_file_id", "path")
    return t.with_(ts_files=t.ts_files.unionByName(new, allowMissingColumns=True))


def enqueue_missing_pes(t: Tables, blobs: DataFrame, on_disk: DataFrame) -> Tables:
    """Done files that have captions and a source but no stored caption stream are marked for making it again."""
    due = t.ts_files.where("status = 'done' and pes_regen = 0").select("ts_file_id", "path").join(t.captions.select("ts_file_id"), "ts_file_id", "left_semi").join(blobs.select("ts_file_id"), "ts_file_id", "left_anti").join(on_disk.select("path"), "path", "left_semi")
    return t.with_(ts_files=marked(t.ts_files, due.select("ts_file_id"), {"pes_regen": F.lit(1)}))


def marked(files: DataFrame, ids: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """files with columns changed where the id is among ids."""
    hit = ids.select(F.col("ts_file_id").alias("_id")).distinct()
    types = dict(files.dtypes)
    out = files.join(hit, F.col("ts_file_id") == F.col("_id"), "left")
    return out.select(*[F.when(F.col("_id").isNotNull(), changes[c]).otherwise(F.col(c)).cast(types[c]).alias(c) if c in changes else F.col(c) for c in files.columns])


def claim(files: DataFrame, most: int | None = 1) -> DataFrame:
    """Ids of the next pending files, or of all; Spark's tasks share the work, so a batch is claimed at once."""
    due = files.where("status = 'pending'").select("ts_file_id")
    return due if most is None else due.orderBy("ts_file_id").limit(most)


def start(t: Tables, ids: DataFrame) -> Tables:
    return t.with_(ts_files=marked(t.ts_files, ids, {"status": F.lit("ingesting")}))


def claim_regen(files: DataFrame, most: int | None = 1) -> DataFrame:
    due = files.where("pes_regen = 1").select("ts_file_id")
    return due if most is None else due.orderBy("ts_file_id").limit(most)


def finish_regen(t: Tables, ids: DataFrame) -> Tables:
    """Idle again, whatever came of making the caption stream; the next listing queues a file that still lacks one."""
    return t.with_(ts_files=marked(t.ts_files, ids, {"pes_regen": F.lit(0)}))


def start_regen(t: Tables, ids: DataFrame) -> Tables:
    return t.with_(ts_files=marked(t.ts_files, ids, {"pes_regen": F.lit(2)}))


def reset_files(t: Tables, ids: DataFrame, strict: bool = True) -> Tables:
    """Back to pending, without captions and metadata; an unknown id is an error."""
    if strict:
        require(t.ts_files, ids)
    null = F.lit(None)
    changes = {"status": F.lit("pending"), "error_msg": null, "ingested_at": null, "program_id": null, "episode_number": null, "episode_title": null, "air_date": null}
    return drop_captions(t, ids).with_(ts_files=marked(t.ts_files, ids, changes))


def reset_program(t: Tables, program_id: int) -> Tables:
    return reset_files(t, t.ts_files.where(F.col("program_id") == program_id).select("ts_file_id"), strict=False)


def clear_subtitles(t: Tables, ids: DataFrame) -> Tables:
    """Without captions and tags; the files stay as they are."""
    return drop_captions(t, ids)


def crash_recovery(t: Tables) -> Tables:
    """What was running when the process died is pending again."""
    running = F.col("status") == "ingesting"
    files = t.ts_files.withColumns({"error_msg": F.when(running, None).otherwise(F.col("error_msg")), "status": F.when(running, "pending").otherwise(F.col("status")), "pes_regen": F.lit(0)})
    return t.with_(ts_files=files.select(*t.ts_files.columns))


def keyed(results: DataFrame) -> DataFrame:
    """results with the title of the programme that each belongs to; null for none."""
    return results.withColumn("_key", F.nullif(program_key(F.col("series_title"), F.col("title")), F.lit("")))


def added_programs(programs: DataFrame, results: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """New rows of programs for results whose title is not there yet.  top: a row with the largest id used so far."""
    keys = keyed(results).where("error is null and _key is not null").select(F.col("_key").alias("title")).distinct().join(programs.select("title"), "title", "left_anti")
    return next_ids(keys.withColumn("normalized_title", normalize_title("title")), programs if top is None else top, "program_id", "title").select(*programs.columns)


def with_outcome(files: DataFrame, programs: DataFrame, results: DataFrame) -> DataFrame:
    """files with the outcome of those that results name; an error changes only status and message."""
    r = keyed(results).join(programs.select(F.col("title").alias("_key"), F.col("program_id").alias("_pid")), "_key", "left")
    r = r.select(F.col("ts_file_id").alias("_id"), F.col("error").alias("_error"), "_pid", F.col("episode_number").alias("_ep"), F.col("episode_title").alias("_et"), F.col("air_date").alias("_air"), F.col("ingested_at").alias("_at"))
    f = files.join(r, F.col("ts_file_id") == F.col("_id"), "left")
    good, bad = F.col("_id").isNotNull() & F.col("_error").isNull(), F.col("_error").isNotNull()
    put = {"status": F.when(good, "done").when(bad, "error").otherwise(F.col("status")), "error_msg": F.when(bad, F.col("_error")).otherwise(F.col("error_msg"))}
    for c, new in (("program_id", "_pid"), ("episode_number", "_ep"), ("episode_title", "_et"), ("air_date", "_air"), ("ingested_at", "_at")):
        put[c] = F.when(good, F.col(new)).otherwise(F.col(c))
    return f.select(*[put[c].alias(c) if c in put else F.col(c) for c in files.columns])


def apply_results(t: Tables, results: DataFrame, captions: DataFrame | None = None) -> Tables:
    """Outcome of ingesting: results (ts_file_id, error, series_title, title, episode_number, episode_title, air_date, ingested_at).

    Programmes are added by their key.  A file with an error gets only status and message.
    """
    programs = t.programs.unionByName(added_programs(t.programs, results))
    return t.with_(programs=programs, ts_files=with_outcome(t.ts_files, programs, results), captions=t.captions if captions is None else t.captions.unionByName(captions, allowMissingColumns=True))


def add_tag(t: Tables, caption_id: int, tag: str, spark: SparkSession) -> Tables:
    """With a tag; a blank one changes nothing."""
    tag = tag.strip()
    if not tag:
        return t
    return t.with_(tags=insert_or_ignore(t.tags, spark.createDataFrame([(caption_id, tag)], "caption_id long, tag string"), ["caption_id", "tag"]))


def delete_tag(t: Tables, caption_id: int, tag: str) -> Tables:
    return t.with_(tags=t.tags.where(~((F.col("caption_id") == caption_id) & (F.col("tag") == tag))))


def tags_of(t: Tables, caption_id: int) -> DataFrame:
    return t.tags.where(F.col("caption_id") == caption_id).select("tag").orderBy("tag")


def select_frame(t: Tables, chosen: DataFrame) -> Tables:
    """With the last chosen frame of each caption: (caption_id, selected_frame, seq)."""
    return t.with_(thumbnails=upsert(t.thumbnails, chosen, ["caption_id"], "seq"))
