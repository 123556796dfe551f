"""Jobs around the engine: answers from the cache, requests, counters, alerts, configuration and benchmark reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.text import rounded

#: Formats that a request may ask for.
FORMATS = ("json", "srt")
DIGEST = r"^[0-9a-fA-F]{32}$"


def effective_option(requested: Column, default: Column) -> Column:
    """Three states: what a request says, true or false, comes before the default; null follows it."""
    return F.coalesce(requested, default)


def hit_metadata(hits: DataFrame) -> DataFrame:
    """hits: output_format, body (JSON of the cached result). Adds usable (an SRT request needs a cached SRT), and
    for usable ones projected and merged (for JSON from the metadata; SRT never has merged segments)."""
    srt = F.col("output_format") == "srt"
    flag = lambda path: F.coalesce(F.get_json_object("body", path) == "true", F.lit(False))
    usable = ~srt | F.coalesce(F.get_json_object("body", "$.format") == "srt", F.lit(False))
    rows = hits.withColumn("usable", usable)
    return rows.withColumns({"projected": F.when(srt, usable & flag("$.projected")).otherwise(flag("$.metadata.projected")), "merged": ~srt & flag("$.metadata.segment_merge_applied")})


def task_from_hit(hits: DataFrame) -> DataFrame:
    """Task rows of usable hits: an SRT has its content and no segments, its duration (0 if unknown) and no processing
    time; JSON has the cached segments as they are."""
    rows = hit_metadata(hits).filter("usable")
    srt, number = F.col("output_format") == "srt", lambda p: F.get_json_object("body", p).cast("double")
    return rows.withColumns(
        {
            "content": F.when(srt, F.get_json_object("body", "$.content")),
            "segments": F.when(srt, F.lit("[]")).otherwise(F.get_json_object("body", "$.segments")),
            "duration": F.when(srt, F.coalesce(number("$.duration"), F.lit(0.0))).otherwise(number("$.duration")),
            "processing_time": F.when(srt, F.lit(0.0)).otherwise(number("$.processing_time")),
        }
    )


def touched(cache: DataFrame, reads: DataFrame) -> DataFrame:
    """cache with accessed_min as the latest of its own and those of reads (id, at_min)."""
    last = reads.groupBy("id").agg(F.max("at_min").alias("at_min"))
    return cache.join(last, "id", "left").withColumn("accessed_min", F.greatest("accessed_min", "at_min")).drop("at_min")


def answered_meanwhile(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """Tasks (file_hash, queued_min, start_min) that the cache can answer when they start, though it couldn't
    when they were queued: hit (the first result stored in between) is null for the others."""
    # where nothing was stored by the time of queueing, the first of all results is the first one in between
    first = cache.filter("created_min is not null").groupBy("file_hash").agg(F.min(F.struct("created_min", "id")).alias("m"))
    known = F.coalesce(F.col("m.created_min") <= F.col("queued_min"), F.lit(False))
    between = (F.col("m.created_min") > F.col("queued_min")) & (F.col("m.created_min") <= F.col("start_min"))
    return tasks.distinct().join(first, "file_hash", "left").select(*tasks.columns, F.when(~known & between, F.col("m.id")).alias("hit"))


def request_error(size: Column, digest: Column, output_format: Column, extension: Column, most: int, extensions: tuple[str, ...]) -> Column:
    """The first rule that a request breaks, else null."""
    broken = [(size.isNull() | (size <= 0), "empty_file"), (size > most, "file_too_large"), (~F.coalesce(digest.rlike(DIGEST), F.lit(False)), "bad_hash")]
    broken += [(~F.coalesce(output_format.isin(*FORMATS), F.lit(False)), "invalid_output_format"), (~F.coalesce(F.lower(extension).isin(*extensions), F.lit(False)), "invalid_format")]
    out = F.when(*((broken[0][0], broken[0][1])))
    for test, name in broken[1:]:
        out = out.when(test, name)
    return out


def waiting_ranges(tasks: DataFrame, key: str) -> DataFrame:
    """tasks: key, queue_position, wait_s, refused. How many wait and were refused, and the ranges of places and
    times, in which 0 and null don't count."""
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    ranges = [f(some(c)).alias(f"{n}_{c}") for c in ("queue_position", "wait_s") for n, f in (("least", F.min), ("most", F.max))]
    return tasks.groupBy(key).agg(F.count_if(F.col("queue_position").isNotNull()).alias("waiting"), F.count_if("refused").alias("refused"), *ranges)


def counters(events: DataFrame, key: str, order: list[str], coarse: Column) -> DataFrame:
    """The value of a key's counter after each of its events. coarse: a value that never falls along ``order``, such as the hour.
    Events are counted by key and coarse value, and numbered within them from the sum of those before, so a key with most of
    the events is no single task."""
    rows = events.withColumn("__coarse", coarse)
    sums = rows.groupBy(key, "__coarse").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("__key"), F.col("__coarse").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(key, "__coarse").orderBy(*order))
    numbered = rows.withColumn("__own", own).join(sums, F.col(key).eqNullSafe(F.col("__key")) & F.col("__coarse").eqNullSafe(F.col("__at")))
    return numbered.withColumn("value", F.col("__before") + F.col("__own")).drop("__coarse", "__key", "__at", "__before", "__own")


def probe_alerts(probes: DataFrame, key: str, order: str, ratio: float, surge: int) -> DataFrame:
    """probes: key, order, reachable, health, queue, queue_max, errors (null: not known). Per probe whether server_down,
    queue_saturation and error_surge fire; null where a rule keeps its state, as what it needs is not known. The first
    known count of errors is the baseline."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("reachable") & F.col("errors").isNotNull()
    errors = F.when(known, F.col("errors"))
    rise = F.when(known, errors - F.last(errors, True).over(before))
    full = F.coalesce((F.col("queue_max") > 0) & (F.col("queue") / F.col("queue_max") >= ratio), F.lit(False))
    return probes.withColumns({"server_down": ~F.col("reachable") | ~F.coalesce(F.col("health") == "healthy", F.lit(False)), "queue_saturation": F.when(known, full), "error_surge": F.when(rise.isNotNull(), rise >= surge)})


def sent_states(alerts: DataFrame, key: str, order: str) -> DataFrame:
    """alerts: key, order, name, at, delivered. The state that is kept: only alerts that were delivered advance it."""
    sent = F.max(F.when(F.col("delivered"), F.struct(order, "name"))).alias("m")
    return alerts.groupBy(key).agg(sent, F.count_if(~F.col("delivered")).alias("lost")).select(key, F.col(f"m.{order}").alias("last"), F.col("m.name").alias("name"), "lost")


def age_seconds(now: Column, completed: Column, created: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(F.coalesce(completed, created))


def progress(elapsed: Column, duration: Column, speed: float = 10.0) -> Column:
    """Percent by the time that a recording should take, from 10 to 85 at most."""
    return F.least(F.lit(10) + F.try_divide(elapsed, duration / speed) * 80, F.lit(85.0)).cast("int")


def heartbeat(beats: Column) -> Column:
    """Percent after some heartbeats: from 5 by 3 to 95."""
    return F.least(F.lit(5) + beats * 3, F.lit(95))


def cluster_shares(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Raw clusters of each recording: how many, the number of turns, and seconds and shares, largest first (ties: the
    speaker that comes first)."""
    own = turns.groupBy(key, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    found = own.groupBy(key).agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("turns"), F.sum("ms").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("ms")).alias("down"), "first"))).alias("l"))
    seconds = F.transform("l", lambda x: rounded(-x["down"] / 1000, 2))
    shares = F.transform("l", lambda x: F.when(F.col("total") > 0, rounded(-x["down"] / F.col("total"), 4)).otherwise(0.0))
    return found.select(key, "clusters", "turns", seconds.alias("seconds"), shares.alias("shares"))


def samples(segments: DataFrame, most: int, ends: int = 5, key: str = "conv_id") -> DataFrame:
    """Of each recording its speakers' ``most`` longest segments, and its first and last ones (a limit of the report)."""
    longest = F.row_number().over(Window.partitionBy(key, "speaker").orderBy(F.desc(F.col("end_ms") - F.col("start_ms")), "pos"))
    first, last = (F.row_number().over(Window.partitionBy(key).orderBy(o)) for o in ("pos", F.desc("pos")))
    rows = segments.withColumns({"by_length": longest, "from_first": first, "from_last": last})
    return rows.filter((F.col("by_length") <= most) | (F.col("from_first") <= ends) | (F.col("from_last") <= ends))


def first_runnable(chunks: DataFrame, most: int, key: str = "conv_id") -> DataFrame:
    """chunks: key, chunk, runs. Only the first ``most`` that run still do; all rows stay."""
    n = F.sum(F.col("runs").cast("int")).over(Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("runs", F.col("runs") & (n <= most))


def without_comments(settings: Column) -> Column:
    """A map of settings without the keys that begin with _comment. Keys of nested settings are joined by dots."""
    return F.map_filter(settings, lambda k, v: ~k.rlike(r"(^|\.)_comment"))


def layered(*layers: Column) -> Column:
    """Maps of settings, later ones before earlier ones, key by key: a null wins too, a value takes the place of the settings
    below it, and a setting below a value takes the value's place."""

    def over(low: Column, high: Column) -> Column:
        hidden = lambda k: F.exists(F.map_keys(high), lambda p: (p == k) | F.startswith(k, F.concat(p, F.lit("."))) | F.startswith(p, F.concat(k, F.lit("."))))
        return F.map_concat(F.map_filter(low, lambda k, v: ~hidden(k)), high)

    out = layers[0]
    for layer in layers[1:]:
        out = over(out, layer)
    return out


def profile(name: Column, profiles: dict[str, dict[str, str | None]]) -> Column:
    """The settings of a named profile; none where the name is empty or unknown. Names are trimmed and in lower case."""
    empty = F.create_map().cast("map<string,string>")
    out = F.when(F.lit(False), empty)
    for known, settings in profiles.items():
        own = F.create_map(*(F.lit(x).cast("string") for kv in settings.items() for x in kv))
        out = out.when(F.lower(F.trim(name)) == known, own)
    return out.otherwise(empty)


def prompt(prefix: str, terms: Column) -> Column:
    """Terms behind a prefix, one a line; null without any."""
    return F.when(F.size(terms) > 0, F.concat(F.lit(prefix), F.array_join(terms, "\n")))


def capability_id(engine: Column, runtime: Column, terms: Column, version: int) -> Column:
    """SHA-256 of the canonical JSON (sorted keys, no blanks) of what an engine can do."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    body = F.concat(F.lit('{"engine":'), quoted(engine), F.lit(',"features":{"terms":'), terms.cast("string"), F.lit('},"runtime":'), quoted(runtime), F.lit(f',"schema_version":{version}}}'))
    return F.sha2(body, 256)


def log_reference(connection: Column) -> Column:
    return F.substring(F.sha2(connection, 256), 1, 16)


def is_cjk(text: Column) -> Column:
    return text.rlike(r"^[\x{4E00}-\x{9FFF}]")


def align_error(raw: Column) -> Column:
    """raw.word_align.error, only where raw is an object."""
    return F.when(F.substring(F.ltrim(raw), 1, 1) == "{", F.get_json_object(raw, "$.word_align.error"))


def free_memory(log: Column) -> Column:
    """The first line of a memory query as a number, null if it isn't one."""
    return F.regexp_extract(log, r"^\s*(\d+)\s*(?:\n|$)", 1).try_cast("int")


def process_memory(log: Column, pid: Column) -> Column:
    """Sum of what the lines "pid, MiB" of a process say; 0 without any, null if a line can't be read."""
    lines = F.filter(F.split(log, "\n"), lambda x: F.trim(x) != "")
    number = lambda x, k: F.trim(F.regexp_extract(x, "^([^,]*),(.*)$", k)).try_cast("long")
    rows = F.transform(lines, lambda x: F.struct(number(x, 1).alias("pid"), number(x, 2).alias("used")))
    spoilt = F.exists(rows, lambda r: r["pid"].isNull() | ((r["pid"] == pid) & r["used"].isNull()))
    return F.when(~spoilt, F.aggregate(F.filter(rows, lambda r: r["pid"] == pid), F.lit(0).cast("long"), lambda s, r: s + r["used"]))



def hypothesis(segments: DataFrame, normalized: Column, key: str = "conv_id") -> DataFrame:
    """Per character of the normalised texts, in order: its place in the whole (from 0), speaker and segment (from 0)."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(key).orderBy("pos")
    rows = segments.select(key, "pos", "speaker", normalized.alias("norm"))
    rows = rows.withColumns({"before": F.coalesce(F.sum(F.length("norm")).over(order), F.lit(0)), "segment": F.row_number().over(every) - 1})
    rows = rows.filter("norm <> ''").select(key, "speaker", "segment", "before", F.posexplode(F.filter(F.split("norm", ""), lambda c: c != "")).alias("i", "ch"))
    return rows.select(key, (F.col("before") + F.col("i")).alias("n"), "ch", "speaker", "segment")


def run_summary(runs: DataFrame, windows: DataFrame, segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """runs: key, audio_s, elapsed_s; windows: key, processed_s; segments: key, speaker. Real-time factors over the whole
    audio and over what was processed (0 if nothing was), segments and distinct speakers, sorted."""
    done = windows.groupBy(key).agg(F.sum("processed_s").alias("processed_s"), F.count(F.lit(1)).alias("windows"))
    said = segments.groupBy(key).agg(F.count(F.lit(1)).alias("segments"), F.sort_array(F.collect_set("speaker")).alias("speakers"))
    rows = runs.join(done, key, "left").join(said, key, "left")
    ratio = lambda c: F.coalesce(F.try_divide("elapsed_s", c), F.lit(0.0))
    return rows.select(key, ratio("audio_s").alias("rtf_audio"), ratio("processed_s").alias("rtf_processed"), F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("segments", F.lit(0)).alias("segments"), "speakers")


def benchmark_rows(summaries: DataFrame, body: str, stages: list[str]) -> DataFrame:
    """summaries: JSON of a run in column ``body``. A Markdown row of each of its tasks: label, wall and duration in
    seconds, real-time factor, segments, and the seconds of stages (0 where one is missing)."""
    schema = "struct<tasks: map<string, struct<meta: struct<wall: double, duration: double, rtf: double, n_segments: long>, totals: map<string, double>>>>"
    rows = summaries.select("*", F.explode(F.from_json(body, schema)["tasks"]).alias("label", "task"))
    number = lambda c, n: F.format_string(f"%.{n}f", F.bround(F.coalesce(c, F.lit(0.0)), n))
    meta = F.col("task.meta")
    cells = [F.col("label"), number(meta["wall"], 1), number(meta["duration"], 0), number(meta["rtf"], 3), F.coalesce(meta["n_segments"], F.lit(0)).cast("string")]
    cells += [number(F.element_at(F.col("task.totals"), F.lit(s)), 1) for s in stages]
    return rows.withColumn("row", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))).drop("task")
