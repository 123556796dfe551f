"""Readers of text formats as columns: silence logs, metrics, clocks, labels, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def silence_log(logs: DataFrame, key: str, log: str = "log", duration: str = "duration_ms", least_ms: int = 100) -> DataFrame:
    """Speech regions from a silence detector's log: ends pair with starts in order (those before any open start are left out), a
    start without an end lasts to the duration, and regions of least_ms or less go."""
    lines = logs.select(key, duration, F.posexplode(F.split(log, "\n")).alias("n", "line"))
    seconds = lambda p: (F.try_to_number(F.nullif(F.regexp_extract("line", p + r": ([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")), F.lit("999999999.999999")) * 1000).cast("long")
    marks = lines.withColumns({"from_ms": seconds("silence_start"), "to_ms": seconds("silence_end")})
    # The n-th end closes the n-th start, without the ends that come before any open start: those are counted by the largest surplus of ends so far.
    order = Window.partitionBy(key).orderBy("n")
    marks = marks.filter("from_ms is not null or to_ms is not null").withColumns({"starts": F.count("from_ms").over(order), "ends": F.count(F.when(F.col("from_ms").isNull(), 1)).over(order)})
    marks = marks.withColumn("lost", F.greatest(F.lit(0), F.max(F.col("ends") - F.col("starts")).over(order)))
    marks = marks.withColumn("fits", F.col("lost") == F.coalesce(F.lag("lost").over(order), F.lit(0)))
    starts = marks.filter("from_ms is not null").select(key, duration, "from_ms", F.col("starts").alias("nth"))
    ends = marks.filter("from_ms is null and fits").select(key, "to_ms", (F.col("ends") - F.col("lost")).alias("nth"))
    silences = starts.join(ends, [key, "nth"], "left").select(key, F.col("from_ms").alias("start_ms"), F.coalesce("to_ms", duration).alias("end_ms"))
    tail = logs.select(key, F.col(duration).alias("start_ms"), F.col(duration).alias("end_ms"))
    before = Window.partitionBy(key).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    rows = silences.unionByName(tail).withColumn("cursor", F.coalesce(F.max("end_ms").over(before), F.lit(0)))
    return rows.filter(F.col("start_ms") - F.col("cursor") > least_ms).select(key, F.col("cursor").alias("start_ms"), F.col("start_ms").alias("end_ms"))


_METRIC = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)"


def metrics(scrapes: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """name, label (the first label's value, null without labels) and value of each metric line; comments and lines
    that don't parse are left out, and the last line of a name and label holds."""
    lines = scrapes.select(*keys, F.posexplode(F.split(text, "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    part = lambda i: F.regexp_extract("line", _METRIC, i)
    rows = lines.filter(~F.col("line").startswith("#") & (part(1) != "")).select(*keys, "n", part(1).alias("name"), part(2).alias("labels"), part(3).try_cast("double").alias("value"))
    first = F.regexp_extract("labels", r'[a-zA-Z_][a-zA-Z0-9_]*="([^"]*)"', 1)
    has = F.col("labels").rlike(r'[a-zA-Z_][a-zA-Z0-9_]*="')
    rows = rows.filter(F.col("value").isNotNull() & ((F.col("labels") == "") | has)).withColumn("label", F.when(has, first))
    return rows.groupBy(*keys, "name", "label").agg(F.max_by("value", "n").alias("value"))


def exposition(rows: DataFrame, keys: list[str], prefix: str = "engine") -> DataFrame:
    """rows: keys, name, kind (gauge or counter), help, label_name, label, value. One text of each key: HELP and TYPE
    of each name, then its lines by label; rows without a value are left out."""
    name = F.concat(F.lit(f"{prefix}_"), F.col("name"))
    tag = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("{"), "label_name", F.lit('="'), "label", F.lit('"}')))
    lines = rows.filter("value is not null").withColumn("line", F.concat(name, tag, F.lit(" "), F.col("value").cast("string")))
    blocks = lines.groupBy(*keys, "name").agg(F.first("help").alias("help"), F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("label", "line"))).alias("l"))
    head = F.array(F.concat(F.lit("# HELP "), name, F.lit(" "), "help"), F.concat(F.lit("# TYPE "), name, F.lit(" "), "kind"))
    blocks = blocks.withColumn("block", F.array_join(F.concat(head, F.transform("l", lambda x: x["line"])), "\n"))
    texts = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("name", "block"))).alias("b"))
    return texts.select(*keys, F.concat(F.array_join(F.transform("b", lambda x: x["block"]), "\n"), F.lit("\n")).alias("text"))


def paired_silences(logs: DataFrame, keys: list[str], log: str = "log", strict: bool = False) -> DataFrame:
    """Silences of a detector's log, in milliseconds: an end closes the last start since the end before it. strict: lines count
    only with a plain number, ends only with a bar after it; otherwise any line that names a start or an end counts, and where its
    number can't be read its silence is lost."""
    number, tail = (r":\s*(-?[0-9.]+)", r"\s*\|") if strict else (r":\s*(\S+)", "")
    lines = logs.select(*keys, F.posexplode(F.split(log, "\r?\n")).alias("n", "line"))
    ms = lambda p: F.round(F.regexp_extract("line", p, 1).try_cast("double") * 1000).try_cast("long")
    start, end = f"silence_start{number}", f"silence_end{number}{tail}"
    is_start, is_end = F.col("line").rlike(start if strict else "silence_start"), F.col("line").rlike(end if strict else "silence_end")
    marks = lines.withColumn("mark", F.when(is_start, F.struct(F.lit(True).alias("opens"), ms(start).alias("ms"))).when(is_end, F.struct(F.lit(False).alias("opens"), ms(end).alias("ms")))).filter("mark is not null")
    rows = marks.withColumn("before", F.lag("mark").over(Window.partitionBy(*keys).orderBy("n")))
    rows = rows.filter("not mark.opens and before.opens and mark.ms is not null and before.ms is not null")
    return rows.select(*keys, F.col("before.ms").alias("start_ms"), F.col("mark.ms").alias("end_ms"))


def window_silences(logs: DataFrame, keys: list[str], log: str = "log", start: str = "from_ms", end: str = "to_ms", least_ms: int = 500, least_window_ms: int = 1000) -> DataFrame:
    """Silences of at least least_ms in logs of windows (start, end), on the clock of the whole recording; windows below
    least_window_ms have none."""
    rows = paired_silences(logs.filter(F.col(end) - F.col(start) >= least_window_ms), [*keys, start], log)
    rows = rows.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)
    return rows.select(*keys, start, (F.col(start) + F.col("start_ms")).alias("start_ms"), (F.col(start) + F.col("end_ms")).alias("end_ms"))


#: Readings of the power log and their units.
SHARES, MILLIWATTS = ("GPU HW active residency",), ("ANE Power", "CPU Power", "GPU Power")


def sensors(logs: DataFrame, key: str, log: str = "log") -> DataFrame:
    """Mean, maximum and number of each reading in a power log (per cent and milliwatts); readings that a log lacks have no row."""
    share, power = "|".join(SHARES), "|".join(MILLIWATTS)
    pattern = rf"({share}|{power}):\s+([\d.]+)(%|\s*mW)"
    part = lambda i, name: F.regexp_extract_all(log, F.lit(pattern), i).alias(name)
    rows = logs.select(key, F.explode(F.arrays_zip(part(1, "name"), part(2, "value"), part(3, "unit"))).alias("r"))
    rows = rows.select(key, "r.name", F.col("r.value").try_cast("double").alias("value"), (F.col("r.unit") == "%").alias("share"))
    rows = rows.filter(F.col("value").isNotNull() & (F.col("share") == F.col("name").isin(*SHARES)))
    return rows.groupBy(key, "name").agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))


def summed(values: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of each metric over its labels; those without a label aren't part of it."""
    return values.filter("label is not null").groupBy(*keys, "name").agg(F.sum("value").alias("value"))


def last_clock(text: Column) -> Column:
    """Seconds of the last time=HH:MM:SS.ff of a log; null without one."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(r"time=(\d+:\d+:\d+(?:\.\d+)?)"), 1), F.lit(-1))
    p = F.split(last, ":")
    return F.try_element_at(p, F.lit(1)).cast("double") * 3600 + F.try_element_at(p, F.lit(2)).cast("double") * 60 + F.try_element_at(p, F.lit(3)).cast("double")


def duration(container: Column, stream: Column, log: Column) -> Column:
    """First known duration that is finite and not negative."""
    good = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf")), c)
    return F.coalesce(*(good(c) for c in (container.try_cast("double"), stream.try_cast("double"), last_clock(log))))


def speaker_number(label: Column) -> Column:
    """Number of a label such as Speaker3 (3); null without digits at its end."""
    return F.regexp_extract(label, r"(\d+)$", 1).try_cast("int")


def buffer_gb(message: Column) -> Column:
    """Size named by an allocation error, in GB."""
    size = lambda unit: F.regexp_extract(message, rf"(\d+(?:\.\d+)?) ?{unit}", 1).try_cast("double")
    return F.coalesce(size("GB"), size("GiB"), size("MB") / 1024, size("MiB") / 1024)


def transcript(files: DataFrame, key: str, speakers: tuple, text: str = "text") -> DataFrame:
    """Paragraphs of transcripts: after the second --- line, a line that names one of the speakers begins a paragraph and
    other lines go on with it; lines before the first are left out."""
    lines = files.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    order = Window.partitionBy(key).orderBy("n")
    marks = lines.withColumn("marks", F.sum((F.col("line") == "---").cast("int")).over(order)).filter("marks >= 2 and line <> '---' and line <> ''")
    named = r"^(" + "|".join(speakers) + r")：(.*)$"
    rows = marks.withColumn("who", F.nullif(F.regexp_extract("line", named, 1), F.lit(""))).withColumn("para", F.count("who").over(order))
    said = F.when(F.col("who").isNull(), F.col("line")).otherwise(F.regexp_extract("line", named, 2))
    parts = rows.filter("para > 0").groupBy(key, "para").agg(F.min_by("who", "n").alias("speaker"), F.sort_array(F.collect_list(F.struct("n", said.alias("t")))).alias("l"))
    return parts.select(key, "para", "speaker", F.array_join(F.transform("l", lambda x: x["t"]), "").alias("text"))
