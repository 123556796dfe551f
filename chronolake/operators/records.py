"""Records from documents and back: parsing of results, migration of tables, labels by overlap, small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions import text as T
from chronolake.operators import intervals
from chronolake.operators.results import TERMINAL
from chronolake.operators.speakers import cosine

_SENTENCES = "struct<text:string,sentence_info:array<struct<start:double,end:double,text:string,spk:string>>>"


def sentences(results: DataFrame, key: str, body: str = "result") -> DataFrame:
    """Sentences of a model's JSON (an object, or a list whose first one counts): speaker SpeakerN from 0-based ids, else Speaker1;
    milliseconds; blank texts go. error instead for broken shapes: bad_json, no sentences with a text."""
    first = F.when(F.ltrim(body).startswith("["), F.get_json_object(body, "$[0]")).otherwise(F.col(body))
    rows = results.select(key, body, F.from_json(first, _SENTENCES).alias("r"), F.get_json_object(first, "$.sentence_info").alias("info"))
    listed, said = F.col("info").startswith("["), F.trim(F.coalesce("r.text", F.lit(""))) != ""
    empty_list = F.regexp_replace(body, r"\s", "") == "[]"
    has_text = F.get_json_object(first, "$.text").isNotNull()
    error = F.when(empty_list, F.lit(None)).when(F.col("r").isNull() | (F.col("info").isNull() & ~has_text), "bad_json").when(F.col("info").isNull() & said, "missing_sentences")
    error = error.when(F.col("info").isNotNull() & ~listed, "sentences_not_a_list").when(said & (F.size("r.sentence_info") == 0), "text_without_sentences")
    rows = rows.withColumn("error", error)
    one = rows.select(key, "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("r.sentence_info"))).alias("pos", "s"))
    number = F.col("s.spk").try_cast("int")
    speaker = F.concat(F.lit("Speaker"), (F.coalesce(number, F.lit(0)) + 1).cast("string"))
    ms = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0.0)).cast("long")
    out = one.select(key, "error", F.col("pos").cast("long").alias("pos"), speaker.alias("speaker"), F.trim("s.text").alias("text"), ms("start").alias("start_ms"), ms("end").alias("end_ms"))
    return out.filter("error is not null or text <> ''")


def json_turns(documents: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Turns of a document: diarization_turns, or else segments; speakers are numbers at the end of labels, from 0."""
    kind = "array<struct<start:double,end:double,speaker:string>>"
    rows = documents.select(key, F.coalesce(*(F.from_json(F.get_json_object(body, f"$.{c}"), kind) for c in ("diarization_turns", "segments"))).alias("t"))
    rows = rows.select(key, F.posexplode("t").alias("pos", "x"))
    number = F.regexp_extract("x.speaker", r"(\d+)\s*$", 1).try_cast("int")
    ms = lambda c: F.bround(F.col(f"x.{c}") * 1000, 0).cast("long")
    return rows.select(key, F.col("pos").cast("long").alias("pos"), F.when(F.col("x.speaker").rlike("[A-Za-z]"), F.greatest(number - 1, F.lit(0))).otherwise(number).alias("speaker"), ms("start").alias("start_ms"), ms("end").alias("end_ms"))


def migrated(old: DataFrame, defaults: dict) -> DataFrame:
    """A table with all columns of ``defaults``: those it lacks are added, and nulls take the default."""
    return old.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in old.columns else F.lit(v) for c, v in defaults.items()})


def label_items(items: DataFrame, turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Speaker of each item (pos): that of the turn of largest overlap (confidence: its share of the item), else of the shortest turn
    around its middle (0.5), else of the turn with the nearest edge (0). Ties: the earlier turn. Turns of a recording are one array
    only for items without an overlap."""
    pairs = intervals.overlap_join(items.select(key, "pos", "start_ms", "end_ms"), turns.select(key, "pos", "speaker", "start_ms", "end_ms"), key)
    best = pairs.groupBy(key, F.col("l_pos").alias("pos")).agg(F.min(F.struct((-F.col("overlap_ms")).alias("o"), F.col("r_pos").alias("p"), F.col("r_speaker").alias("speaker"), (F.col("l_end_ms") - F.col("l_start_ms")).alias("span"))).alias("b"))
    found = best.select(key, "pos", "b.speaker", F.least(F.lit(1.0), -F.col("b.o") / F.greatest(F.col("b.span"), F.lit(1))).alias("confidence"))
    alone = items.select(key, "pos", "start_ms", "end_ms").join(best, [key, "pos"], "left_anti")
    all_turns = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "start_ms", "end_ms", "speaker"))).alias("t"))
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    around = F.array_min(F.transform(F.filter("t", lambda x: (x["start_ms"] <= mid) & (mid <= x["end_ms"])), lambda x: F.struct((x["end_ms"] - x["start_ms"]).alias("d"), x["pos"].alias("p"), x["speaker"].alias("speaker"))))
    near = F.array_min(F.transform("t", lambda x: F.struct(F.least(F.abs(x["start_ms"] - mid), F.abs(x["end_ms"] - mid)).alias("d"), x["pos"].alias("p"), x["speaker"].alias("speaker"))))
    rest = alone.join(all_turns, key).select(key, "pos", F.coalesce(around["speaker"], near["speaker"]).alias("speaker"), F.when(around.isNotNull(), 0.5).otherwise(0.0).alias("confidence"))
    return found.unionByName(rest)


def aligned_runs(items: DataFrame, least: float = 0.5, key: str = "conv_id") -> DataFrame:
    """items: key, pos, speaker, confidence, start_ms, end_ms, text. Runs of one speaker with the largest end, the joined text
    and the number of items below ``least``."""
    order = Window.partitionBy(key).orderBy("pos")
    new = (F.row_number().over(order) == 1) | ~F.lag("speaker").over(order).eqNullSafe(F.col("speaker"))
    rows = items.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    runs = rows.groupBy(key, "run").agg(F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count_if(F.col("confidence") < least).alias("low"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return runs.withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), "")).drop("t")


def piece_of(words: DataFrame, pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """The piece (of pieces without overlap) that holds each word's middle: half open, but for a recording's last piece."""
    last = F.max("end_ms").over(Window.partitionBy(key)) == F.col("end_ms")
    double = pieces.withColumn("last", last).select(key, "pos", "last", (F.col("start_ms") * 2).alias("start_ms"), (F.col("end_ms") * 2).alias("end_ms"))
    mid = F.col("start_ms") + F.col("end_ms")
    dots = words.select(key, "pos", mid.alias("mid"), (mid - 1).alias("start_ms"), (mid + 1).alias("end_ms"))
    hit = intervals.overlap_join(dots, double, key, 10_000).filter("r_start_ms <= l_mid and (l_mid < r_end_ms or (r_last and l_mid = r_end_ms))")
    return hit.select(key, F.col("l_pos").alias("pos"), F.col("r_pos").alias("piece"))


def jumps(vectors: DataFrame, key: str, order: str, label: str, far: float = 0.5) -> DataFrame:
    """Cosine distance of each vector to the one before, and whether both have one label and lie far apart."""
    w = Window.partitionBy(key).orderBy(order)
    rows = vectors.withColumns({"before": F.lag("embedding").over(w), "was": F.lag(label).over(w)}).filter("before is not null")
    rows = rows.withColumn("distance", 1 - cosine(F.col("embedding"), F.col("before")))
    return rows.withColumn("suspect", (F.col(label) == F.col("was")) & (F.col("distance") > far)).drop("before", "was")


def spoken_srt(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """segments: key, pos, speaker (number from 0), text, start_s, end_s. Subtitles with the speaker before each text; blank texts are
    left out but keep their numbers, and milliseconds round half to even (they may show as 1000)."""

    def clock(s: Column) -> Column:
        whole = F.floor(s)
        return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, F.rint((s - whole) * 1000).cast("long"))

    rows = segments.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.trim("text") != "")
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), clock(F.col("start_s")), F.lit(" --> "), clock(F.col("end_s")), F.lit("\nSpeaker"), (F.col("speaker") + 1).cast("string"), F.lit(": "), F.trim("text"), F.lit("\n"))
    parts = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", block.alias("l")))).alias("p"))
    return parts.select(key, F.array_join(F.transform("p", lambda x: x["l"]), "\n").alias("srt"))


def srt(sentences: DataFrame, key: str = "conv_id") -> DataFrame:
    """SRT of raw sentences: numbers count all of them, also blank ones that aren't shown."""
    rows = sentences.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.trim("text") != "")
    line = F.concat(F.col("n").cast("string"), F.lit("\n"), T.clock(F.col("start_ms")), F.lit(" --> "), T.clock(F.col("end_ms")), F.lit("\n"), F.trim("text"))
    parts = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", line.alias("l")))).alias("p"))
    return parts.select(key, F.array_join(F.transform("p", lambda x: x["l"]), "\n\n").alias("srt"))


def moved(segments: DataFrame, offset_ms: Column) -> DataFrame:
    return segments.withColumns({c: F.col(c) + offset_ms for c in ("start_ms", "end_ms")})


def external(segments: DataFrame) -> DataFrame:
    """Numbered speakers (from 0) as labels, times in seconds with two places (half to even)."""
    second = lambda c: F.bround(F.col(c) / 1000, 2)
    return segments.withColumns({"speaker": F.concat(F.lit("Speaker"), (F.col("speaker") + 1).cast("string")), "start_time": second("start_ms"), "end_time": second("end_ms")}).drop("start_ms", "end_ms")


def without_turns(chunks: DataFrame, texts: DataFrame, key: str = "conv_id") -> DataFrame:
    """Segments of recordings without turns: their chunks with a text, or else the whole text over the duration_ms."""
    some = chunks.filter(F.trim("text") != "").select(key, "pos", "text", "start_ms", "end_ms")
    rest = texts.filter(F.trim("text") != "").join(some.select(key).distinct(), key, "left_anti")
    return some.unionByName(rest.select(key, F.lit(0).cast("long").alias("pos"), "text", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms")))


def cancelled(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Tasks that someone asked to cancel and that aren't over yet are cancelled; unknown ids change nothing."""
    asked = requests.select("task_id").distinct().withColumn("asked", F.lit(True))
    stop = F.col("asked") & ~F.col("status").isin(*TERMINAL)
    return tasks.join(asked, "task_id", "left").withColumn("status", F.when(stop, "cancelled").otherwise(F.col("status"))).drop("asked")


def snapshot(tasks: DataFrame, key: str) -> DataFrame:
    """Gauges by status, and a map of all counts."""
    counts = tasks.groupBy(key, "status").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s)
    return counts.groupBy(key).agg(pick("pending"), pick("processing"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("totals"))


def parity(found: DataFrame, keys: list[str], backend: str, speaker: str) -> DataFrame:
    """Whether all backends find the same number of speakers for each source and cut."""
    n = found.groupBy(*keys, backend).agg(F.countDistinct(speaker).alias("n"))
    return n.groupBy(*keys).agg(F.count(F.lit(1)).alias("backends"), F.min("n").alias("fewest"), F.max("n").alias("most")).withColumn("equal", F.col("fewest") == F.col("most"))


def stage_totals(timings: DataFrame, stage: str, seconds: str) -> DataFrame:
    return timings.groupBy(stage).agg(F.sum(seconds).alias("total"), F.count(F.lit(1)).alias("n"))


def term_error(terms: Column, clean: Column) -> Column:
    """The first limit that raw terms or, normalised, clean ones break, else null: 100 items, 256 characters each; then
    50 terms, 64 characters each, 1024 in all."""
    total = F.aggregate(clean, F.lit(0), lambda s, t: s + F.length(t))
    longest = lambda a, n: F.exists(a, lambda t: F.length(t) > n)
    raw = F.when(F.size(terms) > 100, "too_many_raw_items").when(longest(terms, 256), "raw_item_too_long")
    return raw.when(F.size(clean) > 50, "too_many_terms").when(longest(clean, 64), "term_too_long").when(total > 1024, "total_too_long")


def glossary(text: Column, pairs: list[tuple[str, str]], patterns: tuple = ()) -> Column:
    """Replaces each pair's first by its second, in order, then patterns."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern, new in patterns:
        text = F.regexp_replace(text, pattern, new)
    return text
