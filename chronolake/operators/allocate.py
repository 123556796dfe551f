"""Text over time: texts dealt to turns, and long segments cut at silences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators import intervals

STOPS = "。？！；!?;"


def linear_split(texts: DataFrame, turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """texts: key, text. Each turn (in order of its start) takes text by its share of all turns' time, rounded half to
    even; the last one takes the rest. Texts without turns make one piece at 0 of speaker 0; without any time, none."""
    order = Window.partitionBy(key).orderBy("start_ms", "pos")
    span = F.col("end_ms") - F.col("start_ms")
    every = Window.partitionBy(key)
    t = turns.withColumns({"span": span, "cum": F.sum(span).over(order), "total": F.sum(span).over(every), "last": F.row_number().over(order) == F.count(F.lit(1)).over(every)})
    rows = texts.filter("text <> ''").join(t, key, "left").withColumn("speaker", F.col("speaker").cast("string"))
    alone = F.col("pos").isNull()
    rows = rows.filter(alone | (F.col("total") > 0))
    n = F.length("text")
    end = F.when(alone | F.col("last"), n).otherwise(F.greatest(F.lit(0), F.least(n, F.bround(F.col("cum") * n / F.col("total"), 0).cast("int"))))
    rows = rows.withColumn("end", F.greatest(end, F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    begin = F.coalesce(F.lag("end").over(order), F.lit(0))
    piece = F.substring("text", begin + 1, F.col("end") - begin)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(key, zero("pos"), F.coalesce("speaker", F.lit("0")).alias("speaker"), zero("start_ms"), zero("end_ms"), piece.alias("text"))


def boundary(text: Column, target: Column, search: Column) -> Column:
    """Position after the sentence mark nearest to target within search (ties: the earlier), else target."""
    n = F.length(text)
    low, high = F.greatest(F.lit(1), target - search), F.least(n - 1, target + search)
    spots = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    stops = F.filter(spots, lambda i: F.lit(STOPS).contains(F.substring(text, i, F.lit(1))))
    best = F.array_min(F.transform(stops, lambda i: F.struct(F.abs(i - target).alias("d"), i.alias("i"))))
    return F.when(target <= 0, 0).when(target >= n, n).otherwise(F.coalesce(best["i"], target))


def weighted_split(text: Column, weights: Column) -> Column:
    """The text's pieces by weights; a cut moves to a sentence mark near it (within half of the piece, 2 to 18)."""
    clean = F.transform(weights, lambda w: F.greatest(F.lit(0.0), w.cast("double")))
    summed = lambda a: F.aggregate(a, F.lit(0.0), lambda s, w: s + w)
    even = F.transform(weights, lambda w: F.lit(1.0))
    used = F.when(summed(clean) > 0, clean).otherwise(even)
    total = summed(used)
    begin = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("acc"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        acc = s["acc"] + w
        target = F.greatest(s["at"], F.bround(F.length(text) * acc / total, 0).cast("int"))
        search = F.least(F.lit(18), F.greatest(F.lit(2), F.bround((target - s["at"]) * 0.5, 0).cast("int")))
        cut = boundary(text, target, search)
        return F.struct(cut.alias("at"), acc.alias("acc"), F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, cut - s["at"]))).alias("out"))

    heads = F.slice(used, F.lit(1), F.greatest(F.size(used) - 1, F.lit(0)))
    done = F.aggregate(heads, begin, step, lambda s: F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, F.length(text)))))
    return F.when(F.size(weights) == 0, F.array().cast("array<string>")).otherwise(done)


def chunk_turns(chunks: DataFrame, turns: DataFrame, least_ms: int = 30, key: str = "conv_id") -> DataFrame:
    """Chunks (pos, text) dealt to the turns that they overlap by more than least_ms, by length; a chunk without one goes
    to the turn with the nearest edge to its middle (ties: the earlier turn), and to speaker 0 where there are no turns.
    Empty pieces are left out."""
    good = chunks.filter("text <> '' and end_ms > start_ms").select(key, "pos", "text", "start_ms", "end_ms")
    pairs = intervals.overlap_join(good, turns.select(key, "pos", "speaker", "start_ms", "end_ms"), key, least_ms=least_ms)
    cut = F.struct(F.col("r_start_ms").alias("by"), F.col("r_pos").alias("turn"), F.greatest("l_start_ms", "r_start_ms").alias("start_ms"), F.least("l_end_ms", "r_end_ms").alias("end_ms"), F.col("r_speaker").alias("speaker"))
    found = pairs.groupBy(key, F.col("l_pos").alias("pos")).agg(F.sort_array(F.collect_list(cut)).alias("cuts"))
    # Turns of one recording, for chunks that overlap none.
    lone = good.join(found, [key, "pos"], "left_anti")
    edges = turns.groupBy(key).agg(F.collect_list(F.struct("start_ms", "end_ms", "pos", "speaker")).alias("t"))
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    near = F.array_min(F.transform("t", lambda t: F.struct(F.least(F.abs(t["start_ms"] - mid), F.abs(t["end_ms"] - mid)).alias("d"), t["start_ms"].alias("s"), t["pos"].alias("p"), t["speaker"].alias("speaker"))))
    alone = lone.join(edges, key, "left").select(key, "pos", F.array(F.struct(F.lit(0).cast("long").alias("by"), F.lit(0).cast("long").alias("turn"), "start_ms", "end_ms", F.coalesce(near["speaker"], F.lit("0")).alias("speaker"))).alias("cuts"))
    rows = good.select(key, "pos", "text").join(found.unionByName(alone), [key, "pos"])
    rows = rows.withColumn("parts", weighted_split(F.col("text"), F.transform("cuts", lambda c: c["end_ms"] - c["start_ms"])))
    zipped = F.transform("cuts", lambda c, i: F.struct(c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), c["speaker"].alias("speaker"), F.get("parts", i).alias("text")))
    out = rows.select(key, "pos", F.posexplode(zipped).alias("part", "z")).select(key, "pos", F.col("part").cast("long").alias("part"), "z.speaker", "z.start_ms", "z.end_ms", "z.text")
    return out.filter("text <> ''")


def cut_points(start: Column, end: Column, candidates: Column, most: int, least: int) -> Column:
    """Cuts of start..end into pieces of ``most`` or less: near the equal points, at the nearest candidate that leaves
    room (ties: the earlier), else where it must be; pieces are never shorter than ``least``. cuts and the number of hard ones."""
    span = (end - start).cast("double")
    n = F.ceil(span / most).cast("int")
    begin = F.struct(start.cast("double").alias("prev"), F.array().cast("array<double>").alias("cuts"), F.lit(0).alias("hard"), F.lit(False).alias("over"))

    def step(s: Column, i: Column) -> Column:
        left = n - i
        low, high = F.greatest(s["prev"] + least, end - most * left), F.least(s["prev"] + most, end - least * left)
        over = s["over"] | (low > high + 1e-9)
        target = start + span * i / n
        fit = F.filter(candidates, lambda c: (c >= low - 1e-9) & (c <= high + 1e-9))
        best = F.array_min(F.transform(fit, lambda c: F.struct(F.abs(c - target).alias("d"), c.cast("double").alias("c"))))["c"]
        cut = F.coalesce(best, F.least(F.greatest(target, low), high)).cast("double")
        short = cut - s["prev"] < least - 1e-9
        hard = s["hard"] + F.when(over | best.isNotNull(), 0).otherwise(1)
        skip = over | short
        return F.struct(F.when(skip, s["prev"]).otherwise(cut).alias("prev"), F.when(skip, s["cuts"]).otherwise(F.concat(s["cuts"], F.array(cut))).alias("cuts"), hard.alias("hard"), over.alias("over"))

    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, begin, step, lambda s: F.struct(s["cuts"].alias("cuts"), s["hard"].alias("hard")))


def split_long(segments: DataFrame, silences: DataFrame, most_ms: int, least_ms: int, key: str = "conv_id") -> DataFrame:
    """Segments longer than most_ms cut at the middles of silences (by a range join) or hard; texts by length of pieces."""
    long = segments.filter((F.col("end_ms") - F.col("start_ms") > most_ms) & (F.trim("text") != ""))
    mids = silences.select(key, ((F.col("start_ms") + F.col("end_ms")) / 2).alias("mid"))
    dots = mids.select(key, "mid", F.floor("mid").alias("start_ms"), (F.floor("mid") + 1).alias("end_ms"))
    inner = long.select(key, "pos", (F.col("start_ms") + least_ms).alias("start_ms"), (F.col("end_ms") - least_ms).alias("end_ms"))
    # A millisecond of slack on both sides, then the exact bounds.
    wide = inner.withColumns({"low": F.col("start_ms"), "high": F.col("end_ms"), "start_ms": F.col("start_ms") - 1, "end_ms": F.col("end_ms") + 1})
    hits = intervals.overlap_join(wide, dots, key).filter("r_mid between l_low and l_high").groupBy(key, F.col("l_pos").alias("pos")).agg(F.sort_array(F.collect_list("r_mid")).alias("mids"))
    rows = segments.select(key, "pos", "speaker", "text", "start_ms", "end_ms").join(hits, [key, "pos"], "left")
    none = F.struct(F.array().cast("array<double>").alias("cuts"), F.lit(0).alias("hard"))
    is_long = (F.col("end_ms") - F.col("start_ms") > most_ms) & (F.trim("text") != "")
    cuts = cut_points(F.col("start_ms"), F.col("end_ms"), F.coalesce("mids", F.array().cast("array<double>")), most_ms, least_ms)
    rows = rows.withColumn("c", F.when(is_long, cuts).otherwise(none))
    edges = F.concat(F.array(F.col("start_ms").cast("double")), F.col("c.cuts"), F.array(F.col("end_ms").cast("double")))
    rows = rows.withColumn("edges", edges)
    spans = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.element_at("edges", i + 1) - F.element_at("edges", i))
    rows = rows.withColumn("spans", spans).withColumn("parts", weighted_split(F.col("text"), F.col("spans")))
    piece = F.transform("parts", lambda t, i: F.struct(F.get("edges", i).alias("start_ms"), F.get("edges", i + 1).alias("end_ms"), t.alias("text")))
    return rows.select(key, "pos", "speaker", F.col("c.hard").alias("hard_cuts"), F.posexplode(piece).alias("piece", "p")).select(key, "pos", "piece", "speaker", "hard_cuts", "p.start_ms", "p.end_ms", "p.text")


def snap(segments: DataFrame, silences: DataFrame, tolerance_ms: int = 2000, least_ms: int = 100, key: str = "conv_id") -> DataFrame:
    """Starts and ends move to the middle of the nearest silence closer than tolerance_ms, unless they lie in one already or
    the segment would get shorter than least_ms; a first start and a last end stay. The end is judged by the new start."""
    order = Window.partitionBy(key).orderBy("pos")
    rows = segments.withColumns({"first": F.row_number().over(order) == 1, "last": F.lead("pos").over(order).isNull()})
    points = rows.select(key, F.explode(F.array("start_ms", "end_ms")).alias("at_ms")).distinct()
    # Twice the middle is an integer; the scans of nearest_boundary find the nearest on either side.
    mids = silences.select(key, (F.col("start_ms") + F.col("end_ms")).alias("at_ms"))
    near = intervals.nearest_boundary(points.select(key, (F.col("at_ms") * 2).alias("at_ms")), mids, 2 * tolerance_ms - 1, key)
    near = near.select(key, F.expr("at_ms div 2").alias("at_ms"), (F.col("target_ms") / 2).alias("mid"))
    inside = intervals.overlap_join(points.select(key, F.col("at_ms").alias("pos"), (F.col("at_ms") - 1).alias("start_ms"), (F.col("at_ms") + 1).alias("end_ms")), silences.select(key, F.lit(0).alias("pos"), "start_ms", "end_ms"), key)
    inside = inside.filter("l_pos between r_start_ms and r_end_ms").select(key, F.col("l_pos").alias("at_ms")).distinct()
    goal = near.join(inside, [key, "at_ms"], "left_anti").filter("mid is not null")
    left, right = (goal.select(key, F.col("at_ms").alias(c), F.col("mid").alias(m)) for c, m in (("start_ms", "start_mid"), ("end_ms", "end_mid")))
    rows = rows.join(left, [key, "start_ms"], "left").join(right, [key, "end_ms"], "left")
    start = F.when(~F.col("first") & (F.col("end_ms") - F.col("start_mid") >= least_ms), F.col("start_mid")).otherwise(F.col("start_ms").cast("double"))
    rows = rows.withColumn("new_start", start)
    end = F.when(~F.col("last") & (F.col("end_mid") - F.col("new_start") >= least_ms), F.col("end_mid")).otherwise(F.col("end_ms").cast("double"))
    return rows.withColumn("new_end", end).drop("first", "last", "start_mid", "end_mid")
