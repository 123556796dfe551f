"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequent function words of English, Spanish, French and German.
STOP_WORDS = (
    "the and of to a in is that it for was on with as are be by this at from "
    "de que la el en las y los se del un por con para una no su al es "
    "le et des les du une pour est dans qui par au sur pas avec "
    "der die und den von das zu sich mit für nicht des auf ist im dem eine ein als"
).split()
GRAM = 5
#: White space that parts words, in the order of code points.
WHITE = "\t\n\x0b\f\r "


@dataclass(frozen=True)
class Rule:
    """A text fails if, having ``from_words`` words or more, its ratio is outside low..high."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0

    def fails(self) -> Column:
        ratio = F.col(self.numerator) / F.greatest(F.col(self.denominator), F.lit(1))
        out = F.lit(False)
        if self.low is not None:
            out = out | (ratio < F.lit(self.low))
        if self.high is not None:
            out = out | (ratio > F.lit(self.high))
        return out & (F.col("n_words") >= self.from_words)


#: The table of thresholds.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 10.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("words_with_letters", "n_letter_words", "n_words", 0.8, None, 30),
    Rule("upper_case_words", "n_upper_words", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None, 30),
    Rule("words_like_the_last", "n_same_words", "n_words", None, 0.25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.35),
)

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letter_words", "n_upper_words", "n_stop_words", "n_same_words", "n_repeat_words")


def _size_if(array: Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("long")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds a struct ``quality`` to docs (replacing a column of that name): the counts of FEATURES, base_failed,
    failed (names of the rules that the text fails) and kept.

    Words are runs of characters other than space and tab to carriage return. base_failed: fewer than 10
    words, or over a fifth of the words in 5-word windows that occur twice or more in the text. kept: not
    base_failed and no rule of the table fails. A null or empty text has no words and is base_failed; rows
    are independent, so ties and repeats need no rule; an empty table stays empty. Other columns pass
    through, whatever their names.
    """
    names = [c for c in docs.columns if c != "quality"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # one projection after another, so that what several expressions use is computed once
    step = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), text.alias("text"))
    bare = F.btrim(F.col("text"), F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    step = step.select("row", "text", words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    step = step.select(
        "row",
        "words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    h = F.col("hashes")
    gram = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - GRAM), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(GRAM))))
    step = step.withColumns(
        {
            "grams": F.when(F.col("n_words") >= GRAM, gram).otherwise(F.array().cast("array<bigint>")),
            "n_letter_words": _size_if(F.col("words"), lambda w: w.rlike("\\p{L}")),
            "n_upper_words": _size_if(F.col("words"), lambda w: (F.upper(w) == w) & (F.lower(w) != w)),
            "n_stop_words": _size_if(F.col("words"), lambda w: F.lower(w).isin(STOP_WORDS)),
            "n_same_words": _size_if(F.zip_with("hashes", F.slice("hashes", 2, F.greatest(F.size("hashes") - 1, F.lit(0))), lambda a, b: a == b), lambda same: same),
        }
    ).drop("hashes", "words")
    step = step.withColumn("twice", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("grams")
    # neighbours in the order of grams: equal ones are the windows found twice or more
    m = F.size("twice")
    lone = F.array(F.lit(None).cast("struct<g:bigint,i:int>"))
    beside = F.arrays_zip(F.col("twice").alias("own"), F.concat(lone, F.slice("twice", 1, m - 1)).alias("before"), F.concat(F.slice("twice", 2, m - 1), lone).alias("after"))
    same = F.filter(beside, lambda x: F.coalesce(x["before"]["g"] == x["own"]["g"], F.lit(False)) | F.coalesce(x["after"]["g"] == x["own"]["g"], F.lit(False)))
    step = step.withColumn("repeated", F.when(F.col("twice").isNotNull(), F.sort_array(F.transform(same, lambda x: x["own"]["i"])))).drop("twice")
    gaps = F.zip_with("repeated", F.slice("repeated", 2, F.size("repeated") - 1), lambda a, b: F.least(F.lit(GRAM), F.coalesce(b - a, F.lit(GRAM))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    step = step.withColumn("n_repeat_words", covered).drop("repeated")
    base = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(r.fails(), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")
    step = step.withColumns({"base_failed": base, "failed": failed})
    verdict = F.struct(*FEATURES, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
    return step.select("row", verdict.alias("verdict")).select("row.*", F.col("verdict").alias("quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that all rules keep.

    The rows are picked by a generator: a filter would be pushed below the projections, with all their
    expressions put into each other over and over.
    """
    judged = quality(docs.select(F.struct("*").alias("own"), "text"))
    return judged.select(F.explode(F.when(F.col("quality.kept"), F.array("own"))).alias("own")).select("own.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = F.col("quality")
    return quality(docs).select("doc_id", *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


ORACLE_SQL = """
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
g as (select doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] as g
      from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from d where len(words) >= 5)),
r as (select doc_id, i, count(*) over (partition by doc_id, g) as c from g),
v as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, i + unnest(range(0, 5)) as j from r where c > 1) group by doc_id),
l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
      from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
w as (select doc_id, unnest(words) as w, unnest(range(1, len(words) + 1)) as i from d),
p as (select doc_id, w, i, lag(w) over (partition by doc_id order by i) as before from w),
s as (select doc_id, count(*) as n_words, sum(length(w)) as word_chars, count(*) filter (where regexp_matches(w, '\\p{L}')) as n_letter,
      count(*) filter (where upper(w) = w and lower(w) <> w) as n_upper, count(*) filter (where lower(w) in (STOP)) as n_stop,
      count(*) filter (where before = w) as n_same from p group by doc_id),
f as (select d.doc_id, coalesce(s.n_words, 0)::bigint as n_words, coalesce(s.word_chars, 0)::bigint as word_chars,
      (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      coalesce(l.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(v.n_repeat_words, 0)::bigint as n_repeat_words, coalesce(l.n_lines, 0) as n_lines,
      coalesce(n_letter, 0) as n_letter, coalesce(n_upper, 0) as n_upper, coalesce(n_stop, 0) as n_stop, coalesce(n_same, 0) as n_same
      from d left join s using (doc_id) left join l using (doc_id) left join v using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, greatest(n_words, 1) as n from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars / n < 2.5 or word_chars / n > 10 or n_symbols / n > 0.1 or (n_letter / n < 0.8 and n_words >= 30)
       or n_upper / n > 0.5 or (n_stop / n < 0.05 and n_words >= 30) or n_same / n > 0.25 or n_dup_lines / greatest(n_lines, 1) > 0.35) as kept
from b
""".replace("STOP", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
