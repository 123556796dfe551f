"""Text functions on columns."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: White space as Unicode has it, with the separators of the first 32 characters.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def clock(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm, in integers (no value loses or gains a millisecond)."""
    ms = ms.cast("long")
    pad = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(pad(ms / 3_600_000, 2), F.lit(":"), pad((ms / 60_000) % 60, 2), F.lit(":"), pad((ms / 1000) % 60, 2), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


@F.pandas_udf(Y.ArrayType(Y.StringType()))
def nfkc_terms(lists: pd.Series) -> pd.Series:
    """Terms in compatibility normal form, which has no built-in."""
    return lists.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in ts])


def normalize_terms(terms: Column) -> Column:
    """Terms in compatibility normal form, trimmed, with white space collapsed, without empty and repeated ones (the
    first stays)."""
    clean = F.transform(nfkc_terms(terms), lambda t: F.trim(F.regexp_replace(t, BLANKS, " ")))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def _first_unit(text: str, sizes: range, times: int) -> str | None:
    """The unit of the first phrase said ``times`` times in a row: a run of (times - 1) x size characters, each of which equals
    the one ``size`` places on. Linear in the text for each size."""
    codes = np.frombuffer("".join(text.split()).encode("utf-32-le", "surrogatepass"), np.uint32)
    for size in sizes:
        if len(codes) < size * times:
            return None
        breaks = np.flatnonzero(codes[size:] != codes[:-size])
        begins = np.append(0, breaks + 1)
        long = np.flatnonzero(np.append(breaks, len(codes) - size) - begins >= (times - 1) * size)
        if len(long):
            at = begins[long[0]]
            return codes[at : at + size].tobytes().decode("utf-32-le", "surrogatepass")
    return None


def first_repetition(text: Column, sizes: range = range(2, 13), times: int = 6) -> Column:
    """The unit of the first phrase said ``times`` times in a row, smallest size first; null without one. White
    space doesn't count."""

    @F.arrow_udf(Y.StringType())
    def unit(texts: pa.Array) -> pa.Array:
        return pa.array((_first_unit(t.as_py(), sizes, times) if t.is_valid else None for t in texts), pa.string())

    return unit(text)


def rounded(number: Column, places: int) -> Column:
    """A number that isn't negative, rounded half up as a double: what is compared with a half is the product by the power of ten."""
    scaled = number * 10.0**places
    down = F.floor(scaled)
    return (down + (scaled - down >= 0.5).cast("int")) / 10.0**places


def unit_ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def processing_timeout(seconds: Column) -> Column:
    """300 + 0.3 x duration, within 600..3600 seconds; 1200 where the duration is unknown."""
    return F.coalesce(F.least(F.greatest(F.lit(300) + seconds * 0.3, F.lit(600)), F.lit(3600)).cast("int"), F.lit(1200))


def rttm_line(recording: Column, start_ms: Column, end_ms: Column, speaker: Column) -> Column:
    """One line of a speaker turn, times in seconds with three places."""
    seconds = lambda ms: F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.concat_ws(" ", F.lit("SPEAKER"), recording, F.lit("1"), seconds(start_ms), seconds(end_ms - start_ms), F.lit("<NA>"), F.lit("<NA>"), speaker, F.lit("<NA>"), F.lit("<NA>"))
