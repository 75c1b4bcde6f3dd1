"""Text and record functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of required fields and the reserved key.
REQUIRED = ("body", "category", "id", "rating")
DUMMY = "__dummy"


def words(text: Column) -> Column:
    """Split at non-word characters (ASCII), then lower-case and trim; empty parts go."""
    return F.filter(F.transform(F.split(text, r"\W+"), lambda w: F.trim(F.lower(w))), lambda w: w != "")


def word_counts(text: Column) -> Column:
    return F.size(words(text))


def split_sentences(rows: DataFrame, text: str, user: str) -> DataFrame:
    """(user, word, 1) for every word."""
    return rows.select(F.col(user).alias("user"), F.explode(words(F.col(text))).alias("word"), F.lit(1).cast("long").alias("count"))


def required_fields(record: Column, names=REQUIRED) -> Column:
    """Whether a JSON object has every field, none null; malformed text has none."""
    out = F.lit(True)
    for n in names:
        out = out & F.get_json_object(record, f"$.{n}").isNotNull()
    return F.coalesce(out, F.lit(False))


def user_key(user: Column) -> Column:
    return F.sha2(F.concat(F.lit("user:"), user.cast("string")), 256)


def word_key(word: Column) -> Column:
    return F.sha2(F.concat(F.lit("word:"), word.cast("string")), 256)


def round_release(x: Column) -> Column:
    """Half up, never below zero."""
    return F.greatest(F.lit(0), F.floor(x + F.lit(0.5))).cast("long")


def clamp(x: Column, limit: float, signed: bool = True) -> Column:
    return F.greatest(F.lit(-limit if signed else 0.0), F.least(F.lit(float(limit)), x))


def one_decimal(x: Column) -> Column:
    """The double with one decimal that C's ``%.1f`` prints: the binary value itself is rounded (1.15 lies below its decimal form), a half to
    even. Java rounds the decimal form, a half up. Ten times the fraction is held exactly, as the sum of s and e."""
    x = x.cast("double")
    part = x % F.lit(1.0)
    a, b = part * 8.0, part * 2.0
    s = a + b
    e = b - (s - a)
    tenths = F.when((F.abs(s % F.lit(1.0)) == 0.5) & (e != 0), s + F.signum(e) * 0.5).otherwise(F.rint(s))
    out = (x - part) + tenths / 10.0
    return F.when(F.isnan(part), x).when(out == 0, x * 0.0).otherwise(out)  # infinity; a zero keeps its sign


def short_number(x: Column) -> Column:
    """1000000 as 1M, 2500 as 2.5K."""
    trimmed = lambda c: F.regexp_replace(F.format_string("%.1f", one_decimal(c)), r"\.0$", "")
    return F.when(x >= 1e6, F.concat(trimmed(x / 1e6), F.lit("M"))).when(x >= 1e3, F.concat(trimmed(x / 1e3), F.lit("K"))).when(x.isNotNull(), trimmed(x.cast("double")))


def reverse_message(x: Column) -> Column:
    return F.reverse(x)


def random_message(x: Column) -> Column:
    return F.format_string("I just got %f as random value", x)


def component_name(x: Column) -> Column:
    return F.lower(x)


def status(completed: Column, timed_out: Column, out_of_memory: Column, has_data: Column) -> Column:
    """Later rules override earlier ones: completed, timed out, out of memory, no data."""
    return F.when(~has_data, "No data").when(out_of_memory, "OOM").when(timed_out, "Timed out").when(completed, "Completed")


def run_label(parts: dict[str, Column]) -> Column:
    """``t90 e50 p8``: each letter with its short number, in the order given; nulls are left out."""
    return F.concat_ws(" ", *[F.concat(F.lit(k), short_number(c)) for k, c in parts.items()])


def derived_metrics(rows: DataFrame, size_gb: str = "size_gb", records: str = "n_records", ms: str = "duration_ms") -> DataFrame:
    """duration_s, gb_per_s and mrec_per_s of each run; null for a run that took no time."""
    seconds = F.nullif(F.col(ms), F.lit(0)) / 1000.0
    return rows.withColumns({"duration_s": F.col(ms) / 1000.0, "gb_per_s": F.col(size_gb) / seconds, "mrec_per_s": F.col(records) / 1e6 / seconds})


def coalesced(rows: DataFrame, name: str, *sources: str) -> DataFrame:
    """``name`` from the first of the columns that exists in the table and is not null in the row."""
    have = [F.col(c) for c in (name, *sources) if c in rows.columns]
    return rows.withColumn(name, F.coalesce(*have) if have else F.lit(None))


def error_cause(message: Column) -> Column:
    """The innermost cause of a chained message: what follows the last ``Caused by:``, on one line."""
    return F.trim(F.regexp_extract(F.element_at(F.split(message, "Caused by:"), -1), r"^\s*([^\n]*)", 1))
