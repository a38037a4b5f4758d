"""Quality rules as predicates: no UDF, so they reach the scan and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import ends_with_any, ratio, tokens, word_count, words


def valid_text(x: Column, least: int = 5, most_numeric: float = 0.5, digits: bool = True) -> Column:
    """A string of enough words, not more than half of them numbers (commas and dots aside)."""
    w = words(x)
    numeric = F.size(F.filter(F.transform(w, lambda t: F.regexp_replace(t, "[.,]", "")), lambda t: t.rlike(r"^[\d⁰¹²³⁴⁵⁶⁷⁸⁹]+$")))
    ok = F.size(w) >= least
    if digits:
        ok = ok & (numeric <= F.size(w) * most_numeric)
    return F.coalesce(x.isNotNull() & ok, F.lit(False))


def words_in_ratio(a: Column, b: Column, most: float = 5.0) -> Column:
    return F.coalesce(ratio(word_count(a), word_count(b)) <= most, F.lit(False))


def chars_in_ratio(a: Column, b: Column, most: float = 5.0, least_words: int = 5) -> Column:
    long_enough = (word_count(a) >= least_words) & (word_count(b) >= least_words)
    return F.coalesce(long_enough & (ratio(F.length(a), F.length(b)) <= most), F.lit(False))


def language_score(x: Column, suffixes: list[str] = T.SCORE_SUFFIXES, stops: list[str] = T.SCORE_STOPS) -> Column:
    """Tokens with a suffix minus stop words, over tokens; 0 without tokens."""
    t = tokens(x, T.SCORE_MARKS)
    hits = F.size(F.filter(t, lambda w: ends_with_any(w, suffixes))) - F.size(F.filter(t, lambda w: w.isin(stops)))
    return F.when(F.size(t) == 0, F.lit(0.0)).otherwise(F.try_divide(hits.cast("double"), F.size(t).cast("double")))


def language(score: Column) -> Column:
    return F.when(score > 0.02, "inga").when(score < -0.05, "es").otherwise("mixed")


def looks_target(x: Column, share: float = 0.10, suffixes: list[str] = T.CHECK_SUFFIXES) -> Column:
    w = words(F.lower(x))
    return F.coalesce(F.try_divide(F.size(F.filter(w, lambda t: ends_with_any(t, suffixes))).cast("double"), F.size(w).cast("double")) >= share, F.lit(False))


def looks_source(x: Column, least: int = 2, stops: list[str] = T.CHECK_STOPS) -> Column:
    return F.size(F.array_intersect(words(F.lower(x)), F.array(*[F.lit(s) for s in stops]))) >= least


def discard_reasons(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs, invalid sides, bad ratios, and those that pass all, in one pass."""
    ok_a, ok_b, ok_r = valid_text(F.col(a)), valid_text(F.col(b)), words_in_ratio(F.col(a), F.col(b))
    return pairs.agg(F.count("*").alias("n"), F.count_if(~ok_a).alias("bad_a"), F.count_if(~ok_b).alias("bad_b"), F.count_if(~ok_r).alias("bad_ratio"), F.count_if(ok_a & ok_b & ok_r).alias("kept"))
