"""Containment joins of lines and words by q-grams (no text is shuffled before a word may be in it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4  # characters


def _grams(text: Column) -> Column:
    """The distinct ``GRAM``-character substrings of a text that has at least ``GRAM`` characters."""
    def of(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - GRAM)
        return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)]))

    # the characters are bound once as a lambda's argument: linear in the length of the text
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(text, "")), of)))


def lines_with_words(lines: DataFrame, words: DataFrame, keys: list[str], text: str = "_l", word: str = "word",
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id columns of ``lines``, carry, word) of the lines that contain a word of their ``keys``, as a q-gram join.

    ``lines`` are (keys, ids that are unique together, carry, text), ``words`` distinct
    (keys, word) of at least ``GRAM`` characters. Each word is looked up by the
    one of its grams that the fewest lines have; a word with a gram that no line
    has is in none. Only ids and grams of lines are shuffled until the candidates
    are verified against the text. Null keys, texts and words match nothing; texts
    shorter than a gram contain no word.
    """
    ids = [c for c in lines.columns if c not in (*keys, text, *carry)]
    parts = words.where(F.length(word) >= GRAM).select(*keys, word, F.explode(_grams(F.col(word))).alias("_g"))
    has = (lines.where(F.length(text) >= GRAM).select(*keys, *ids, F.explode(_grams(F.col(text))).alias("_g"))
           .join(parts.select(*keys, "_g").distinct(), [*keys, "_g"], "left_semi"))
    spread = has.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (parts.join(spread, [*keys, "_g"], "left").groupBy(*keys, word)
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_r"))
              .where("_r.n > 0").select(*keys, word, F.col("_r._g").alias("_g")))
    candidates = has.join(rarest, [*keys, "_g"]).select(*keys, *ids, word)
    return (candidates.join(lines, [*keys, *ids]).where(F.col(text).contains(F.col(word)))
            .select(*keys, *ids, *carry, word))
