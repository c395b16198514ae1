"""Grading of replies: normalised tokens, the last number or option, aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number words 0 to 20.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalized(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalized(text), " "), lambda t: t != "")


def extracted(text: Column, answer: Column, options: Column, aliases: Column | None = None) -> Column:
    """The last number of a reply if the answer is a number, else the last token that is an option (null: none).

    ``options`` is an array; where it is empty, the answer and its ``aliases`` stand for it.
    """
    words = F.array(*map(F.lit, NUMBER_WORDS))
    numbers = F.filter(tokens(text), lambda t: t.rlike(r"^\d+$") | F.array_contains(words, t))
    number = F.try_element_at(numbers, F.lit(-1))
    digits = F.coalesce(F.nullif(F.array_position(words, number) - 1, F.lit(-1)).cast("string"), number)
    own = F.array(answer) if aliases is None else F.concat(F.array(answer), F.coalesce(aliases, F.array().cast("array<string>")))
    among = F.transform(F.when(F.size(options) > 0, options).otherwise(own), normalized)
    option = F.try_element_at(F.filter(tokens(text), lambda t: F.array_contains(among, t)), F.lit(-1))
    return F.when(answer.rlike(r"^\d+$"), digits).otherwise(option)


def graded(text: Column, answer: Column, options: Column, aliases: Column | None = None) -> Column:
    """Whether the extracted token is the answer or an alias, as it stands or normalised."""
    accepted = F.concat(F.array(answer), aliases) if aliases is not None else F.array(answer)
    got = extracted(text, answer, options, aliases)
    return F.coalesce(F.exists(accepted, lambda x: (normalized(x) == got) | (x == got)), F.lit(False))


def number_alias(n: Column) -> Column:
    """The number word of 0 to 20, null beyond."""
    return F.get(F.array(*map(F.lit, NUMBER_WORDS)), n)
