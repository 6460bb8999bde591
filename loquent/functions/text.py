"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def trimmed(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def null_if_blank(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def clean_text(c: Column) -> Column:
    """Tags out, at most one empty line in a row, runs of other white space as one space, each line trimmed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\n{3,}", "\n\n")
    bare = F.regexp_replace(bare, r"[ \t\r\f]+", " ")
    return trimmed(F.array_join(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), "\n"))


def with_names(c: Column, char: str, user: str) -> Column:
    """{{char}} and {{user}}, in any case, replaced by names."""
    quoted = [x.replace("\\", "\\\\").replace("$", "\\$") for x in (char, user)]
    return F.regexp_replace(F.regexp_replace(c, r"(?i)\{\{char\}\}", quoted[0]), r"(?i)\{\{user\}\}", quoted[1])


def approx_tokens(c: Column) -> Column:
    """Characters over 3.67, rounded up."""
    return F.ceil(F.length(c) / 3.67)


def estimate_tokens(c: Column) -> Column:
    """Four printable ASCII characters a token; any other character is one."""
    other = F.length(F.regexp_replace(c, r"[\x20-\x7E]", ""))
    return (F.ceil((F.length(c) - other) / 4) + other).cast("long")


def snippet(c: Column, n: int = 280) -> Column:
    return F.substring(c, 1, n)


def strip_think(c: Column) -> Column:
    """Without <think> sections."""
    return trimmed(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))


def normalize_keyword(c: Column) -> Column:
    """Lower case, no leading article, no trailing punctuation; null under four characters."""
    word = F.regexp_replace(trimmed(F.lower(c)), r"^(?:the|a|an)\s+", "")
    word = trimmed(F.regexp_replace(word, r"[\p{Punct}\s]+$", ""))
    return F.when(F.length(word) >= 4, word)


def has_word(c: Column, key: str) -> Column:
    """Whether ``key`` stands in the text as a whole word, in any case."""
    quoted = "".join(f"\\{x}" if not x.isalnum() and not x.isspace() else x for x in key.lower())
    return F.lower(c).rlike(rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])")


def snippet_around(c: Column, terms: Sequence[str], reach: int = 70, fallback: int = 140) -> Column:
    """The text around the first of ``terms`` found, with dots where it is cut; its beginning if none is."""
    return snippet_of(c, F.array(*[F.lit(t.lower()) for t in terms]), reach, fallback)


def snippet_of(c: Column, terms: Column, reach: int = 70, fallback: int = 140) -> Column:
    """``snippet_around`` for an array of terms in lower case that each row has of its own.

    The flat text is made once a row: inside lambdas Spark works out again whatever isn't bound to a variable.
    """
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    low = F.transform(F.array(flat), lambda x: F.struct(x.alias("flat"), F.lower(x).alias("low")))
    places = lambda x: F.filter(F.transform(terms, lambda t: F.position(t, x["low"])), lambda p: p > 0)
    found = F.transform(low, lambda x: F.struct(x["flat"].alias("flat"), F.array_min(places(x)).alias("at")))

    def shown(x: Column) -> Column:
        begin, end = F.greatest(x["at"] - reach, F.lit(1)), F.least(x["at"] + reach, F.length(x["flat"]))
        cut = F.concat(F.when(begin > 1, "…").otherwise(""), F.substring(x["flat"], begin, end - begin + 1), F.when(end < F.length(x["flat"]), "…").otherwise(""))
        return F.when(x["at"].isNotNull(), cut).otherwise(F.substring(x["flat"], 1, fallback))

    return F.get(F.transform(found, shown), F.lit(0))


def whole_name(c: Column) -> Column:
    """A file name with .jsonl at its end; null if blank."""
    name = null_if_blank(c)
    return F.when(name.endswith(".jsonl"), name).otherwise(F.concat(name, F.lit(".jsonl")))


def parent_of_branch(c: Column) -> Column:
    """The file that a name with ' - Branch #' in it branched from."""
    stem = F.nullif(F.regexp_extract(c, r"^(.*?) - Branch #", 1), F.lit(""))
    return F.concat(stem, F.lit(".jsonl"))


@F.pandas_udf(StringType())
def slugify(names: pd.Series) -> pd.Series:
    """Lower case, compatibility forms, runs of anything but a-z and 0-9 as a hyphen; 'unnamed' if nothing is left."""
    flat = names.fillna("").map(lambda x: unicodedata.normalize("NFKD", x.lower()))
    flat = flat.str.replace(r"[̀-ͯ]", "", regex=True).str.replace(r"[^a-z0-9]+", "-", regex=True).str.strip("-")
    return flat.where(flat != "", "unnamed")
