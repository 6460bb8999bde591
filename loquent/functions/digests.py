"""What models answer, as columns: digests with keywords, finish reasons, and rewriting by patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loquent.functions.text import null_if_blank, trimmed

# Names that providers give the end of an answer, and one name for each kind.
FINISH_REASONS = {"stop": "stop", "end_turn": "stop", "stop_sequence": "stop", "completed": "stop", "length": "length", "max_tokens": "length", "content_filter": "filter", "tool_use": "tool", "tool_calls": "tool", "function_call": "tool"}


def finish_reason(c: Column, known: dict[str, str] | None = None) -> Column:
    """One name for each kind of end; other for unknown ones, null for none."""
    table = F.create_map(*[F.lit(x) for kv in (known or FINISH_REASONS).items() for x in kv])
    return F.when(null_if_blank(c).isNotNull(), F.coalesce(F.element_at(table, F.lower(c)), F.lit("other")))


def braces(c: Column) -> Column:
    """From the first opening brace to the last closing one; null without."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def _texts(v: Column, path: str) -> Column:
    items = F.try_variant_get(v, path, "array<variant>")
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def _filled(items: Column) -> Column:
    return F.filter(F.transform(items, trimmed), lambda x: x != "")


def parse_digest(c: Column) -> Column:
    """text, anchor and keywords of an answer: JSON if there is any that holds, nothing if it was cut short, else lines.

    Of lines the first one with text is the anchor; keywords stand after ``keywords:``, and what follows is dropped.
    """
    raw = trimmed(c)
    v = F.try_parse_json(braces(raw))
    anchor = F.when(F.schema_of_variant(F.try_variant_get(v, "$.topicAnchor", "variant")) == "STRING", trimmed(F.try_variant_get(v, "$.topicAnchor", "string")))
    anchor = F.nullif(anchor, F.lit(""))
    facts = _texts(v, "$.facts")
    held = anchor.isNotNull() | (F.size(facts) > 0)
    lines = F.concat(F.when(anchor.isNotNull(), F.array(anchor)).otherwise(F.array().cast("array<string>")), F.transform(facts, lambda f: F.concat(F.lit("- "), f)))
    shape = lambda text, first, words: F.struct(text.alias("text"), first.alias("anchor"), words.alias("keywords"))
    from_json = shape(F.array_join(lines, "\n"), anchor, _filled(_texts(v, "$.keywords")))
    body = trimmed(F.regexp_replace(raw, r"(?ims)^[ \t]*keywords[ \t]*:.*", ""))
    words = F.regexp_extract(raw, r"(?im)^[ \t]*keywords[ \t]*:(.*)$", 1)
    from_lines = shape(body, F.nullif(trimmed(F.regexp_extract(body, r"^[^\n]*", 0)), F.lit("")), _filled(F.split(words, "[,;]")))
    nothing = shape(F.lit(""), F.lit(None).cast("string"), F.array().cast("array<string>"))
    return F.when(F.coalesce(held, F.lit(False)), from_json).when(raw.startswith("{"), nothing).otherwise(from_lines)


def rewritten(c: Column, scripts: Sequence[tuple[str, str]]) -> Column:
    """Each pattern replaced in turn; groups as $1, the whole match as {{match}}."""
    for pattern, replacement in scripts:
        c = F.regexp_replace(c, pattern, replacement.replace("{{match}}", "$0"))
    return c
