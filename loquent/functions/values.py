"""Numbers, times and JSON as column expressions; times are milliseconds since 1970 in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product, as double, over the shorter length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; a vector without length counts as of length 1."""
    size = norm(a) * norm(b)
    return dot(a, b) / F.when(size == 0, 1.0).otherwise(size)


def csls_distance(distance: Column, hub: Column) -> Column:
    """The distance less what a hub is near to everything: at least 0; as it is without a hub score."""
    return F.when(hub.isNull(), distance).otherwise(F.greatest(F.lit(0.0), distance - 1 + hub))


def epoch_to_ms(c: Column) -> Column:
    """Seconds or milliseconds, told apart by size; null if not above 0."""
    c = c.cast("double")
    ms = F.when(c >= 1e12, F.round(c)).otherwise(F.round(c * 1000))
    return F.when(~F.isnan(c) & (c > 0) & (c < float("inf")), ms).cast("long")


def bucket_ms(c: Column, days: int) -> Column:
    """The start of the span of ``days`` days, counted from 1970."""
    width = days * 86_400_000
    return (F.floor(c / width) * width).cast("long")


def date_to_ms(c: Column) -> Column:
    """A date in any of the forms that chat exports use; null for others.

    Numbers of ten digits or more are epochs; ISO forms without a zone are UTC; then ``2023-05-01@12h30m05s`` and
    ``May 1, 2023 3:04pm``, with or without a time.
    """
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(r"^\d{10,}(\.\d+)?$"), epoch_to_ms(text.try_cast("double")))
    parts = F.regexp_replace(text, r"^(\d{4})-(\d{1,2})-(\d{1,2})\s*@\s*(\d{1,2})h\s*(\d{1,2})m\s*(\d{1,2})s.*$", "$1-$2-$3 $4:$5:$6")
    at = F.try_to_timestamp(parts, F.lit("yyyy-M-d H:m:s"))
    plain = F.regexp_replace(F.lower(text), r"\s*([ap])m$", " $1m")
    named = F.coalesce(*[F.try_to_timestamp(F.initcap(plain), F.lit(f)) for f in ("MMMM d, yyyy h:mm a", "MMM d, yyyy h:mm a", "MMMM d, yyyy", "MMM d, yyyy")])
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d|$)"), text.try_cast("timestamp"))
    return F.coalesce(number, F.unix_millis(iso), F.unix_millis(F.when(text.contains("@"), at)), F.unix_millis(named))


def string_items(c: Column) -> Column:
    """The strings of a JSON array, in order; other items go, and anything but an array has none."""
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)
