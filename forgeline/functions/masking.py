"""Masking of phone and identity numbers in texts, with the number of redactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of Vietnamese mobile phones, 12-digit and 9-digit identity numbers, in order, and the mask.
PHONE = r"(?:\+84[\s.\-]*|0)(?:3|5|7|8|9)[\s.\-]*\d[\s.\-]*\d[\s.\-]*\d[\s.\-]*\d[\s.\-]*\d[\s.\-]*\d[\s.\-]*\d[\s.\-]*\d\b"
ID_12 = r"\b\d{12}\b"
ID_9 = r"(?<![\d])\d{9}(?![\d])"
TOKEN = "[REDACTED_PII]"


def masked(text: Column) -> Column:
    for pattern in (PHONE, ID_12, ID_9):
        text = F.regexp_replace(text, pattern, TOKEN)
    return text


def redactions(text: Column) -> Column:
    """How many parts of the text `masked` replaces; each pattern is counted on what the ones before left."""
    total = F.lit(0)
    for pattern in (PHONE, ID_12, ID_9):
        total = total + F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        text = F.regexp_replace(text, pattern, TOKEN)
    return total


def masked_messages(messages: Column) -> Column:
    """The same over array<struct<role, content>>."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), masked(m["content"]).alias("content")))


def _masked_value(value: Column) -> tuple[Column, Column]:
    text = F.try_variant_get(value, "$", "string")
    return masked(text), redactions(text)


def masked_bodies(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """(*keys, path, text, redactions): every text of a JSON request body that is masked, with its place in the body.

    Masked are the contents of messages, be they a text or a list of parts with a `text`, and `input`, be it a text or a list of texts. `keys` tell
    the bodies apart. The body is taken apart as VARIANT, so that other shapes pass without an error; a body that isn't a JSON object
    has no rows. Texts are those of the JSON, numbers aren't texts.
    """
    v = df.select(*keys, F.try_parse_json(body).alias("__v"))
    is_text = lambda c: F.schema_of_variant(c) == "STRING"
    get = lambda c, path: F.try_variant_get(c, path, "variant")
    items = lambda c: F.try_variant_get(c, "$", "array<variant>")
    messages = v.select(*keys, F.posexplode(items(get("__v", "$.messages"))).alias("i", "m")).select(*keys, "i", get("m", "$.content").alias("c"))
    plain = messages.filter(is_text("c")).select(*keys, F.format_string("messages[%d].content", "i").alias("path"), "c")
    parts = messages.select(*keys, "i", F.posexplode(items(F.col("c"))).alias("j", "p")).select(*keys, F.format_string("messages[%d].content[%d].text", "i", "j").alias("path"), get("p", "$.text").alias("c"))
    one = v.select(*keys, F.lit("input").alias("path"), get("__v", "$.input").alias("c"))
    many = v.select(*keys, F.posexplode(items(get("__v", "$.input"))).alias("i", "c")).select(*keys, F.format_string("input[%d]", "i").alias("path"), "c")
    texts = plain.unionByName(parts).unionByName(one).unionByName(many).filter(is_text("c"))
    text, n = _masked_value(F.col("c"))
    return texts.select(*keys, "path", text.alias("text"), n.alias("redactions"))
