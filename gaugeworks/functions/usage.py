"""Fields of provider payloads, which stay JSON strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extracted(payload: Column) -> Column:
    """Token counts of a chat payload; a count that isn't reported is null, not zero."""

    def n(path: str) -> Column:
        return F.get_json_object(payload, f"$.usage.{path}").cast("long")

    reasoning = F.coalesce(n("completion_tokens_details.reasoning_tokens"), n("reasoning_tokens"))
    return F.struct(
        n("prompt_tokens").alias("prompt_tokens"),
        n("completion_tokens").alias("completion_tokens"),
        n("total_tokens").alias("total_tokens"),
        reasoning.alias("reasoning_tokens"),
        n("prompt_tokens_details.cached_tokens").alias("cached_prompt_tokens"),
        reasoning.isNotNull().alias("reasoning_tokens_reported"),
    )


def reply(payload: Column) -> Column:
    """struct<text, reasoning>: the first choice's content, or its reasoning where there is no content."""

    def part(name: str) -> Column:
        return F.nullif(F.get_json_object(payload, f"$.choices[0].message.{name}"), F.lit(""))

    reasoning = F.coalesce(part("reasoning_content"), part("reasoning"), F.lit(""))
    return F.struct(F.coalesce(part("content"), reasoning).alias("text"), reasoning.alias("reasoning"))
