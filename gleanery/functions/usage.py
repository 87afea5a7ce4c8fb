"""Token usage of model calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USAGE_SCHEMA = ("prompt_tokens bigint, input_tokens bigint, completion_tokens bigint, "
                "output_tokens bigint, total_tokens bigint")


def usage_cost(usage: Column, input_rate: float = 0.0, output_rate: float = 0.0) -> Column:
    """Struct of normalised token counts and cost at per-million rates."""
    def tokens(*names: str) -> Column:
        return F.greatest(F.coalesce(*[usage[n] for n in names], F.lit(0)), F.lit(0))

    read, written = tokens("prompt_tokens", "input_tokens"), tokens("completion_tokens", "output_tokens")
    present = F.coalesce(*[usage[n] for n in ("prompt_tokens", "input_tokens", "completion_tokens",
                                              "output_tokens", "total_tokens")]).isNotNull()
    return F.struct(
        read.alias("input_tokens"), written.alias("output_tokens"),
        F.greatest(read + written, tokens("total_tokens")).alias("total_tokens"),
        F.round((read * input_rate + written * output_rate) / 1_000_000, 10).alias("cost_usd"),
        F.lit(input_rate > 0 or output_rate > 0).alias("pricing_configured"),
        present.alias("usage_available"))
