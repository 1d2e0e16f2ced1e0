"""Training batches under budgets of options, states and tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(options: np.ndarray, tokens: np.ndarray, choice_budget: int, max_states: int, token_budget: int | None) -> np.ndarray:
    """The batch of each row, taken in order: a batch closes before a row that would exceed a budget; tokens are counted at the
    longest row, to which the others are padded. A row over a budget by itself is a batch of its own."""
    out = np.zeros(len(options), np.int64)
    batch = n = used = longest = 0
    for i, (o, t) in enumerate(zip(options.tolist(), tokens.tolist(), strict=True)):
        if n and (used + o > choice_budget or n >= max_states or (token_budget and max(longest, t) * (n + 1) > token_budget)):
            batch, n, used, longest = batch + 1, 0, 0, 0
        out[i] = batch
        n, used, longest = n + 1, used + o, max(longest, t)
    return out


def training_batches(
    df: DataFrame, id_col: str, choice_budget: int = 384, max_states: int = 48, token_budget: int | None = None, seed: int = 0, chunk: int = 2048, max_tokens: int = 512
) -> DataFrame:
    """(id, chunk, batch, n_options, tokens): rows of (state, question, choices) packed into batches. Rows are dealt by a seeded hash into
    chunks of about `chunk`, another order for every seed; in a chunk they are sorted by size, so that batches are alike in
    length, and packed greedily. Tokens are estimated from lengths. No task sees more than a chunk; a null list counts as none."""
    size = 8 + F.floor(F.coalesce(F.length("state"), F.lit(0)) / 3) + F.floor(F.coalesce(F.length("question"), F.lit(0)) / 4)
    n = F.greatest(F.lit(0), F.size("choices"))
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = df.select(F.col(id_col).alias("id"), n.cast("bigint").alias("n_options"), F.least(F.lit(max_tokens), size).cast("bigint").alias("tokens"), h.alias("h"))
    chunks = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / chunk)).alias("_n"))  # one row
    dealt = rows.crossJoin(F.broadcast(chunks)).withColumn("chunk", F.pmod("h", "_n")).drop("_n")
    kind = dealt.schema["id"].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(size=part["tokens"] // 128 if token_budget else 0).sort_values(["size", "n_options", "h"], kind="stable")
        part["batch"] = pack(part["n_options"].to_numpy(), part["tokens"].to_numpy(), choice_budget, max_states, token_budget)
        return part[["id", "chunk", "batch", "n_options", "tokens"]]

    return dealt.groupBy("chunk").applyInPandas(one, f"id {kind}, chunk bigint, batch bigint, n_options bigint, tokens bigint")
