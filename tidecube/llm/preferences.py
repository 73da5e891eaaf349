"""Chat formatting: preference pairs with their longest common prefix of turns as prompt, and masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(turns: Column) -> Column:
    """<|role|>, text and <|end|> of each turn, a line each part."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))))


def trained_spans(turns: Column, role: str) -> Column:
    """Code points of rendered(turns) that count in training: texts of `role` with their end mark."""
    head = lambda t: F.length(t["role"]) + 5
    size = lambda t: F.length(t["text"]) + 7
    step = lambda acc, t: F.struct(
        (acc["at"] + head(t) + size(t) + 1).alias("at"),
        F.when(t["role"] == role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + head(t)).alias("start"), (acc["at"] + head(t) + size(t)).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(conversations: DataFrame, pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """A row for each of pairs(chosen_id, rejected_id): n_prefix, prompt, chosen, rejected, chosen_spans, rejected_spans.

    conversations(conv_id, turn, role, text): turns in order of turn, then role, then text, so ties and repeated rows
    have a place. The prompt renders the turns that both begin with; the completions render the rest of each, and the
    spans are what of them counts in training. Null roles and texts are empty; rows with a null conv_id and pairs with an
    unknown id have no result; extra columns are dropped; empty tables give an empty result. Roles and texts are rendered as
    they are: marks that stand in a text are not escaped, so a reader takes turns from the spans, not from the marks.
    DataFrame operations only.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    both = pairs.select("chosen_id", "rejected_id").join(whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id")
    both = both.join(whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id")
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    both = both.withColumn("n_prefix", F.when(differs > 0, differs - 1).otherwise(F.size("a")).cast("long"))
    n = F.col("n_prefix").cast("int")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    return both.select(
        "chosen_id",
        "rejected_id",
        "n_prefix",
        rendered(F.slice("a", F.lit(1), n)).alias("prompt"),
        rendered(rest("a")).alias("chosen"),
        rendered(rest("b")).alias("rejected"),
        trained_spans(rest("a"), role).alias("chosen_spans"),
        trained_spans(rest("b"), role).alias("rejected_spans"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of the conversations 2k (chosen) and 2k + 1 (rejected), where both are there."""
    ids = conversations.select("conv_id").where("conv_id is not null").distinct()
    other = ids.select((F.col("conv_id") - 1).alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    return ids.select(F.col("conv_id").alias("chosen_id")).where("chosen_id % 2 = 0").join(other, "chosen_id")
