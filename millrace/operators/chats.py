"""Conversations as supervised samples: rendering, the trainer's format, and checks of the message order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def messages(turns: DataFrame) -> DataFrame:
    """conv_id and its messages (turn, role, content) in order; a null content is empty."""
    m = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages"))


def render_sft(turns: DataFrame) -> DataFrame:
    """id, prompt and completion digests, and lengths: the last assistant turn completes all that stands before it."""
    said = messages(turns).withColumn("at", F.size("messages") - F.array_position(F.reverse(F.transform("messages", lambda m: m["role"])), "assistant") + 1)
    said = said.where(F.array_contains(F.transform("messages", lambda m: m["role"]), "assistant"))
    lines = F.transform(F.slice("messages", F.lit(1), (F.col("at") - 1).cast("int")), lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    prompt, completion = F.array_join(lines, "\n"), F.element_at("messages", F.col("at").cast("int"))["content"]
    return said.select(
        F.concat(F.lit("sft-"), F.col("conv_id").cast("string")).alias("id"), (F.col("at") - 1).cast("long").alias("n_prompt_turns"),
        F.sha2(prompt, 256).alias("prompt_sha256"), F.sha2(completion, 256).alias("completion_sha256"), F.length(completion).cast("long").alias("completion_chars"),
    )


def fold(turns: DataFrame) -> DataFrame:
    """One system, user and target text for each conversation.

    The last assistant message is the target and what follows it is dropped; the last system message wins; the first user message stands as it
    is, later ones are marked [USER_FOLLOWUP], earlier non-empty assistant messages [ASSISTANT]; parts are joined by a blank line."""
    m = messages(turns).withColumn("roles", F.transform("messages", lambda x: x["role"]))
    back = F.array_position(F.reverse("roles"), "assistant")
    m = m.withColumn("at", F.when(back > 0, F.size("roles") - back + 1).otherwise(F.size("roles") + 1).cast("int"))
    before = F.slice("messages", F.lit(1), F.col("at") - 1)
    m = m.withColumn("before", before).withColumn("first_user", F.array_position(F.transform("before", lambda x: x["role"]), "user"))
    part = F.transform(
        "before",
        lambda x, i: F.when((x["role"] == "user") & (i + 1 == F.col("first_user")), x["content"])
        .when(x["role"] == "user", F.concat(F.lit("[USER_FOLLOWUP]\n"), x["content"]))
        .when(x["role"] == "tool", F.concat(F.lit("[TOOL_RESULT]\n"), x["content"]))
        .when((x["role"] == "assistant") & (x["content"] != ""), F.concat(F.lit("[ASSISTANT]\n"), x["content"])),
    )
    systems = F.filter("messages", lambda x: x["role"] == "system")
    return m.select(
        "conv_id",
        F.when(F.size(systems) > 0, F.element_at(F.transform(systems, lambda x: x["content"]), -1)).alias("system"),
        F.array_join(F.array_compact(part), "\n\n").alias("user"),
        F.coalesce(F.get("messages", F.col("at") - 1)["content"], F.lit("")).alias("target"),
    )


def order_issues(turns: DataFrame) -> DataFrame:
    """conv_id and issue of each broken rule: starts with user or system, user and assistant alternate, ends with assistant, no repeated turn."""
    m = messages(turns).withColumn("roles", F.filter(F.transform("messages", lambda x: x["role"]), lambda r: r != "system"))
    m = m.withColumn("all_turns", F.transform("messages", lambda x: x["turn"]))
    twice = F.exists(F.sequence(F.lit(0), F.size("roles")), lambda i: F.coalesce(F.get("roles", i) == F.get("roles", i + 1), F.lit(False)))
    issues = F.array_compact(F.array(
        F.when(F.coalesce(F.get("roles", F.lit(0)), F.lit("")) != "user", "first_not_user"),
        F.when(twice, "same_role_twice"),
        F.when(F.coalesce(F.try_element_at("roles", F.lit(-1)), F.lit("")) != "assistant", "last_not_assistant"),
        F.when(F.size(F.array_distinct("all_turns")) < F.size("all_turns"), "repeated_turn"),
    ))
    return m.select("conv_id", F.explode(issues).alias("issue"))
