"""Text operators over message tables (T1-T6): built-in string functions, no UDFs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlab.functions.columns import any_contains, normalize_text
from cohortlab.functions.fixed import INTENT_RULES


def intent_expr(normalized: F.Column, rules=INTENT_RULES) -> F.Column:
    """First rule (in order) with any keyword and no excluded keyword; else null. One CASE
    expression over the row — no join against the rule table."""
    expr = None
    for intent, kws, excl in rules:
        cond = any_contains(normalized, kws) & ~any_contains(normalized, excl)
        expr = F.when(cond, F.lit(intent)) if expr is None else expr.when(cond, F.lit(intent))
    return expr.otherwise(F.lit(None).cast("string"))


def normalized_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """Lower, accents stripped, non-word to space, spaces collapsed, trimmed."""
    return messages.withColumn("normalized", normalize_text(text))


def tag_intents(messages: DataFrame, text: str = "text") -> DataFrame:
    """Intent of each message (null = not answered locally). The normalised text is bound once: repeated inside every
    keyword test it would make the generated code too large to compile."""
    return messages.withColumn("intent", F.transform(F.array(normalize_text(text)), lambda n: intent_expr(n))[0])


def intent_coverage(tagged: DataFrame) -> DataFrame:
    """Total messages, answered locally, not answered."""
    return tagged.agg(F.count(F.lit(1)).alias("total"), F.count("intent").alias("answered_locally")) \
        .withColumn("not_answered", F.col("total") - F.col("answered_locally"))


REPLY_SCHEMA = "response string, action string"


def extract_structured_reply(messages: DataFrame, text: str = "text") -> DataFrame:
    """T4: strip code fences and parse ``{response, action}``; else the first embedded JSON
    object that has a response; else the raw text as the response."""
    raw = F.col(text)
    cleaned = F.regexp_replace(F.trim(raw), r"(?m)^```(?:json)?\s*", "")
    cleaned = F.regexp_replace(F.trim(cleaned), r"(?m)\s*```$", "")
    whole = F.when(F.trim(cleaned).startswith("{"), F.from_json(cleaned, REPLY_SCHEMA))
    emb_txt = F.regexp_extract(raw, r'(\{[\s\S]*"response"[\s\S]*\})', 1)
    emb = F.when(emb_txt != "", F.from_json(emb_txt, REPLY_SCHEMA))
    resp = F.coalesce(whole["response"], emb["response"], raw)
    act = F.when(whole["response"].isNotNull(), whole["action"]).when(emb["response"].isNotNull(), emb["action"])
    return messages.withColumn("response", resp).withColumn("action", act)


def extract_action_block(messages: DataFrame, text: str = "text") -> DataFrame:
    """T4: a fenced json block that holds an action with a type: its type, label and params (as JSON text), and
    the text without the block. Other texts stay as they are."""
    block = F.regexp_extract(F.col(text), r"(?s)```json\s*(.*?)\s*```", 1)
    field = lambda path: F.get_json_object(block, path)
    kind = F.when(F.coalesce(block, F.lit("")) != "", field("$.action.type"))
    found = kind.isNotNull() & (kind != "")
    return messages.withColumn("action_type", F.when(found, kind)) \
        .withColumn("action_label", F.when(found, F.coalesce(field("$.action.label"), F.lit("Execute action")))) \
        .withColumn("action_params", F.when(found, F.coalesce(field("$.action.params"), F.lit("{}")))) \
        .withColumn("clean_text", F.when(found, F.trim(F.regexp_replace(F.col(text), r"(?s)```json.*?```", ""))).otherwise(F.col(text)))


def intent_answer_facts(profile: DataFrame, names: DataFrame) -> DataFrame:
    """T5: the numbers each intent answer quotes per segment: count, %, spend, AOV, orders, recency."""
    p = profile.join(names, "seg", "left")
    return p.select("seg", "segment", F.col("n").alias("count"),
                    (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("pct"),
                    "avg_spend", "avg_aov", "avg_orders", "avg_recency")


def recent_turns(conversations: DataFrame, n: int = 14) -> DataFrame:
    """The last ``n`` messages of each conversation (position 1 = newest). The window is per
    conversation, whose length is bounded by the chat itself."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def recent_context(conversations: DataFrame, n: int = 14) -> DataFrame:
    """T6 as one ordered array of (turn, role, text) per conversation."""
    r = recent_turns(conversations, n)
    return r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("context"))
