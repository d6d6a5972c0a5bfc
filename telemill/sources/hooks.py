"""Hook payloads: one JSON object, or an array of them, per body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import mapping as mp
from telemill.functions.attributes import canonical_json, variant_string
from telemill.sources.otlp import _events

VENDOR = "claude_code"


def payloads(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads as VARIANT ``v`` with their canonical JSON ``attrs``, rejects).

    A body that is no JSON, or an array with an element that is no object or whose
    session is no text or an empty one, is one reject and gives no payload.
    """
    parsed = bodies.select("body", F.try_parse_json("body").alias("j"))
    shaped = parsed.withColumn("items", F.when(F.schema_of_variant("j").startswith("ARRAY"), F.try_variant_get("j", "$", "array<variant>")).when(F.schema_of_variant("j").startswith("OBJECT"), F.array("j")))
    good = lambda x: F.schema_of_variant(x).startswith("OBJECT") & (F.coalesce(variant_string(x, "session_id"), F.lit("")) != "")
    fine = F.coalesce(F.col("items").isNotNull() & F.forall("items", good), F.lit(False))
    rejects = shaped.where(~fine).select(F.lit("invalid hook body").alias("reason"), F.col("body").alias("record"), F.greatest(F.lit(1), F.coalesce(F.size("items"), F.lit(1))).cast("long").alias("points"))
    rows = shaped.where(fine).select(F.explode("items").alias("v"))
    return rows.withColumn("attrs", canonical_json(F.to_json("v"))), rejects


def hooks(bodies: DataFrame, now: Column, retention_days: int = 90, allow_message_display: bool = False) -> tuple[DataFrame, DataFrame]:
    """(canonical events without seq, rejects) of hook bodies received at ``now``."""
    rows, rejects = payloads(bodies)
    rows = rows.withColumn("now", now)
    v = F.col("v")
    name = F.coalesce(variant_string(v, "hook_event_name"), F.lit(""))
    if not allow_message_display:
        rows = rows.where(name != "MessageDisplay")
    session, prompt = variant_string(v, "session_id"), variant_string(v, "prompt_id")
    ts, odd = mp.clamped(F.coalesce(variant_string(v, "timestamp").try_cast("timestamp"), F.col("now")), F.col("now"), retention_days)
    columns = mp.hook_columns(name, v) | {
        "ts": ts, "ingested_at": F.col("now"), "session_id": session, "prompt_id": prompt, "vendor": F.lit(VENDOR), "source": F.lit("hook"), "event_name": name, "clock_skewed": odd,
        "dedup_key": mp.hook_key(name, session, prompt, F.col("attrs")), "attrs": F.col("attrs"),
    }
    return _events(rows, columns), rejects
