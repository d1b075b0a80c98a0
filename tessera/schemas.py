"""Schemas of rollout tables, typed where files at rest hold JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
INTERACTIONS = "array<struct<code:string,output:string>>"
TESTS = "struct<inputs:array<string>,outputs:array<string>,fn_name:string>"

TRAJECTORIES = (
    "problem_id long, trajectory_id long, question string, "
    f"messages {MESSAGES}, num_turns long, final_reward double, terminated boolean, truncated boolean, "
    f"interactions {INTERACTIONS}, tests {TESTS}, is_successful boolean, interaction_timeout_count long, "
    "eval_timeout_count long, turn_wise_finish_reason array<string>, turn_wise_truncated_by_token_limit array<boolean>, "
    "num_assistant_messages_truncated long, num_assistant_messages_not_truncated long, rendered string"
)
CANDIDATES = f"problem_id long, candidate_id long, question string, response string, final_reward double, is_successful boolean, rsa_step long, aggregated_from array<int>, tests {TESTS}, rendered string"

#: Other names that sources give a column.
ALIASES = {"problem_id": ("problem_index",)}


def normalised(df: DataFrame) -> DataFrame:
    """Gives columns their usual names where only another name is there, and
    parses JSON text in nested columns (text that is not JSON becomes null)."""
    for name, others in ALIASES.items():
        for other in others:
            if name not in df.columns and other in df.columns:
                df = df.withColumnRenamed(other, name)
    kinds = dict(df.dtypes)
    for name, kind in (("messages", MESSAGES), ("interactions", INTERACTIONS), ("tests", TESTS), ("aggregated_from", "array<int>")):
        if kinds.get(name) == "string":
            df = df.withColumn(name, F.from_json(name, kind))
    return df
