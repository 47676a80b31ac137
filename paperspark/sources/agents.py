"""The agent catalogue: one row per agent definition.

Definitions are small records (class, name, instructions, link to another
agent). They can come from JSON lines, YAML-like dicts, or a DataFrame; the
class is lower-cased data, not a folder name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import AGENT_SCHEMA


def agents_from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    rows = [(r.get("agent_class"), r.get("agent_name"), r.get("instructions"), r.get("agent_link"))
            for r in records]
    return normalise_agents(spark.createDataFrame(rows, AGENT_SCHEMA))


def read_agents(spark: SparkSession, path: str) -> DataFrame:
    """Agent definitions from JSON lines (one object per agent)."""
    return normalise_agents(spark.read.schema(AGENT_SCHEMA).json(path))


def normalise_agents(df: DataFrame, agent_class: str | list[str] | None = None) -> DataFrame:
    """Lower-case the class, keep the first definition of each (class,
    name), optionally keep only some classes."""
    out = df.withColumn("agent_class", F.lower(F.col("agent_class")))
    if agent_class is not None and agent_class != "all":
        classes = [agent_class] if isinstance(agent_class, str) else list(agent_class)
        out = out.filter(F.col("agent_class").isin([c.lower() for c in classes]))
    return out.dropDuplicates(["agent_class", "agent_name"])


def agent_links(agents: DataFrame) -> DataFrame:
    """Each agent with the agent its link names (NULL when unknown)."""
    a = agents.alias("a")
    b = agents.select(F.col("agent_name").alias("linked_name"),
                      F.col("agent_class").alias("linked_class")).alias("b")
    return (a.join(b, F.col("a.agent_link") == F.col("b.linked_name"), "left")
            .select("a.agent_class", "a.agent_name", "a.agent_link", "linked_class"))
