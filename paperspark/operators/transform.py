"""User text functions applied in Arrow batches across the cluster.

A user function takes a list of texts and returns a list of outputs of the
same length (a summary, a vector, ...). It runs inside ``mapInPandas``, on
slices of ``batch_size`` rows, so a remote service sees requests of that
size and concurrency is the number of tasks. A failing slice yields NULL
outputs with the error text in ``error``; the key columns travel with each
row, so nothing can shift onto the wrong key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.text import text_validity
from ..session import ship_package
from ..schemas import EMBED_BATCH_SIZE

TextFn = Callable[[list], Sequence]


def _check_batch_size(batch_size) -> int:
    size = int(batch_size)
    if size < 1:
        raise ValueError("batch_size must be at least 1")
    return size


def apply_batched(df: DataFrame, fn: TextFn, input_col: str, output_col: str,
                  output_type: T.DataType, batch_size: int = EMBED_BATCH_SIZE,
                  keep_cols: list[str] | None = None) -> DataFrame:
    """``keep_cols + [output_col, error]`` with ``fn`` applied to ``input_col``."""
    keep = list(keep_cols) if keep_cols is not None else [c for c in df.columns if c != input_col]
    ship_package(df.sparkSession)
    in_df = df.select(*keep, F.col(input_col).alias("_in"))
    out_schema = T.StructType(
        [in_df.schema[c] for c in keep]
        + [T.StructField(output_col, output_type), T.StructField("error", T.StringType())])
    size = _check_batch_size(batch_size)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            outs, errs = [], []
            texts = pdf["_in"].tolist()
            for i in range(0, len(texts), size):
                chunk = texts[i:i + size]
                try:
                    res = list(fn(chunk))
                    if len(res) != len(chunk):
                        raise ValueError(f"function returned {len(res)} outputs for {len(chunk)} inputs")
                    outs.extend(res)
                    errs.extend([None] * len(chunk))
                except Exception as e:  # noqa: BLE001 - reported per row
                    outs.extend([None] * len(chunk))
                    errs.extend([f"{type(e).__name__}: {e}"] * len(chunk))
            res_df = pdf.drop(columns=["_in"])
            res_df[output_col] = pd.Series(outs, index=pdf.index, dtype=object)
            res_df["error"] = pd.Series(errs, index=pdf.index, dtype=object)
            yield res_df

    return in_df.mapInPandas(run, out_schema)


def split_valid(df: DataFrame, text_col: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` by :func:`text_validity`; rejected rows carry
    ``reason``. With ``strict=True`` an invalid text fails the job."""
    v = text_validity(text_col)
    tagged = df.withColumn("_valid", v)
    if strict:
        tagged = tagged.withColumn("_valid", F.when(
            ~F.col("_valid.is_valid"),
            F.raise_error(F.concat(F.lit("invalid text: "), F.col("_valid.reason")))
        ).otherwise(F.col("_valid")))
    valid = tagged.filter(F.col("_valid.is_valid")).drop("_valid")
    rejected = (tagged.filter(~F.col("_valid.is_valid"))
                .withColumn("reason", F.col("_valid.reason")).drop("_valid"))
    return valid, rejected


def embed_with(df: DataFrame, fn: TextFn, text_col: str, key_cols: list[str],
               batch_size: int = EMBED_BATCH_SIZE, strict: bool = False,
               out_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Validate texts, then embed the valid ones with ``fn`` in batches.

    Returns ``(vectors, rejected)``: vectors = key_cols, embedding
    ARRAY<DOUBLE>, error; rejected = invalid texts with a reason.
    """
    valid, rejected = split_valid(df, text_col, strict)
    vecs = apply_batched(valid, fn, text_col, out_col, T.ArrayType(T.DoubleType()),
                         batch_size, keep_cols=key_cols)
    return vecs, rejected


def agent_rows(agents: DataFrame, agent_class: str | None = "summarizer",
               agent_name: str | None = None) -> list:
    """Agents of a class (and optionally one name). Every agent is a
    function that the caller builds on the driver, so their rows fit there."""
    if agent_class is not None:
        agents = agents.filter(F.col("agent_class") == agent_class.lower())
    rows = agents.select("agent_class", "agent_name", "instructions").collect()
    if agent_class is not None and not rows:
        raise ValueError(f"the catalogue has no agent of class {agent_class!r}")
    if agent_name is not None:
        found = [r for r in rows if r.agent_name == agent_name]
        if not found:
            raise ValueError(f"class {agent_class!r} has no agent {agent_name!r}, only {[r.agent_name for r in rows]}")
        rows = found
    return rows


def agent_keys(texts: DataFrame, names: list[str], key_cols: list[str], agent_col: str = "agent_name") -> DataFrame:
    """``key_cols, agent_col``: the keys of every text once per agent. The
    names are a literal array, so there is no join; texts stay behind."""
    return texts.select(*key_cols, F.explode(F.array(*[F.lit(n) for n in names])).alias(agent_col))


def run_agents(texts: DataFrame, fns: dict, key_cols: list[str], text_col: str, agents_col: str,
               batch_size: int = EMBED_BATCH_SIZE, output_col: str = "summary_text",
               agent_col: str = "agent_name") -> DataFrame:
    """Every text through the functions of the agents that its array
    ``agents_col`` names, in batches of ``batch_size``.

    A text enters the Python worker once, however many agents work on it.
    Output: one row per text and agent with key_cols, agent_col, output_col,
    error."""
    ship_package(texts.sparkSession)
    src = texts.select(*key_cols, F.col(agents_col).alias("_agents"), F.col(text_col).alias("_text"))
    out_schema = T.StructType([src.schema[c] for c in key_cols] + [
        T.StructField(agent_col, T.StringType()),
        T.StructField(output_col, T.StringType()),
        T.StructField("error", T.StringType())])
    size = _check_batch_size(batch_size)

    def call(name, batch):
        try:
            if name not in fns:
                raise KeyError(f"no function for agent '{name}'")
            found = list(fns[name](batch))
            if len(found) != len(batch):
                raise ValueError("function returned a wrong number of outputs")
            return found, [None] * len(batch)
        except Exception as e:  # noqa: BLE001 - reported per row
            return [None] * len(batch), [f"{type(e).__name__}: '{name}': {e}"] * len(batch)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows_of: dict = {}
            for row, names in enumerate(pdf["_agents"]):
                for name in names:
                    rows_of.setdefault(name, []).append(row)
            held = pdf["_text"].tolist()
            for name, rows in rows_of.items():
                outs, errs = [], []
                for i in range(0, len(rows), size):
                    out, err = call(name, [held[r] for r in rows[i:i + size]])
                    outs += out
                    errs += err
                res = pdf.iloc[rows][key_cols].reset_index(drop=True)
                res[agent_col] = name
                res[output_col] = pd.Series(outs, dtype=object)
                res["error"] = pd.Series(errs, dtype=object)
                yield res

    return src.mapInPandas(run, out_schema)


def apply_agents(texts: DataFrame, agents: DataFrame, fn_for_agent: Callable[[str, str], TextFn],
                 text_col: str, key_cols: list[str], agent_class: str | None = "summarizer",
                 agent_name: str | None = None, batch_size: int = EMBED_BATCH_SIZE,
                 output_col: str = "summary_text") -> DataFrame:
    """Every selected agent applied to every text.

    ``fn_for_agent(agent_name, instructions)`` returns the text function of
    one agent; unknown classes or names raise. Output: key_cols,
    agent_name, output_col, error.
    """
    rows = agent_rows(agents, agent_class, agent_name)
    fns = {r.agent_name: fn_for_agent(r.agent_name, r.instructions) for r in rows}
    listed = texts.withColumn("_agents", F.array(*[F.lit(n) for n in fns]))
    return run_agents(listed, fns, key_cols, text_col, "_agents", batch_size, output_col)


def outputs_per_agent(results: DataFrame, order_col: str, output_col: str = "summary_text",
                      chunk: int = 10_000) -> DataFrame:
    """Outputs regrouped per agent in input order, in chunks of ``chunk``.
    ``results`` is staged first, so the agents' functions run once."""
    from .grouping import chunked_lists

    return chunked_lists(results, ["agent_name"], output_col, order=order_col, chunk=chunk,
                         out_col="outputs")
