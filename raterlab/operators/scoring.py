"""Resumable batch scoring.

The scored result table *is* the resume log: work already present for
(persona, approach, seed, id) is removed with a left-anti join before any scorer
call, so re-running a job adds nothing. The scorer is caller-supplied and runs in
``mapInPandas`` over Arrow batches; any per-row failure becomes the fallback
record instead of failing the task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlab import constants as C

KEY = ["persona", "approach", "seed", "id"]


def result_schema(id_type: str = "bigint") -> str:
    return (f"persona string, approach string, seed int, id {id_type}, model_name string, "
            "temperature double, max_tokens int, output string")


def pending(grid: DataFrame, done: DataFrame | None, retry_failed: bool = False) -> DataFrame:
    """Grid rows without a result yet. Failed responses count as done unless
    ``retry_failed``."""
    if done is None:
        return grid
    d = done
    if retry_failed:
        d = d.filter(~F.col("output").contains('"failed to generate"'))
    return grid.join(d.select(*KEY).distinct(), KEY, "left_anti")


def pending_with_texts(pubs: DataFrame, personas: DataFrame, approach: str, seeds: Sequence[int], done: DataFrame | None,
                       persona_cols: Sequence[str] = ("persona", "narrative"), retry_failed: bool = False) -> DataFrame:
    """J11 + J9 with late materialisation: the grid of keys alone meets the results, and only what is left fetches its
    text (by id) and its persona's columns. Ids are expected once in ``pubs``."""
    keys = work_grid(pubs.select("id"), personas.select("persona"), approach, seeds, ("persona",))
    todo = pending(keys, done, retry_failed)
    return todo.join(pubs, "id").join(personas.select(*persona_cols), "persona")


def latest(log: DataFrame, ts_col: str = "ingest_ts") -> DataFrame:
    """Last log line per key (``max_by`` aggregate, pre-reduced per task)."""
    cols = [c for c in log.columns if c not in KEY]
    m = F.max_by(F.struct(*cols), ts_col)
    return log.groupBy(*KEY).agg(m.alias("_l")).select(*KEY, "_l.*")


def run_scorer(work: DataFrame, scorer: Callable[[pd.Series, pd.DataFrame], pd.Series],
               model_name: str | dict[str, str] = C.MODEL_NAME, temperature: float = C.TEMPERATURE,
               max_tokens: int = C.MAX_TOKENS, parallelism: int | None = None) -> DataFrame:
    """L6 + F4 + L4: score ``work`` (persona, approach, seed, id, messages) and return
    result envelopes. ``scorer(messages_json, batch)`` is called once per row, with series and frame of
    that row alone, and returns its raw model text; text that is not JSON, or a call that raises, yields the
    failure record of that row. No row is ever sent twice.

    ``parallelism`` sets the number of concurrent scorer tasks (the external
    service's rate limit is the scorer's business). ``model_name`` may map persona →
    model (one fine-tuned model per persona).
    """
    w = work.select(*KEY, F.to_json("messages").alias("messages_json"))
    id_type = w.schema["id"].dataType.simpleString()
    if parallelism:
        w = w.repartition(parallelism)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answer(b: pd.DataFrame):
            try:
                raw = list(scorer(b["messages_json"], b))
                return raw[0] if len(raw) == 1 else None
            except Exception:  # noqa: BLE001 — a failing call must not abort the job
                return None

        for b in batches:
            out = []
            for r in (answer(b.iloc[i:i + 1]) for i in range(len(b))):
                try:
                    out.append(json.dumps(json.loads(r), ensure_ascii=False))
                except Exception:  # noqa: BLE001
                    out.append(C.FAILED_OUTPUT_JSON)
            yield pd.DataFrame({
                "persona": b["persona"], "approach": b["approach"], "seed": b["seed"].astype("int32"),
                "id": b["id"],
                "model_name": b["persona"].map(model_name) if isinstance(model_name, dict) else model_name,
                "temperature": float(temperature),
                "max_tokens": int(max_tokens), "output": out})

    return w.mapInPandas(score, result_schema(id_type))


def append_results(results: DataFrame, path: str) -> None:
    """K4/K5: append to the partitioned result table (persona=/approach=/seed=)."""
    (results.withColumn("ingest_ts", F.current_timestamp())
     .write.mode("append").partitionBy("persona", "approach", "seed").parquet(path))


# ---- deterministic scorer used by tests and registered queries -----------------
def length_scorer(messages_json: pd.Series, batch: pd.DataFrame) -> pd.Series:
    """Label from the user message length: emotion = EMOTIONS[len % 7], level =
    len % 5 + 1; lengths divisible by 13 return non-JSON text (a failed call)."""
    out = []
    for m in messages_json:
        msgs = json.loads(m)
        n = len(msgs[-1]["content"])
        if n % 13 == 0:
            out.append("the model said something that is not JSON")
            continue
        k = n % 7
        out.append(json.dumps({"emotion": C.EMOTIONS[k],
                               "emotion_class": "positive" if k in (1, 2, 3) else "negative",
                               "trigger_level": n % 5 + 1, "context": [], "description": f"length {n}"}))
    return pd.Series(out)


def work_grid(pubs: DataFrame, personas: DataFrame, approach: str, seeds: Sequence[int] = C.SEEDS,
              persona_cols: Sequence[str] = ("persona", "narrative")) -> DataFrame:
    """J11 for one approach: publications × personas × seeds (Generate, no join)."""
    from raterlab.operators.prompts import persona_grid
    return persona_grid(pubs, personas, seeds, persona_cols).withColumn("approach", F.lit(approach))
