"""Surfaces of models that run outside of Spark: batches of rows go to a function and come back with a status."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as T


def with_retries(call: Callable, attempts: int, wait: float = 0.0) -> Callable:
    """call, tried again up to ``attempts`` times in all, with a pause that doubles; the last failure is raised."""

    def run(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(wait * 2**attempt)

    return run


def applied(rows: DataFrame, keys: list[str], inputs: list[str], call: Callable[[list[tuple]], list], kind: str = "string", batch: int = 16) -> DataFrame:
    """keys, result, status (success, failed), error, latency_ms: ``call`` on the inputs of up to ``batch`` rows at once.

    A batch that fails is tried row by row, so that one bad row costs no other its result.  A result of None is a failure.
    """
    kinds = dict(rows.dtypes)
    arrow = {"string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "struct<score:double,spans:array<string>>": pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.string()))])}[kind]

    def one(items: list[tuple]) -> list[tuple]:
        began = time.perf_counter()
        try:
            results = list(call(items))
            if len(results) != len(items):
                raise ValueError("a result for each row is needed")
            each = int((time.perf_counter() - began) * 1000 / len(items))
            return [(r, "success" if r is not None else "failed", None if r is not None else "no result", each) for r in results]
        except Exception as error:
            if len(items) > 1:
                return [x for item in items for x in one([item])]
            return [(None, "failed", f"{type(error).__name__}: {error}"[:500], int((time.perf_counter() - began) * 1000))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(len(keys) + i).to_pylist() for i in range(len(inputs))]
            items = list(zip(*columns))
            out = [x for i in range(0, len(items), batch) for x in one(items[i : i + batch])]
            result, status, error, latency = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keys)], pa.array(result, arrow), pa.array(status, pa.string()), pa.array(error, pa.string()), pa.array(latency, pa.int32())], names=[*keys, "result", "status", "error", "latency_ms"]
            )

    shape = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return rows.select(*keys, *inputs).mapInArrow(run, f"{shape}, result {kind}, status string, error string, latency_ms int")


def generated(rows: DataFrame, keys: list[str], prompt: str, backend: Callable[[list[str]], list[tuple[str, str]]], batch: int = 16) -> DataFrame:
    """keys, result, status, error, latency_ms of a backend that answers prompts with (text, reason it finished); an answer that was cut by its length is a failure."""

    def call(items: list[tuple]) -> list:
        answers = backend([p for (p,) in items])
        cut_off = [i for i, (_, reason) in enumerate(answers) if reason == "length"]
        if cut_off and len(items) == 1:
            raise ValueError("cut off by its length")
        if cut_off:
            raise ValueError("some were cut off")  # tried row by row
        return [text for text, _ in answers]

    out = applied(rows, keys, [prompt], call, "string", batch)
    return out.withColumn("result", T.generation_clean(F.col("result")))


def languages(rows: DataFrame, keys: list[str], text: str, classify: Callable[[list[str]], list[str]] | None = None, head: int = 300) -> DataFrame:
    """keys, lang, reason: by script where it tells, else what ``classify`` says of the text's head if that is a language in Latin script; null with a reason, never a default."""
    seen = rows.withColumn("_script", T.script(F.col(text)))
    told = seen.where("_script <> 'latin'").select(*keys, F.col("_script").alias("lang"), F.lit("script").alias("reason"))
    none = seen.where("_script is null").select(*keys, F.lit(None).cast("string"), F.lit("no_letters"))
    latin = seen.where("_script = 'latin'").withColumn("_head", F.left(text, F.lit(head)))
    if classify is None:
        return told.union(none).union(latin.select(*keys, F.lit(None).cast("string"), F.lit("unresolved")))
    named = applied(latin, keys, ["_head"], lambda items: classify([t for (t,) in items]))
    known = F.when(F.upper("result").isin("EN", "DE", "FR", "ES"), F.lower("result"))
    return told.union(none).union(named.select(*keys, known, F.when(known.isNotNull(), "model").otherwise("unresolved")))


def response_text(response: Column) -> Column:
    """The text of a model's response written as JSON, wherever its kind puts it; null without one."""
    paths = ("$.choices[0].message.content", "$.output.choices[0].message.content", "$.output.text", "$.choices[0].text", "$.text")
    return T.first_nonblank(*[F.get_json_object(response, p) for p in paths])


def score_rows(scored: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """inputs with score (null unless scored), status and error of applied() with a number for a result."""
    return inputs.join(scored.select(*keys, F.col("result").alias("score"), "status", "error", "latency_ms"), keys, "left").withColumn("status", F.coalesce("status", F.lit("missing")))
