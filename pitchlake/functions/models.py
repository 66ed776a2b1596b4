"""Where detectors, readers and segmenters plug in; they run over Arrow batches, loaded once for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MODELS: dict[str, tuple[Callable[[], Any], str]] = {}

BOXES = "array<struct<class_id:int,confidence:double,x1:double,y1:double,x2:double,y2:double>>"


def register_model(name: str, load: Callable[[], Any], returns: str = "string") -> None:
    """``load`` makes a function from a list of inputs to a list of results of the type given."""
    _MODELS[name] = (load, returns)


def apply_model(df: DataFrame, name: str, column: str, output: str) -> DataFrame:
    """The rows with the model's result for ``column``. Filter the rows before: a filter above doesn't go below."""
    load, returns = _MODELS[name]

    @F.pandas_udf(returns)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(list(b)))

    return df.withColumn(output, of.asNondeterministic()(F.col(column)))


def prompted(df: DataFrame, encode: Callable[[Any], Any], answer: Callable[[Any, str], list[dict]], prompts: list[str], key: str = "image_id", image: str = "image") -> DataFrame:
    """(key, prompt, seq, confidence, box) of a text-prompted segmenter; each image is encoded once for all prompts."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, prompt string, seq int, confidence double, x1 double, y1 double, x2 double, y2 double"
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, raw in zip(b[key], b[image]):
                state = encode(raw)
                rows += [{key: k, "prompt": p, "seq": n, **box} for p in prompts for n, box in enumerate(answer(state, p))]
            yield pd.DataFrame(rows, columns=names)

    return df.select(key, image).mapInPandas(of, schema)


def exploded(results: DataFrame, keys: tuple[str, ...], column: str = "boxes") -> DataFrame:
    """Model results as one row for each box, det_idx from 1 in the order given."""
    return results.select(*keys, F.posexplode(column).alias("_n", "_b")).select(*keys, (F.col("_n") + 1).alias("det_idx"), "_b.*")
