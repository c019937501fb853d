"""The hook for user-supplied models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def annotate(
    df: DataFrame, factory: Callable, inputs: Sequence[str], output: str,
    skip_null: bool = False, error: str = "error",
) -> DataFrame:
    """Add a model's value and the column ``error`` to every row; a column of either
    name is replaced.

    ``factory()`` is called once per task and returns ``model(rows) -> values``,
    where ``rows`` is a list of tuples of the ``inputs``, as plain Python values.
    ``output`` is one column as DDL (``"summary string"``). Only the input columns
    travel to Python. If a batch fails, its rows are tried one by one: a failing row
    gets null and the error's text, the others keep their values. A model that
    cannot load marks the rows it would have been shown. With ``skip_null`` a row
    whose inputs are all null is not shown to the model.
    """
    field = T.StructType.fromDDL(output).fields[0]
    name = field.name
    returned = T.StructType([T.StructField("value", field.dataType), T.StructField("error", T.StringType())])
    kinds = list(to_arrow_schema(returned))

    @F.arrow_udf(returned)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = broken = None
        for batch in batches:
            rows = list(zip(*(batch.field(i).to_pylist() for i in range(batch.type.num_fields))))
            values, errors = [None] * len(rows), [None] * len(rows)
            shown = [
                i for i, row in enumerate(rows)
                if not (skip_null and all(value is None for value in row))
            ]
            if shown and model is None and broken is None:
                try:
                    model = factory()
                except Exception as failure:
                    broken = f"{type(failure).__name__}: {failure}"
            try:
                if broken is not None:
                    raise RuntimeError(broken)
                results = list(model([rows[i] for i in shown])) if shown else []
                if len(results) != len(shown):
                    raise ValueError("the model must return one value per row")
                for i, value in zip(shown, results):
                    values[i] = value
            except Exception:
                for i in shown:
                    try:
                        if broken is None:
                            values[i] = list(model([rows[i]]))[0]
                        else:
                            errors[i] = broken
                    except Exception as failure:
                        errors[i] = f"{type(failure).__name__}: {failure}"
            yield pa.StructArray.from_arrays(
                [pa.array(values, kinds[0].type), pa.array(errors, pa.string())], fields=kinds)

    answered = df.withColumn("_answer", run(F.struct(*inputs)))
    rest = [c for c in df.columns if c not in (name, error)]
    return answered.select(
        *rest, F.col("_answer.value").alias(name), F.col("_answer.error").alias(error))
