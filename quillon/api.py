"""The scoring API: load a model graph, apply it to DataFrames."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import BadShape, UnknownOutput
from .plans.compile import apply_graph
from .plans.spec import Graph, Input, Output

ROW = "__row"


class ScoringModel:
    """A graph, ready to be applied. It holds no session: the data's own is used."""

    def __init__(self, graph: Graph | Mapping):
        self.graph = graph if isinstance(graph, Graph) else Graph.of(graph)

    @classmethod
    def load(cls, path: str) -> ScoringModel:
        return cls(Graph.load(path))

    @classmethod
    def loads(cls, data: str | bytes) -> ScoringModel:
        return cls(Graph.loads(data))

    def save(self, path: str) -> None:
        self.graph.save(path)

    @property
    def inputs(self) -> list[Input]:
        return self.graph.inputs

    @property
    def outputs(self) -> list[Output]:
        return self.graph.outputs

    def transform(self, df: DataFrame, outputs: list[str] | None = None, vector: str | None = None) -> DataFrame:
        """df with the outputs, or those named, as further columns. Batch or streaming."""
        return apply_graph(self.graph, df, outputs, vector)

    def fit(self, *_: object) -> ScoringModel:
        """Parameters are frozen: nothing to do."""
        return self

    def _choose(self, roles: tuple[str, ...], names: tuple[str, ...], default: int) -> str:
        for o in self.outputs:
            if o.role in roles or o.name in names:
                return o.name
        return self.outputs[min(default, len(self.outputs) - 1)].name

    def predict(self, data: object) -> object:
        """The output that is a prediction, else the first one: a DataFrame of data and it, or for local data an array."""
        return self._one(data, self._choose(("prediction",), ("y_pred", "prediction"), 0))

    def predict_proba(self, data: object) -> object:
        """The output that is a probability, else the last one."""
        return self._one(data, self._choose(("probability",), ("y_prob", "probability"), len(self.outputs) - 1))

    def _one(self, data: object, name: str) -> object:
        if isinstance(data, DataFrame):
            return self.transform(data, [name])
        return self.run(data, [name])[name]

    def _frame(self, spark: SparkSession, data: object) -> tuple[DataFrame, str | None]:
        """Local data as a DataFrame with a row number, and the column to be dealt out over the inputs, if it has no names."""
        if isinstance(data, pd.DataFrame):
            return spark.createDataFrame(data.assign(**{ROW: np.arange(len(data))})), None
        if isinstance(data, Mapping):
            local = {k: list(np.asarray(v, dtype=object)) if np.ndim(v) < 2 else [list(map(float, r)) for r in v] for k, v in data.items()}
            one = len(self.inputs) > 1 and len(local) == 1 and next(iter(local)) not in {i.column or i.name for i in self.inputs}
            frame = pd.DataFrame(local).infer_objects().assign(**{ROW: lambda f: np.arange(len(f))})
            return spark.createDataFrame(frame), next(iter(local)) if one else None
        rows = np.asarray(data, dtype=float)
        rows = rows.reshape(-1, sum(i.width for i in self.inputs)) if rows.ndim < 2 else rows
        if rows.shape[1] != sum(i.width for i in self.inputs):
            raise BadShape(f"{rows.shape[1]} features are given, not {sum(i.width for i in self.inputs)}")
        return spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(rows)], f"{ROW} long, x array<double>"), "x"

    def run(self, data: object, outputs: list[str] | None = None) -> dict[str, np.ndarray]:
        """All outputs, or those named, of local data (pandas, a mapping of columns, or a matrix), as arrays; missing is NaN."""
        df, vector = self._frame(SparkSession.builder.getOrCreate(), data)
        got = self.transform(df, outputs, vector).orderBy(ROW)
        names = [o.name for o in self.outputs if outputs is None or o.name in outputs]
        rows = got.select(*names).collect()

        def array(name: str) -> np.ndarray:
            values = [r[name] for r in rows]
            if values and isinstance(next((v for v in values if v is not None), 0.0), str):
                return np.array(values, dtype=object)
            plain = [[math.nan if x is None else x for x in v] if isinstance(v, list) else math.nan if v is None else v for v in values]
            return np.array(plain, dtype=object if plain and isinstance(plain[0], dict) else float)

        return {n: array(n) for n in names}

    def session(self) -> Session:
        return Session(self)

    def verify(self, atol: float = 1e-6, rtol: float = 1e-5) -> list[str]:
        """What the graph's recorded cases (inputs and outputs) say: a line for each output that differs. Missing equals missing only."""
        bad = []
        for n, case in enumerate(self.graph.verification):
            got = self.run(case["inputs"], list(case["outputs"]))
            for name, want in case["outputs"].items():
                flat = np.array([math.nan if v is None else v for v in np.asarray(want, dtype=object).reshape(-1)])
                have = got[name].reshape(-1)
                if flat.dtype == object:
                    continue
                if have.shape != flat.shape or not np.allclose(have, flat.astype(float), rtol, atol, equal_nan=True):
                    bad.append(f"case {n}, output {name}: {have.tolist()} instead of {flat.tolist()}")
        return bad


class Session:
    """Inputs bound one by one, then run together."""

    def __init__(self, model: ScoringModel):
        self.model, self.bound, self.made = model, {}, {}

    def bind(self, name: str, values: object) -> Session:
        self.bound[name] = values
        return self

    def run(self) -> Session:
        self.made = self.model.run(self.bound)
        return self

    def get(self, name: str) -> np.ndarray:
        if name not in self.made:
            raise UnknownOutput(f"there is no output {name}; run first")
        return self.made[name]


def score_summary(df: DataFrame, output: str) -> DataFrame:
    """Rows, missing values, mean and range of an output: one row, from partial sums."""
    c = F.col(output)
    return df.agg(F.count("*").alias("rows"), F.count(F.when(c.isNull(), 1)).alias("missing"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))
