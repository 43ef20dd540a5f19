"""The log of a job's iterations in a shared folder, from which a run goes on after its driver was lost.

<folder>/start holds one JSON row: the job's parameters, the number of points, the limits of the coordinates and k.
<folder>/iterations/iteration=<i> holds the centroids after iteration i (0: the seeds), a row each, with their movement and
the seconds of the iteration, written as one file; doubles are kept exactly. A folder that was not written
to its end has no file, or fewer rows than it names, and counts as not there: that iteration is run again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.scaling import Limits
from .geometry import Geometry
from .kmeans import KMeansResult


@dataclass
class Progress:
    spark: SparkSession
    folder: str
    geom: Geometry

    def _read(self, kind: str, name: str, schema: str) -> DataFrame | None:
        try:
            return getattr(self.spark.read.schema(schema), kind)(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def started(self) -> dict | None:
        """What begin() was given; None if the folder has no start."""
        rows = self._read("text", "start", "value string")
        line = rows.first() if rows is not None else None
        return json.loads(line["value"]) if line else None

    def begin(self, parameters: dict, n: int, limits: Limits, seeds: list[dict]) -> None:
        """The seeds first: with the start, all that a later run needs is there."""
        self.save(0, seeds, {}, 0.0)
        line = json.dumps({"parameters": parameters, "n": n, "limits": limits, "k": len(seeds)}, sort_keys=True)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/start")

    def _schema(self) -> str:
        numbers = "".join(f"`{c}` double, " for c in self.geom.numeric_columns)
        terms = "".join(f"`{c}` string, " for c in self.geom.categorical_columns)
        return f"cluster_id int, {numbers}{terms}movement double, seconds double, centroids int"

    def save(self, iteration: int, centroids: list[dict], movements: dict[int, float], seconds: float) -> None:
        names = [*self.geom.numeric_columns, *self.geom.categorical_columns]
        rows = [(c["cluster_id"], *[c.get(x) for x in names], movements.get(c["cluster_id"]), seconds, len(centroids)) for c in centroids]
        table = self.spark.createDataFrame(rows, self._schema()).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.folder}/iterations/iteration={iteration}")

    def last(self) -> KMeansResult:
        """The whole iterations from the seeds on, up to the first gap."""
        rows = self._read("parquet", "iterations", self._schema() + ", iteration int")
        found: dict[int, list[dict]] = {}
        for r in rows.orderBy("iteration", "cluster_id").collect():  # k rows an iteration
            found.setdefault(r["iteration"], []).append(r.asDict())
        res = KMeansResult([], 0)
        while (it := res.iterations + 1 if res.centroids else 0) in found and len(found[it]) == found[it][0]["centroids"]:
            own = found[it]
            res.centroids = [{k: v for k, v in c.items() if k not in ("movement", "seconds", "centroids", "iteration")} for c in own]
            res.iterations = it
            if it:
                res.movements.append({c["cluster_id"]: c["movement"] for c in own})
                res.seconds.append(own[0]["seconds"])
        return res
