"""Extension point: detectors of the user's own beside the built-in ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from findmill import schemas as S

SOURCE_TYPES = ("sast", "sca", "secrets", "dast")


class DetectorError(Exception):
    """A detector that cannot be used; ``kind`` is one of the engine failure kinds."""

    def __init__(self, name: str, kind: str, message: str) -> None:
        super().__init__(f"[{name}] {message}")
        self.name, self.kind = name, kind


@dataclass(frozen=True)
class Detector:
    """``run`` maps ``files(project, path, content)`` to project plus the raw finding columns."""

    name: str
    source_type: str
    run: Callable[[DataFrame], DataFrame]


class DetectorRegistry:
    def __init__(self) -> None:
        self._detectors: dict[str, Detector] = {}

    def register(self, detector: Detector, probe: DataFrame) -> None:
        """Add a detector after checking its output type on the plan; nothing is run."""
        if detector.source_type not in SOURCE_TYPES:
            raise DetectorError(detector.name, "rule_config", f"unknown source type {detector.source_type}")
        if detector.name in self._detectors:
            raise DetectorError(detector.name, "rule_config", "already registered")
        self._checked(detector, probe)
        self._detectors[detector.name] = detector

    @staticmethod
    def _checked(detector: Detector, files: DataFrame) -> DataFrame:
        out = detector.run(files)
        have = dict(out.dtypes)
        want = {"project": "string"} | {f.name: f.dataType.simpleString() for f in S.RAW_FINDING.fields}
        wrong = sorted(n for n, t in want.items() if have.get(n) != t)
        if wrong:
            raise DetectorError(detector.name, "malformed_output", f"missing or mistyped columns: {', '.join(wrong)}")
        return out.select(*want).withColumn("tool", F.lit(detector.name)).withColumn("source_type", F.lit(detector.source_type))

    def names(self) -> list[str]:
        return sorted(self._detectors)

    def run(self, files: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Findings of the chosen detectors as one plan."""
        chosen = names or self.names()
        unknown = [n for n in chosen if n not in self._detectors]
        if unknown or not chosen:
            raise DetectorError(",".join(unknown) or "-", "unavailable", "no such detector")
        out = self._checked(self._detectors[chosen[0]], files)
        for n in chosen[1:]:
            out = out.unionByName(self._checked(self._detectors[n], files))
        return out


def pandas_detector(find: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Lift a function over batches of files into a detector.

    ``find`` gets project, path, content and returns any of the finding columns; the
    others are filled with their defaults.
    """
    fields = S.RAW_FINDING.fields
    names = ["project", *[f.name for f in fields]]
    schema = "project string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    defaults = {f.name: "" if f.dataType.simpleString() == "string" else None for f in fields}

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = find(pdf)
            for n in names:
                if n not in found.columns:
                    found[n] = [[] for _ in range(len(found))] if n == "redaction_tokens" else defaults.get(n, "")
            yield found[names].astype(object).where(found[names].notna(), None)

    return lambda files: files.select("project", "path", "content").mapInPandas(batches, schema)


def sql_detector(spark: SparkSession, name: str, source_type: str, find: Callable[[str, str, str], Iterable[dict]]) -> None:
    """Make a detector callable from SQL: ``SELECT * FROM name(TABLE(SELECT project, path, content FROM files))``.

    ``find(project, path, content)`` gives the findings of one file as dicts of finding columns; what it leaves out has
    its default. Files are judged where they lie. A table without the three text columns, or a finding with a column that
    findings do not have or a value of another kind, ends the query with a ``DetectorError`` of kind ``malformed_output``.
    """
    if source_type not in SOURCE_TYPES:
        raise DetectorError(name, "rule_config", f"unknown source type {source_type}")
    fields = {f.name: f.dataType for f in S.RAW_FINDING.fields}
    default = {n: [] if isinstance(t, T.ArrayType) else "" if isinstance(t, T.StringType) else None for n, t in fields.items()}
    kinds = {n: list if isinstance(t, T.ArrayType) else str if isinstance(t, T.StringType) else int for n, t in fields.items()}
    out = T.StructType([T.StructField("project", T.StringType()), *S.RAW_FINDING.fields])

    class Detect:
        @staticmethod
        def analyze(files: AnalyzeArgument) -> AnalyzeResult:
            have = {f.name: f.dataType.simpleString() for f in files.dataType.fields} if files.isTable else {}
            wrong = [c for c in ("project", "path", "content") if have.get(c) != "string"]
            if wrong:
                raise DetectorError(name, "malformed_output", f"malformed_output: the table lacks text columns {', '.join(wrong)}")
            return AnalyzeResult(out)

        def eval(self, file):
            for given in find(file["project"], file["path"], file["content"]):
                wrong = [c for c, x in given.items() if c not in kinds or not (x is None or isinstance(x, kinds[c]))]
                if wrong:
                    raise DetectorError(name, "malformed_output", f"malformed_output: unknown or mistyped columns {', '.join(wrong)}")
                row = default | {"file_path": file["path"], "severity": "low"} | given | {"tool": name, "source_type": source_type}
                yield (file["project"], *[row[n] for n in fields])

    spark.udtf.register(name, F.udtf(Detect))
