"""Run and stage records of the jobs, appended as rows."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id string, pipeline_name string, source_system string, run_mode string, started_at timestamp, "
    "completed_at timestamp, duration_seconds double, status string, rows_extracted bigint, rows_transformed bigint, "
    "rows_enriched bigint, rows_loaded bigint, error_message string, config_json string"
)
STAGE_SCHEMA = (
    "run_id string, stage_name string, started_at timestamp, completed_at timestamp, duration_seconds double, "
    "status string, rows_in bigint, rows_out bigint, notes string, error_message string"
)


@dataclass
class Stage:
    name: str
    rows_in: int = 0
    rows_out: int = 0
    notes: str = ""


@dataclass
class RunAudit:
    """``with RunAudit(...) as run: with run.stage('extract') as s: ...``; errors are recorded and re-raised."""

    spark: SparkSession
    folder: str
    pipeline_name: str
    source_system: str = "flows"
    run_mode: str = "full"
    config: dict = field(default_factory=dict)
    counts: dict = field(default_factory=dict)
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __enter__(self) -> RunAudit:
        self.started = datetime.now()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        done = datetime.now()
        count = [self.counts.get(k) for k in ("extracted", "transformed", "enriched", "loaded")]
        row = (self.run_id, self.pipeline_name, self.source_system, self.run_mode, self.started, done,
               round((done - self.started).total_seconds(), 2), "failed" if kind else "success", *count,
               str(error) if error else None, json.dumps(self.config, default=str))
        self._append("meta_pipeline_runs", row, RUN_SCHEMA)
        return False

    @contextmanager
    def stage(self, name: str):
        stage, started, error = Stage(name), datetime.now(), None
        try:
            yield stage
        except Exception as e:
            error = e
            raise
        finally:
            done = datetime.now()
            row = (self.run_id, name, started, done, round((done - started).total_seconds(), 2),
                   "failed" if error else "success", stage.rows_in, stage.rows_out, stage.notes,
                   str(error) if error else None)
            self._append("meta_pipeline_stages", row, STAGE_SCHEMA)

    def _append(self, table: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).write.mode("append").parquet(f"{self.folder}/{table}")


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at")).limit(limit)


def stages_of_run(stages: DataFrame, run_id: str) -> DataFrame:
    return stages.filter(F.col("run_id") == run_id).orderBy("started_at")
