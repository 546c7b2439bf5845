"""Settings of a project folder, and what a run records of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Folders and files of a project, below its root; the strategy that request seeds follow.
FOLDERS = {"data_dir": "data", "output_dir": "outputs", "world_path": "data/world.json", "schema_path": "data/quest_schema.json"}
SEED_STRATEGY = "run_seed_plus_request_index"


@dataclass(frozen=True)
class Settings:
    """Paths (any that Spark reads) and parameters; a project's own values replace the defaults."""

    root: str
    data_dir: str
    output_dir: str
    world_path: str
    schema_path: str
    generation_model: str = "llama3.2"
    review_model: str = "llama3.2"
    generation_temperature: float = 0.7
    review_temperature: float = 0.1
    top_p: float = 0.9
    request_timeout_seconds: int = 360
    max_repair_attempts: int = 3
    max_generation_attempts: int = 8
    more: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_project_root(cls, root: str, **own: Any) -> Settings:
        root = root.rstrip("/")
        return replace(cls(root, **{k: f"{root}/{v}" for k, v in FOLDERS.items()}), **own)


def run_metadata(spark: SparkSession, settings: Settings, seed: int | None, batches: int, per_batch: int) -> DataFrame:
    """One row: what a run's results go by."""
    row = (seed, SEED_STRATEGY, settings.generation_model, settings.review_model, settings.generation_temperature, settings.review_temperature, settings.top_p, batches, per_batch, batches * per_batch)
    fields = "run_seed long, seed_strategy string, generation_model string, review_model string, generation_temperature double, review_temperature double, top_p double, batches int, quests_per_batch int, total_quests_per_configuration int"
    return spark.createDataFrame([row], fields)
