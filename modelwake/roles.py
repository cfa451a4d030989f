"""What each column of a monitored table means, and the settings of a prediction task."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame


class SemanticType(str, Enum):
    NUMERICAL = "numerical"
    CATEGORICAL = "categorical"
    TIMESTAMP = "timestamp"


class TaskType(str, Enum):
    REGRESSION = "regression"
    BINARY = "binary_classification"


@dataclass(frozen=True)
class TaskSpec:
    """Target, keys and tuning metric of one prediction task."""

    name: str
    target: str
    identifiers: tuple[str, ...]
    task_type: TaskType
    tune_metric: str
    table_prefix: str


#: The two retail tasks.
TASKS = {
    "item-sales": TaskSpec(
        "item-sales", "sales", ("article_id", "timestamp"), TaskType.REGRESSION, "mae", "item_sales"
    ),
    "user-churn": TaskSpec(
        "user-churn", "churn", ("customer_id", "timestamp"), TaskType.BINARY, "roc_auc", "user_churn"
    ),
}


@dataclass(frozen=True)
class TimeConfig:
    """Calendar months of one year that form the train, validation and test splits."""

    year: int = 2020
    train_months: tuple[int, ...] = (1, 2, 3, 4, 5, 6)
    val_month: int = 7
    test_month: int = 8


@dataclass(frozen=True)
class ColumnRoles:
    """Column roles of a table. Features are every typed column that is neither key nor target."""

    types: dict[str, SemanticType]
    identifiers: tuple[str, ...]
    target: str
    prediction: str = "prediction"
    error: str = "error"

    def __post_init__(self):
        unknown = [c for c in self.identifiers if c not in self.types]
        if unknown:
            raise KeyError(f"identifier columns without a type: {unknown}")

    @classmethod
    def for_task(cls, task: TaskSpec, types: dict[str, SemanticType]) -> "ColumnRoles":
        return cls(types, task.identifiers, task.target)

    @property
    def id_column(self) -> str:
        plain = [c for c in self.identifiers if self.types[c] != SemanticType.TIMESTAMP]
        return plain[-1] if plain else ""

    @property
    def timestamp_column(self) -> str:
        times = [c for c in self.identifiers if self.types[c] == SemanticType.TIMESTAMP]
        return times[-1] if times else ""

    @property
    def features(self) -> list[str]:
        return [c for c in self.types if c not in self.identifiers and c != self.target]

    def _features_of(self, kind: SemanticType) -> list[str]:
        return [c for c in self.features if self.types[c] == kind]

    @property
    def numerical(self) -> list[str]:
        return self._features_of(SemanticType.NUMERICAL)

    @property
    def categorical(self) -> list[str]:
        return self._features_of(SemanticType.CATEGORICAL)

    @property
    def timestamps(self) -> list[str]:
        return self._features_of(SemanticType.TIMESTAMP)

    def validate(self, df: DataFrame, need_target: bool = False) -> None:
        """Raise before any job starts when columns are missing."""
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise KeyError(f"columns not in table: {missing}")
        if need_target and self.target not in df.columns:
            raise ValueError(f"the table has no target column {self.target}")

    def project(self, df: DataFrame) -> DataFrame:
        """Features, plus the target where the table has it."""
        self.validate(df)
        keep = self.features + ([self.target] if self.target in df.columns else [])
        return df.select(*keep)
