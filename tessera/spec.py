"""What a task is: its features, target, kind, primary metric and constraints, validated before any work."""

from __future__ import annotations

from dataclasses import dataclass, field

METRICS = {
    "classification": ("auc", "accuracy", "f1", "brier", "log_loss"),
    "regression": ("rmse", "mae", "r2", "rmsle"),
    "clustering": ("ari", "nmi", "silhouette"),
}
#: True where a larger value is better.
HIGHER = {"auc": True, "accuracy": True, "f1": True, "brier": False, "log_loss": False, "rmse": False, "mae": False, "r2": True, "rmsle": False, "ari": True, "nmi": True, "silhouette": True}
CONSTRAINTS = {"feature_iterations": 3, "model_iterations": 3, "parameter_iterations": 2, "stage_timeout_s": 600, "feedback_enabled": True, "optimization_enabled": True}


@dataclass(frozen=True)
class TableSpec:
    """Columns of a task table: row_id is its stable identity, categorical lists the features that are categories."""

    features: tuple[str, ...]
    target: str | None
    row_id: str = "row_id"
    categorical: tuple[str, ...] = ()


@dataclass(frozen=True)
class TaskSpec:
    task_type: str
    dataset: str
    primary_metric: str = ""
    output_preferences: tuple[str, ...] = ()
    constraints: dict = field(default_factory=dict)
    profile: str = "default"

    def __post_init__(self):
        if self.task_type not in METRICS:
            raise ValueError(f"unknown task type {self.task_type!r}")
        metric = self.primary_metric or METRICS[self.task_type][0]
        if metric not in METRICS[self.task_type]:
            raise ValueError(f"metric {metric!r} does not fit a {self.task_type} task")
        if unknown := set(self.constraints) - set(CONSTRAINTS):
            raise ValueError(f"unknown constraints: {', '.join(sorted(unknown))}")
        object.__setattr__(self, "primary_metric", metric)
        object.__setattr__(self, "constraints", CONSTRAINTS | dict(self.constraints))

    @property
    def higher_is_better(self) -> bool:
        return HIGHER[self.primary_metric]
