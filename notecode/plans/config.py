"""Parameters of a run, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from notecode.operators.admissions import NOTE_CATEGORIES
from notecode.operators.linear import Fit


@dataclass(frozen=True)
class RunConfig:
    """What to code, from which notes, and how to train and predict."""

    version: str = "9"
    kind: str = "diag"
    sequence: int | str = "all"
    category: str = "Discharge summary"
    categories: tuple[str, ...] = NOTE_CATEGORIES
    train_fraction: float = 0.66
    seed: int = 42
    subsample_train: int | None = None
    subsample_test: int | None = None
    longest_ngram: int = 1
    min_df: int = 1
    label_features: str = "pifa"
    indexer: str = "skmeans"
    cluster_size: int = 100
    index_iterations: int = 20
    index_seed: int = 0
    extra_depth: int = 1
    mode: str = "full-model"
    shallow: bool = True
    scheme: int = 1
    bias: float = 1.0
    fit: Fit = field(default_factory=Fit)
    beam: int = 10
    max_depth: int | None = None
    top_k: int = 10
    post: str = "l3-hinge"
    depth: int = 10

    def __post_init__(self) -> None:
        if self.version not in ("9", "10"):
            raise ValueError("version must be '9' or '10'")
        if self.kind not in ("diag", "proc"):
            raise ValueError("kind must be 'diag' or 'proc'")
        if self.version == "10" and self.kind != "diag":
            raise ValueError("version 10 has diagnoses only")
        if self.sequence != "all" and int(self.sequence) < 1:
            raise ValueError("sequence must be 'all' or a sequence number")
        if self.category not in self.categories:
            raise ValueError(f"unknown note category {self.category!r}")
