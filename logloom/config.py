"""Pipeline settings and the named datasets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Site numbers and names, as the log formats define them.
SITES = {1: "portal", 2: "news", 3: "shop", 4: "api"}


@dataclass(frozen=True)
class PipelineConfig:
    """What a run of the pipeline depends on.

    strategy: "hash" (FNV-1a 64 of the address) or "range" (sampled
    boundaries).  compat_source_sites: list for each address all sites that
    its partition has seen rather than its own.  allow_empty: let validation
    pass when input and output are both empty.  networks: path of a table of
    networks for places; places are synthetic without one.  memory_threshold:
    percentage of memory in use above which a phase is reported.
    """

    n_reducers: int = 4
    strategy: str = "hash"
    chunk_size: int = 2048
    sample_size: int = 10_000
    skew_threshold: float = 0.5
    steal_iterations: int = 10
    rebalance: bool = True
    compat_source_sites: bool = False
    allow_empty: bool = False
    max_attempts: int = 3
    backoff_base: float = 1.5
    networks: str | None = None
    memory_threshold: float = 80.0

    def __post_init__(self):
        if self.n_reducers < 1 or self.strategy not in ("hash", "range"):
            raise ValueError("n_reducers must be positive and strategy hash or range")


@dataclass(frozen=True)
class Dataset:
    """Files of one dataset by site; ``unified`` is the file of a csv dataset that validation reads."""

    kind: str
    files: dict[int, str] = field(default_factory=dict)
    unified: str | None = None


def datasets(root: str) -> dict[str, Dataset]:
    """The named datasets under a folder: balanced (logs), csv, csv9k and skew."""
    return {
        "balanced": Dataset("log", {i: f"{root}/{s}_access.log" for i, s in SITES.items()}),
        "csv": Dataset("csv", {i: f"{root}/csv_{s}.csv" for i, s in SITES.items()}, f"{root}/apache_550k_unique_ips.csv"),
        "csv9k": Dataset("csv", {i: f"{root}/csv_9k_{s}.csv" for i, s in SITES.items()}, f"{root}/apache_550k_9k_dup.csv"),
        "skew": Dataset("csv", {i: f"{root}/csv_{s}_skew.csv" for i, s in SITES.items()}, f"{root}/apache_skew_unified.csv"),
    }


__all__ = ["SITES", "Dataset", "PipelineConfig", "datasets", "replace"]
