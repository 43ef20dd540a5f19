"""Feature specs, parameters and their preconditions (the job's configuration)."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureSpec:
    """One feature of an element.

    kind 'numeric': `columns` are the double columns of its coordinates.
    kind 'categorical': `columns` is the single string column.
    `distance` names an entry of the distance registry (None = the default for the kind).
    """

    name: str
    kind: str
    columns: tuple[str, ...]
    distance: str | None = None

    def __post_init__(self):
        if self.kind not in ("numeric", "categorical"):
            raise ValueError(f"feature {self.name}: kind must be numeric or categorical")
        if self.kind == "categorical" and len(self.columns) != 1:
            raise ValueError(f"categorical feature {self.name} needs exactly one column")
        if not self.columns:
            raise ValueError(f"feature {self.name} has no column")

    @property
    def column(self) -> str:
        return self.columns[0]

    @property
    def distance_name(self) -> str:
        if self.distance:
            return self.distance
        return "euclidean" if self.kind == "numeric" else "normalizedLevenshtein"


def numeric(name: str, *columns: str, distance: str | None = None) -> FeatureSpec:
    return FeatureSpec(name, "numeric", tuple(columns) or (name,), distance)


def categorical(name: str, column: str | None = None, distance: str | None = None) -> FeatureSpec:
    return FeatureSpec(name, "categorical", (column or name,), distance)


# The spam-record features in the reference's order; numerics first.
SPAM_FEATURES = (
    numeric("time"),
    numeric("size"),
    numeric("space", "long", "lat"),
    numeric("IP", "ip"),
    categorical("bot"),
    categorical("uri"),
)
# Reduced featurizer: time and space only, no categorical feature.
SPAM_FEATURES_REDUCED = (
    numeric("time"),
    numeric("space", "long", "lat"),
)
# Weight names accepted for another feature name.
WEIGHT_ALIASES = {"botname": "bot"}


def resolve_weights(features, weights: dict[str, float]) -> dict[str, float]:
    """Weights are matched to features by name (never by position)."""
    names = [f.name for f in features]
    out: dict[str, float] = {}
    for key, w in weights.items():
        name = WEIGHT_ALIASES.get(key, key)
        if name not in names:
            raise ValueError(f"weight given for unknown feature {key!r}; features: {names}")
        if name in out:
            raise ValueError(f"two weights for feature {name!r}")
        out[name] = float(w)
    missing = [n for n in names if n not in out]
    if missing:
        raise ValueError(f"no weight for feature(s) {missing}")
    total = sum(out.values())
    if abs(1.0 - total) >= 0.001:
        raise ValueError(f"the weights add up to {total}, not to 1")
    return out


MODES = ("PartialSums", "Standard")
# The keys of the parameter file and of the job configuration.
PARAMETER_KEYS = ("mode", "initialCentroids", "convergeDist", "numSamplesForMedoid", "weights", "maxIter")
JOB_KEYS = ("host", "inputFile", "appName", "evalOutput")


def require_keys(conf: dict, keys, what: str) -> None:
    if missing := [k for k in keys if k not in conf]:
        raise ValueError(f"the {what} lacks the key(s) {missing}")


@dataclass
class ClusterParams:
    mode: str = "PartialSums"          # 'PartialSums' | 'Standard'
    k: int | str = 10                  # int, or 'auto' = floor(sqrt(n / 2))
    epsilon: float = 0.001
    max_iter: int = 2
    samples_for_medoid: int = 1
    weights: dict[str, float] = field(default_factory=dict)
    seed: int = 42
    assign_plan: str = "auto"          # 'auto' | 'inline' | 'dictionary'

    def validate(self, features, further_modes=()) -> dict[str, float]:
        if self.mode not in (*MODES, *further_modes):
            raise ValueError(f"mode must be one of {[*MODES, *further_modes]}, got {self.mode!r}")
        if not (self.k == "auto" or (isinstance(self.k, int) and self.k >= 1)):
            raise ValueError("k must be a positive int or 'auto'")
        if self.max_iter < 1:
            raise ValueError("max_iter must be >= 1")
        if self.samples_for_medoid < 0:
            raise ValueError("samples_for_medoid must be >= 0")
        if not any(f.kind == "categorical" for f in features) and self.samples_for_medoid != 0:
            raise ValueError("a medoid sample needs a categorical feature; set samples_for_medoid to 0")
        return resolve_weights(features, self.weights)

    @classmethod
    def from_conf(cls, conf: dict | str) -> "ClusterParams":
        """Read the reference's parameter file layout (JSON)."""
        if isinstance(conf, str):
            conf = json.loads(conf)
        require_keys(conf, PARAMETER_KEYS, "parameter file")
        return cls(
            mode=conf["mode"],
            k=conf["initialCentroids"],
            epsilon=float(conf["convergeDist"]),
            max_iter=int(conf["maxIter"]),
            samples_for_medoid=int(conf["numSamplesForMedoid"]),
            weights=dict(conf["weights"]),
        )


def suggest_k_value(n: int) -> int:
    return max(1, int(math.floor(math.sqrt(n / 2.0))))
