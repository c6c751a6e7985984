"""Job parameters: plain dataclasses that read and write the usual nested config layout."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from tallyfold.operators.fingerprints import FEATURIZERS, featurizer
from tallyfold.operators.learning import BoostParams, trainer

SINGLE, ENSEMBLE = "single", "ensemble"

# Model and fingerprint names accepted in a config file.
MODEL_NAMES = {"single": SINGLE, "ensemble": ENSEMBLE, "xgboost": SINGLE, "xgboost_ensemble": ENSEMBLE}
FEATURIZER_NAMES = {
    "token_chain": "token_chain",
    "graph_circular": "graph_circular",
    "pattern_keys": "pattern_keys",
    "circular_fingerprint": "graph_circular",
    "structure_keys": "structure_keys",
    "maccs_fingerprint": "structure_keys",
    "ensemble_predictions": "weak_scores",
    "weak_scores": "weak_scores",
}
# Settings that belong to the cluster or are implied by Spark's trees; read, kept and not used.
CLUSTER_KEYS = ("verbosity", "nthread", "tree_method", "grow_policy", "device")

OBJECTIVE = "binary:logistic"


@dataclass(frozen=True)
class FeatureParams:
    name: str = "token_chain"
    radius: int = 2
    length: int = 2048
    hash: str = "xx"

    def __post_init__(self):
        if self.name != "weak_scores":
            featurizer(self.name)


@dataclass(frozen=True)
class Columns:
    """Which columns of the input play which part.

    ``row_id=None`` numbers the rows by file position; ``test_id`` names the id of the test table where it
    differs from that of the training table.
    """

    text: str
    label: str
    row_id: str | None = None
    category: str | None = None
    test_id: str | None = None


@dataclass(frozen=True)
class JobParams:
    model: BoostParams = BoostParams()
    kind: str = SINGLE
    features: FeatureParams = FeatureParams()
    train_size: int = -1
    target_scale_pos_weight: float = -1
    weak: JobParams | None = None
    trainer: str = "boosted_trees"
    train_share: float = 0.8
    seed: int = 42
    hash: str = "xx"  # of row ids; "md5" makes the row sets reproducible outside Spark
    debug: bool = False
    debug_rows: int = 50_000
    debug_added: int = 10_000
    top_up_from: str = "own"  # "all": positives of the whole table, even those dealt to other learners
    code_mode: str = "append"  # "add": the code is added to every bit instead
    ignored: dict = field(default_factory=dict)

    def __post_init__(self):
        trainer(self.trainer)
        if self.kind not in (SINGLE, ENSEMBLE):
            raise ValueError(f"model kind {self.kind!r} is not supported")
        if self.kind == ENSEMBLE and self.weak is None:
            raise ValueError("an ensemble needs the settings of its weak learners")
        if self.code_mode not in ("append", "add"):
            raise ValueError(f"code_mode {self.code_mode!r} is not supported")

    @classmethod
    def from_dict(cls, config: Mapping, **extra) -> JobParams:
        """Read ``{"model": …, "train": …, "featurizer": …}``; unknown keys are an error."""
        model, train, feats = dict(config["model"]), dict(config["train"]), dict(config["featurizer"])
        name = model.pop("name")
        if name not in MODEL_NAMES:
            raise ValueError(f"model {name!r} is not supported")
        if feats["name"] not in FEATURIZER_NAMES and feats["name"] not in FEATURIZERS:
            raise ValueError(f"featurizer {feats['name']!r} is not supported")
        if feats["name"] == "maccs_fingerprint":
            warnings.warn("maccs_fingerprint selects this library's own structure keys, not the public key set", stacklevel=2)
        feats["name"] = FEATURIZER_NAMES.get(feats["name"], feats["name"])
        weak = model.pop("weak_learner_config", None)
        model.pop("num_weak_learners", None)
        ignored = {k: model.pop(k) for k in CLUSTER_KEYS if k in model}
        objective = model.pop("objective", OBJECTIVE)
        if objective != OBJECTIVE:
            raise ValueError(f"objective {objective!r} is not supported, only {OBJECTIVE!r}")
        boost = BoostParams(
            early_stopping_rounds=train.get("early_stopping_rounds"), seed=extra.get("seed", 42), **model
        )
        return cls(
            model=boost,
            kind=MODEL_NAMES[name],
            features=FeatureParams(**feats),
            train_size=train.get("train_size", -1),
            target_scale_pos_weight=train.get("target_scale_pos_weight", -1),
            weak=cls.from_dict(weak, **extra) if weak else None,
            ignored=ignored,
            **extra,
        )

    @classmethod
    def from_yaml(cls, path: str, **extra) -> JobParams:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("reading YAML needs the yaml package; pass a dict to from_dict instead") from e
        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f), **extra)

    def to_dict(self) -> dict:
        """Nested plain values; ``from_saved`` reads them back."""

        def plain(v):
            return {f.name: plain(getattr(v, f.name)) for f in fields(v)} if hasattr(v, "__dataclass_fields__") else v

        return plain(self)

    @classmethod
    def from_saved(cls, saved: Mapping) -> JobParams:
        saved = dict(saved)
        saved["model"] = BoostParams(**saved["model"])
        saved["features"] = FeatureParams(**saved["features"])
        saved["weak"] = cls.from_saved(saved["weak"]) if saved["weak"] else None
        return cls(**saved)
