"""Pipeline configuration: one frozen dataclass."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Config:
    # None: every document is used; a number keeps that many (an exact sample, by choice only)
    sample_n: int | None = None
    # fixed values: defaults of the pipeline configuration
    random_seed: int = 42
    keep_hashtag_word: bool = True
    enrich_iocs: bool = False
    tfidf_max_features: int = 20000
    tfidf_ngram_range: tuple[int, int] = (1, 2)
    threat_detection_threshold: float = 0.7
    ioc_weight: float = 0.3
    graph_centrality_weight: float = 0.2
    # applied to the rows that fit the classifier only; every document is scored
    balance_method: str | None = "undersample"
    test_size: float = 0.2
    do_ioc_features: bool = True
    do_mitre_mapping: bool = True
    do_build_kg: bool = True
    do_baseline: bool = False
    do_embeddings_lr: bool = False
    # label source: "weak" (keyword rule, the reference behaviour) or "given"
    label_source: str = "weak"
    # broadcast a dimension side only when its counted bytes are below this bound
    broadcast_bytes: int = 64 << 20
    # model preference order for the scoring probability (first available wins)
    model_preference: tuple[str, ...] = field(default=("BERT", "CNN"))

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)


DEFAULT_CONFIG = Config()
