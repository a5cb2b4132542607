"""Settings of the engine. Names, addresses and domains of an organisation are configuration, never literals."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    internal_domain: str = "example.com"
    always_exclude: tuple[str, ...] = ()
    firms: dict[str, str] = field(default_factory=dict)  # domain -> firm
    name_rules: tuple[tuple[str, str], ...] = ()  # (pattern, project), in order
    code_rules: tuple[tuple[str, str], ...] = ()  # (code, project)
    cluster_rules: tuple[tuple[str, str], ...] = ()  # (pattern, project), in order
    as_of: str = "2000-01-01"
    # search
    fts_limit: int = 300
    vector_k: int = 100
    cluster_decay: tuple[float, ...] = (1.0, 0.7, 0.5)
    noise_penalty: float = -0.1
    weights: tuple[float, float, float] = (0.3, 0.5, 0.2)  # words, vectors, clusters
    top_k: int = 20
    min_score: float = 0.55
    # person expansion
    window_days: int = 90
    min_overlap: int = 2
    context_threshold: float = 0.75
    # graph
    min_weight: float = 2.0
    internal_factor: float = 0.2
    min_community: int = 3
    # conversations and activity
    subject_gap_days: int = 60
    block_gap_days: int = 6
    streak_gap_days: int = 21
    activity_days: int = 30
    active_days: int = 60
    topic_min: int = 20
    model_cap: int = 25
    # models
    episode_prompt: str = "List the episodes of this thread, one a line: first day - last day | what it was about.\n\n"
    summary_prompt: str = "Sum up where this thread stands. Begin with SUMMARY: and end with OPEN: and what is still open.\n\n"
