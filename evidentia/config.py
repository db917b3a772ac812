"""Parameters with their defaults, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # matching
    matching_mode: str = "PRUNED"
    episode_window_years: float = 5.0
    knn_k: int = 20
    sim_floor: float = 0.60
    sim_auto_repeat: float = 0.93
    idf_floor: float = 0.25
    co_mention_hub_share: float = 0.30
    candidates_per_claim: int = 80
    # entity resolution
    entity_merge: float = 0.85
    entity_review: float = 0.75
    # judging
    ensemble_k: int = 5
    confidence_floor: float = 0.55
    # scoring
    volatile_half_life_years: dict[str, float] = field(default_factory=lambda: {"SKILL": 5.0})
    max_iterations: int = 20
    epsilon: float = 0.005
    damping: float = 0.5
    corroboration_weight: float = 0.8
    contradiction_weight: float = 1.2
    dependence_damping: float = 0.4
    explanation_mitigation: float = 0.6
    anchor_plasticity: float = 0.2
    against_interest_bonus: float = 0.4
    inferred_penalty: float = -0.5
    self_praise_ceiling: float = 0.65
    trust_shrinkage: int = 5
    tier_high: float = 0.75
    tier_medium: float = 0.45
    declared_belief_floor: float = 0.50
    favorability_threshold: float = 0.5
    as_of: str = "2026-07-09"
    # subject index
    mass_midpoint: float = 2.0
    depth_weight: float = 0.30
    self_only_penalty: float = 0.30
    diversity_weight: float = 0.15
    contradiction_drag_weight: float = 0.25
    contradiction_midpoint: float = 2.0
    attestor_target: int = 4
    doc_coverage_target: float = 0.25
    diversity_shares: tuple[float, float, float] = (0.5, 0.3, 0.2)
    bands: tuple[tuple[float, str], ...] = ((0.80, "STRONG"), (0.65, "GOOD"), (0.45, "MODERATE"), (0.25, "WEAK"))
    # training sets
    score_bare_gap: float = 0.15
    conflict_epsilon: float = 0.05
    independence_high: float = 0.5
    mix: dict[str, float] = field(default_factory=lambda: {"QA": 0.25, "SITUATIONAL": 0.35, "MULTI_CLAIM": 0.25})
    conversations_per_claim: int = 6
    dedupe_jaccard: float = 0.85
    subset_size: int = 12
    subset_laps: int = 3
    holdout_fraction: float = 0.10
    max_tokens: int = 8192
    # limits
    attempts_per_window: int = 5
    attempt_window_seconds: int = 60
    lockout_seconds: int = 900
    messages_per_session: int = 30
    chat_interval_seconds: int = 3
    daily_cap: int = 200
    session_ttl_minutes: int = 60

    @property
    def exhaustive(self) -> bool:
        return self.matching_mode == "EXHAUSTIVE"
