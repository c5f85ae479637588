"""Thresholds and names shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from mailsieve.functions import fixed_values as fv


@dataclass(frozen=True)
class EngineConfig:
    # detection
    ml_confidence_threshold: float = 0.8
    use_scorer_for_uncertain: bool = True
    classify_marketing_as_spam: bool = True
    marketing_confidence_threshold: float = 0.6
    # learning
    retrain_threshold: int = 10
    auto_blacklist_threshold: int = 3
    auto_whitelist_threshold: int = 3
    min_training_samples: int = 10
    collect_min_confidence: float = 0.7
    # actions
    spam_folder: str = "SPAM_AUTO"
    inbox: str = "INBOX"
    auto_delete_after_days: int = 0
    cache_max_age_days: int = 30
    poll_seconds: int = 300
    # feedback folder -> feedback type, in the order the folders are handled
    feedback_folders: tuple[tuple[str, str], ...] = (
        ("FEEDBACK_WHITELIST", "whitelist"),
        ("FEEDBACK_BLACKLIST", "blacklist"),
        ("FEEDBACK_NOT_SPAM", "not_spam"),
        ("FEEDBACK_IS_SPAM", "is_spam"),
    )
    # pluggable word lists
    lexicons: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(fv.LEXICONS))
    brands: tuple[str, ...] = fv.BRANDS
    # a stored first_seen that cannot be read gives 0 days; True forces 0 for every sender
    compat_zero_days: bool = False
    # forest
    num_trees: int = 100
    max_depth: int = 10
    seed: int = 42
    test_share: float = 0.2

    def with_(self, **changes) -> "EngineConfig":
        return replace(self, **changes)
