"""Engine settings: immutable, complete, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions import fixed

MODES = {"strict": (0, 10), "balanced": (10, 0), "relaxed": (40, -10)}  # least score, score bonus
LEVELS = ("high", "medium", "low")


@dataclass(frozen=True)
class EngineConfig:
    enabled: bool = True
    environments: tuple[str, ...] = ()
    mode: str = "balanced"
    min_confidence: int = 0
    whitelist: tuple[str, ...] = ()
    blocklist: tuple[str, ...] = ()
    only_paths: tuple[str, ...] = ()
    skip_paths: tuple[str, ...] = ("assets/*", "images/*", "css/*", "js/*", "fonts/*", "build/*", "api/healthcheck", "favicon.ico", "_debugbar/*", "telescope/*", "horizon/*", "livewire/*")
    auth_paths: tuple[str, ...] = ("login", "api/login", "auth/*", "api/auth/*", "oauth/*", "api/oauth/*", "register", "api/register", "password/*", "api/password/*")
    content_paths: tuple[str, ...] = ()
    probes: tuple[tuple[str, str], ...] = tuple(fixed.PROBES)
    probe_level: str = "medium"
    safe_fields: tuple[str, ...] = ()
    safe_paths: tuple[str, ...] = ()
    custom_rules: tuple = tuple(fixed.CUSTOM_RULES)
    validators: dict = field(default_factory=lambda: {"Aadhaar Number Detected": "verhoeff"})
    api_suppress_levels: tuple[str, ...] = ("low", "medium")
    context_weights: dict = field(default_factory=lambda: {"path": 1.5, "raw": 1.5, "query": 1.5, "headers": 1.3, "body": 1.0})
    redact_labels: tuple[str, ...] = tuple(fixed.REDACTED)
    mask: str = "[REDACTED]"
    max_detections: int = 0
    flood_threshold: int = 300
    flood_window_s: int = 60
    dedup_window_s: int = 300
    home_country: str = "IN"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {sorted(MODES)}")
        if set(self.api_suppress_levels) - set(LEVELS):
            raise ValueError(f"levels must be among {LEVELS}")
        if self.flood_window_s <= 0 or self.dedup_window_s <= 0:
            raise ValueError("windows must be positive")

    @property
    def least_score(self) -> int:
        return max(MODES[self.mode][0], int(self.min_confidence))

    @property
    def mode_bonus(self) -> int:
        return MODES[self.mode][1]

    def runs_in(self, environment: str) -> bool:
        """Whether requests are looked at at all."""
        return self.enabled and (not self.environments or environment in self.environments)
