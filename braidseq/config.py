"""Settings of a reconciliation run, and the errors the library raises."""

from __future__ import annotations

from dataclasses import dataclass


class BraidError(Exception):
    """Anything wrong with inputs or settings; command line tools exit with 2."""


class InputError(BraidError):
    """Input data break a stated rule."""


class ConfigError(BraidError):
    """A setting is out of range."""


@dataclass(frozen=True)
class RunConfig:
    """Thresholds; percentages are fractions here (``from_percent`` takes 0 to 100)."""

    identity: float = 0.98
    min_overlap: int = 1000
    min_containment: int = 500
    containment_coverage: float = 0.98
    end_tolerance: int = 50
    kmer: int = 21
    window: int = 10
    min_shared: int = 5
    max_frequency: int = 100
    evidence: str = "none"

    def __post_init__(self) -> None:
        if not 0 <= self.identity <= 1 or not 0 <= self.containment_coverage <= 1:
            raise ConfigError("identity and coverage are fractions")
        if min(self.min_overlap, self.min_containment, self.kmer, self.window, self.min_shared, self.max_frequency) < 1 or self.end_tolerance < 0:
            raise ConfigError("lengths and counts are positive, the end tolerance isn't negative")
        if self.evidence not in ("none", "alignments"):
            raise ConfigError("evidence is none or alignments")

    @classmethod
    def from_percent(cls, identity: float = 98.0, containment_coverage: float = 98.0, **more) -> RunConfig:
        for name, value in (("identity", identity), ("containment coverage", containment_coverage)):
            if not 0 <= value <= 100:
                raise ConfigError(f"{name} must lie between 0 and 100")
        return cls(identity=identity / 100, containment_coverage=containment_coverage / 100, **more)

    @property
    def terminal_band(self) -> int:
        return max(self.min_overlap, self.min_containment)
