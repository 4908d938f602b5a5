"""A run's settings, their hash, and what a run was made with."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a run's manifest that change from run to run.
VOLATILE = ("created_at", "hostname")


@dataclass(frozen=True)
class RunConfig:
    """What a run is asked to do; the names are those of the settings file."""

    seed: int
    gold: str | list[str]
    parsed_dir: str
    checkpoint: str
    arms: list[str]
    navigators: list[str]
    answerers: list[str]
    judge: str
    models: dict[str, dict]
    splits: tuple[str, ...] = ("test",)
    dev_fraction: float = 0.2
    max_evidence_words: int = 9000
    max_answer_tokens: int = 1024
    services: dict[str, dict] = field(default_factory=dict)
    arm_options: dict[str, dict] = field(default_factory=dict)
    scope: dict[str, str] = field(default_factory=dict)
    indexer: str | None = None
    prices: dict[str, list[float]] = field(default_factory=dict)

    @classmethod
    def of(cls, text: str) -> RunConfig:
        """Of a YAML text; a setting that isn't known is an error."""
        import yaml

        data = yaml.safe_load(text)
        if unknown := set(data) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**data | {"splits": tuple(data.get("splits", ("test",)))})

    def grid(self, navigating: dict[str, bool]) -> list[tuple[str, str, str]]:
        """(arm, navigator, answerer) of the run; arms that don't navigate have navigator 'none'."""
        return [(a, n, w) for a in self.arms for n in (self.navigators if navigating[a] else ["none"]) for w in self.answerers]


def checked_arms(wanted: list[str], config: RunConfig) -> list[str]:
    """The wanted subset of a run's arms; others are an error."""
    if odd := [a for a in wanted if a not in config.arms]:
        raise ValueError(f"arms that the settings don't have: {', '.join(odd)}")
    return wanted


def canonical_json(text: Column, drop: tuple[str, ...] = ()) -> Column:
    """A JSON object with its keys in order and no white space, less some of its top keys; null of what is no object."""
    fields = F.map_filter(F.try_variant_get(F.try_parse_json(text), "$", "map<string, variant>"), lambda k, v: ~k.isin(*drop) if drop else F.lit(True))
    pairs = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(F.to_json(F.array(k)), F.lit(":"), F.to_json(F.element_at(fields, k))))
    # a key is written as JSON writes a string: the one element of a list, without its brackets
    shown = F.transform(pairs, lambda p: F.regexp_replace(p, r'^\[("(?:[^"\\]|\\.)*")\]:', "$1:"))
    return F.when(fields.isNotNull(), F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}")))


def config_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text), 256))


def manifest_hash(text: Column) -> Column:
    """The hash of a run's manifest without what changes from run to run."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text, VOLATILE), 256))


def raptor_key(sha256: Column, embedder: str, indexer: str, branching: int, levels: int, summary_words: int, most: int, overlap: int, seed: int, extra: str = "{}") -> Column:
    """Names a document's summary tree under its settings: 24 hex digits; extra is the indexer's own settings as JSON."""
    parts = (embedder, indexer, branching, levels, summary_words, most, overlap, seed, extra)
    return F.left(F.sha2(F.concat_ws("|", sha256, *(F.lit(str(p)) for p in parts)), 256), F.lit(24))
