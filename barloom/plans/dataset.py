"""Feature profiles and the dataset builder, for all series at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from barloom.operators.columns import check_dataset, clean
from barloom.operators.labels import POSITION, barrier_labels
from barloom.operators.layout import with_position
from barloom.plans import enrich
from barloom.plans.config import ExperimentConfig


@dataclass(frozen=True)
class Sources:
    """External tables a profile may need; only those of its enrichments are read."""

    sentiment: DataFrame | None = None
    daily_bars: DataFrame | None = None
    funding: DataFrame | None = None
    onchain: DataFrame | None = None
    mempool: DataFrame | None = None

    def require(self, name: str) -> DataFrame:
        table = getattr(self, name)
        if table is None:
            raise ValueError(f"the profile needs the source {name!r}")
        return table


Enrichment = Callable[[DataFrame, Sources], DataFrame]

ENRICHMENTS: dict[str, Enrichment] = {
    "technicals": lambda df, src: enrich.add_technicals(df),
    "sentiment": lambda df, src: enrich.add_sentiment(df, src.require("sentiment")),
    "trend_htf": lambda df, src: enrich.add_trend_htf(df, src.require("daily_bars")),
    "funding_rate": lambda df, src: enrich.add_funding_rate(df, src.require("funding")),
    "taker_buy_ratio": lambda df, src: enrich.add_taker_buy_ratio(df),
    "onchain_active_addresses": lambda df, src: enrich.add_onchain_active_addresses(df, src.require("onchain")),
    "mempool_fee_rate_p50": lambda df, src: enrich.add_mempool_fee_rate(df, src.require("mempool")),
}


@dataclass(frozen=True)
class FeatureProfile:
    """Enrichments in order, and the column whose effect an A/B test measures."""

    name: str
    enrichments: tuple[str, ...]
    treatment: str | None = None


_BASE = ("technicals", "sentiment")
PROFILES = {
    p.name: p
    for p in (
        FeatureProfile("control", _BASE),
        FeatureProfile("trend_htf", (*_BASE, "trend_htf"), "trend_htf"),
        FeatureProfile("funding_rate", (*_BASE, "funding_rate"), "funding_rate_current"),
        FeatureProfile("taker_buy_ratio", (*_BASE, "taker_buy_ratio"), "taker_buy_ratio"),
        FeatureProfile("onchain_activity", (*_BASE, "onchain_active_addresses"), "onchain_active_addresses"),
        FeatureProfile("onchain_fee_pressure", (*_BASE, "mempool_fee_rate_p50"), "mempool_fee_rate_p50"),
    )
}


def get_profile(name: str) -> FeatureProfile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; available: {sorted(PROFILES)}")
    return PROFILES[name]


def build_dataset(
    bars: DataFrame, sources: Sources, profile: str | FeatureProfile = "control", config: ExperimentConfig = ExperimentConfig()
) -> tuple[DataFrame, list[str]]:
    """Enrich, label, drop raw columns and incomplete rows; positions count what is left.

    Returns the dataset and the control features (without the treatment column).
    """
    profile = profile if isinstance(profile, FeatureProfile) else get_profile(profile)
    out = bars
    for name in profile.enrichments:
        out = ENRICHMENTS[name](out, sources)
    labelled = clean(barrier_labels(out, config.barrier))
    features = check_dataset(labelled, profile.treatment)
    return with_position(labelled.drop(*POSITION), last="close"), features
