"""Configuration of a network: loaded from files, closed against unknown keys, checked as a whole."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from . import fees

#: A rate at or above this is taken for a percentage written as a number.
MOST_RATE = 0.1
#: Where a merchant sells.
MERCHANT_CHANNELS = ("cp", "cnp", "mixed")


class ConfigError(ValueError):
    pass


def _closed(kind, data: dict, where: str):
    """An instance of a dataclass from a mapping with exactly its fields; those with defaults may be left out."""
    names = {f.name for f in fields(kind)}
    if unknown := sorted(set(data) - names):
        raise ConfigError(f"{where}: unknown keys {unknown}")
    try:
        return kind(**data)
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from None


def rate(value: float, where: str) -> float:
    if not 0 <= value < MOST_RATE:
        raise ConfigError(f"{where}: {value} is no rate between 0 and {MOST_RATE}; write 0.015 for 1.5 %")
    return value


def sums_to_one(shares: dict[str, float], where: str) -> None:
    if any(not 0 <= x <= 1 for x in shares.values()) or abs(sum(shares.values()) - 1) > 1e-9:
        raise ConfigError(f"{where}: shares have to be between 0 and 1 and add up to 1")


def covers(keys, wanted, where: str) -> None:
    if missing := sorted(set(wanted) - set(keys)):
        raise ConfigError(f"{where}: missing {missing}")
    if extra := sorted(set(keys) - set(wanted)):
        raise ConfigError(f"{where}: unknown {extra}")


def distinct(values, where: str) -> None:
    values = list(values)
    if len(set(values)) != len(values):
        raise ConfigError(f"{where}: repeated values")


def subset(values, of, where: str) -> None:
    if extra := sorted(set(values) - set(of)):
        raise ConfigError(f"{where}: {extra} not among {sorted(of)}")


@dataclass(frozen=True)
class Group:
    sector_margin: float
    base_elasticity: float
    blended_mdr_rate: float
    online_share: float = 0.0
    fraud_risk: float = 1.0
    dispute_rate: float = 0.0


@dataclass(frozen=True)
class Mcc:
    group: str
    merchant_share: float
    channel_mix: dict


@dataclass(frozen=True)
class Issuer:
    market_share: float
    product_mix: str


@dataclass(frozen=True)
class Network:
    """Everything that prices and generates purchases."""

    groups: dict
    base_rates: dict
    fixed: dict
    product_mix: dict
    group_mix: dict
    tier_shares: dict
    small_products: tuple = fees.SMALL_PRODUCTS
    small_groups: tuple = fees.SMALL_GROUPS
    weekday_profile: tuple = (1.0,) * 7
    segmentation_k: tuple = (4, 12)
    start: str = "2024-01-01"
    end: str = "2025-12-31"
    # What follows is checked where it is given.
    mccs: dict = field(default_factory=dict)  # code -> Mcc
    weekday_profiles: dict = field(default_factory=dict)  # name -> seven factors
    group_weekdays: dict = field(default_factory=dict)  # group -> name of a profile
    country: str = "CO"
    cities: dict = field(default_factory=dict)  # city -> inhabitants
    other_cities_share: float = 0.0
    foreign_countries: dict = field(default_factory=dict)  # country -> share of purchases abroad
    foreign_groups: dict = field(default_factory=dict)  # group -> share of purchases abroad
    issuers: dict = field(default_factory=dict)  # issuer -> Issuer
    product_mixes: dict = field(default_factory=dict)  # name -> product -> share
    acquirers: dict = field(default_factory=dict)  # acquirer -> size tier -> share of the tier's merchants
    spend_segments: dict = field(default_factory=dict)  # product -> segment -> share
    lifestyles: dict = field(default_factory=dict)  # product -> lifestyle -> share
    lifestyle_boosts: dict = field(default_factory=dict)  # lifestyle -> group -> factor
    issuer_costs: dict = field(default_factory=dict)  # product -> costs
    fraud_rates: dict = field(default_factory=dict)  # channel -> rate
    price_overrides: tuple = ()  # (product, group)
    abandonment: tuple = (fees.LOWEST, fees.ABANDONMENT, fees.HIGHEST)

    @property
    def city_weights(self) -> dict[str, float]:
        """Share of cards and merchants by city, by inhabitants; `other` is the rest of the country."""
        all_ = sum(self.cities.values())
        return {c: (1 - self.other_cities_share) * n / all_ for c, n in self.cities.items()} | {"other": self.other_cities_share}

    @property
    def lifestyle_names(self) -> tuple[str, ...]:
        """Lifestyles in the order of the first product."""
        return tuple(next(iter(self.lifestyles.values()), ()))

    @property
    def k_values(self) -> list[int]:
        return list(range(self.segmentation_k[0], self.segmentation_k[1] + 1))

    @property
    def days(self) -> int:
        from datetime import date

        return (date.fromisoformat(self.end) - date.fromisoformat(self.start)).days + 1


def _mix(shares: dict[str, float], keys, where: str) -> None:
    covers(shares, keys, where)
    sums_to_one(shares, where)


def _check_groups(net: Network) -> None:
    """Codes belong to groups, each group has some, and somewhere to sell what it sells online and in person."""
    subset((m.group for m in net.mccs.values()), net.groups, "mccs group")
    for code, m in net.mccs.items():
        _mix(m.channel_mix, MERCHANT_CHANNELS, f"mccs.{code}.channel_mix")
    if net.mccs:
        sums_to_one({code: m.merchant_share for code, m in net.mccs.items()}, "mccs merchant_share")
        for name, g in net.groups.items():
            mixes = [m.channel_mix for m in net.mccs.values() if m.group == name]
            if not mixes:
                raise ConfigError(f"groups.{name}: no code")
            for sells, kind, channel in ((g.online_share > 0, "online", "cnp"), (g.online_share < 1, "in person", "cp")):
                if sells and not any(m[channel] + m["mixed"] for m in mixes):
                    raise ConfigError(f"groups.{name}: sells {kind} but has no {channel} or mixed merchants")
    for name, factors in net.weekday_profiles.items():
        if len(factors) != 7 or min(factors) <= 0:
            raise ConfigError(f"weekday_profiles.{name}: seven factors above 0")
    subset(net.group_weekdays, net.groups, "group_weekdays")
    subset(net.group_weekdays.values(), net.weekday_profiles, "group_weekdays profile")


def _check_people(net: Network) -> None:
    """Issuers, acquirers, cardholders' segments and where they live and buy."""
    for name, mix in net.product_mixes.items():
        _mix(mix, net.base_rates, f"product_mixes.{name}")
    if net.issuers:
        sums_to_one({k: i.market_share for k, i in net.issuers.items()}, "issuers market_share")
        subset((i.product_mix for i in net.issuers.values()), net.product_mixes, "issuers product_mix")
    for name, shares in net.acquirers.items():
        covers(shares, net.tier_shares, f"acquirers.{name}")
    for tier in net.tier_shares if net.acquirers else ():
        sums_to_one({k: shares[tier] for k, shares in net.acquirers.items()}, f"acquirers of {tier} merchants")
    for name, by_product, keys in (("spend_segments", net.spend_segments, fees.REWARDS_ELASTICITY), ("lifestyles", net.lifestyles, net.lifestyle_names)):
        if by_product:
            covers(by_product, net.base_rates, name)
        for product, mix in by_product.items():
            _mix(mix, keys, f"{name}.{product}")
    subset(net.lifestyle_boosts, net.lifestyle_names, "lifestyle_boosts")
    for name, boosts in net.lifestyle_boosts.items():
        subset(boosts, net.groups, f"lifestyle_boosts.{name}")
        if any(x <= 0 for x in boosts.values()):
            raise ConfigError(f"lifestyle_boosts.{name}: factors above 0")
    if any(n <= 0 for n in net.cities.values()) or not 0 <= net.other_cities_share <= 1:
        raise ConfigError("cities: inhabitants above 0 and a share of other cities between 0 and 1")
    if net.country in net.foreign_countries:
        raise ConfigError(f"foreign_countries: {net.country} is the home country")
    subset(net.foreign_groups, net.groups, "foreign_groups")
    for name, shares in (("foreign_countries", net.foreign_countries), ("foreign_groups", net.foreign_groups)):
        if shares:
            sums_to_one(shares, name)


def _check_prices(net: Network) -> None:
    """Costs by product, fraud by channel, overrides of cells that exist, and an abandonment that the bounds leave room for."""
    for name, keys, wanted in (("issuer_costs", net.issuer_costs, net.base_rates), ("fraud_rates", net.fraud_rates, fees.CHANNELS)):
        if keys:
            covers(keys, wanted, name)
    for channel, x in net.fraud_rates.items():
        rate(x, f"fraud_rates.{channel}")
    subset((o[0] for o in net.price_overrides), net.base_rates, "price_overrides product")
    subset((o[1] for o in net.price_overrides), net.groups, "price_overrides group")
    low, target, high = net.abandonment
    if not 0 <= low < target < high <= 1:
        raise ConfigError("abandonment: the target has to lie between its bounds")


def checked(data: dict) -> Network:
    """A Network from plain data; any gap, unknown key, bad share or rate raises ConfigError."""
    data = dict(data)
    for name, kind in (("groups", Group), ("mccs", Mcc), ("issuers", Issuer)):
        data[name] = {k: _closed(kind, v, f"{name}.{k}") for k, v in data.get(name, {}).items()}
    net = _closed(Network, data, "network")
    for k, g in net.groups.items():
        rate(g.blended_mdr_rate, f"groups.{k}.blended_mdr_rate")
        rate(g.dispute_rate, f"groups.{k}.dispute_rate")
        if g.sector_margin <= 0 or g.base_elasticity <= 0 or not 0 <= g.online_share <= 1:
            raise ConfigError(f"groups.{k}: out of range")
    for product, rates in net.base_rates.items():
        covers(rates, net.groups, f"base_rates.{product}")
        for g, x in rates.items():
            rate(x, f"base_rates.{product}.{g}")
    for name, keys in (("fixed", net.fixed), ("product_mix", net.product_mix)):
        covers(keys, net.base_rates, name)
    covers(net.group_mix, net.groups, "group_mix")
    for name, shares in (("product_mix", net.product_mix), ("group_mix", net.group_mix), ("tier_shares", net.tier_shares)):
        sums_to_one(shares, name)
    subset(net.small_products, net.base_rates, "small_products")
    subset(net.small_groups, net.groups, "small_groups")
    distinct(net.small_groups, "small_groups")
    if len(net.weekday_profile) != 7 or min(net.weekday_profile) < 0:
        raise ConfigError("weekday_profile: seven factors of 0 or more")
    if not 2 <= net.segmentation_k[0] <= net.segmentation_k[1] or net.days < 2:
        raise ConfigError("segmentation_k or dates are out of order")
    for check in (_check_groups, _check_people, _check_prices):
        check(net)
    return net


def default() -> dict:
    """The configured network as plain data."""
    names = [f.name for f in fields(Group)]
    from ..operators.generate import GROUP_MIX, PRODUCT_MIX

    return {
        "groups": {k: dict(zip(names, v, strict=True)) for k, v in fees.GROUPS.items()},
        "base_rates": {p: dict(zip(fees.GROUPS, r, strict=True)) for p, r in fees.BASE_RATES.items()},
        "fixed": dict(fees.FIXED), "product_mix": dict(PRODUCT_MIX), "group_mix": dict(zip(fees.GROUPS, GROUP_MIX, strict=True)),
        "tier_shares": dict(fees.TIERS), "issuer_costs": dict(fees.ISSUER_COSTS), "fraud_rates": dict(fees.FRAUD),
    }


def load(path: str | Path) -> Network:
    """A JSON or YAML file over the defaults; `include` names files beside it that are read first."""
    path = Path(path)
    data = default()

    def parse(file: Path) -> dict:
        text = file.read_text()
        if file.suffix == ".json":
            return json.loads(text)
        try:
            import yaml
        except ImportError:
            raise ConfigError("YAML files need the yaml package; JSON files don't") from None
        return yaml.safe_load(text) or {}

    top = parse(path)
    for name in top.pop("include", []):
        data |= parse(path.parent / name)
    return checked(data | top)
