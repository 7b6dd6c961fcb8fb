"""Parameters of the jobs. The defaults are the fixed values of the car-listing data."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# Brand prefixes in matching order.
BRAND_PREFIXES = {
    "aud": "Audi", "bmw": "BMW", "cit": "Citroën", "dod": "Dodge", "for": "Ford",
    "hyu": "Hyundai", "jee": "Jeep", "kia": "Kia", "maz": "Mazda", "mer": "MercedesBenz",
    "nis": "Nissan", "ope": "Opel", "peu": "Peugeot", "por": "Porsche", "ren": "Renault",
    "sko": "Skoda", "toy": "Toyota", "volk": "Volkswagen", "volv": "Volvo",
}

# Fixed values: (any of these parts, class), first match wins.
TRANSMISSION_RULES = ((("man",), "Manuální"), (("auto",), "Automatická"))
FUEL_RULES = (
    (("benz", "gasol"), "Benzin"),
    (("naf", "diesel"), "Nafta"),
    (("hyb",), "Hybridni"),
    (("ele",), "Elektro"),
)


@dataclass(frozen=True)
class CleanRules:
    """Thresholds and vocabularies of the cleaning job. Range ends belong to the range."""

    as_of_year: int | None = None  # None: the year in which the job runs
    price: tuple[float, float] = (30_000, 2_500_000)
    year: tuple[float, float] = (1970, 2025)
    max_mileage: float = 600_000
    volume: tuple[float, float] = (0.5, 8.0)
    power: tuple[float, float] = (20, 800)
    brand_prefixes: dict[str, str] = field(default_factory=lambda: dict(BRAND_PREFIXES))
    transmission_rules: tuple = TRANSMISSION_RULES
    fuel_rules: tuple = FUEL_RULES
    excluded_pair: tuple[str, str] | None = ("BMW", "rada")
    block_list: tuple[str, ...] = ("ostatni", "nezjisteno")
    dedup_after: bool = False  # also drop rows that became equal by cleaning


@dataclass(frozen=True)
class RequestRules:
    """Accepted ranges of a scoring request."""

    max_mileage: float = 600_000
    volume: tuple[float, float] = (0.5, 8.0)
    power: tuple[float, float] = (20, 800)
    max_age: float = 50


@dataclass(frozen=True)
class Site:
    """How a site links its listings and numbers its result pages."""

    base: str
    link_class: str  # one class, or the whole class attribute
    page_param: str


# Addresses, link classes and page parameters of the two sites.
SITE_A = Site("https://www.autoesa.cz", "car_item", "stranka")
SITE_B = Site(
    "https://www.sauto.cz",
    "sds-surface sds-surface--clickable sds-surface--00 c-item__link",
    "strana",
)


@dataclass(frozen=True)
class DetailA:
    """Selectors and labels of a detail page of source A (fixed values)."""

    heading_class: str = "car_detail2__h1"
    price_class: str = "show-more-price-right-right"
    toggle: str = "popover"
    year: str = "rok"
    mileage: str = "stav tachometru"
    fuel: str = "palivo"
    transmission: str = "převodovka"
    power: str = "výkon"
    engine: str = "motor"


# Years that a subtitle may show as `m/yyyy`, and as plain digits; the ends do not count.
DATED_YEARS, PLAIN_YEARS = (1900, 2025), (1900, 2100)


@dataclass(frozen=True)
class DetailB:
    """Selectors and labels of a detail page of source B (fixed values)."""

    subtitle_class: str = "c-a-basic-info__subtitle-info"
    price_class: str = "c-a-basic-info__price"
    other_price_class: str = "c-basic-info__price"
    item_pattern: str = "c-car-properties__tile|c-car-otherProperties__tile"
    label_pattern: str = "tile-label"
    value_pattern: str = "tile-value"
    used: str = "Ojeté"
    new: str = "Nové"
    fuel: str = "Palivo"
    transmission: str = "Převodovka"
    power: str = "Výkon"
    engine: str = "Objem"
    dated_years: tuple[int, int] = DATED_YEARS
    plain_years: tuple[int, int] = PLAIN_YEARS


def bounded(default, least=None, above: str | None = None):
    """A parameter with its smallest value and the parameter that it must exceed; None is unbounded."""
    return field(default=default, metadata={"least": least, "above": above})


class Bounded:
    """Parameters that hold to the bounds of their declarations; all breaches are told at once."""

    def __post_init__(self):
        breaches = []
        for f in fields(self):
            value, least, other = getattr(self, f.name), f.metadata.get("least"), f.metadata.get("above")
            if value is None:
                continue
            if least is not None and value < least:
                breaches.append(f"{f.name} is {value}, at least {least} is needed")
            if other and (under := getattr(self, other)) is not None and value <= under:
                breaches.append(f"{f.name} is {value}, more than {other} ({under}) is needed")
        if breaches:
            raise ValueError(", ".join(breaches))


@dataclass(frozen=True)
class Budget(Bounded):
    """When a collection over numbered result pages ends."""

    min_rows: int = bounded(50, least=1)
    max_pages: int = bounded(5, least=1)
    min_price: int | None = bounded(None, least=0)
    max_price: int | None = bounded(None, above="min_price")
