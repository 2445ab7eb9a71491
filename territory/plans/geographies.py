"""The geographies that can be read: tokens, code columns and abilities of both catalogs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Spec:
    """One catalog's view of a geography."""

    token: str
    code_col: str | None = None
    abbrev_col: str | None = None
    sliced: bool = False
    by_code: bool = False


@dataclass(frozen=True)
class Geography:
    name: str
    v1: Spec | None = None
    v2: Spec | None = None

    def spec(self, backend: str) -> Spec:
        s = {"v1": self.v1, "v2": self.v2}[backend]
        if s is None:
            raise ValueError(f"{self.name} is not in the {backend} catalog")
        return s


def _coded(name: str, v1: str, v2: str, code: str, sliced: bool = False, v1_abbrev: str | None = "abbrev_state", v2_abbrev: str | None = "abbrev_state") -> Geography:
    return Geography(name, Spec(v1, code, v1_abbrev, sliced, True), Spec(v2, code, v2_abbrev, False, True))


def _plain(name: str, v1: str | None, v2: str | None, v2_by_muni: bool = False) -> Geography:
    second = Spec(v2, "code_muni", "abbrev_state", False, True) if v2 and v2_by_muni else Spec(v2) if v2 else None
    return Geography(name, Spec(v1) if v1 else None, second)


# Names, catalog tokens and code columns.
GEOGRAPHIES = {
    g.name: g
    for g in (
        _plain("country", "country", "country"),
        _coded("region", "regions", "regions", "code_region", v1_abbrev="name_region", v2_abbrev=None),
        _coded("state", "state", "states", "code_state"),
        _coded("meso_region", "meso_region", "mesoregions", "code_meso", True),
        _coded("micro_region", "micro_region", "microregions", "code_micro", True),
        _coded("immediate_region", "immediate_regions", "immediateregions", "code_immediate", v1_abbrev=None),
        _coded("intermediate_region", "intermediate_regions", "intermediateregions", "code_intermediate", v1_abbrev=None),
        _coded("municipality", "municipality", "municipalities", "code_muni", True),
        _plain("municipal_seat", "municipal_seat", "municipalseats", True),
        _coded("census_tract", "census_tract", "censustracts", "code_tract", True),
        _coded("weighting_area", "weighting_area", "weightingareas", "code_weighting", True),
        _plain("statistical_grid", "statistical_grid", "statsgrid"),
        _plain("neighborhood", "neighborhood", "neighborhoods", True),
        _plain("metro_area", "metropolitan_area", "metroarea"),
        _plain("urban_area", "urban_area", "urbanareas"),
        _plain("urban_concentrations", "urban_concentrations", None),
        _plain("pop_arrangements", "pop_arrengements", "poparrangements"),
        _plain("biomes", "biomes", "biomes"),
        _plain("amazon", "amazonia_legal", "amazonialegal"),
        _plain("semiarid", "semiarid", "semiarid"),
        _plain("conservation_units", "conservation_units", "conservationunits"),
        _plain("indigenous_land", "indigenous_land", "indigenouslands"),
        _plain("disaster_risk_area", "disaster_risk_area", "disasterriskareas"),
        _plain("health_region", "health_region", "healthregions"),
        _plain("health_facilities", "health_facilities", "healthfacilities"),
        _plain("schools", "schools", "schools", True),
        _plain("favela", None, "favelas", True),
        _plain("polling_places", None, "pollingplaces"),
        _plain("quilombola_land", None, "quilombolalands"),
    )
}


def geography(name: str) -> Geography:
    """By name, with or without ``read_`` before it."""
    key = name.removeprefix("read_")
    if key not in GEOGRAPHIES:
        raise ValueError(f"unknown geography {name!r}; known: {', '.join(sorted(GEOGRAPHIES))}")
    return GEOGRAPHIES[key]
