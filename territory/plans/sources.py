"""The registry of the municipal diagnostic's sources, and how each is filtered and clipped."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROTOCOLS = ("wfs", "arcgis", "geo", "osm")
AXES = ("transportes", "saneamento", "demografia", "ambiental", "educacao", "saude", "urbano", "pol-admin", "contexto")


# The axes' titles. Others are titled by their own id.
AXIS_TITLES = {
    "transportes": "1. Transport",
    "saneamento": "2. Drainage & Sanitation",
    "demografia": "3. Demography",
    "ambiental": "4. Environment",
    "educacao": "5. Education",
    "saude": "6. Health",
    "urbano": "7. Urban",
    "pol-admin": "8. Administrative",
}


@dataclass(frozen=True)
class Source:
    """``cut`` is code, name or bbox: how its rows are limited to a municipality, by the column ``field`` if not by box."""

    id: str
    axis: str
    name: str
    protocol: str
    endpoint: str = ""
    layer: str = ""
    cut: str = "bbox"
    field: str = ""
    srs: str = "EPSG:4674"
    license: str = "Publica"

    @property
    def clipped(self) -> bool:
        """Rows found by box are cut to the polygon; so are layers that take no code."""
        return self.cut == "bbox"


# Public services and their layers. Ids of layers read through the catalogs begin with geo_.
SOURCES = (
    Source("dnit_snv", "transportes", "DNIT — SNV (rodovias federais)", "wfs", "https://geoservicos.inde.gov.br/geoserver/DNIT/ows", "DNIT:snv_202507a"),
    Source("minfra_ferrovias", "transportes", "MInfra — Ferrovias", "wfs", "https://geoservicos.inde.gov.br/geoserver/ows", "MInfra:Ferrovias", "name", "municipio"),
    Source("der_mg_rodovias", "transportes", "DER-MG — Rodovias estaduais", "wfs", "https://geoserver.meioambiente.mg.gov.br/IDE/wfs", "IDE:ide_0401_mg_rodovias_lin"),
    Source("osm_vias", "transportes", "OSM — Vias urbanas (Overpass)", "osm", license="OpenStreetMap contributors"),
    Source("sgb_rios", "saneamento", "SGB/CPRM — Rios (BC250)", "wfs", "https://opendata.sgb.gov.br/geoserver/ows", "p3m:vw_ibge_rios"),
    Source("sgb_bacias", "saneamento", "SGB/CPRM — Bacias hidrograficas", "wfs", "https://opendata.sgb.gov.br/geoserver/ows", "p3m:vw_ibge_bacia_hidro_6"),
    Source("sicar_imoveis", "ambiental", "SICAR — Imoveis (CAR)", "wfs", "https://geoserver.car.gov.br/geoserver/sicar/wfs", "sicar:sicar_imoveis_{uf}", "code", "cod_municipio_ibge"),
    Source("icmbio_embargos", "ambiental", "ICMBio — Embargos", "wfs", "https://geoservicos.inde.gov.br/geoserver/ICMBio/ows", "ICMBio:embargos_icmbio", "name", "municipio"),
    Source("icmbio_uc", "ambiental", "ICMBio — UCs federais", "wfs", "https://geoservicos.inde.gov.br/geoserver/ICMBio/ows", "ICMBio:limiteucsfederais_a"),
    Source("ana_hidrografia", "saneamento", "ANA — Hidrografia", "arcgis", "https://www.snirh.gov.br/arcgis/rest/services/DADOSABERTOS/Hidrografia/MapServer", "0"),
    Source("ibama_autos", "ambiental", "IBAMA — Autos de infracao/embargos", "arcgis", "https://pamgia.ibama.gov.br/server/rest/services/app_dadosabertos/adm_auto_infracao_p/MapServer", "0", "code", "cod_municipio"),
    Source("ibama_esgoto", "saneamento", "IBAMA — Esgotamento sanitario", "arcgis", "https://pamgia.ibama.gov.br/server/rest/services/SIGAGEO/Sistema_de_Esgotamento_Sanit%C3%A1rio/MapServer", "6"),
    Source("ibama_agua", "saneamento", "IBAMA — Abastecimento de agua", "arcgis", "https://pamgia.ibama.gov.br/server/rest/services/SIGAGEO/Sistema_de_Abastecimento_de_%C3%81gua/MapServer", "5"),
    Source("ibama_aterro", "saneamento", "IBAMA — Aterro sanitario", "arcgis", "https://pamgia.ibama.gov.br/server/rest/services/SIGAGEO/Aterro_Sanit%C3%A1rio/MapServer", "8"),
    Source("geo_municipio", "demografia", "Limite municipal", "geo", "v1", "municipality", "code", "code_muni"),
    Source("geo_setores", "demografia", "Setores censitarios", "geo", "v1", "census_tract", "code", "code_muni"),
    Source("geo_ponderacao", "demografia", "Areas de ponderacao", "geo", "v1", "weighting_area", "code", "code_muni"),
    Source("geo_escolas", "educacao", "Escolas", "geo", "v1", "schools"),
    Source("geo_saude", "saude", "Estabelecimentos de saude", "geo", "v1", "health_facilities"),
    Source("geo_biomas", "ambiental", "Biomas", "geo", "v1", "biomes"),
    Source("geo_ucs", "ambiental", "Unidades de conservacao", "geo", "v1", "conservation_units"),
    Source("geo_terras_indigenas", "ambiental", "Terras indigenas", "geo", "v1", "indigenous_land"),
    Source("geo_risco", "ambiental", "Areas de risco de desastre", "geo", "v1", "disaster_risk_area"),
    Source("geo_mancha_urbana", "urbano", "Mancha urbana", "geo", "v1", "urban_area"),
    Source("geo_sede", "pol-admin", "Sede municipal", "geo", "v1", "municipal_seat"),
    Source("geo_bairros", "pol-admin", "Bairros", "geo", "v1", "neighborhood"),
    Source("geo_favelas", "demografia", "Favelas/comunidades", "geo", "v2", "favela", "code", "code_muni"),
    Source("geo_locais_votacao", "pol-admin", "Locais de votacao", "geo", "v2", "polling_places"),  # takes no code, so it is clipped
    Source("geo_quilombolas", "ambiental", "Terras quilombolas", "geo", "v2", "quilombola_land"),
    Source("basemap_satelite", "contexto", "Imagem de satelite", "basemap"),
)


def by_id(ids) -> list[Source]:
    """In registry order; unknown ids and repeats fall away."""
    wanted = set(ids)
    return [s for s in SOURCES if s.id in wanted]


def table(spark: SparkSession) -> DataFrame:
    """The registry as rows, with position, clipping and axis order."""
    names = [f.name for f in fields(Source)]
    rows = [(i, *astuple(s), s.clipped and s.protocol in PROTOCOLS, AXES.index(s.axis)) for i, s in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "pos int, " + ", ".join(f"{n} string" for n in names) + ", clipped boolean, axis_pos int")


def axis_label(axis: Column) -> Column:
    """An axis' title; one without has its id, the first letter large."""
    titles = F.create_map(*(F.lit(x) for p in AXIS_TITLES.items() for x in p))
    return F.coalesce(F.try_element_at(titles, axis), F.concat(F.upper(F.substring(axis, 1, 1)), F.lower(F.substring(axis, 2, 1 << 20))))


def server_filter(cut: Column, field: Column, code: Column, name: Column) -> Column:
    """The text of a source's filter, quotes doubled; null means by box."""
    by_code = F.concat(field, F.lit(" = "), code.cast("bigint").cast("string"))
    by_name = F.concat(field, F.lit(" = '"), F.replace(F.coalesce(name, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(cut == "code", by_code).when(cut == "name", by_name)
