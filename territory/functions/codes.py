"""Administrative codes: the 27 federative units and the small code language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Official codes, abbreviations and names of the federative units.
UF = (
    (11, "RO", "Rondônia"), (12, "AC", "Acre"), (13, "AM", "Amazonas"), (14, "RR", "Roraima"), (15, "PA", "Pará"), (16, "AP", "Amapá"), (17, "TO", "Tocantins"),
    (21, "MA", "Maranhão"), (22, "PI", "Piauí"), (23, "CE", "Ceará"), (24, "RN", "Rio Grande do Norte"), (25, "PB", "Paraíba"), (26, "PE", "Pernambuco"), (27, "AL", "Alagoas"), (28, "SE", "Sergipe"), (29, "BA", "Bahia"),
    (31, "MG", "Minas Gerais"), (32, "ES", "Espírito Santo"), (33, "RJ", "Rio de Janeiro"), (35, "SP", "São Paulo"),
    (41, "PR", "Paraná"), (42, "SC", "Santa Catarina"), (43, "RS", "Rio Grande do Sul"),
    (50, "MS", "Mato Grosso do Sul"), (51, "MT", "Mato Grosso"), (52, "GO", "Goiás"), (53, "DF", "Distrito Federal"),
)
CODE_TO_ABBREV = {c: a for c, a, _ in UF}
ABBREV_TO_CODE = {a: c for c, a, _ in UF}


def uf_dimension(spark: SparkSession) -> DataFrame:
    """(code_state, abbrev_state, name_state, label) of the 27 units."""
    return spark.createDataFrame([(c, a, n, f"{a} - {n}") for c, a, n in UF], "code_state int, abbrev_state string, name_state string, label string")


def _map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs for x in p))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def is_alpha(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def code_from_abbrev(c: Column) -> Column:
    return F.try_element_at(_map(ABBREV_TO_CODE.items()), F.upper(F.trim(c)))


def abbrev_from_code(c: Column) -> Column:
    return F.try_element_at(_map(CODE_TO_ABBREV.items()), c.cast("int"))


def normalize_uf(c: Column) -> Column:
    """struct(code int, abbrev string) of an abbreviation, a code or a longer code that begins with one; nulls otherwise.

    Null, blank, ``all``, unknown abbreviations and fewer than two digits give nulls.
    """
    text = F.trim(c.cast("string"))
    two = F.substring(digits(text), 1, 2)
    by_digits = F.when(F.length(two) == 2, two.cast("int"))
    found = F.coalesce(code_from_abbrev(text), by_digits)
    code = F.when((text == "") | (F.lower(text) == "all"), None).otherwise(found)
    abbrev = abbrev_from_code(code)
    return F.struct(F.when(abbrev.isNotNull(), code).alias("code"), abbrev.alias("abbrev"))


def normalize_uf_value(value) -> tuple[int | None, str | None]:
    """The same for one value on the driver."""
    text = "" if value is None else str(value).strip()
    if not text or text.lower() == "all":
        return None, None
    if text.upper() in ABBREV_TO_CODE:
        return ABBREV_TO_CODE[text.upper()], text.upper()
    d = "".join(c for c in text if c.isdigit())[:2]
    return (int(d), CODE_TO_ABBREV[int(d)]) if len(d) == 2 and int(d) in CODE_TO_ABBREV else (None, None)


def code_text(c: Column) -> Column:
    """A code as text, never through a double's own text."""
    return F.round(c.cast("double")).cast("bigint").cast("string")


def integer_key(c: Column) -> Column:
    """Canonical BIGINT of a numeric or text key (``'310620005000001.0'`` too); null if it is none."""
    text = F.trim(c.cast("string"))
    whole, number = text.rlike(r"^[+-]?[0-9]{1,19}$"), text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    # a cast that fails is slow even where it may, so only texts that look like numbers are cast
    return F.when(whole, text.try_cast("bigint")).when(number, F.round(text.try_cast("double")).try_cast("bigint"))
