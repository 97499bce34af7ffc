"""The entity types: family, tier and flags, as a small table and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (tier, family, types, adjacency-safe, propagates, orthography-gated).
GROUPS = (
    (0, "IBAN", "TR_IBAN IBAN_CODE", True, True, False),
    (0, "TCKN", "TR_TCKN", True, True, False),
    (0, "PHONE", "TR_GSM TR_PHONE UK_PHONE", True, True, False),
    (0, "CARD", "CREDIT_CARD", True, True, False),
    (0, "EMAIL", "EMAIL_ADDRESS", True, True, False),
    (0, "SSN", "US_SSN", True, True, False),
    (0, "IP", "IP_ADDRESS", True, True, False),
    (0, "URL", "URL", True, True, False),
    (1, "ACCOUNT", "TR_ACCOUNT", True, True, False),
    (1, "SECRET", "SECRET_KEY", True, True, False),
    (1, "PLATE", "TR_PLATE", True, True, False),
    (1, "PASSPORT", "TR_PASSPORT", True, True, False),
    (1, "VKN", "TR_VKN", True, True, False),
    (1, "LOCATION", "TR_ADDRESS", False, True, False),
    (1, "ORG", "TR_COMPANY", False, True, False),
    (1, "PHONE", "PHONE_NUMBER", False, False, False),
    (1, "PERSON", "TR_PERSON_CTX", False, False, False),
    (1, "SALARY", "TR_SALARY_BAND", False, False, False),
    (1, "SENSITIVE", "TR_DISABILITY TR_HEALTH SENSITIVE", False, False, False),
    (1, "PASSPORT", "PASSPORT", False, False, False),
    (1, "DL", "DRIVER_LICENSE US_DRIVER_LICENSE", False, False, False),
    (1, "ACCOUNT", "ACCOUNT", False, False, False),
    (1, "SECRET", "SECRET", False, False, False),
    (1, "USERNAME", "USERNAME", False, False, False),
    (1, "PLATE", "PLATE", False, False, False),
    (2, "PERSON", "PERSON", False, False, True),
    (2, "LOCATION", "LOCATION", False, False, True),
    (2, "ORG", "ORGANIZATION", False, False, True),
    (2, "NRP", "NRP", False, False, True),
    (2, "DATE", "DATE_TIME", False, False, False),
)
TYPES = {t: (tier, family, safe, spread, gated) for tier, family, names, safe, spread, gated in GROUPS for t in names.split()}


def entity_types(spark: SparkSession) -> DataFrame:
    """The table (entity_type, tier, family, adjacency_safe, propagate, ortho_gated)."""
    rows = [(t, *v) for t, v in TYPES.items()]
    return spark.createDataFrame(rows, "entity_type string, tier int, family string, adjacency_safe boolean, propagate boolean, ortho_gated boolean")


def _lookup(entity_type: Column, field: int, otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for t, v in TYPES.items() for x in (t, v[field])])
    return F.coalesce(F.try_element_at(table, entity_type), otherwise)


def tier_of(entity_type: Column) -> Column:
    """Known types by the table; ``USER:<FAMILY>`` is 0; anything else 1."""
    return _lookup(entity_type, 0, F.when(entity_type.startswith("USER:"), 0).otherwise(1))


def family_of(entity_type: Column) -> Column:
    """Known types by the table; ``USER:<FAMILY>`` its family; anything else its own name."""
    return _lookup(entity_type, 1, F.regexp_replace(entity_type, "^USER:", ""))


def flag_of(entity_type: Column, flag: str) -> Column:
    return _lookup(entity_type, {"adjacency_safe": 2, "propagate": 3, "ortho_gated": 4}[flag], F.lit(False))
