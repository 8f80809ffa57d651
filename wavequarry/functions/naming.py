"""Channel names to parts and roles, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted spelling of a contact, and the sixteen direct-current inputs.
CONTACT = r"^(POL|EEG) ([A-Za-z]+)([0-9]+)(-Ref)?$"
AUXILIARY = r"^POL DC(0[1-9]|1[0-6])$"
CURRENT_FAMILY = r"^POL AC[0-9]+$"


def _part(label: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(label, CONTACT, group), F.lit(""))


def parsed(label: Column) -> dict[str, Column]:
    """source_prefix, electrode_code, contact_text, contact_number, reference_tag; all null where a label does not parse."""
    return {
        "source_prefix": _part(label, 1),
        "electrode_code": _part(label, 2),
        "contact_text": _part(label, 3),
        "contact_number": _part(label, 3).cast("int"),
        "reference_tag": F.when(label.rlike(CONTACT), F.regexp_extract(label, CONTACT, 4)),
    }


def role(label: Column) -> Column:
    return F.when(label.rlike(AUXILIARY), "auxiliary_dc").when(label.rlike(CONTACT), "seeg_candidate").otherwise("unknown")


def schema_hash(ids: Column) -> Column:
    """Eight hexadecimal digits that stand for an ordered list of channel ids."""
    return F.substring(F.sha1(F.array_join(ids, "\0")), 1, 8)
