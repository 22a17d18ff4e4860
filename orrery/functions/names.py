"""Residue and feature names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One-letter codes of residue names, protonation variants and modified residues included.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "ASH": "D", "CYM": "C", "CYX": "C", "GLH": "E", "HID": "H", "HIE": "H", "HIP": "H", "LYN": "K",
    "HSP": "H", "SEP": "S", "TPO": "T", "PTR": "Y", "MSE": "M", "CSO": "C", "ARN": "R",
}


def one_letter(name: Column) -> Column:
    """One-letter code; an unknown name's first three letters."""
    table = F.create_map(*[F.lit(x) for pair in ONE_LETTER.items() for x in pair])
    return F.coalesce(table[F.upper(name)], F.substring(name, 1, 3))


def code_of(name: str) -> str:
    """One-letter code; an unknown name's first three letters."""
    return ONE_LETTER.get(name.upper(), name[:3])


def full_name(aaa: Column, seqid: Column, consensus: Column) -> Column:
    """Name, number and consensus label after an x: ALA13, ALA13x1.50."""
    return F.concat(aaa, seqid.cast("string"), F.when(consensus.isNotNull(), F.concat(F.lit("x"), consensus)).otherwise(F.lit("")))


def feature_name(partners: Column) -> Column:
    """Partners' names joined by a dash; a special label follows its partner."""
    one = lambda p: F.concat_ws("_", p["full_name"], p["special_label"])
    return F.array_join(F.transform(partners, one), "-")


def cluster_number(name: str) -> int | None:
    found = re.search(r"(\d+)\s*$", name)
    return int(found[1]) if found else None
