"""A language for atoms, and slices of trajectories by it.

A string combines tests with ``and``, ``or``, ``not`` and parentheses:

* ``all``, ``none``, ``protein``, ``water``, ``backbone``, ``sidechain``, ``hydrogen``;
* ``name CA CB``, ``element C N``, ``resname ALA GLY``, ``chain A B``: any of the words;
* ``index 0 to 9``, ``resid 3 5``, ``resSeq 10 to 20``: numbers and inclusive ranges;
  ``index < 5``, ``resSeq >= 12``, ``name == CA``, ``resname != ALA``: comparisons.

It becomes one condition on a table of atoms, so it is pushed to the source like any filter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.names import ONE_LETTER

#: Names of water molecules, and of atoms of the backbone.
WATER = ("H2O", "HHO", "OHH", "HOH", "OH2", "SOL", "WAT", "TIP", "TIP2", "TIP3", "TIP4")
BACKBONE = ("N", "CA", "C", "O")

TEXT = {"name": "name", "element": "element", "symbol": "element", "type": "element", "resname": "aaa_code", "resn": "aaa_code", "chain": "chain", "chainid": "chain", "segment_id": "chain"}
NUMBER = {"index": "atom_idx", "resid": "residue_index", "resi": "residue_index", "resseq": "seqid", "residue": "seqid"}
TOKEN = re.compile(r"\(|\)|<=|>=|==|!=|<|>|=|'[^']*'|\"[^\"]*\"|[^\s()<>=!]+")


def _words() -> dict[str, Column]:
    name, residue = F.upper("name"), F.upper("aaa_code")
    protein = residue.isin(*ONE_LETTER)
    return {
        "all": F.lit(True),
        "everything": F.lit(True),
        "none": F.lit(False),
        "nothing": F.lit(False),
        "protein": protein,
        "is_protein": protein,
        "water": residue.isin(*WATER),
        "is_water": residue.isin(*WATER),
        "waters": residue.isin(*WATER),
        "backbone": protein & name.isin(*BACKBONE),
        "is_backbone": protein & name.isin(*BACKBONE),
        "sidechain": protein & ~name.isin(*BACKBONE, "H", "HA", "OXT"),
        "is_sidechain": protein & ~name.isin(*BACKBONE, "H", "HA", "OXT"),
        "hydrogen": F.upper("element") == "H",
    }


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = [t.strip("'\"") if t[0] in "'\"" else t for t in TOKEN.findall(text)], 0
        if not self.tokens:
            raise ValueError("an empty selection")

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self) -> str:
        if self.peek() is None:
            raise ValueError("the selection ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Column:
        out = self.both()
        while (self.peek() or "").lower() in ("or", "||"):
            self.next()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while (self.peek() or "").lower() in ("and", "&&"):
            self.next()
            out = out & self.one()
        return out

    def one(self) -> Column:
        token = self.next()
        word = token.lower()
        if word in ("not", "!"):
            return ~self.one()
        if word == "(":
            out = self.either()
            if self.next() != ")":
                raise ValueError("a parenthesis isn't closed")
            return out
        if word in _words():
            return F.coalesce(_words()[word], F.lit(False))
        if word in TEXT or word in NUMBER:
            return F.coalesce(self.values(word), F.lit(False))
        raise ValueError(f"unknown word {token!r}")

    def values(self, word: str) -> Column:
        column = F.upper(TEXT[word]) if word in TEXT else F.col(NUMBER[word])
        of = (lambda t: t.upper()) if word in TEXT else int
        if (sign := self.peek()) in ("<", "<=", ">", ">=", "=", "==", "!="):
            self.next()
            value = F.lit(of(self.next()))
            return {"<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value, "!=": column != value}.get(sign, column == value)
        out = None
        while self.peek() is not None and self.peek() not in ("(", ")") and self.peek().lower() not in ("and", "or", "not", "&&", "||"):
            low = of(self.next())
            if (self.peek() or "").lower() == "to":
                self.next()
                test = column.between(low, of(self.next()))
            else:
                test = column == low
            out = test if out is None else out | test
        if out is None:
            raise ValueError(f"{word} needs values")
        return out


def condition(selection: str) -> Column:
    """The condition on a table of atoms."""
    reader = _Reader(selection)
    out = reader.either()
    if reader.peek() is not None:
        raise ValueError(f"unexpected {reader.peek()!r}")
    return out


def select(atoms: DataFrame, selection: str) -> DataFrame:
    return atoms.where(condition(selection))


def sliced(atoms: DataFrame, frames: DataFrame, selection: str) -> tuple[DataFrame, DataFrame]:
    """Chosen atoms, numbered anew, and frames with their coordinates only. atoms: traj_id, atom_idx, ...; frames: traj_id, xyz, ...

    The list of chosen atoms is one row for each trajectory; coordinates are picked within the row.
    """
    chosen = select(atoms, selection)
    lists = chosen.groupBy("traj_id").agg(F.sort_array(F.collect_list("atom_idx")).alias("_atoms"))
    joined = frames.join(lists, "traj_id")
    pick = F.flatten(F.transform("_atoms", lambda a: F.slice(F.col("xyz"), a * 3 + 1, F.lit(3))))
    place = lists.select("traj_id", F.posexplode("_atoms").alias("_new", "atom_idx"))
    numbered = chosen.join(place, ["traj_id", "atom_idx"]).withColumn("atom_idx", F.col("_new")).drop("_new")
    return numbered.select(*atoms.columns), joined.withColumn("xyz", pick).select(*frames.columns)


def without_solvent(atoms: DataFrame, frames: DataFrame, also: tuple[str, ...] = ("NA", "CL", "K", "NA+", "CL-", "K+"), keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Atoms and coordinates without water and ions, but for residues in ``keep``."""
    gone = [n for n in (*WATER, *also) if n not in keep]
    return sliced(atoms, frames, f"not resname {' '.join(gone)}")
