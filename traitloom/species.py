"""Per-organism settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Species:
    """Where an organism's files keep what the jobs read; columns count from 0."""

    name: str
    source_db: str  # value of annotation column 0
    annotation_gene: int  # annotation column of the gene
    first_synonym: bool  # the gene column lists names split by '|'
    min_columns: int  # phenotype rows with fewer columns are skipped
    read_columns: int  # phenotype columns the rules read
    lethal: tuple[str, ...] = ("lethal",)  # statuses that make a gene lethal


# Database tags and column positions of the public file formats.
SPECIES = {
    "yeast": Species("yeast", "SGD", 10, True, 0, 10, ("inviable",)),
    "fly": Species("fly", "FB", 2, True, 4, 4),
    "fish": Species("fish", "ZFIN", 2, False, 0, 11),
    "worm": Species("worm", "WB", 2, False, 4, 5),
    "mouse": Species("mouse", "MGI", 1, False, 4, 6),
}


def species_named(name: str) -> Species:
    try:
        return SPECIES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown species {name!r}, known: {', '.join(SPECIES)}") from None
