"""Limits and codes of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

# Mapping categories, smaller is better.
CONCRD, DISCRD, CHIORF, CHIBSJ, CHI2BSJ, CONGEN, CHIFUS, CONGNM, OEA2, CANDID, OEANCH, ORPHAN, MANYHIT, NOMATCH = range(14)
# Split mapping types.
FR, RF, CR, NCR, MCR, UD, NF = 0, 1, 20, 21, 22, 30, 40
# Labels of reported types.
LABELS = {CR: "STC", NCR: "MTC", MCR: "NC"}


@dataclass(frozen=True)
class Params:
    """Limits that callers may change."""

    kmer: int = 20
    window: int = 8
    step: int = 3
    max_edit: int = 4
    band: int = 3
    max_clip: int = 7
    max_tlen: int = 500
    discordant_tlen: int = 20_000
    seed_limit: int = 500
    max_intron: int = 2_000_000
    max_chains: int = 30
    lariat: int = 1_000
    tolerance: int = 5
    contig_size: int = 1_100_000_000
    spacer: int = 50
    try_chains: int = 10


DEFAULT = Params()
