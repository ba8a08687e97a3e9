"""Parameters, kit presets and column schemas.  Coordinates are 1-based and inclusive."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    """Options of the annotation pipeline, typed, with their defaults."""

    match_score: float = 2.0
    mismatch_score: float = -3.0
    gap_open_score: float = -3.0
    gap_extend_score: float = -3.0
    three_adapter: str = "A" * 30
    five_adapter: str = "TGGATTGATATGTAATACGACTCACTATAG"
    five_score: float = 20.0
    three_score: float = 20.0
    check_in_soft: int = 30
    check_in_match: int = 10
    check_from_alignment: int = 3
    shs_for_ts: int = 3
    first_exon: int = 30
    match_in_first: int = 15
    insert_before_intron: int = 20
    window: int = 50
    minimum: int = 2
    wobble: int = 10
    intron_wobble: int = 15
    rare_intron: float = 0.05
    ratio: float = 0.001
    distance: int = 15
    cov_sample: int = 5
    force_consensus: bool = False
    significance: bool = False
    mintr_count: int = 1
    drna: bool = False
    shift: int = 30
    #: 'reference' looks at no position on right ends (depth 0); 'inward' mirrors the left side.
    coverage_mode: str = "reference"
    #: 'reference' lets a cDNA start pass if the end is out of place; 'fixed' tests the start.
    tss_gate: str = "reference"


#: Settings documented for library kits, as changes of the defaults.
PRESETS = {
    "default": {},
    "direct-rna": {"drna": True, "check_in_soft": 6, "three_adapter": "AAAA", "three_score": 6.0},
    # Adapters and scores documented for the kits.
    "teloprime": {"significance": True, "force_consensus": True},
    "isoseq": {"five_adapter": "AGAGTACATGGG", "five_score": 16.0, "check_in_soft": 15, "three_adapter": "A" * 15, "three_score": 18.0, "significance": True, "force_consensus": True},
    "ont-cdna": {"five_adapter": "TGCCATTAGGCCGGG", "five_score": 16.0, "check_in_soft": 15, "three_adapter": "A" * 15, "three_score": 16.0, "significance": True, "force_consensus": True},
}


def preset(name: str, **changes) -> Params:
    return replace(Params(), **(PRESETS[name] | changes))


GFF = "contig string, source string, feature string, start int, end int, score double, strand string, frame string, info string"
READ = "qname string, flag int, contig string, start int, end int, mapq int, cigar string, seq string, tags map<string,string>, rnext string, pnext int, tlen int, qual string, tag_types map<string,string>"
BED = "contig string, start0 int, end int, name string, score string, strand string"
DEPTH = "contig string, pos int, depth int"
