"""Parameters of the detection modes, with the defaults of the command-line tool they follow."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StdGate:
    """Coverage-spread gate: ``base <= 0`` switches it off, ``mean_floor`` this high the bypass."""

    base: float = 50.0
    dynamic: bool = True
    mean_ref: float = 200.0
    min_floor: float = 8.0
    shared_ref: float = 500.0
    span_ref: float = 150_000.0
    min_cv: float = 0.085
    mean_floor: float = 1e9
    bin_size: int = 100


@dataclass(frozen=True)
class Split:
    """Coverage split of loci, then junction split of the wide ones."""

    bin_size: int = 100
    dynamic: bool = True
    peak_frac: float = 0.12
    min_gap_bp: int = 2200
    min_segment_bp: int = 1500
    merge_min_segment_bp: int = 5000
    merge_max_gap_bp: int = 1000
    junction_min_locus_bp: int = 200_000
    junction_min_span_bp: int = 200_000
    junction_merge_min_segment_bp: int = 10_000
    junction_merge_max_gap_bp: int = 5000
    advance_junctions: bool = False


@dataclass(frozen=True)
class TightSplit:
    """Late, stricter re-split of loci; with ``max_segments`` given up for loci that fall into more pieces."""

    bin_size: int = 100
    peak_frac: float = 0.12
    min_gap_bp: int = 1200
    min_segment_bp: int = 800
    merge_min_segment_bp: int = 2500
    merge_max_gap_bp: int = 400
    min_input_span_bp: int = 8000
    max_segments: int | None = None  # published: 12


@dataclass(frozen=True)
class Detect:
    """Transitive detection and its filters."""

    min_jaccard: float = 0.001
    min_reads: int = 5
    cluster_distance: int = 10_000
    adaptive_gap: bool = False
    include_supplementary: bool = False
    min_core_reads: int = 1
    min_seeds: int = 1
    min_jaccard_locus: float = 0.01
    min_coverage_quality: float = 0.0
    std_gate: StdGate = field(default_factory=StdGate)
    split: Split = field(default_factory=Split)
    bin_width: int = 8192


@dataclass(frozen=True)
class Envelope:
    """Read-envelope trim; quantiles in percent."""

    lo: float = 5.0
    hi: float = 95.0
    min_span: int = 2000
    min_alignments: int = 8
    pad: int = 500_000


@dataclass(frozen=True)
class ClipTail:
    """PolyA clip-tail trim."""

    min_len: int = 12
    min_a_frac: float = 0.62
    min_reads: int = 6
    end_slack: int = 400
    start_slack: int = 400
    strand_dom_frac: float = 0.65
    pad: int = 500_000
    min_result_span: int = 2000


@dataclass(frozen=True)
class Refine:
    """Boundary refinement."""

    window: int = 1000
    step: int = 500
    min_jaccard_window: float = 0.01
    jaccard_drop: float = 0.5
    max_trim_frac: float = 0.95
    min_region: int = 5000
    min_tx_density: float = 0.05
    strand_exon: bool = True
    keep_all_segments: bool = True
    min_segment_jaccard: float = 0.01


@dataclass(frozen=True)
class ExonTrim:
    """Exon-union trim with read-end and acceptor guards."""

    max_trim_frac: float = 0.35
    min_span: int = 500
    min_junction_reads: int = 3
    cluster_slack: int = 12
    read_end_slack: int = 2000
    win_left: int = 2500
    win_right: int = 1200


@dataclass(frozen=True)
class Integrated:
    """Integrated mode: valley depth decides a split, transcripts the doubtful ones."""

    bin_size: int = 100
    peak_frac: float = 0.12
    min_gap_bp: int = 2200
    min_segment_bp: int = 1500
    auto_split: float = 0.1
    validate: float = 0.3
    strand_split: bool = True
    strand_min_span: int = 50_000
    validate_window: int = 5000
    exon_trim: bool = False
    cluster_distance: int = 10_000
    min_reads: int = 5


@dataclass(frozen=True)
class Explore:
    """Adaptive reseeding; a round adds ``max_new_seeds`` and rounds go on until there is no new one."""

    max_new_seeds: int = 1
    min_component_reads: int = 20
    strict: bool = False
    min_jaccard: float = 0.02
    max_span: int = 200_000
    min_shared_frac: float = 0.20
    min_score: float = 0.12
    novel_distance: int = 5_000_000
    skeleton: bool = False
    skeleton_min_score: float = 0.35
    skeleton_top_k: int | None = None  # published: 25
    hotspots: bool = False
    hotspot_bin: int = 50_000
    hotspot_min_reads: int = 200
    hotspot_top_k: int | None = None  # published: 3; a round adds max_new_seeds at most
    hotspot_min_shared_frac: float = 0.05
    hotspot_min_seeds: int = 2
    hotspot_gap: int = 500_000
    max_growth: float | None = None  # published: 2.0; ends a strict search whose loci grow faster
    max_rounds: int | None = None  # published: 5


@dataclass(frozen=True)
class Fast:
    """Fast mode on the chromosome-partitioned index table."""

    min_reads: int = 2
    min_size: int = 10_000
    max_size: int | None = None  # published: 2,000,000
    cluster_distance: int = 10_000
    split_valleys: bool = False
    valley_frac: float = 0.15
    min_segment: int = 5000
    bin_size: int = 100
    max_rounds: int | None = None  # published: 2; None goes on until no read is added
    top_loci: int | None = None  # published: 5; None expands around every new locus
    window: int = 20_000
    index_bin: int = 10_000


@dataclass(frozen=True)
class FamilyAssembly:
    """Isoforms of all members of a gene family from their common junction tree."""

    tolerance: int = 10
    min_member_support: int = 2
    min_family_support: int = 5
    min_members: int = 1
    group_tolerance: int = 10


@dataclass(frozen=True)
class Validation:
    """Evidence an assembled isoform must have."""

    min_junction_reads: int = 3
    min_coverage: int = 5
    min_canonical: float = 0.95
    min_confidence: float = 0.7
    min_family_ratio: float = 0.3
    high_confidence: float = 0.8
    group_bonus: float = 0.1
