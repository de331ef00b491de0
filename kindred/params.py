"""Thresholds, with the studied pipeline's defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    min_gs: float = 0.15
    geno: float = 0.05
    mind: float = 0.1
    maf: float = 0.01
    #: p >= 1e-4 is chi-square with one degree of freedom of at most this.
    hwe_chi2: float = 15.136705226623
    ld_window: int = 50
    ld_r2: float = 0.2
    min_reference_af: float = 0.01
    aim_maf: float = 0.05
    top_outliers: int = 25
    top_aims: int = 200
    tie_ratio: float = 1.15
    nmf_call_rate: float = 0.8


DEFAULT = Params()
