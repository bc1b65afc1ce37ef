"""Parameters of an assembly, checked when made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults follow from k and the reads' length where None is given.

    ``counters``: each stage's numbers are noted, for some jobs more.
    ``stage_stats``: the statistics of the graph are worked out after each stage.
    """

    k: int
    read_len: int
    tip_length: int | None = None
    max_bubble_len: int | None = None
    low_cov: float = 1.0
    majority: float = 0.6
    pwm_n: float = 0.1
    kmer_cov: float = 30.0
    insert_len: int = 200
    insert_sd: int = 20
    bubble_edit_rate: float = 0.05
    low_kmer: int = 1
    up_kmer: int = 2000
    trust_k: int = 24
    n50_target: int = 0
    chimeric_rounds: int = 2
    max_rounds: int = 50
    counters: bool = True
    stage_stats: bool = False

    def __post_init__(self) -> None:
        if self.k < 1 or self.k % 2 == 0:
            raise ValueError(f"k must be odd and positive, not {self.k}")
        if self.read_len <= self.k:
            raise ValueError(f"reads of {self.read_len} bases hold no overlap of more than k = {self.k}")
        if not 0 < self.majority <= 1 or not 0 <= self.pwm_n <= 1:
            raise ValueError("majority and pwm_n are shares")

    @property
    def tips(self) -> int:
        return 10 * self.read_len if self.tip_length is None else self.tip_length

    @property
    def bubble(self) -> int:
        return 4 * self.read_len - 2 * self.k - 1 if self.max_bubble_len is None else self.max_bubble_len
