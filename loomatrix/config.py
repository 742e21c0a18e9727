"""Options of a run and their checks."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

FORMATS = ("coo", "crs", "csr", "scs")
PRECISIONS = ("dp", "sp", "hp", "ap[dp_sp]", "ap[dp_hp]", "ap[sp_hp]", "ap[dp_sp_hp]")
MODES = ("bench", "solve")
SEGMENTATIONS = ("rows", "nnz", "graph")


@dataclass(frozen=True)
class SpmvConfig:
    """What to multiply, how it is stored, and how it is measured."""

    matrix: str = ""
    format: str = "crs"
    chunk: int = 1
    sigma: int = 1
    precision: str = "dp"
    threshold_1: float = 1.0
    threshold_2: float = 0.5
    x_precision: str = "highest"
    block_width: int = 1
    mode: str = "bench"
    repetitions: int = 5
    bench_seconds: float = 5.0
    warm_ups: int = 1
    equilibrate: bool = False
    dropout: bool = False
    dropout_threshold: float = 0.0
    segmentation: str = "rows"
    parts: int = 1
    random_x: str = "0"
    validate: bool = True
    seed: int = 42
    output: str = ""

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.format in FORMATS, f"format must be one of {FORMATS}")
        need(self.precision in PRECISIONS, f"precision must be one of {PRECISIONS}")
        need(self.mode in MODES, f"mode must be one of {MODES}")
        need(self.segmentation in SEGMENTATIONS, f"segmentation must be one of {SEGMENTATIONS}")
        need(self.x_precision in ("highest", "own"), "x_precision must be highest or own")
        need(self.random_x in ("0", "1", "m"), "random_x must be 0, 1 or m")
        need(min(self.chunk, self.sigma, self.block_width, self.parts, self.repetitions) >= 1, "chunk, sigma, block_width, parts and repetitions must be positive")
        need(self.format == "scs" or (self.chunk == 1 and self.sigma == 1), "chunk and sigma belong to scs")
        need(self.block_width == 1 or self.mode == "bench", "block_width belongs to bench mode")
        need(self.block_width == 1 or not self.precision.startswith("ap["), "adaptive precision has no products with a block of vectors")
        need(self.bench_seconds > 0 and self.warm_ups >= 0, "bench_seconds must be positive")
        need(self.threshold_1 >= self.threshold_2 or self.precision != "ap[dp_sp_hp]", "threshold_1 must not be below threshold_2")


def parse(argv: list[str]) -> SpmvConfig:
    """A configuration from command-line arguments: a matrix file, a format, options."""
    p = argparse.ArgumentParser(prog="loomatrix", description="Sparse matrix-vector products on Spark")
    p.add_argument("matrix")
    p.add_argument("format", nargs="?", default="crs", choices=FORMATS)
    p.add_argument("-c", "--chunk", type=int)
    p.add_argument("-s", "--sigma", type=int)
    p.add_argument("--precision", choices=PRECISIONS)
    p.add_argument("--threshold-1", type=float)
    p.add_argument("--threshold-2", type=float)
    p.add_argument("--x-precision", choices=("highest", "own"))
    p.add_argument("--block-width", type=int)
    p.add_argument("--mode", choices=MODES)
    p.add_argument("--repetitions", type=int)
    p.add_argument("--bench-seconds", type=float)
    p.add_argument("--warm-ups", type=int)
    p.add_argument("--equilibrate", action="store_true", default=None)
    p.add_argument("--dropout-threshold", type=float)
    p.add_argument("--segmentation", choices=SEGMENTATIONS)
    p.add_argument("--parts", type=int)
    p.add_argument("--random-x", choices=("0", "1", "m"))
    p.add_argument("--seed", type=int)
    p.add_argument("--output", help="a folder to which figures or comparisons are appended")
    given = {k: v for k, v in vars(p.parse_args(argv)).items() if v is not None}
    if "dropout_threshold" in given:
        given["dropout"] = True
    return SpmvConfig(**{f.name: given[f.name] for f in fields(SpmvConfig) if f.name in given})
