"""Set-oriented analysis of dynamical systems and point data on Spark DataFrames."""

from .functions.geometry import Box, BoxPartition
from .functions.ode import FlowMap, TimeSpanFlow, rk4_step
from .operators.algorithms import (
    alpha_limit_set,
    finite_time_lyapunov_exponents,
    ftle_frames,
    invariant_measure,
    maximal_invariant_set,
    morse_sets,
    morse_tiles,
    preimage,
    recurrent_set,
    relative_attractor,
    unstable_set,
)
from .operators.boxset import BoxSet
from .operators.graph import BoxGraph
from .operators.maps import BatchMap, BoxMap, ColumnMap, GridMap, MonteCarloMap, NonautonomousMap, PointMap, box_map, grid_points, lattice, monte_carlo_points
from .operators.measure import BoxMeasure
from .operators.transfer import TransferOperator

__all__ = [
    "BatchMap", "Box", "BoxGraph", "BoxMap", "BoxMeasure", "BoxPartition", "BoxSet", "ColumnMap", "FlowMap", "GridMap", "MonteCarloMap", "NonautonomousMap",
    "PointMap", "TimeSpanFlow", "TransferOperator", "alpha_limit_set", "box_map", "finite_time_lyapunov_exponents", "ftle_frames", "grid_points", "invariant_measure",
    "lattice", "maximal_invariant_set", "monte_carlo_points", "morse_sets", "morse_tiles", "preimage", "recurrent_set", "relative_attractor", "rk4_step", "unstable_set",
]
