"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunks import op2_gear_chunks
from .html import op3_host_suffixes
from .lattice import op1_lattice
from .merkle import ORACLE as OP13_SQL
from .merkle import op13_superblocks
from .mixing import op10_soft_mixing
from .neardup import op5_superminhash
from .packing import op6_harmonic
from .pieces import op12_agenda
from .quality import op8_ngram_ratio
from .secrets import op4_randomness
from .substring import op9_seed_extend
from .urls import ORACLE as OP7_SQL
from .urls import op7_blocked_bloom
from .variants import ORACLE as OP11_SQL
from .variants import op11_errata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice": op1_lattice,
    "op2_gear_chunks": op2_gear_chunks,
    "op3_host_suffixes": op3_host_suffixes,
    "op4_randomness": op4_randomness,
    "op5_superminhash": op5_superminhash,
    "op6_harmonic": op6_harmonic,
    "op7_blocked_bloom": op7_blocked_bloom,
    "op8_ngram_ratio": op8_ngram_ratio,
    "op9_seed_extend": op9_seed_extend,
    "op10_soft_mixing": op10_soft_mixing,
    "op11_errata": op11_errata,
    "op12_agenda": op12_agenda,
    "op13_superblocks": op13_superblocks,
}

ORACLES: dict[str, str] = {
    "op7_blocked_bloom": OP7_SQL,
    "op11_errata": OP11_SQL,
    "op13_superblocks": OP13_SQL,
}
