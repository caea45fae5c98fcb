"""The queries of this subpackage. SQL can state three of them; tests/llm holds the others against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_byte_bpe
from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .language import op8_language
from .packing import op10_packing
from .permutation_index import op6_permutations
from .phrases import OP13_SQL, op13_phrases
from .pieces import op11_pieces
from .quality import op3_quality
from .sharding import op2_virtual_slots
from .simhash import op7_simhash
from .suffix_dedup import op9_repeated_passages
from .toxicity import op1_toxicity
from .voronoi_knn import OP4_SQL, op4_voronoi

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_virtual_slots": op2_virtual_slots,
    "op3_quality": op3_quality,
    "op4_voronoi": op4_voronoi,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_permutations": op6_permutations,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_packing": op10_packing,
    "op11_pieces": op11_pieces,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_phrases": op13_phrases,
}
ORACLE_SQL: dict[str, str] = {"op4_voronoi": OP4_SQL, "op12_fill_in_middle": OP12_SQL, "op13_phrases": OP13_SQL}
