"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bit_slices import op13_bit_slices
from .content_sort import op11_content_sort
from .cover_tree import op3_cover_tree
from .gif import op6_gif
from .kneser_ney import op8_kneser_ney
from .longest_match import op4_longest_match
from .minhash import op10_minhash
from .mixing import op9_pivotal
from .packing import op7_best_fit
from .sharding import op2_rendezvous
from .sql import SQL as STATED
from .suffix_dedup import op5_suffix_array
from .toxicity import op1_toxicity
from .wand import op12_wand

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_rendezvous, op3_cover_tree, op4_longest_match, op5_suffix_array, op6_gif, op7_best_fit, op8_kneser_ney, op9_pivotal, op10_minhash, op11_content_sort, op12_wand, op13_bit_slices)
}

#: op3, op5 and op10 have SQL. tests/llm holds the other operators to brute force or examples.
SQL: dict[str, str] = dict(STATED)
