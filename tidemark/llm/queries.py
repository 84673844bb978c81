"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from .decontaminate import op2_decontaminate
from .lines import OP11_SQL, op11_line_dedup
from .middle import OP13_SQL, op13_fill_in_middle
from .periods import op12_periodic_runs
from .pieces import op7_sentencepiece
from .pii import op3_pii_sanitise
from .separators import op6_separator_scan
from .shards import op8_lpt_sharding
from .simhash import op10_simhash_near_dedup
from .tokenfiles import op9_token_files
from .topk import OP5_SQL, op5_exact_top_k
from .toxicity import op4_toxicity
from .warc import OP1_SQL, op1_warc_chunks

QUERIES: dict[str, Callable] = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii_sanitise": op3_pii_sanitise,
    "op4_toxicity": op4_toxicity,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_separator_scan": op6_separator_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_lpt_sharding": op8_lpt_sharding,
    "op9_token_files": op9_token_files,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op1_warc_chunks": OP1_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op11_line_dedup": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
