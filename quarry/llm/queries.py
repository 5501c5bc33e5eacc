"""The registered queries of the corpus operators, and their DuckDB text where SQL can state one."""

from __future__ import annotations

from quarry.llm.bpe import op9_bpe_prefix
from quarry.llm.chat_format import OP13_SQL, op13_chat_format
from quarry.llm.cutting_stock import op6_cutting_stock
from quarry.llm.dart_minhash import op3_dart_minhash
from quarry.llm.digest_index import OP10_SQL, op10_exact_dedup
from quarry.llm.dimension_scan import op8_dimension_scan
from quarry.llm.hyper_language import op7_hyper_language
from quarry.llm.lanczos_whitening import op11_lanczos_whitening
from quarry.llm.periodic_runs import op12_periodic_runs
from quarry.llm.secret_scan import op1_secret_scan
from quarry.llm.toxicity import op4_toxicity
from quarry.llm.training_order import op5_training_order
from quarry.llm.url_rules import OP2_SQL, op2_url_rules

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_url_rules": op2_url_rules,
    "op3_dart_minhash": op3_dart_minhash,
    "op4_toxicity": op4_toxicity,
    "op5_training_order": op5_training_order,
    "op6_cutting_stock": op6_cutting_stock,
    "op7_hyper_language": op7_hyper_language,
    "op8_dimension_scan": op8_dimension_scan,
    "op9_bpe_prefix": op9_bpe_prefix,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_lanczos_whitening": op11_lanczos_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_chat_format": op13_chat_format,
}
ORACLES = {"op2_url_rules": OP2_SQL, "op10_exact_dedup": OP10_SQL, "op13_chat_format": OP13_SQL}
