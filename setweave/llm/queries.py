"""Queries of the corpus operators, and their SQL where SQL can express them."""

import corpus_pipeline

from .decontaminate import op1_template_decontam
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .language_ppm import op5_ppm_language
from .mixing import OP2_SQL, op2_pareto_mix
from .quality_rules import op10_quality_rules
from .quote_linking import op6_quote_linking
from .relative_lz import OP12_SQL, op12_relative_lz
from .rope_fim import OP11_SQL, op11_rope_fim
from .secrets import op8_secret_guess_cost
from .simhash import op7_simhash_anchors
from .token_binary import op4_repair_tokens
from .token_counts import op3_viterbi_counts
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_template_decontam, op2_pareto_mix, op3_viterbi_counts, op4_repair_tokens, op5_ppm_language,
        op6_quote_linking, op7_simhash_anchors, op8_secret_guess_cost, op9_exact_dedup, op10_quality_rules,
        op11_rope_fim, op12_relative_lz, op13_vector_codes,
    )
} | {"pipeline": corpus_pipeline.run}
SQL = {"op2_pareto_mix": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op11_rope_fim": OP11_SQL, "op12_relative_lz": OP12_SQL, "op13_vector_codes": OP13_SQL}
