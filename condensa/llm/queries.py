"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from condensa.llm.decontaminate import OP3_SQL, op3_decontaminate
from condensa.llm.exact_topk import OP7_SQL, op7_exact_topk
from condensa.llm.html_extract import op2_html_extract
from condensa.llm.licenses import OP8_SQL, op8_licenses
from condensa.llm.mixing import TARGETS_SQL, mixing_targets, op1_mixing
from condensa.llm.ngram_jaccard import OP10_SQL, op10_ngram_jaccard
from condensa.llm.pii import PII_BASE_SQL, op9_pii, pii_base
from condensa.llm.secrets import OP4_SQL, op4_secrets
from condensa.llm.sharding import OP6_SQL, op6_sharding
from condensa.llm.toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_mixing, op2_html_extract, op3_decontaminate, op4_secrets, op5_toxicity, op6_sharding, op7_exact_topk, op8_licenses, op9_pii, op10_ngram_jaccard, mixing_targets, pii_base)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op3_decontaminate": OP3_SQL, "op4_secrets": OP4_SQL, "op6_sharding": OP6_SQL, "op7_exact_topk": OP7_SQL, "op8_licenses": OP8_SQL, "op10_ngram_jaccard": OP10_SQL, "mixing_targets": TARGETS_SQL, "pii_base": PII_BASE_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
