"""The subpackage's queries by name, and their SQL where SQL can express them."""

import corpus_pipeline
from kinledger.llm import op1_quality, op2_binary_ids, op3_sharding, op4_packing, op5_ann, op6_language, op7_simhash, op8_secrets, op9_mixing, op10_media

_MODULES = (op1_quality, op2_binary_ids, op3_sharding, op4_packing, op5_ann, op6_language, op7_simhash, op8_secrets, op9_mixing, op10_media)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
