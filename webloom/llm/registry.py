"""Queries and SQL of this subpackage, for the driver's entry."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import op4_decontaminate
from .langid import op8_language
from .line_dedup import OP3_SQL, op3_line_dedup
from .media import op9_media
from .mixing import op7_lm_score
from .near_dup import OP5_SQL, op5_minhash
from .packing import OP2_SQL, op2_packing
from .quality import op1_quality
from .suffix import op10_suffix_dedup
from .urls import op6_url_filter

QUERIES: dict = {f.__name__: f for f in (op1_quality, op2_packing, op3_line_dedup, op4_decontaminate, op5_minhash, op6_url_filter, op7_lm_score, op8_language, op9_media, op10_suffix_dedup)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL: dict = {"op2_packing": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_minhash": OP5_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
