"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from .jaccard_join import OP6_SQL, op6
from .lm_scoring import op2
from .mixing import OP7_SQL, op7
from .mpeg_audio import OP4_SQL, op4
from .packing import op5
from .quality import OP9_SQL, op9
from .secrets import op1
from .sharding import op8
from .url_filters import OP10_SQL, op10
from .warc import OP3_SQL, op3


def queries():
    return {
        "op1_secret_scan": op1,
        "op2_lm_scoring": op2,
        "op3_warc_salvage": op3,
        "op4_mpeg_audio": op4,
        "op5_packing": op5,
        "op6_ngram_jaccard": op6,
        "op7_mixing": op7,
        "op8_kd_sharding": op8,
        "op9_quality_rules": op9,
        "op10_url_filters": op10,
    }


def oracle_sql():
    return {"op3_warc_salvage": OP3_SQL, "op4_mpeg_audio": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op7_mixing": OP7_SQL, "op9_quality_rules": OP9_SQL, "op10_url_filters": OP10_SQL}
