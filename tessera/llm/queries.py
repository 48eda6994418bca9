"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import oracles
from .bpe import op5_bpe
from .chat import op10_chat
from .decontamination import SQL as OP9_SQL
from .decontamination import op9_decontamination
from .fingerprints import op7_fingerprints
from .licenses import op3_licenses
from .ngram_join import op4_ngram_join
from .sharding import op1_sharding
from .substring_dedup import op8_suffix_dedup
from .toxicity import op6_toxicity
from .url_filters import op2_url_filters

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_url_filters": op2_url_filters,
    "op3_licenses": op3_licenses,
    "op4_ngram_join": op4_ngram_join,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
}

#: Where SQL on DuckDB can express the query; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": oracles.url_filters(),
    "op3_licenses": oracles.licenses(),
    "op4_ngram_join": oracles.NGRAM_JOIN,
    "op8_suffix_dedup": oracles.SUBSTRING_DEDUP,
    "op9_decontamination": OP9_SQL,
    "op10_chat": oracles.chat(),
}
