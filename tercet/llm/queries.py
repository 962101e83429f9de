"""Registry of the ``llm`` queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tercet.llm import chat, lexical, mixing
from tercet.llm.chat import op6_chat
from tercet.llm.languages import op13_languages
from tercet.llm.lexical import op11_lexical
from tercet.llm.mixing import op9_mixing
from tercet.llm.neighbours import op8_neighbours
from tercet.llm.ngram_join import op3_ngram_join
from tercet.llm.packing import op1_packing
from tercet.llm.periodic import op12_periodic
from tercet.llm.quality import op4_quality
from tercet.llm.resharding import op7_resharding
from tercet.llm.scoring import op10_scoring
from tercet.llm.secrets import op5_secrets
from tercet.llm.token_records import op2_token_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op10_scoring": op10_scoring,
    "op11_lexical": op11_lexical,
    "op12_periodic": op12_periodic,
    "op13_languages": op13_languages,
    "op2_token_records": op2_token_records,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_chat": op6_chat,
    "op7_resharding": op7_resharding,
    "op8_neighbours": op8_neighbours,
    "op9_mixing": op9_mixing,
}

ORACLES: dict[str, str] = {
    "op11_lexical": lexical.ORACLE,
    "op6_chat": chat.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
