"""The operators' queries on the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filescope.llm.bpe import op6_bpe_tree
from filescope.llm.chat import OP7_SQL, op7_chat_format
from filescope.llm.decontaminate import OP2_SQL, op2_decontaminate
from filescope.llm.jaccard import OP5_SQL, op5_ngram_jaccard
from filescope.llm.neighbours import OP3_SQL, op3_collision_counting
from filescope.llm.sharding import OP1_SQL, op1_rendezvous_sharding
from filescope.llm.suffix_dedup import OP10_SQL, op10_suffix_dedup
from filescope.llm.token_store import op8_token_store
from filescope.llm.toxicity import op9_toxicity
from filescope.llm.wrapper import OP4_SQL, op4_html_wrapper


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_rendezvous_sharding, op2_decontaminate, op3_collision_counting, op4_html_wrapper, op5_ngram_jaccard, op6_bpe_tree, op7_chat_format, op8_token_store, op9_toxicity, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_rendezvous_sharding": OP1_SQL, "op2_decontaminate": OP2_SQL, "op3_collision_counting": OP3_SQL, "op4_html_wrapper": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op7_chat_format": OP7_SQL, "op10_suffix_dedup": OP10_SQL}
