"""The corpus queries and their SQL twins, by registered name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lagwell.llm import chat, tries
from lagwell.llm.bpe import op1_bpe
from lagwell.llm.edits import op3_edit_prints
from lagwell.llm.languages import op11_languages
from lagwell.llm.lines import op9_lines
from lagwell.llm.near import op4_near
from lagwell.llm.packing import op8_packing
from lagwell.llm.pages import op5_pages
from lagwell.llm.privacy import op2_pii
from lagwell.llm.quality import op6_quality
from lagwell.llm.shards import op7_shards


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_pii": op2_pii,
        "op3_edit_prints": op3_edit_prints,
        "op4_near": op4_near,
        "op5_pages": op5_pages,
        "op6_quality": op6_quality,
        "op7_shards": op7_shards,
        "op8_packing": op8_packing,
        "op9_lines": op9_lines,
        "op10_chat": chat.op10_chat,
        "op11_languages": op11_languages,
        "op12_prefix_trie": tries.op12_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_chat": chat.ORACLE_SQL, "op12_prefix_trie": tries.ORACLE_SQL}
