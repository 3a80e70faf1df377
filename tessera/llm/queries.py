"""The queries of this subpackage, each over its whole tables, and their DuckDB oracles."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run as pipeline
from tessera.llm.ann import op7_ann
from tessera.llm.bpe import op5_bpe
from tessera.llm.langid import op10_langid
from tessera.llm.lattice_lm import op2_lattice_lm
from tessera.llm.lines import op4_lines
from tessera.llm.mixing import ORACLE as MIXING_SQL
from tessera.llm.mixing import op8_mixing
from tessera.llm.pivots import op1_pivots
from tessera.llm.quality import op3_quality
from tessera.llm.simhash import op9_simhash
from tessera.llm.wacz import ORACLE as WACZ_SQL
from tessera.llm.wacz import op6_wacz


def queries():
    """Name → callable of (spark, sf_dir)."""
    return {f.__name__: f for f in (op1_pivots, op2_lattice_lm, op3_quality, op4_lines, op5_bpe, op6_wacz, op7_ann, op8_mixing, op9_simhash, op10_langid)} | {"pipeline": pipeline}


def oracle_sql():
    """Name → SQL, for the queries that SQL can express."""
    return {"op6_wacz": WACZ_SQL, "op8_mixing": MIXING_SQL} | ({"pipeline": PIPELINE_SQL} if PIPELINE_SQL else {})
