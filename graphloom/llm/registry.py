"""The registered text queries; SQL for those that SQL can express."""

from __future__ import annotations

from graphloom.llm.bpe import op8_bpe
from graphloom.llm.decontaminate import op7_decontaminate
from graphloom.llm.html_text import op4_html
from graphloom.llm.langid import op3_langid
from graphloom.llm.licenses import op5_licenses
from graphloom.llm.near_dedup import op6_near_dedup
from graphloom.llm.oracles import ORACLES
from graphloom.llm.quality import op2_quality
from graphloom.llm.suffix_dedup import op1_suffix_dedup
from graphloom.llm.topk import op10_topk
from graphloom.llm.toxicity import op9_toxicity

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality, op3_langid, op4_html, op5_licenses, op6_near_dedup, op7_decontaminate, op8_bpe, op9_toxicity, op10_topk)}
