"""The queries opN_<name> of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from sediment.llm.decontaminate import op3_decontaminate
from sediment.llm.licenses import OP6_SQL, op6_license_scan
from sediment.llm.linedup import OP9_SQL, op9_line_dedup
from sediment.llm.neardup import OP4_SQL, op4_near_duplicates
from sediment.llm.quality import op2_quality
from sediment.llm.token_counts import op5_token_counts
from sediment.llm.topk import OP8_SQL, op8_topk
from sediment.llm.toxicity import op10_toxicity
from sediment.llm.unigram import op1_sentencepiece
from sediment.llm.wrappers import OP7_SQL, op7_html_text

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_counts": op5_token_counts,
    "op6_license_scan": op6_license_scan,
    "op7_html_text": op7_html_text,
    "op8_topk": op8_topk,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": OP4_SQL,
    "op6_license_scan": OP6_SQL,
    "op7_html_text": OP7_SQL,
    "op8_topk": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
}
