"""Queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from larkspur.llm.attention_lm import op11_attention_lm
from larkspur.llm.byte_bpe import op10_byte_bpe
from larkspur.llm.decontaminate import op5_decontaminate
from larkspur.llm.embedding_dedup import NEAR_SQL, OP9_SQL, near_embeddings, op9_embedding_dedup
from larkspur.llm.html_text import op4_html_text
from larkspur.llm.license_scan import op7_license_scan
from larkspur.llm.ngram_jaccard import OP1_SQL, op1_ngram_jaccard
from larkspur.llm.quality import op8_quality
from larkspur.llm.sharding import OP3_SQL, op3_sharding
from larkspur.llm.spelling import OP13_SQL, op13_spelling
from larkspur.llm.suffix_dedup import op2_suffix_dedup
from larkspur.llm.unit_dedup import OP6_SQL, op6_substring_dedup
from larkspur.llm.vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_html_text": op4_html_text,
    "op5_decontaminate": op5_decontaminate,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_attention_lm": op11_attention_lm,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling": op13_spelling,
    "near_embeddings": near_embeddings,
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": OP1_SQL,
    "op3_sharding": OP3_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op9_embedding_dedup": OP9_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_spelling": OP13_SQL,
    "near_embeddings": NEAR_SQL,
}
