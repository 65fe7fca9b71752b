"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from clausework.llm.bpe import op7_bpe
from clausework.llm.corpus_bpe import op13_corpus_bpe
from clausework.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from clausework.llm.html_text import op8_html_text
from clausework.llm.language_id import op10_language_id
from clausework.llm.merkle import OP11_SQL, op11_merkle_manifest
from clausework.llm.mixing import OP9_SQL, op9_mix_sources
from clausework.llm.near_dedup import op2_near_dedup
from clausework.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from clausework.llm.quality import op5_quality_rules
from clausework.llm.secrets import op3_secret_scan
from clausework.llm.url_filter import OP6_SQL, op6_url_filter
from clausework.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_bpe": op7_bpe,
    "op8_html_text": op8_html_text,
    "op9_mix_sources": op9_mix_sources,
    "op10_language_id": op10_language_id,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_corpus_bpe": op13_corpus_bpe,
}
SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op4_warc": OP4_SQL,
    "op6_url_filter": OP6_SQL,
    "op9_mix_sources": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
