"""Queries of this subpackage, by name, and their SQL twins."""

from __future__ import annotations

from windowforge.llm.chat import ORACLE_OP1, op1_chat_format
from windowforge.llm.decontamination import op7_decontamination
from windowforge.llm.dialogue_repair import ORACLE_OP13, op13_dialogue_repair
from windowforge.llm.hard_negatives import ORACLE_OP11, op11_hard_negatives
from windowforge.llm.neighbours import op8_nearest_neighbours
from windowforge.llm.ngram_join import ORACLE_OP5, op5_ngram_jaccard
from windowforge.llm.packing import op10_best_fit_packing
from windowforge.llm.sentence_pieces import op12_sentence_pieces
from windowforge.llm.sharding import ORACLE_OP2, op2_sharding
from windowforge.llm.substring_dedup import ORACLE_OP9, op9_substring_dedup
from windowforge.llm.suffix_dedup import ORACLE_OP3, op3_suffix_dedup
from windowforge.llm.token_files import op6_token_files
from windowforge.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_sharding": op2_sharding,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_dialogue_repair": op13_dialogue_repair,
}
ORACLE: dict[str, str] = {
    "op1_chat_format": ORACLE_OP1,
    "op2_sharding": ORACLE_OP2,
    "op3_suffix_dedup": ORACLE_OP3,
    "op5_ngram_jaccard": ORACLE_OP5,
    "op9_substring_dedup": ORACLE_OP9,
    "op11_hard_negatives": ORACLE_OP11,
    "op13_dialogue_repair": ORACLE_OP13,
}
