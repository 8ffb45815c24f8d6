"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from memloom.llm.centroids import op13_centroids
from memloom.llm.embedding_dups import op7_embedding_dups
from memloom.llm.katz import op5_katz
from memloom.llm.line_rules import op4_line_rules
from memloom.llm.merkle import op12_merkle
from memloom.llm.mixing import op9_mixing
from memloom.llm.oracles import ORACLES
from memloom.llm.piece_codec import op1_piece_codec
from memloom.llm.quality import op3_quality
from memloom.llm.secrets import op10_secrets
from memloom.llm.simhash import op6_simhash
from memloom.llm.token_count import op2_token_counts
from memloom.llm.topk import op11_topk
from memloom.llm.url_rules import op8_url_rules

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_piece_codec, op2_token_counts, op3_quality, op4_line_rules, op5_katz, op6_simhash, op7_embedding_dups, op8_url_rules, op9_mixing, op10_secrets, op11_topk, op12_merkle, op13_centroids)}
