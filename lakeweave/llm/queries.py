"""The registered queries of this subpackage, and SQL for those that it can express."""

from lakeweave.llm.best_fit import op13_best_fit_packing
from lakeweave.llm.bpe import op6_byte_bpe
from lakeweave.llm.bradley_terry import op1_bradley_terry
from lakeweave.llm.conversation_trie import OP12_SQL, op12_conversation_trie
from lakeweave.llm.ef_lm import op10_elias_fano_lm
from lakeweave.llm.hard_negatives import OP11_SQL, op11_threshold_negatives
from lakeweave.llm.line_rules import OP2_SQL, op2_line_frequency
from lakeweave.llm.ngram_join import OP9_SQL, op9_grouped_prefix_join
from lakeweave.llm.nn_descent import op3_nn_descent
from lakeweave.llm.packing import op7_mixture_packing
from lakeweave.llm.sharding import op5_prefix_sum_shards
from lakeweave.llm.token_counts import op8_trie_token_counts
from lakeweave.llm.toxicity import op4_nearest_examples

QUERIES = {f.__name__: f for f in (
    op1_bradley_terry, op2_line_frequency, op3_nn_descent, op4_nearest_examples, op5_prefix_sum_shards, op6_byte_bpe,
    op7_mixture_packing, op8_trie_token_counts, op9_grouped_prefix_join, op10_elias_fano_lm, op11_threshold_negatives,
    op12_conversation_trie, op13_best_fit_packing)}

ORACLES = {"op2_line_frequency": OP2_SQL, "op9_grouped_prefix_join": OP9_SQL,
           "op11_threshold_negatives": OP11_SQL, "op12_conversation_trie": OP12_SQL}
