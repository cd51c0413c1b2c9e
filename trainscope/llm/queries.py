"""The queries of this package and, where SQL can say them, their SQL."""

from __future__ import annotations

from trainscope.llm import negatives, prefix_trie, preferences, quality, topk
from trainscope.llm.decontamination import op5_decontamination
from trainscope.llm.jaccard_join import op4_jaccard_join
from trainscope.llm.language_id import op8_language_id
from trainscope.llm.mixing import op7_mixing
from trainscope.llm.negatives import op13_hard_negatives
from trainscope.llm.pitman_yor import op2_pitman_yor
from trainscope.llm.preferences import op1_preference_format
from trainscope.llm.prefix_trie import op11_prefix_trie
from trainscope.llm.quality import op12_quality_cascade
from trainscope.llm.sharding import op10_minimax_sharding
from trainscope.llm.suffix_dedup import op3_repeated_passages
from trainscope.llm.topk import op6_top_k
from trainscope.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_preference_format, op2_pitman_yor, op3_repeated_passages, op4_jaccard_join, op5_decontamination, op6_top_k,
                                   op7_mixing, op8_language_id, op9_toxicity, op10_minimax_sharding, op11_prefix_trie,
                                   op12_quality_cascade, op13_hard_negatives)}

ORACLES = {"op1_preference_format": preferences.SQL, "op6_top_k": topk.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_quality_cascade": quality.SQL,
           "op13_hard_negatives": negatives.SQL}
