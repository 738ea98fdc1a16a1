"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from lectern.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from lectern.llm.decontaminate import OP10_SQL, op10_decontaminate
from lectern.llm.divergence import OP11_SQL, op11_source_divergence
from lectern.llm.fingerprints import op1_fingerprints
from lectern.llm.html_text import op6_html_text
from lectern.llm.jaccard_join import OP8_SQL, op8_jaccard_join
from lectern.llm.language import op7_language
from lectern.llm.masked_lm import op5_masked_lm
from lectern.llm.quality import op4_quality
from lectern.llm.sentencepiece_codec import op9_sentencepiece
from lectern.llm.substrings import OP2_SQL, op2_substring_dedup
from lectern.llm.toxicity import op12_toxicity
from lectern.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_substring_dedup, op3_warc, op4_quality, op5_masked_lm, op6_html_text, op7_language, op8_jaccard_join, op9_sentencepiece, op10_decontaminate, op11_source_divergence, op12_toxicity, op13_conversation_repair)
}
SQL = {"op2_substring_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op8_jaccard_join": OP8_SQL, "op10_decontaminate": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_conversation_repair": OP13_SQL}
