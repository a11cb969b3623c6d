"""The operators' queries, one for each, over whole tables."""

from orrery.llm.chat import op4_chat_formatting
from orrery.llm.decontaminate import op7_benchmark_decontamination
from orrery.llm.fingerprint import EDITS_SQL, fingerprint_edits, op6_document_fingerprints
from orrery.llm.html_extract import op3_html_extraction
from orrery.llm.line_dedup import op8_line_dedup
from orrery.llm.ngram_join import op10_ngram_jaccard_join
from orrery.llm.packing import op2_best_fit_packing
from orrery.llm.pii import COUNTS_SQL, op9_pii, pii_counts
from orrery.llm.toxicity import op1_toxicity
from orrery.llm.url_filter import RULES_SQL, op5_url_filters, url_rules

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_best_fit_packing, op3_html_extraction, op4_chat_formatting, op5_url_filters, op6_document_fingerprints, op7_benchmark_decontamination, op8_line_dedup, op9_pii, op10_ngram_jaccard_join)}
#: What SQL can say of op5, op6 and op9, as queries of their own.
QUERIES |= {f.__name__: f for f in (url_rules, fingerprint_edits, pii_counts)}
ORACLE_SQL: dict[str, str] = {"url_rules": RULES_SQL, "fingerprint_edits": EDITS_SQL, "pii_counts": COUNTS_SQL}
