"""The operators' queries and, where SQL can express them, their oracles."""

from pagewright.llm import language, licenses, media, neardup, packing, pieces, quality, topk, toxicity, warc

QUERIES = {f.__name__: f for f in (licenses.op1_license_scan, topk.op2_exact_top_k, pieces.op3_sentencepiece, toxicity.op4_toxicity, quality.op5_quality, media.op6_media_columns, language.op7_language, packing.op8_best_fit_packing, warc.op9_warc, neardup.op10_ngram_jaccard_join)}
ORACLES = {"op1_license_scan": licenses.ORACLE, "op2_exact_top_k": topk.ORACLE, "op9_warc": warc.ORACLE}
