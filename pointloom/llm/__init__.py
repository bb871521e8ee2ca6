"""Training-data operators: quality, language, HTML, packing, search, licences, URLs, mixing, similarity joins, PII.

Nothing outside this folder (but ``corpus_pipeline.py``) imports it.
"""
