"""Training-data operators: archives, deduplication, decontamination, privacy, mixing, extraction and filtering.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
