"""Training-data operators: packing, extraction, classifiers, joins, tokenizers, rules, fingerprints, dedup.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
