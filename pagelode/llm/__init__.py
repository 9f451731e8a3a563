"""Operations that large training corpora need: near-duplicate search, language identification, tokenizing and so on.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so it can be removed as a whole.
"""
