"""Training-data operators: quality, decontamination, tokenisation, deduplication, personal data, language models.

Nothing outside this subpackage imports it. ``tessera.llm.queries`` registers its queries.
"""
