"""Training-data operators: tokenising, deduplication, language, packing, media, chat and quality.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
