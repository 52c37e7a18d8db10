"""Operators for preparing training data: dedup, counting, packing, scanning, archives, language, scoring."""
