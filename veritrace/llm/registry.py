"""The queries of this subpackage and their DuckDB SQL."""

from veritrace.llm import bpe, decontaminate, language, licenses, periodic, pii, quality, sharding, simhash, suffix_array, urls, vectors, whitening

_MODULES = (sharding, quality, licenses, bpe, decontaminate, simhash, language, urls, suffix_array, pii, whitening, periodic, vectors)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
