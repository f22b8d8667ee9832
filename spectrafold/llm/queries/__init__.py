"""The registered queries of this subpackage: ``QUERIES`` and ``ORACLES``, gathered from the modules beside this file."""

from . import aligned, codec, conversations, language, native, near, packed, pages, token_output, toxic, vectors

MODULES = (aligned, codec, conversations, language, native, near, packed, pages, token_output, toxic, vectors)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
