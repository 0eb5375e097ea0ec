"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import align, bpe, centroids, decontaminate, html_extract, licenses, lm, media, minhash, pii, quality, token_counts, warc

MODULES = (warc, html_extract, minhash, token_counts, quality, bpe, lm, media, pii, decontaminate, align, licenses, centroids)


def queries() -> dict:
    out = {name: f for m in MODULES for name, f in m.QUERIES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out = {name: s for m in MODULES for name, s in m.SQL.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
