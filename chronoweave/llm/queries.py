"""The registered queries of this subpackage."""

from chronoweave.llm import byte_bpe, decontaminate, hilbert_shards, html_text, jaccard_join, language, licenses, neighbours, periodic_runs, pseudonyms, secrets, toxicity, whitening  # noqa: F401
from chronoweave.llm.common import QUERIES

__all__ = ["QUERIES"]
