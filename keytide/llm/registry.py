"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import fingerprint, langid, mixing, packing, pii, simhash, topk, toxicity, urlfilter, warc

_MODULES = (pii, toxicity, fingerprint, simhash, urlfilter, warc, langid, mixing, packing, topk)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
