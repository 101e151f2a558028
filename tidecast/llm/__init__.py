"""Training-data operators: URL filters, language-model scores, license
scans, quality rules, deduplication, secrets, similarity joins, piece
encoding, mixtures and nearest neighbours.

Nothing else in the library imports this subpackage.
"""
