"""Query texts: the dialect's few rewrites, and the catalogue of named queries."""
