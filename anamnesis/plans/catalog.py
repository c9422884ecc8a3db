"""All registered queries outside the training-data subpackage."""

from . import context, retrieval, store, streams, study

QUERIES: dict = {}
ORACLES: dict = {}
for part in (retrieval, store, context, study, streams):
    QUERIES |= part.R.queries
    ORACLES |= part.R.oracles
