"""All queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from tessera.plans import base, calibration, control, encoding, ensembles, evaluation, feature_programs, loading, modelling, relational, reports, runlog, runs, splits, text

MODULES = (calibration, control, encoding, ensembles, evaluation, feature_programs, loading, modelling, relational, reports, runlog, runs, splits, text)
QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
flagship = modelling.flagship
score_card = evaluation.score_card
