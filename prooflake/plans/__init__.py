"""Named queries and the SQL that says the same."""

from __future__ import annotations

from . import audits, certificates, changes, corpora, recurrences, sequences, structure, verdicts

QUERIES, ORACLE = {}, {}
for _m in (sequences, corpora, audits, certificates, verdicts, recurrences, changes, structure):
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
