"""Every query of the library proper with its oracle SQL."""

from __future__ import annotations

from ledgerloom.plans import federation, graphs, landed, networks, prepared, rounds, scoring, streams

QUERIES: dict = scoring.QUERIES | networks.QUERIES | federation.QUERIES | graphs.QUERIES | rounds.QUERIES | streams.QUERIES | landed.QUERIES | prepared.QUERIES
ORACLE: dict = scoring.ORACLE | networks.ORACLE | federation.ORACLE | graphs.ORACLE | rounds.ORACLE | streams.ORACLE | landed.ORACLE | prepared.ORACLE
