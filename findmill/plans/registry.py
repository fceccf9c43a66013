"""All registered queries with their checks."""

from __future__ import annotations

from findmill.plans import q_events, q_findings, q_ingest, q_jobs, q_lines, q_rules, q_scans, q_streams

_PARTS = (q_findings, q_ingest, q_lines, q_scans, q_events, q_rules, q_jobs, q_streams)


def registered() -> dict:
    out: dict = {}
    for part in _PARTS:
        clash = out.keys() & part.Q.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(part.Q)
    return out
