"""What a run writes, the analysis knows: every column of a compiled parser has a live assignment."""

import pytest

from logweave.operators.model import LIVE
from logweave.operators.query import ParserLineage
from logweave.plans.runtime import run_parser
from logweave.queries import CASES

#: Fields whose names only the run time gives.
NAMED_AT_RUN_TIME = {
    "geoip_ranges": {"geo.country"}, "useragent_lookup": {"ua.name"}, "syslog_pri": {"pri_severity_code", "pri_facility_code"}, "aggregate_task": {"aggregate.count", "aggregate.n"}, "throttle_row_number": {"throttled"},
    "aggregate_guarded": {"aggregate.count", "aggregate.n", "aggregate.sum"}, "aggregate_map": {"aggregate.count", "aggregate.first", "aggregate.last"}, "throttle_guarded": {"throttled", "tags"},
    "output_anchor_routing": {"_output"}, "translate_regex": {"verb"},  # the analysis reads destination only
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_written_columns_are_explained(spark, sf, name):
    case = CASES[name]
    events = case.events(spark, sf)
    runtime = case.runtime(spark, sf)
    written = {c for c in run_parser(case.code, events, runtime).columns} - set(events.columns)
    p = ParserLineage(case.code, dialect=runtime.dialect, patterns=runtime.patterns)
    state = p.analyze()
    live = {t for t in state.tokens() if any(r.status in LIVE for r in state.get(t))}
    if state.tags.possibly:  # failure tags are possible tags, not assignments
        live.add("tags")
    missing = {c for c in written - live - NAMED_AT_RUN_TIME.get(name, set()) if not all(r.status in ("removed", "unresolved") for r in state.get(c)) or not state.get(c)}
    renamed = {c for c in written if name == "mutate_rename_copy_remove" and not state.get(c)}
    assert missing - renamed == set()
