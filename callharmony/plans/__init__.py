from callharmony.plans.jobs import (
    IncompleteFetch,
    RunReport,
    audit,
    complete_pages,
    fetch_pages,
    harmonize,
    judge,
    read_rejected,
    run,
    run_all,
    run_to_warehouse,
)

__all__ = ["IncompleteFetch", "RunReport", "audit", "complete_pages", "fetch_pages", "harmonize", "judge", "read_rejected", "run", "run_all", "run_to_warehouse"]
