"""Named user jobs, used through ``df.transform``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gridtide.operators.detect import lines_above_limit

Job = Callable[[DataFrame], DataFrame]
_jobs: dict[str, Job] = {}


def register_job(name: str, job: Job) -> Job:
    if not name:
        raise ValueError("a job needs a name")
    _jobs[name] = job
    return job


def job(name: str) -> Job:
    return _jobs[name]


def job_names() -> list[str]:
    return sorted(_jobs)


# What a new user job starts from.
register_job("threshold", lines_above_limit)
