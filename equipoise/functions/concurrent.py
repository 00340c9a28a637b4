"""Independent Spark jobs side by side."""

from __future__ import annotations


def run_concurrently(tasks: list, max_workers: int = 4) -> list:
    """Run independent fits as concurrent Spark jobs from driver threads (a
    forest fit leaves executors idle between tree levels; other fits fill the
    gaps). Results keep the order of ``tasks``."""
    from concurrent.futures import ThreadPoolExecutor
    if len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=min(max_workers, len(tasks))) as pool:
        return list(pool.map(lambda t: t(), tasks))
