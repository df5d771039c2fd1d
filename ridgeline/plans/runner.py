"""Runs of models: each is built once, after those it reads, and a few at a time; what it reads is stored.

Staging and intermediate models are views; every other model is a table of the store. A selection names models, `+name` with all that they need
and `name+` with all that need them. A model that fails leaves its table as it was, and those below it are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import Column

from ridgeline.operators.store import ChecksFailed, Store
from ridgeline.plans import marts
from ridgeline.plans.marts import is_view


@dataclass
class Run:
    """What became of each selected model: built, failed or skipped; why the failed ones did."""

    status: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


_NEEDS: dict[str, set[str]] = {}


def graph(spark, sources) -> dict[str, set[str]]:
    """The models that each model reads, found by resolving all of them once; nothing runs."""
    if _NEEDS:
        return _NEEDS
    session = marts.Session(spark, sources)
    for name in marts.MODELS:
        session.ref(name)
    needs: dict[str, set[str]] = {name: set() for name in marts.MODELS}
    for parent, child in session.lineage:
        needs[child].add(parent)
    _NEEDS.update(needs)
    return needs


def closure(needs: dict[str, set[str]], start: str) -> set[str]:
    seen, todo = set(), [start]
    while todo:
        for name in needs[todo.pop()] - seen:
            seen.add(name)
            todo.append(name)
    return seen


def selected(needs: dict[str, set[str]], select: Sequence[str] | None) -> set[str]:
    if select is None:
        return set(needs)
    children = {name: {c for c, parents in needs.items() if name in parents} for name in needs}
    out = set()
    for text in select:
        name = text.strip("+")
        if name not in needs:
            raise ValueError(f"no model {name}")
        out |= {name} | (closure(needs, name) if text.startswith("+") else set()) | (closure(children, name) if text.endswith("+") else set())
    return out


def run_models(spark, sources, store: Store, select: Sequence[str] | None = None, at_once: int = 4, now: Column | None = None, today=None, only_absent: bool = False, full_refresh: bool = False, whole: bool = False) -> Run:
    """Builds the selected models in the order of their needs, at most `at_once` side by side.

    A model with an increment strategy is built by it (`full_refresh`: anew; `whole`: as a table without partitions); others replace
    their tables. The checks of a model
    (`marts.CHECKS`) are counted while it is written, and one that fails keeps its table as it was. With only_absent a model that has
    a table is left alone, as is everything that only it needs.
    """
    needs, run = graph(spark, sources), Run()
    chosen = selected(needs, select)
    if only_absent:
        wanted, todo = set(), [x.strip("+") for x in select or needs]
        while todo:
            name = todo.pop()
            if name not in wanted and name in chosen and (is_view(name) or not store.exists(name)):
                wanted.add(name)
                todo += needs[name]
        chosen = wanted
    marts.keep_snapshots(sources, store, {x for name in chosen for x in {name} | closure(needs, name)})
    tables = {name for name in chosen if not is_view(name)}
    run.status = {name: "built" for name in chosen - tables}
    before = {name: closure(needs, name) & tables for name in tables}

    def build(name: str) -> None:
        context = spark.sparkContext
        context.setJobGroup(f"model {name}", name)
        marts.materialise(spark, sources, store, name, today, now, full_refresh, whole)

    # what isn't built in this run is read as it is stored
    run.status |= {x: "built" for xs in before.values() for x in xs if x not in tables}
    with ThreadPoolExecutor(at_once) as threads:
        running = {}
        while tables or running:
            for name in sorted(tables):
                bad = [x for x in before[name] if run.status.get(x) in ("failed", "skipped")]
                if bad:
                    run.status[name] = "skipped"
                elif all(run.status.get(x) == "built" for x in before[name]):
                    running[threads.submit(build, name)] = name
                else:
                    continue
                tables.discard(name)
            if not running:
                continue
            for done in wait(running, return_when=FIRST_COMPLETED).done:
                name = running.pop(done)
                run.status[name] = "failed" if done.exception() else "built"
                if done.exception():
                    run.errors[name] = f"{type(done.exception()).__name__}: {done.exception()}"[:500]
                    if isinstance(done.exception(), ChecksFailed):
                        run.errors[name] = str(done.exception().failures)
    return run
