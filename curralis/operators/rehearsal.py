"""Rehearsing the operator's flow: pending runs walk through the states of one that writes cleanly, without model or graph."""

from __future__ import annotations

from collections.abc import Callable

from curralis.operators import runs
from curralis.operators.store import TABLES, OperationalStore

MODEL, PROMPT = "rehearsal (simulated)", "rehearsal"


def seed(real: OperationalStore, rehearsal: OperationalStore) -> bool:
    """Copies the real store's tables into a rehearsal store that holds nothing yet: its history and its gate. False if it holds something."""
    if any(not rehearsal.table(name).isEmpty() for name in TABLES):
        return False
    for name in TABLES:
        real.table(name).coalesce(1).write.mode("append").parquet(f"{rehearsal.path}/{name}")
    return True


def rehearse(store: OperationalStore, pause: Callable[[], None] = lambda: None) -> list[int]:
    """The runs, in the order taken, that went from pending to completed while the gate was open; every pause falls while a run is running."""
    done = []
    while runs.gate(store.reports()).first()[0] == "open" and (run_id := store.take()) is not None:
        pause()
        store.record_extraction(run_id, {}, model=MODEL, prompt_version=PROMPT, input_tokens=0, output_tokens=0)
        pause()
        store.mark_written(run_id)
        store.finish(run_id, clean=True)
        done.append(run_id)
    return done
