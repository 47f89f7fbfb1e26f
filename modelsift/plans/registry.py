"""Which candidates exist for which task."""

from __future__ import annotations

from ..errors import RegistryError

TASKS = ("classification", "regression")
_CANDIDATES: dict[str, list[type]] = {t: [] for t in TASKS}


def register_model(task: str):
    """Class decorator; ``task`` is classification, regression or both.  Registering twice has no effect."""
    if task not in (*TASKS, "both"):
        raise RegistryError("unknown task", task=task)

    def keep(cls: type) -> type:
        for t in TASKS if task == "both" else (task,):
            if cls not in _CANDIDATES[t]:
                _CANDIDATES[t].append(cls)
        return cls

    return keep


def get_registered_models(task: str) -> list[type]:
    if task not in TASKS:
        raise RegistryError("unknown task", task=task)
    return list(_CANDIDATES[task])


def clear_registry() -> None:
    for v in _CANDIDATES.values():
        v.clear()
