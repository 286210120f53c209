"""A bounded memory for what a Python worker has already worked out; it outlives the tasks of a reused worker."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

_KEPT: dict[Hashable, Memo] = {}


class Memo:
    """Two generations of at most `most` entries each: when the young one is full it becomes the old one.

    Keys of over `longest` characters or bytes are worked out each time, so that all that is remembered is bounded by
    2 * most * longest. Only speed depends on it: what was forgotten is worked out again.
    """

    def __init__(self, work: Callable[[list], Iterable], most: int = 200_000, longest: int = 64):
        self.work, self.most, self.longest = work, most, longest
        self.young: dict = {}
        self.old: dict = {}
        self.passing: list = []  # keys of the last call that aren't to be remembered

    def known(self, keys: Iterable) -> dict:
        """A dict with the values of all `keys` at least; it holds until the next call."""
        for k in self.passing:
            self.young.pop(k, None)
        self.passing = []
        young, old = self.young, self.old
        missing = {k for k in keys if k not in young}  # set.difference would read all of `young`
        if missing:
            self.passing = [k for k in missing if len(k) > self.longest]
            if len(young) + len(missing) > self.most:
                self.old, self.young = old, young = young, {k: young[k] for k in keys if k in young}
            again = missing & old.keys()
            young.update((k, old[k]) for k in again)
            new = list(missing - again)
            young.update(zip(new, self.work(new), strict=True))
        return young


def kept(name: Hashable, make: Callable[[], Memo]) -> Memo:
    """This worker's memory under `name`; that of any other work is dropped, so that a worker never holds two."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drop what the worker remembers, for work that remembers nothing itself."""
    _KEPT.clear()
