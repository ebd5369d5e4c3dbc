"""The likest of the sources that a case may be compared with, from groups of equal sources in equal windows of pages.

Cases of equal tokens, length and place see the same sources in the same order, so that order is worked out once for them. Of the sources in it,
those whose characters in common with the case bound their likeness below the best are not compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

#: Orders and lists of ids that a worker remembers; past it, it starts anew.
REMEMBERED = 50_000


class Likeliest:
    """Groups (source_normal, first_page, last_page, ids), tokens (source_normal, tokens) of sources, and the first ``limit`` sources of all."""

    def __init__(self, held: pa.Table, tokens: pa.Table, few: pa.Table, limit: int, near: int):
        self.limit, self.near = limit, near
        said, firsts, lasts = (held.column(c).to_pylist() for c in ("source_normal", "first_page", "last_page"))
        self.normals = sorted(set(said), key=lambda x: (x is not None, x or ""))
        place = {x: i for i, x in enumerate(self.normals)}
        windows = {w: i for i, w in enumerate(dict.fromkeys(zip(firsts, lasts, strict=True)))}
        of = np.array([place[x] for x in said], np.int64)
        order = np.argsort(of, kind="stable")
        self.of = of[order]
        self.window = np.array([windows[w] for w in zip(firsts, lasts, strict=True)], np.int64)[order]
        lists = held.column("ids").combine_chunks()
        lists = lists.take(pa.array(order)) if len(order) else lists
        self.ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.ids = lists.flatten().to_numpy(zero_copy_only=False)
        self.groups = np.searchsorted(self.of, np.arange(len(self.normals) + 1))  # where a normal's groups begin
        self.windows = list(windows)
        self.sizes = np.array([-1 if x is None else len(x) for x in self.normals], np.int64)
        posts: dict[str, list[int]] = {}
        for x, own in zip(tokens.column(0).to_pylist(), tokens.column(1).to_pylist(), strict=True):
            for token in own:
                posts.setdefault(token, []).append(place[x])
        self.posts = {t: np.array(v, np.int64) for t, v in posts.items()}
        self.few = [(r["source_id"], place[r["source_normal"]], (r["first_page"], r["last_page"])) for r in few.to_pylist()]
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(x or "" for x in self.normals))))}
        most = max((n for x in self.normals for n in Counter(x or "").values()), default=0)
        self.counts = np.zeros((len(self.normals), len(self.letters)), np.uint8 if most < 256 else np.int32)
        for i, x in enumerate(self.normals):
            for c, n in Counter(x or "").items():
                self.counts[i, self.letters[c]] = n
        self.lengths = np.maximum(self.sizes, 0)
        self.spots: dict[tuple[int, bool], tuple] = {}
        self.lists: dict[tuple[int, int, int, bool], np.ndarray] = {}
        self.orders: dict[tuple, tuple] = {}

    def level(self, window: tuple[int | None, int | None], spot: int) -> int:
        first, last = window
        if first is None:
            return 3
        if spot >= first and (last is None or spot <= last):
            return 0
        return 1 if spot >= first - self.near and (last is None or spot <= last + self.near) else 2

    def _at(self, spot: int, here: bool) -> tuple:
        """(normal, tier, sources up to the limit, first id, its level) of sources by normal and tier, and windows' tiers; ``here``: of the spot's pages only."""
        if (spot, here) not in self.spots:
            levels = np.array([self.level(w, spot) for w in self.windows], np.int64)
            seen = np.array([not here or f is not None and f - self.near <= spot <= (f if z is None else z) + self.near for f, z in self.windows], bool)
            tiers = np.where(seen, np.minimum(levels, 2), 3)
            group = np.flatnonzero(tiers[self.window] < 3)
            normal, tier, level = self.of[group], tiers[self.window[group]], levels[self.window[group]]
            first, n = self.ids[self.ends[group]], self.ends[group + 1] - self.ends[group]
            order = np.lexsort((level, first, tier, normal))
            normal, tier, level, first, n = (x[order] for x in (normal, tier, level, first, n))
            begin = np.flatnonzero(np.r_[True, (np.diff(normal) != 0) | (np.diff(tier) != 0)]) if len(normal) else np.zeros(0, np.int64)
            n = np.minimum(np.add.reduceat(n, begin), self.limit) if len(begin) else n
            self.spots[spot, here] = normal[begin], tier[begin], n, first[begin], level[begin], tiers
        return self.spots[spot, here]

    def _ids(self, spot: int, normal: int, tier: int, here: bool) -> np.ndarray:
        key = spot, normal, tier, here
        if key not in self.lists:
            if len(self.lists) >= REMEMBERED:
                self.lists.clear()
            tiers = self._at(spot, here)[5]
            own = [g for g in range(self.groups[normal], self.groups[normal + 1]) if tiers[self.window[g]] == tier]
            self.lists[key] = np.sort(np.concatenate([self.ids[self.ends[g] : self.ends[g + 1]] for g in own]))[: self.limit]
        return self.lists[key]

    def order(self, spot: int, size: int, tokens: tuple[str, ...]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Normals in the order in which a case meets them first, and (place, source, level) of each."""
        here = not tokens
        shared = np.zeros(len(self.normals), np.int64)
        for t in tokens:
            shared[self.posts[t]] += 1
        normal, tier, n, first, level, _ = self._at(spot, here)
        if here and not len(normal):
            ranked = sorted((min(self.level(w, spot), 2), abs(self.lengths[i] - size) if self.sizes[i] >= 0 else -1, source, i, self.level(w, spot)) for source, i, w in self.few)
            found = {}
            for at, (_, _, source, i, own) in enumerate(ranked):
                found.setdefault(i, (at, source, own))
            return np.array(list(found), np.int64), list(found.values())
        kept = np.arange(len(normal)) if here else np.flatnonzero(shared[normal])
        gap = np.where(self.sizes < 0, 0, np.abs(self.lengths - size) + 1)[normal[kept]]
        rank = np.lexsort((gap, -shared[normal[kept]], tier[kept]))
        kept, gap = kept[rank], gap[rank]
        cuts = [0, *(np.flatnonzero((np.diff(tier[kept]) != 0) | (np.diff(shared[normal[kept]]) != 0) | (np.diff(gap) != 0)) + 1).tolist(), len(kept)]
        found, before = {}, 0
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            room = self.limit - before
            if room <= 0:
                break
            # of sources alike in all else, in order of ids, those of the `room` normals that begin first can count
            block = kept[i:j]
            block = block[np.argsort(first[block], kind="stable")]
            if len(block) > 1:
                every = np.sort(np.concatenate([self._ids(spot, normal[k], tier[k], here) for k in block[:room]]))[:room]
                places = np.searchsorted(every, first[block[:room]])
            else:
                places = np.zeros(1, np.int64)
            for k, at in zip(block[:room].tolist(), places.tolist(), strict=True):
                if at < room:
                    found.setdefault(int(normal[k]), (before + at, int(first[k]), int(level[k])))
            before += int(n[block].sum())
        return np.array(list(found), np.int64), list(found.values())

    def best(self, own: str, spot: int, tokens: Sequence[str], likeness: Callable[[str, str | None], float]) -> tuple[int, float, int, int] | None:
        """(source, likeness, place, level) of the likest source, the first on ties."""
        key = spot, len(own), tuple(t for t in tokens if t in self.posts)
        if key not in self.orders:
            if len(self.orders) >= REMEMBERED:
                self.orders.clear()
            self.orders[key] = self.order(*key)
        normals, found = self.orders[key]
        if not found:
            return None
        letters = [(self.letters[c], n) for c, n in Counter(own).items() if c in self.letters]
        both = np.minimum(self.counts[normals[:, None], [c for c, _ in letters]], np.array([n for _, n in letters], np.int64)).sum(axis=1, dtype=np.int64) if letters else np.zeros(len(normals), np.int64)
        size = self.lengths[normals] + len(own)
        bound = np.where(size > 0, 2.0 * both / np.maximum(size, 1), 1.0)
        like, best = 0.0, None
        for i in np.argsort(-bound, kind="stable").tolist():
            if bound[i] + 0.00051 < like:  # a likeness is rounded to three places
                break
            at, source, level = found[i]
            x = likeness(own, self.normals[normals[i]])
            if x > like or best and x == like and at < best[2]:
                like, best = x, (source, x, at, level)
        return best
