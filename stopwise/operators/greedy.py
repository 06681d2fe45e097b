"""Greedy nearest-neighbour walk over the stops of one route, as run inside a task.

A helper for Arrow batches: Spark partitions, groups and sorts the stops (see ``routes``); this only
walks arrays. The nearest neighbours of every stop are found for all stops at once, and a step goes to
the first of them that is not yet visited. Only where all are visited it searches: stops are kept in
leaves of neighbouring points, and it looks at the leaves nearest first and stops once no other leaf
can hold anything as near, so it does not measure the distance to every remaining stop.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from stopwise.constants import EARTH_RADIUS_KM

_LEAF = 96
# Routes up to this long are cheaper to walk side by side than one by one.
SHORT = 256
# Neighbours known of a stop, looked for in this many leaves of so many stops; leaves handled at once, and
# the leaves around all these that are looked at.
_NEAR, _AROUND, _SMALL_LEAF, _AT_ONCE, _WITHIN = 12, 9, 12, 64, 256
_DIAMETER_KM = 2 * EARTH_RADIUS_KM
# Safety margin for comparing a leaf bound, computed from unit vectors, with a measured distance.
_RELATIVE, _ABSOLUTE = 1 + 1e-9, 1e-14


def _distance_km(lat: np.ndarray, lon: np.ndarray, from_lat: float, from_lon: float) -> np.ndarray:
    half_lat, half_lon = np.sin((lat - from_lat) / 2), np.sin((lon - from_lon) / 2)
    chord = half_lat * half_lat + np.cos(from_lat) * np.cos(lat) * (half_lon * half_lon)
    return _DIAMETER_KM * np.arcsin(np.minimum(1.0, np.sqrt(chord)))


def _unit_vectors(lat, lon) -> np.ndarray:
    return np.array([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


class _Leaves:
    """Stops not yet visited, in leaves of neighbouring points with a box around each."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, stops: np.ndarray, visited: np.ndarray):
        self.lat, self.lon, self.visited = lat, lon, visited
        points = _unit_vectors(lat[stops], lon[stops])
        size = max(_LEAF, int(np.sqrt(len(stops))))
        parts, whole = [np.arange(len(stops))], []
        while parts:
            part = parts.pop()
            if len(part) <= size:
                whole.append(part)
                continue
            axis = np.argmax(np.ptp(points[:, part], axis=1))
            half = len(part) // 2
            split = part[np.argpartition(points[axis, part], half)]
            parts += [split[:half], split[half:]]
        # In input order within a leaf, so that the first minimum is the first in input.
        self.stops = [np.sort(stops[part]) for part in whole]
        self.low = np.stack([points[:, part].min(axis=1) for part in whole], axis=1)
        self.high = np.stack([points[:, part].max(axis=1) for part in whole], axis=1)

    def _bounds(self, here: tuple[float, float]) -> np.ndarray:
        """No stop of a leaf is nearer than this, as the squared length of a chord of the unit sphere."""
        at = _unit_vectors(*here)[:, None]
        gap = np.maximum(self.low - at, at - self.high)
        np.maximum(gap, 0.0, out=gap)
        return np.einsum("ij,ij->j", gap, gap)

    def nearest(self, here: tuple[float, float]) -> int:
        """The nearest stop; the first in input among equals."""
        bounds = self._bounds(here) if len(self.stops) > 1 else np.zeros(1)
        found, reach = (np.inf, -1), np.inf
        leaf = int(bounds.argmin())
        while bounds[leaf] < np.inf and bounds[leaf] <= reach:
            stops = self.stops[leaf] = self.stops[leaf][self.visited[self.stops[leaf]] == 0]
            if len(stops):
                distance = _distance_km(self.lat[stops], self.lon[stops], *here)
                first = int(distance.argmin())
                if found[1] < 0 or (distance[first], stops[first]) < found:
                    found = (float(distance[first]), int(stops[first]))
                    reach = (2 * math.sin(found[0] / _DIAMETER_KM) * _RELATIVE + _ABSOLUTE) ** 2
            else:
                self.low[:, leaf] = np.inf
            bounds[leaf] = np.inf
            leaf = int(bounds.argmin())
        return found[1]


def _strips(points: np.ndarray) -> np.ndarray:
    """Positions of ``points`` in leaves: strips along one axis, cut along another; -1 fills the leaves up."""
    n = points.shape[1]
    across, along = np.argsort(np.ptp(points, axis=1))[:0:-1]
    strips = max(1, round(math.sqrt(n / _SMALL_LEAF)))
    strip = np.empty(n, np.int64)
    strip[np.argsort(points[across])] = np.arange(n) * strips // n
    order = np.lexsort((points[along], strip))
    sizes = np.bincount(strip, minlength=strips)
    inside = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    per_strip = -(-int(sizes.max()) // _SMALL_LEAF)
    members = np.full((strips * per_strip, _SMALL_LEAF), -1)
    members[strip[order] * per_strip + inside // _SMALL_LEAF, inside % _SMALL_LEAF] = order
    return members[members[:, 0] >= 0]


def _gaps(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Squared chords that no point of a box and no point of another box are nearer than."""
    gap = np.maximum(other_low[:, None, :] - high[:, :, None], low[:, :, None] - other_high[:, None, :])
    np.maximum(gap, 0.0, out=gap)
    return np.einsum("kij,kij->ij", gap, gap)


def _neighbours(lat: np.ndarray, lon: np.ndarray, stops: np.ndarray) -> Iterator[tuple[list[int], list[list[int]]]]:
    """The stops in parts, and for each the nearest others among ``stops``, the first in input among equals.

    A list has at most ``_NEAR`` of them and ends with -1. It holds only those that are surely nearer
    than every stop it leaves out, so the first one not yet visited is the nearest of all not visited.
    """
    points = _unit_vectors(lat[stops], lon[stops])
    members = _strips(points)
    leaf_points = points[:, members]
    low = np.where(members < 0, np.inf, leaf_points).min(axis=2)
    high = np.where(members < 0, -np.inf, leaf_points).max(axis=2)
    for begin in range(0, len(members), _AT_ONCE):
        own = members[begin : begin + _AT_ONCE]
        own_low, own_high = low[:, begin : begin + _AT_ONCE], high[:, begin : begin + _AT_ONCE]
        within, outside = np.arange(len(members)), np.full(len(own), np.inf)
        if len(members) > _WITHIN:
            # The leaves nearest to all of these together; no other is nearer to one of them than the next.
            gap = _gaps(own_low.min(axis=1)[:, None], own_high.max(axis=1)[:, None], low, high)[0]
            within = np.argpartition(gap, _WITHIN)
            outside = np.full(len(own), gap[within[_WITHIN]])
            within = within[:_WITHIN]
        around = np.broadcast_to(within, (len(own), len(within)))
        if len(within) > _AROUND:
            gap = _gaps(own_low, own_high, low[:, within], high[:, within])
            chosen = np.argpartition(gap, _AROUND, axis=1)
            beyond = np.take_along_axis(gap, chosen[:, _AROUND : _AROUND + 1], axis=1)[:, 0]
            around, outside = within[chosen[:, :_AROUND]], np.minimum(outside, beyond)
        others = members[around].reshape(len(own), -1)
        # Squared chords; rounding is far below the margin that neighbours must keep.
        chord = 2.0 - 2.0 * np.matmul(points[:, own].transpose(1, 2, 0), points[:, others].transpose(1, 0, 2))
        chord[(others[:, None, :] < 0) | (others[:, None, :] == own[:, :, None])] = np.inf
        others = np.broadcast_to(others[:, None, :], chord.shape)
        limit = np.broadcast_to(outside[:, None], own.shape)
        if chord.shape[2] > _NEAR:
            chosen = np.argpartition(chord, _NEAR, axis=2)
            beyond = np.take_along_axis(chord, chosen[:, :, _NEAR : _NEAR + 1], axis=2)[:, :, 0]
            limit = np.minimum(limit, beyond)
            others = np.take_along_axis(others, chosen[:, :, :_NEAR], axis=2)
        real = own >= 0
        one, near, limit = stops[own[real]], others[real], limit[real]
        missing = (near < 0) | (near == own[real][:, None])
        near = np.sort(np.where(missing, len(lat), stops[near]), axis=1)
        known = np.minimum(near, len(lat) - 1)
        km = _distance_km(lat[known], lon[known], lat[one][:, None], lon[one][:, None])
        km[near == len(lat)] = np.inf
        order = np.argsort(km, axis=1, kind="stable")
        near, km = np.take_along_axis(near, order, axis=1), np.take_along_axis(km, order, axis=1)
        reach = (2 * np.sin(np.minimum(km / _DIAMETER_KM, np.pi / 2))) ** 2
        sure = np.isfinite(km) & (reach * _RELATIVE + _ABSOLUTE < limit[:, None])
        near = np.where(np.logical_and.accumulate(sure, axis=1), near, -1)
        yield one.tolist(), np.pad(near, ((0, 0), (0, 1)), constant_values=-1).tolist()


def greedy_walk(
    lat: np.ndarray, lon: np.ndarray, start: tuple[float, float], reach_km: float = np.inf
) -> tuple[np.ndarray, tuple[float, float]]:
    """Order in which stops are visited, always going to the nearest; equal distances, first in input.

    ``lat``, ``lon`` and ``start`` are in radians. With ``reach_km`` the arrays hold only the stops
    within that distance of the start, and the walk ends where a stop beyond it might be nearer.
    Returns the visited positions and the last location.
    """
    order, here = [], start
    left, flags = np.arange(len(lat)), bytearray(len(lat))
    visited = np.frombuffer(flags, np.uint8)
    near: list[list[int]] = [[-1]] * len(lat)
    nearest_known = [-1]
    bounded = np.isfinite(reach_km)
    while len(left):
        # Leaves and lists thin out as stops are visited, so they are built anew when two thirds of them are gone.
        leaves = _Leaves(lat, lon, left, visited)
        for stops, lists in _neighbours(lat, lon, left):
            for stop, known in zip(stops, lists):
                near[stop] = known
        for _ in range(len(left) if len(left) <= _LEAF else len(left) * 2 // 3):
            for stop in nearest_known:
                if stop < 0 or not flags[stop]:
                    break
            if stop < 0:
                stop = leaves.nearest(here)
            if order and bounded:
                km = _distance_km(lat[stop], lon[stop], *here)
                from_start = _distance_km(np.asarray(here[0]), np.asarray(here[1]), *start)
                if km * _RELATIVE >= reach_km - from_start:
                    return np.asarray(order, dtype=np.int64), here
            order.append(stop)
            here = (lat[stop], lon[stop])
            flags[stop] = 1
            nearest_known = near[stop]
        left = np.flatnonzero(visited == 0)
    return np.asarray(order, dtype=np.int64), here


def walk_side_by_side(
    lat: np.ndarray, lon: np.ndarray, block: np.ndarray, route: np.ndarray, start: tuple[float, float]
) -> np.ndarray:
    """Visit numbers of many short routes, one step of all of them at a time.

    The stops come sorted by ``route`` (0, 1, ...), block and tie-break; coordinates are in radians.
    """
    visit = np.zeros(len(lat), dtype=np.int32)
    here_lat, here_lon = (np.full(int(route[-1]) + 1, at) for at in start)
    left, step = np.arange(len(lat)), 0
    while len(left):
        step += 1
        of = route[left]
        first = np.concatenate([[True], of[1:] != of[:-1]])
        begins, group = np.flatnonzero(first), np.cumsum(first) - 1
        distance = _distance_km(lat[left], lon[left], here_lat[of], here_lon[of])
        distance[block[left] != block[left[begins]][group]] = np.inf
        nearest = np.flatnonzero(distance == np.minimum.reduceat(distance, begins)[group])
        chosen = nearest[np.concatenate([[True], group[nearest][1:] != group[nearest][:-1]])]
        taken = left[chosen]
        visit[taken] = step
        here_lat[of[begins]], here_lon[of[begins]] = lat[taken], lon[taken]
        left = np.delete(left, chosen)
    return visit


def walk_blocks(lat: np.ndarray, lon: np.ndarray, block: np.ndarray, start: tuple[float, float]) -> np.ndarray:
    """Visit numbers of one route: block after block, each walk starting where the last one ended.

    The stops come sorted by block and tie-break; coordinates are in radians. Stops at the same place are
    visited one after the other, first in input first, so the walk goes over distinct places.
    """
    visit = np.zeros(len(lat), dtype=np.int32)
    ends = [*(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
    begin, here = 0, start
    for end in ends:
        at = lat[begin:end] + 1j * lon[begin:end]
        first, place = np.unique(at, return_index=True, return_inverse=True)[1:]
        in_input = np.argsort(first)
        order, here = greedy_walk(lat[begin + first[in_input]], lon[begin + first[in_input]], here)
        turn = np.empty(len(first), dtype=np.int64)
        turn[in_input[order]] = np.arange(len(first))
        visit[begin + np.argsort(turn[place], kind="stable")] = np.arange(begin + 1, end + 1)
        begin = end
    return visit
